"""Sorts, top-k and pages.

Sorts state NULL placement explicitly, PostgreSQL style: NULLs last on ASC,
first on DESC (Spark's defaults are the opposite). Every limit gets a unique
key as last sort column so ties at the cut are resolved the same way in every
engine.
"""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from thali.functions.predicates import ts_literal
from thali.operators.scans import SUB
from thali.sources.io import cut_lineage

#: Pages that end within so many rows are a top-k.
SHALLOW = 100_000


def pg_asc(col: str) -> Column:
    return F.col(col).asc_nulls_last()


def pg_desc(col: str) -> Column:
    return F.col(col).desc_nulls_first()


def leading_int(value, default: int) -> int:
    """``parseInt(x)``: the leading digits count ('12abc' is 12); absent or none give the default."""
    digits = re.match(r"\s*([+-]?[0-9]+)", "" if value is None else str(value))
    return int(digits[1]) if digits else default


def param_int(value, default: int) -> int:
    """``parseInt(x) || d``: as ``leading_int``, and 0 gives the default too."""
    return leading_int(value, default) or default


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """O2: ORDER BY … LIMIT k → TakeOrderedAndProject (per-partition top-k, then merge)."""
    return df.orderBy(*order).limit(int(k))


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """O3: LIMIT/OFFSET page. A page that ends beyond ``SHALLOW`` rows is cut out by range (``deep_page``)."""
    if int(offset) + int(limit) > SHALLOW:
        return deep_page(df, order, limit, offset)
    out = df.orderBy(*order)
    if offset:
        out = out.offset(int(offset))
    return out.limit(int(limit))


def deep_page(df: DataFrame, order: Sequence[Column], limit: int, offset: int, parts: int | None = None) -> DataFrame:
    """O3 at any offset: rows are dealt into ranges of `order` and written to the checkpoint folder, the ranges
    are counted, and only those that hold the page are sorted. The rows before the page are counted, never
    collected or sorted; a top-k would bring offset + limit rows to one task."""
    spread = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    held = cut_lineage(spread.withColumn(SUB, F.spark_partition_id()))
    before, skip, wanted = 0, 0, []
    for sub, n in sorted((r[SUB], r["count"]) for r in held.groupBy(SUB).count().collect()):    # one row per range
        if before + n > offset and before < offset + limit:
            skip = skip if wanted else offset - before
            wanted.append(sub)
        before += n
    page_rows = held.filter(F.col(SUB).isin(wanted)).drop(SUB) if wanted else held.limit(0).drop(SUB)
    return page_rows.orderBy(*order).offset(skip).limit(int(limit))


def keyset_page(df: DataFrame, ts: str, key: str, limit: int, after: tuple | None = None) -> DataFrame:
    """O3 (deep pages): newest first, strictly after the last (ts, key) seen.

    The predicate is on raw columns, so it prunes Parquet row groups and each
    page costs a top-k instead of a sort of everything before it.
    """
    out = df
    if after is not None:
        last_ts, last_key = after
        dtype = df.schema[ts].dataType
        # Zone-less columns get a literal parsed from text: no session time zone involved.
        t = ts_literal(last_ts) if isinstance(dtype, TimestampNTZType) else F.lit(last_ts).cast(dtype)
        out = out.filter((F.col(ts) < t) | ((F.col(ts) == t) & (F.col(key) < F.lit(last_key))))
    return top_k(out, [F.col(ts).desc_nulls_first(), F.col(key).desc()], limit)


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                    offset: int = 0) -> DataFrame:
    """O3 for every group at once (e.g. each customer's latest 20 orders).

    ``row_number() <= k`` lets Catalyst insert a partial WindowGroupLimit
    before the shuffle, so a hot group sends at most k rows per map partition.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(w))
    return ranked.filter((F.col("_rn") > offset) & (F.col("_rn") <= offset + k)).drop("_rn")


def oldest_first(df: DataFrame, ts: str = "created_at", key: str = "order_id") -> DataFrame:
    """The kitchen queue order."""
    return df.orderBy(F.col(ts).asc_nulls_last(), F.col(key).asc())
