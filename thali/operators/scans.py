"""Ordered scans of a key's rows that no single task has to hold.

A window over ``PARTITION BY key ORDER BY ts`` puts a whole key into one task. Here rows are dealt by
range of (key, order), so a hot key is cut into ranges of about equal row counts; a window runs inside
each (key, range), and a table with one row per (key, range) carries last values and sums over to the
key's later ranges. That table has at most as many rows per key as there are ranges.

The dealt rows are written to the reliable checkpoint folder: both halves of the scan see the same
ranges, also when an executor is lost. Rows equal in all order columns stay together, so the order
should end in something unique. Serial numbers (``with_prefix_sums``) are the same scan without a key.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thali.sources.io import cut_lineage

SUB = "_sub"


def dealt(rows: DataFrame, by: Sequence[str], parts: int | None = None) -> DataFrame:
    """`rows` cut into ranges of `by` (default: as many as shuffle partitions), with the range's number."""
    columns = [F.col(c) for c in by]
    spread = rows.repartitionByRange(parts, *columns) if parts else rows.repartitionByRange(*columns)
    return cut_lineage(spread.withColumn(SUB, F.spark_partition_id()))


def prefix_scan(rows: DataFrame, keys: Sequence[str], order: Sequence[str], last: dict[str, str] | None = None,
                total: dict[str, str] | None = None, parts: int | None = None) -> DataFrame:
    """`rows` with, per key and in ascending `order`, the newest non-null value (`last`: new column → column)
    and the sum (`total`) of columns up to and including the row. Keys must not be NULL."""
    last, total = last or {}, total or {}
    held = dealt(rows, [*keys, *order], parts)
    here = Window.partitionBy(*keys, SUB).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = held.withColumns({f"_l_{k}": F.last(c, ignorenulls=True).over(here) for k, c in last.items()}
                             | {f"_t_{k}": F.sum(c).over(here) for k, c in total.items()})
    ends = held.groupBy(*keys, SUB).agg(
        *(F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_e_{k}") for k, c in last.items()),
        *(F.sum(c).alias(f"_e_{k}") for k, c in total.items()))
    before = Window.partitionBy(*keys).orderBy(SUB).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, SUB, *(F.last(f"_e_{k}", ignorenulls=True).over(before).alias(f"_c_{k}") for k in last),
                          *(F.sum(f"_e_{k}").over(before).alias(f"_c_{k}") for k in total))
    zero = F.lit(0)
    return local.join(carried, [*keys, SUB]).select(
        *rows.columns, *(F.coalesce(f"_l_{k}", f"_c_{k}").alias(k) for k in last),
        *((F.coalesce(f"_t_{k}", zero) + F.coalesce(f"_c_{k}", zero)).alias(k) for k in total))


def with_prefix_sums(rows: DataFrame, order: Sequence[str], weights: dict[str, Column],
                     parts: int | None = None) -> DataFrame:
    """`rows` with, for each weight, its sum over all rows before this one in `order`. A weight of 1 numbers
    the rows 0, 1, 2, ... without a gap, however they are partitioned."""
    held = dealt(rows.withColumns({f"_w_{k}": w.cast("long") for k, w in weights.items()}), order, parts)
    up_to = Window.partitionBy(SUB).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = held.withColumns({f"_t_{k}": F.sum(f"_w_{k}").over(up_to) for k in weights})
    # one row per range comes to the driver, as many as there are partitions
    ends = held.groupBy(SUB).agg(*(F.sum(f"_w_{k}").alias(k) for k in weights)).orderBy(SUB).collect()
    before, offsets = dict.fromkeys(weights, 0), []
    for r in ends:
        offsets.append((r[SUB], *before.values()))
        before = {k: n + (r[k] or 0) for k, n in before.items()}
    carried = rows.sparkSession.createDataFrame(offsets, f"{SUB} int, " + ", ".join(f"_c_{k} long" for k in weights))
    return local.join(F.broadcast(carried), SUB).select(
        *rows.columns, *((F.col(f"_t_{k}") - F.col(f"_w_{k}") + F.col(f"_c_{k}")).alias(k) for k in weights))


def next_id(table: DataFrame | None, column: str) -> int:
    """The id that a serial column would give next: one above the greatest."""
    return (table.agg(F.max(column)).first()[0] or 0) + 1 if table is not None else 1


def with_serial(rows: DataFrame, name: str, order: Sequence[str], start: int, parts: int | None = None) -> DataFrame:
    """`rows` with serial ids `start`, `start` + 1, ... in `order`, without a gap."""
    numbered = with_prefix_sums(rows, order, {name: F.lit(1)}, parts)
    return numbered.withColumn(name, F.col(name) + F.lit(start).cast("long"))
