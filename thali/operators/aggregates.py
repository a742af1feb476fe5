"""A1–A15 helpers that need more than one built-in call.

Nested arrays (A12/A13) are built per order with ``collect_list`` — an
order's lines are few by construction (a cart), so each group is bounded —
and sorted with ``array_sort`` on a struct whose leading fields are the sort
key (NULL names last, PostgreSQL's ASC rule).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_if(cond: Column) -> Column:
    """COUNT(CASE WHEN cond THEN 1 END)."""
    return F.count(F.when(cond, F.lit(1)))


def sum_if(cond: Column, value: Column) -> Column:
    """SUM(CASE WHEN cond THEN value ELSE 0 END), 0 on empty input."""
    return F.coalesce(F.sum(F.when(cond, value).otherwise(F.lit(0))), F.lit(0))


def nested_array(lines: DataFrame, key: str, fields: Sequence[str], sort_by: str | None = None,
                 name: str = "items") -> DataFrame:
    """One row per `key` with the array of structs of `fields`.

    Rows whose first field is NULL are left out (``FILTER (WHERE id IS NOT
    NULL)``). With `sort_by`, elements are ordered by that field, NULLs last;
    remaining fields break ties so the array is fully deterministic.
    """
    present = lines.filter(F.col(fields[0]).isNotNull())
    if sort_by is None:
        sort_by = fields[0]
    # Sort key first (NULL names last), each field once; then the fields in their order.
    keyed = F.struct(F.col(sort_by).isNull().alias("_null_key"), F.col(sort_by).alias(sort_by),
                     *[F.col(f) for f in fields if f != sort_by])
    arr = F.sort_array(F.collect_list(keyed))
    strip = F.transform(arr, lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    return present.groupBy(key).agg(strip.alias(name))


def repeat_array(arr: Column, times: Column) -> Column:
    """Concatenate an array with itself `times` times (a join fan-out, without the join)."""
    return F.flatten(F.array_repeat(arr, F.coalesce(times, F.lit(1)).cast("int")))


def canonical_text(arr: Column, fields: Sequence[str]) -> Column:
    """A nested array as one comparable string: ``f1|f2|…`` pieces in its order, joined by ';'."""
    pieces = F.transform(arr, lambda x: F.concat_ws(
        "|", *[F.coalesce(x[f].cast("string"), F.lit("~")) for f in fields]))
    return F.array_join(F.coalesce(pieces, F.array().cast("array<string>")), ";")


#: Sketches of 2^12 registers: a relative standard error of 1.04 / 2^6 = 1.6 %.
SKETCH_LG = 12


def daily_sketches(df: DataFrame, day: Column, value: str, lg: int = SKETCH_LG) -> DataFrame:
    """A3 kept by day: (day, sketch, n): a HyperLogLog sketch of the day's distinct values and its rows. The
    table grows with the days, not the rows, and a new day is appended without reading the old ones."""
    return df.groupBy(day.alias("day")).agg(F.hll_sketch_agg(value, F.lit(lg)).alias("sketch"), F.count(F.lit(1)).alias("n"))


def distinct_over(sketches: DataFrame, *groups: Column) -> DataFrame:
    """A3 over any period: the estimated distinct values of the days' union, per group. Values that occur on
    several days count once, which sums of daily counts cannot give."""
    return sketches.groupBy(*groups).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"),
                                         F.sum("n").alias("n"))
