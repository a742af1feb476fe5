"""Projections, filters and predicates.

All predicates compare the raw column to a literal (never wrap the column), so
Parquet min/max statistics and ``PushedFilters`` still apply.
"""

from __future__ import annotations

import datetime as dt
import operator
from functools import reduce
from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERIODS = ("today", "week", "month")
# Days looked back by each period (no upper bound, so `week`
# spans 8 calendar days and `month` 31).
PERIOD_DAYS = {"week": 7, "month": 30}


def as_date(as_of) -> dt.date:
    if isinstance(as_of, dt.datetime):
        return as_of.date()
    if isinstance(as_of, dt.date):
        return as_of
    return dt.date.fromisoformat(str(as_of)[:10])


def as_timestamp(as_of) -> dt.datetime:
    if isinstance(as_of, dt.datetime):
        return as_of
    if isinstance(as_of, dt.date):
        return dt.datetime(as_of.year, as_of.month, as_of.day)
    return dt.datetime.fromisoformat(str(as_of))


def ts_literal(value) -> Column:
    """A zone-less timestamp literal, parsed from text so no time zone is involved."""
    return F.lit(as_timestamp(value).isoformat(sep=" ")).cast("timestamp_ntz")


_ts = ts_literal


def day_range(ts: str | Column, day) -> Column:
    """``DATE(ts) = day`` as a half-open range on the raw column."""
    c = F.col(ts) if isinstance(ts, str) else ts
    start = as_timestamp(as_date(day))
    return (c >= _ts(start)) & (c < _ts(start + dt.timedelta(days=1)))


def before_day(ts: str | Column, day) -> Column:
    """``DATE(ts) < day`` (P4, 'old')."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return c < _ts(as_timestamp(as_date(day)))


def period_predicate(ts: str | Column, period: str | None, as_of) -> Column | None:
    """The reference's `period` parameter; anything unknown means no filter."""
    c = F.col(ts) if isinstance(ts, str) else ts
    if period == "today":
        return day_range(c, as_of)
    if period in PERIOD_DAYS:
        start = as_timestamp(as_date(as_of)) - dt.timedelta(days=PERIOD_DAYS[period])
        return c >= _ts(start)
    return None


def period_bounds(period: str | None, as_of) -> tuple[dt.datetime | None, dt.datetime | None]:
    """[start, end) of a period; (None, None) when it has no filter."""
    if period == "today":
        start = as_timestamp(as_date(as_of))
        return start, start + dt.timedelta(days=1)
    if period in PERIOD_DAYS:
        return as_timestamp(as_date(as_of)) - dt.timedelta(days=PERIOD_DAYS[period]), None
    return None, None


# Layout convention (thali.sources.layout): a frame partitioned by month carries
# this string column ('yyyy-MM') of the order's time.
MONTH_PARTITION = "order_month"


def month_guard(df: DataFrame, period: str | None, as_of) -> Column | None:
    """Partition predicate implied by a period, when `df` is month-partitioned.

    Redundant with the exact time predicate, but on the partition column, so
    Spark skips whole partitions (``PartitionFilters``) before reading files.
    """
    if MONTH_PARTITION not in df.columns:
        return None
    start, end = period_bounds(period, as_of)
    if start is None:
        return None
    m = F.col(MONTH_PARTITION)
    pred = m >= F.lit(start.strftime("%Y-%m"))
    if end is not None:
        pred = pred & (m <= F.lit((end - dt.timedelta(microseconds=1)).strftime("%Y-%m")))
    return pred


def period_filter(df: DataFrame, ts: str, period: str | None, as_of) -> DataFrame:
    pred = period_predicate(ts, period, as_of)
    if pred is None:
        return df
    guard = month_guard(df, period, as_of)
    return df.filter(pred if guard is None else guard & pred)


def within_hours(ts: str | Column, now, hours: int) -> Column:
    """P5: ``ts > now - hours`` (strict)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return c > _ts(as_timestamp(now) - dt.timedelta(hours=hours))


def csv_list(value: str | None) -> list[str]:
    """Split a CSV parameter on ',' and trim each piece."""
    if not value:
        return []
    return [s.strip() for s in value.split(",")]


def in_list(col: str | Column, values: Iterable) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.isin(list(values))


def non_empty(col: str | Column) -> Column:
    """``col IS NOT NULL AND col != ''``."""
    c = F.col(col) if isinstance(col, str) else col
    return c.isNotNull() & (c != "")


def optional_eq(col: str, value) -> Column | None:
    """P10: filter skipped when the parameter is absent or the sentinel 'all'."""
    if value is None or value == "" or value == "all":
        return None
    return F.col(col) == F.lit(value)


def conjunction(preds: Iterable[Column | None]) -> Column:
    """AND of the present predicates (TRUE when there are none)."""
    present = [p for p in preds if p is not None]
    return reduce(operator.and_, present, F.lit(True))


def customer_segment(kind: str | None, as_of) -> Column:
    """`new` (joined on as_of), `birthday`, `with_dob`, `no_dob`, anything else: all."""
    d = as_date(as_of)
    if kind == "new":
        return day_range("created_at", d)
    if kind == "birthday":
        return (F.month("dob") == d.month) & (F.dayofmonth("dob") == d.day)
    if kind == "with_dob":
        return F.col("dob").isNotNull()
    if kind == "no_dob":
        return F.col("dob").isNull()
    return F.lit(True)


def search_customers(term: str | None) -> Column:
    """Case-insensitive substring of name OR substring of phone; blank term matches all."""
    t = (term or "").strip().lower()
    if not t:
        return F.lit(True)
    return F.lower(F.col("name")).contains(t) | F.col("phone").contains(t)


def unexpired(expires_col: str, now) -> Column:
    """``expires_at > now``."""
    return F.col(expires_col) > _ts(as_timestamp(now))
