"""Joins as DataFrame operators.

No join here forces a strategy on a side that grows with the data; AQE picks
broadcast at runtime from measured sizes (``autoBroadcastJoinThreshold``) and
splits skewed partitions of sort-merge joins. Explicit ``broadcast`` is used
only for sides whose size a limit proves (a top-k result, a page of
orders or reviews, that page's lines).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thali.operators.scans import prefix_scan


def exists_flag(df: DataFrame, other: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``EXISTS(SELECT 1 FROM other WHERE keys match) AS name`` as a column.

    The other side is reduced to distinct keys first, so the left join cannot
    multiply rows.
    """
    marks = other.select(*keys).distinct().withColumn(name, F.lit(True))
    for k in keys:
        marks = marks.filter(F.col(k).isNotNull())
    return df.join(marks, list(keys), "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def semi(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that have a partner."""
    return df.join(other.select(*keys), list(keys), "left_semi")


def taken_by_other(df: DataFrame, holders: DataFrame, value: str, owner: str, flag: str) -> DataFrame:
    """Attach `flag`: does a row of `holders` with another `owner` hold the same `value`?

    Holders are reduced to the least and greatest owner per value first, so nothing multiplies
    however many rows share one; a NULL value is nobody's."""
    ends = holders.filter(F.col(value).isNotNull()).groupBy(value).agg(
        F.min(owner).alias("_least"), F.max(owner).alias("_greatest"))
    other = (F.col("_least") != F.col(owner)) | (F.col("_greatest") != F.col(owner))
    return df.join(ends, value, "left").withColumn(flag, F.coalesce(other, F.lit(False))).drop("_least", "_greatest")


def anti(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows without a partner (NULL keys never match, so they are kept)."""
    return df.join(other.select(*keys), list(keys), "left_anti")


def outer_with_condition(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """LEFT JOIN with an extra predicate in ON: the predicate drops partners, never left rows."""
    return left.join(right, on, "left")


def valid_session_activity(sessions: DataFrame, activity: DataFrame, parts: int | None = None) -> DataFrame:
    """Each activity with the session it ran under, if that session was unexpired.

    A login deletes the customer's other sessions before creating a new one,
    so the session in force at `ts` is the owner's newest one started at or
    before `ts`, valid while ``ts < expires_at``: an as-of join, done as a
    prefix scan over the union of both, in time order per owner, that carries
    the newest session along. It never compares pairs, and a hot owner is cut
    into ranges by row count (``scans.prefix_scan``; `parts` ranges in all,
    by default as many as shuffle partitions).
    The session's start comes along as ``session_start``.
    """
    sess_t = T.StructType([T.StructField("session_pk", T.LongType()), T.StructField("s_start", T.TimestampNTZType()),
                           T.StructField("s_end", T.TimestampNTZType())])
    s = sessions.select(
        F.col("customer_id").alias("owner"), F.col("created_at").alias("ts"), F.lit(0).alias("kind"),
        F.col("id").cast("long").alias("pk"),
        F.struct(F.col("id").cast("long").alias("session_pk"), F.col("created_at").cast("timestamp_ntz").alias("s_start"),
                 F.col("expires_at").cast("timestamp_ntz").alias("s_end")).alias("sess"),
        F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("string").alias("event_type"))
    a = activity.select(
        F.col("customer_id").alias("owner"), "ts", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("pk"),
        F.lit(None).cast(sess_t).alias("sess"), "event_id", "event_type")
    u = s.unionByName(a).filter(F.col("owner").isNotNull())
    scanned = prefix_scan(u, ["owner"], ["ts", "kind", "pk", "event_id"], last={"cur": "sess"}, parts=parts)
    return scanned.filter((F.col("kind") == 1) & (F.col("ts") < F.col("cur.s_end"))).select(
        F.col("cur.session_pk").alias("session_pk"), F.col("owner").alias("customer_id"),
        "event_id", "event_type", "ts", F.col("cur.s_start").alias("session_start"))
