"""The reference's rate limiter over whole tables of requests.

Each client has a fixed window that opens at its first request after the previous window closed;
requests beyond the maximum in a window are refused. The windows of a client form a chain, but the
chain is not walked request by request: every request points to the client's first request after a
window that would open at it, and the requests that really open windows are those reached from the
client's first one. They are found by pointer doubling: after k rounds all openings up to the 2^k-th
are known, so a chain of n windows takes log2(n) rounds of two joins on (client, time), which no
client can make uneven. Requests of one client at one time are one row with a count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thali.operators.scans import prefix_scan
from thali.sources.io import cut_lineage


def micros(ts: str) -> Column:
    """Microseconds of a zone-less time since 1970, without any session time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts))


def wall(us: str) -> Column:
    """The zone-less time of ``micros``."""
    return F.timestamp_add("MICROSECOND", F.col(us), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def openings(times: DataFrame, window_us: int, parts: int | None = None) -> DataFrame:
    """(client, t): the requests among `times` (client, t; distinct) that open a window."""
    # newest first, each request's window end meets the earliest request at or after it
    ends = times.select("client", (-F.col("t") - F.lit(window_us)).alias("back"), F.lit(1).alias("kind"), F.col("t").alias("of"),
                        F.lit(None).cast("long").alias("seen"))
    seen = times.select("client", (-F.col("t")).alias("back"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("of"),
                        F.col("t").alias("seen"))
    scanned = prefix_scan(seen.unionByName(ends), ["client"], ["back", "kind", "of"], last={"next": "seen"}, parts=parts)
    jump = cut_lineage(scanned.filter((F.col("kind") == 1) & F.col("next").isNotNull()).select("client", F.col("of").alias("t"), "next"))
    reached = times.groupBy("client").agg(F.min("t").alias("t"))
    while not jump.isEmpty():
        reached = cut_lineage(reached.unionByName(reached.join(jump, ["client", "t"]).select("client", F.col("next").alias("t"))))
        further = jump.select("client", F.col("t").alias("next"), F.col("next").alias("beyond"))
        jump = cut_lineage(jump.join(further, ["client", "next"]).select("client", "t", F.col("beyond").alias("next")))
    return reached


def windows(requests: DataFrame, window_us: int, parts: int | None = None) -> DataFrame:
    """(client, t, n, start, hits): requests (client, t, n) with their window's start and the window's
    requests up to and including them."""
    opens = openings(requests.select("client", "t"), window_us, parts).withColumn("start", F.col("t"))
    marked = requests.join(opens, ["client", "t"], "left")
    scanned = cut_lineage(prefix_scan(marked, ["client"], ["t"], last={"opened": "start"}, total={"sum": "n"}, parts=parts))
    base = scanned.filter(F.col("start").isNotNull()).select("client", F.col("t").alias("opened"), (F.col("sum") - F.col("n")).alias("base"))
    return scanned.join(base, ["client", "opened"]).select("client", "t", "n", F.col("opened").alias("start"),
                                                         (F.col("sum") - F.col("base")).alias("hits"))


def refusals(found: DataFrame, max_requests: int) -> DataFrame:
    """(client, ts, window_start, hits): one row per request beyond the maximum, with its number in the window.
    The last `n` of the `hits` at a time are counted here."""
    first = F.greatest(F.col("hits") - F.col("n") + 1, F.lit(max_requests + 1))
    return found.filter((F.col("hits") > max_requests) & (F.col("n") > 0)).select(
        "client", wall("t").alias("ts"), wall("start").alias("window_start"), F.explode(F.sequence(first, F.col("hits"))).alias("hits"))


def counted(requests: DataFrame, key: str, ts: str) -> DataFrame:
    """(client, t, n): requests per client and time; requests without either are left out."""
    named = requests.select(F.col(key).alias("client"), F.col(ts).cast("timestamp_ntz").alias("ts"))
    return named.filter(F.col("client").isNotNull() & F.col("ts").isNotNull()).select("client", micros("ts").alias("t")) \
        .groupBy("client", "t").agg(F.count(F.lit(1)).alias("n"))


def rate_limit(requests: DataFrame, window_seconds: int = 900, max_requests: int = 5, key: str = "client",
               ts: str = "ts", parts: int | None = None) -> DataFrame:
    """T1 over a table: the refused requests (client, ts, window_start, hits)."""
    return refusals(windows(cut_lineage(counted(requests, key, ts)), window_seconds * 1_000_000, parts), max_requests)
