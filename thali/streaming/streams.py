"""The reference's polling loops and in-process state as Structured Streaming.

Every transformation here is a plain DataFrame → DataFrame function, so the
same code runs on a batch frame (the "batch twin", where ``withWatermark`` is
a no-op) and on a stream. Watermarks need a ``timestamp`` column: model
times are zone-less wall clock (``timestamp_ntz``), so streams cast them with
the session time zone and cast results back. Run streams with
``spark.sql.session.timeZone=UTC`` (as ``thali.session.get_spark`` does) so
that day and hour windows align to wall-clock midnights and hours.

No Python runs per row or key: windows, de-duplication and joins keep their state in the
JVM and drop it behind the watermark, and state that lives as long as an order or a
client's window (T1, T3) is a bucketed table in a ``Store``: each micro-batch is aggregated,
merged into the buckets it touches and committed under its batch id, so a replayed batch
changes nothing and readers see whole batches only.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thali.functions.predicates import ts_literal
from thali.operators import limiter
from thali.sources.commits import Store
from thali.sources.io import cut_lineage
from thali.sources.schema import OPEN_STATUSES


def event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP; zone-less times are cast in the session zone."""
    if isinstance(df.schema[col].dataType, T.TimestampNTZType):
        return df.withColumn(col, F.col(col).cast("timestamp"))
    return df


def _wall(c):
    return c.cast("timestamp_ntz")


def _start(frame: DataFrame, per_batch: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None):
    w = frame.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    return (w.trigger(**trigger) if trigger else w).start()


# ------------------------------------------------------------------ T1, T4

def quota_breaches(requests: DataFrame, window: str = "15 minutes", max_requests: int = 5,
                   delay: str = "15 minutes", key: str = "client", ts: str = "ts") -> DataFrame:
    """Clients over `max_requests` in an epoch-aligned tumbling window.

    Append mode emits a window once the watermark passes its end; rows later
    than `delay` are dropped, as a stream must. The reference's limiter uses a
    window per client starting at its first request; aligned windows are a
    deliberate, stateless-per-window choice.
    """
    r = event_time(requests.select(key, ts), ts).withWatermark(ts, delay)
    counts = r.groupBy(F.window(ts, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") > max_requests).select(
        key, _wall(F.col("w.start")).alias("window_start"), _wall(F.col("w.end")).alias("window_end"), "n")


def attempt_limits(attempts: DataFrame, max_attempts: int = 5, lifetime: str = "10 minutes",
                   delay: str = "10 minutes", key: str = "key") -> DataFrame:
    """T4: codes tried more than `max_attempts` times within `lifetime` of being issued.

    Each attempt carries its code's issue time (`issued_at`) and its own time
    (`ts`). Grouping by (key, issued_at) with the watermark on `issued_at`
    drops a code's state once the watermark passes its issue time plus its
    lifetime and the delay (attempts come that much later than the issue they are
    grouped by); attempts after the code's lifetime do not count (they are refused
    as expired by the reference, not as over-limit).
    """
    a = event_time(event_time(attempts.select(key, "issued_at", "ts"), "issued_at"), "ts") \
        .withWatermark("issued_at", f"{lifetime} {delay}")
    live = a.filter((F.col("ts") >= F.col("issued_at")) & (F.col("ts") < F.col("issued_at") + F.expr(f"INTERVAL {lifetime}")))
    counts = live.groupBy(key, "issued_at").agg(F.count(F.lit(1)).alias("attempts"))
    return counts.filter(F.col("attempts") > max_attempts).select(
        key, _wall(F.col("issued_at")).alias("issued_at"), "attempts")


def _limit_batch(store: Store, batch: DataFrame, batch_id: int, window_us: int, max_requests: int, delay_us: int,
                 buckets: int) -> None:
    """Merge one micro-batch of (client, ts) into the clients' open windows."""
    if store.has_batch(batch_id):
        return
    new = cut_lineage(limiter.counted(batch, "client", "ts"))
    if new.isEmpty():
        return
    before = store.newest()
    if before is None:
        store.create("windows", store.spark.createDataFrame([], "client string, start long, hits long"), "client", buckets)
        before = store.newest()
    high = max(before["meta"].get("high", 0), new.agg(F.max("t")).first()[0])
    refused: list[DataFrame] = []

    def merge(held: DataFrame) -> DataFrame:
        # the open window takes part as requests already counted; late requests count in it
        was = held.join(new.select("client").distinct(), "client", "left_semi")
        rows = new.join(was.select("client", F.col("start").alias("_open")), "client", "left").groupBy(
            "client", F.greatest("t", "_open").alias("t")).agg(F.sum("n").alias("fresh"))
        old = was.select("client", F.col("start").alias("t"), F.col("hits").alias("old"))
        rows = cut_lineage(rows.join(old, ["client", "t"], "full").select(
            "client", "t", F.coalesce("fresh", F.lit(0)).alias("fresh"), F.coalesce("old", F.lit(0)).alias("old")))
        found = limiter.windows(rows.select("client", "t", (F.col("fresh") + F.col("old")).alias("n")), window_us)
        found = cut_lineage(found.drop("n").join(rows.select("client", "t", F.col("fresh").alias("n")), ["client", "t"]))
        refused.append(limiter.refusals(found, max_requests))
        last = found.groupBy("client").agg(F.max("start").alias("start"), F.max_by("hits", "t").alias("hits"))
        kept = held.join(new.select("client").distinct(), "client", "left_anti").unionByName(last)
        # a window that closed before the watermark can take no more requests
        return kept.filter(F.col("start") + window_us > high - delay_us)

    files = store.rewritten("windows", new, merge, before)
    out = refused[0]
    store.commit(append={"refused": store.write(out, "refused")}, buckets={"windows": files}, schemas={"refused": out.schema},
                 batch=batch_id, meta={"high": high}, after=before)


def rate_limit(requests: DataFrame, path: str, checkpoint: str, window_seconds: int = 900, max_requests: int = 5,
               delay_seconds: int = 900, key: str = "client", ts: str = "ts", buckets: int = 64, trigger: dict | None = None):
    """T1 as the reference's limiter on a stream: each client gets a fixed window that opens at its first
    request after the previous window closed; requests beyond `max_requests` in a window are refused.

    The store at `path` holds one (start, hits) row per client with an open window and the appended table
    ``refused`` (client, ts, window_start, hits). A micro-batch goes through the batch limiter together with
    the open windows of its clients; a request that arrives after its window's successor opened counts in the
    successor. Windows that closed `delay_seconds` before the newest request leave the state."""
    store = Store(requests.sparkSession, path)
    named = requests.select(F.col(key).cast("string").alias("client"), F.col(ts).alias("ts"))

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        _limit_batch(store, batch, batch_id, window_seconds * 1_000_000, max_requests, delay_seconds * 1_000_000, buckets)

    return _start(named, per_batch, checkpoint, trigger)


def quota_breaches_batch(requests: DataFrame, window: str, max_requests: int, key: str = "client",
                         ts: str = "ts") -> DataFrame:
    """Batch twin of T1 on zone-less times (no watermark, same windows)."""
    counts = requests.groupBy(F.window(ts, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") > max_requests).select(
        key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


# ------------------------------------------------------------------ T2

def new_arrivals(orders: DataFrame, delay: str = "1 hour", key: str = "order_id", ts: str = "created_at") -> DataFrame:
    """Each order id once, on first sight (state kept for `delay` past its time)."""
    o = event_time(orders, ts).withWatermark(ts, delay)
    return o.dropDuplicatesWithinWatermark([key]).withColumn(ts, _wall(F.col(ts)))


def arrivals(sightings: DataFrame, delay: str = "1 hour", key: str = "order_id", ts: str = "created_at") -> DataFrame:
    """T2 with expiry: an order id arrives anew whenever it was unseen for `delay`. One row per arrival:
    the id, its first and last sighting, and their number.

    Gaps and islands as session windows: on a table, and on a stream, where an island is emitted
    once the watermark has passed its last sighting by `delay` (``new_arrivals`` alerts at first sight)."""
    o = event_time(sightings.select(key, ts).filter(F.col(key).isNotNull()), ts).withWatermark(ts, delay)
    # a window ends `delay` after its last sighting and takes in what comes before that
    seen = o.groupBy(key, F.session_window(ts, delay).alias("w")).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"),
                                                                     F.count(F.lit(1)).alias("sightings"))
    return seen.select(key, _wall(F.col("_first")).alias("arrived_at"), _wall(F.col("_last")).alias("last_seen"), "sightings")


# ------------------------------------------------------------------ T3

def _status_batch(store: Store, batch: DataFrame, batch_id: int, delay_us: int, buckets: int) -> None:
    """Merge one micro-batch of status updates into the live table."""
    if store.has_batch(batch_id):
        return
    before = store.newest()
    high = (before or {"meta": {}})["meta"].get("high")
    updates = batch.select("order_id", "status", F.col("ts").cast("timestamp_ntz").alias("ts")).filter(
        F.col("order_id").isNotNull() & F.col("ts").isNotNull())
    if high is not None:                                    # behind the watermark
        updates = updates.filter(limiter.micros("ts") >= high - delay_us)
    new = cut_lineage(latest_status_batch(updates))
    if new.isEmpty():
        return
    if before is None:
        store.create("live", new.limit(0), "order_id", buckets)
        before = store.newest()
    newest = new.agg(F.max(limiter.micros("ts"))).first()[0]
    high = newest if high is None else max(high, newest)
    final = ~F.coalesce("is_open", F.lit(False)) & (limiter.micros("ts") < high - delay_us)
    done: list[DataFrame] = []

    def merge(held: DataFrame) -> DataFrame:
        merged = cut_lineage(latest_status_batch(held.unionByName(new)))
        done.append(merged.filter(final))
        return merged.filter(~final)

    files = store.rewritten("live", new, merge, before)
    store.commit(append={"finished": store.write(done[0], "finished")}, buckets={"live": files},
                 schemas={"finished": new.schema}, batch=batch_id, meta={"high": high}, after=before)


def live_order_status(updates: DataFrame, path: str, checkpoint: str, delay_seconds: int = 3600, buckets: int = 64,
                      trigger: dict | None = None):
    """The live queue as a table that a stream keeps: latest status per order (by time, then status).

    Each micro-batch is reduced to one row per order and merged into the buckets of table ``live`` that it
    touches. A finished order (ready/completed/cancelled) stays there until its last update lies `delay_seconds`
    behind the newest one, so that a late update cannot reopen it, and then moves to the appended table
    ``finished``; later updates behind that watermark are ignored. Read both with ``order_status``, the queue
    with ``live_queue``."""
    store = Store(updates.sparkSession, path)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        _status_batch(store, batch, batch_id, delay_seconds * 1_000_000, buckets)

    return _start(updates, per_batch, checkpoint, trigger)


def live_queue(spark: SparkSession, path: str) -> DataFrame:
    """The open orders of the live table."""
    return Store(spark, path).read("live").filter("is_open")


def order_status(spark: SparkSession, path: str) -> DataFrame:
    """The latest status of every order seen, finished ones included."""
    store = Store(spark, path)
    rows = store.read("live").unionByName(store.read("finished"))
    return latest_status_batch(rows)


def latest_status_batch(updates: DataFrame) -> DataFrame:
    """Batch twin of T3: latest (ts, status) per order."""
    return updates.groupBy("order_id").agg(F.max_by("status", F.struct("ts", "status")).alias("status"),
                                           F.max("ts").alias("ts")) \
        .withColumn("is_open", F.col("status").isin(*OPEN_STATUSES))


# ------------------------------------------------------------------ T5

def valid_session_activity(sessions: DataFrame, activity: DataFrame, delay: str = "1 hour", lifetime_hours: float = 24,
                           slices: int = 4) -> DataFrame:
    """T5: activity with the session in force (the owner's newest session started at or before it, unexpired):
    the as-of join of J9 as a stream–stream join.

    Both sides have a watermark, and a session meets activity only within `lifetime_hours` of its start, which
    must be the longest time a session is valid (one that claims more counts as ending then). The join's state is
    therefore dropped by time, and the newest of the sessions an activity met is taken (``max_by``) once the
    watermark has passed the activity, when no earlier-started session can still arrive. A newest session older
    than its lifetime is expired, so activity that meets none has none.

    A session is filed under each slice of time it can be valid in (`slices` to a lifetime), so that a hot owner's
    state is spread over tasks by time. Pairs are formed only between an activity and the owner's logins of
    one lifetime. All state is the JVM's."""
    life_us = int(lifetime_hours * 3_600_000_000)
    life = F.expr(f"INTERVAL {life_us // 1_000_000} SECONDS")

    def slice_of(c: Column) -> Column:
        return F.floor(F.unix_micros(c) / F.lit(life_us // slices))

    s = event_time(event_time(sessions.select(
        F.col("customer_id").alias("owner"), F.col("id").cast("long").alias("session_pk"),
        F.col("created_at").alias("s_start"), F.col("expires_at").alias("s_end")), "s_start"), "s_end")
    s = s.filter(F.col("owner").isNotNull()).withWatermark("s_start", delay)
    s = s.withColumn("s_slice", F.explode(F.sequence(slice_of(F.col("s_start")), slice_of(F.col("s_start") + life))))
    a = event_time(activity.select(F.col("customer_id"), "ts", F.col("event_id").cast("long").alias("event_id"), "event_type"), "ts")
    a = a.withWatermark("ts", delay).withColumn("slice", slice_of(F.col("ts")))
    met = a.join(s, (F.col("customer_id") == F.col("owner")) & (F.col("slice") == F.col("s_slice"))
                 & (F.col("ts") >= F.col("s_start")) & (F.col("ts") < F.col("s_start") + life))
    newest = met.groupBy("customer_id", "event_id", "event_type", "ts").agg(
        F.max_by(F.struct("session_pk", "s_end"), F.struct("s_start", "session_pk")).alias("cur"))
    return newest.filter(F.col("ts") < F.col("cur.s_end")).select(
        F.col("cur.session_pk").alias("session_pk"), "customer_id", "event_id", "event_type", _wall(F.col("ts")).alias("ts"))


# ------------------------------------------------------------------ T6

def revenue_stream(orders: DataFrame, window: str = "1 day", delay: str = "1 hour",
                   ts: str = "created_at") -> DataFrame:
    """Revenue and order count per event-time window (R5/R7 kept live)."""
    o = event_time(orders.select(ts, "total_amount"), ts).withWatermark(ts, delay)
    agg = o.groupBy(F.window(ts, window).alias("w")).agg(
        F.sum("total_amount").alias("revenue"), F.count(F.lit(1)).alias("orders"))
    return agg.select(_wall(F.col("w.start")).alias("window_start"), _wall(F.col("w.end")).alias("window_end"),
                      F.col("revenue").cast("double").alias("revenue"), "orders")


def revenue_batch(orders: DataFrame, window: str = "1 day", ts: str = "created_at") -> DataFrame:
    agg = orders.groupBy(F.window(ts, window).alias("w")).agg(
        F.sum("total_amount").alias("revenue"), F.count(F.lit(1)).alias("orders"))
    return agg.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                      F.col("revenue").cast("double").alias("revenue"), "orders")


# ------------------------------------------------------------------ T7

def ingest_stream(carts: DataFrame, orders_path: str, out_path: str, checkpoint: str, trigger: dict | None = None,
                  order_items_path: str | None = None, payments_path: str | None = None):
    """Carts arriving as a stream → D1/D2 per micro-batch via ``foreachBatch``.

    Each batch is checked against the orders snapshot plus everything already ingested on
    the batch's own days; ingested orders are filed by month, so a batch reads only its months' files.
    New ids go on from the greatest of the snapshots and of the commits before.

    The tables orders, order_items, payments and rejects of a batch are written to folders of their
    own and become visible together, by one commit that carries the batch id (``Store``): a writer that
    dies shows nothing, and a batch replayed after its commit writes nothing. A re-sent cart is
    skipped by D1. Carts without a time only yield rejects. Read the result with ``ingested``."""
    from thali.operators.changes import ingest_orders
    from thali.operators.scans import next_id

    spark = carts.sparkSession
    store = Store(spark, out_path)
    sources = {"order_id": orders_path, "order_item_id": order_items_path, "payment_id": payments_path}

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        if store.has_batch(batch_id):
            return
        before = store.newest()
        ids = before["meta"]["next"] if before else {
            k: next_id(spark.read.parquet(p), k) if p else 1 for k, p in sources.items()}
        batch = batch.persist()                  # read several times below
        try:
            # Occupancy and re-sent carts only involve orders of the batch's own days (a
            # re-sent cart keeps its timestamp), so only those days are looked at.
            day = F.to_date(F.col("ts").cast("timestamp_ntz"))
            lo, hi = batch.agg(F.min(day), F.max(day)).first()
            base = spark.read.parquet(orders_path)
            current = base.limit(0)
            if lo is not None:
                days = batch.select(day.alias("_on")).distinct()
                # the commits' files are pruned by their month, then like the snapshot by their row groups
                months = {r[0] for r in days.select(F.date_format("_on", "yyyy-MM")).distinct().collect()}
                files = [f for f in store.files("orders") if f.split("/month=")[1].split("/")[0] in months] if before else []
                current = store.frame("orders", files, before).select(*base.columns).unionByName(base) if files else base
                current = current.filter((F.col("created_at") >= ts_literal(lo)) & (F.col("created_at") < ts_literal(hi + dt.timedelta(days=1))))
                current = current.join(days, F.to_date("created_at") == F.col("_on"), "left_semi")
            change = ingest_orders(current, batch, ids)
            tables = {**change.tables, "rejects": change.rejects}
            by_month = tables["orders"].withColumn("month", F.date_format("created_at", "yyyy-MM"))
            append = {name: store.write(df, name) for name, df in tables.items() if name != "orders"}
            append["orders"] = store.write(by_month.hint("rebalance", "month"), "orders", ["month"])
            store.commit(append=append, schemas={name: df.schema for name, df in tables.items()}, batch=batch_id,
                         meta={"next": change.next_ids}, after=before)
        finally:
            batch.unpersist()

    return _start(carts, per_batch, checkpoint, trigger)


def ingested(spark: SparkSession, out_path: str, table: str) -> DataFrame:
    """A table (orders, order_items, payments, rejects) as of the newest whole batch."""
    return Store(spark, out_path).read(table)
