"""Streams T1–T7: stream = batch on closed windows, bounded state, exactly-once batches."""

import datetime as dt
import os
import tempfile
from decimal import Decimal as D

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from conftest import SF_SMALL
from frames import tables
from thali.functions import quality as Qy
from thali.sources import requests
from thali.sources import schema as S
from thali.sources.commits import Store
from thali.sources.model import load
from thali.streaming import replay
from thali.streaming import streams as St


def _scratch():
    return tempfile.mkdtemp(prefix="thali-test-")


def _events_folder(spark, n_files=4):
    """The sf0.001 events split into files by day, to feed a file stream."""
    path = os.path.join(_scratch(), "events")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    ev.withColumn("part", F.dayofmonth("ts") % n_files).repartition(n_files, "part").drop("part") \
        .write.parquet(path)
    return path, ev.schema


def _run(df, name, mode="append"):
    ck = os.path.join(_scratch(), "ck")
    q = df.writeStream.format("memory").queryName(name).outputMode(mode) \
        .option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return q


def test_quota_stream_equals_batch_on_closed_windows(spark):
    path, schema = _events_folder(spark)
    stream = spark.readStream.schema(schema).parquet(path).select(
        F.col("user_id").cast("string").alias("client"), "ts")
    _run(St.quota_breaches(stream, "1 day", 3, delay="0 seconds"), "t1_out")
    got = {(r.client, r.window_start, r.n) for r in spark.table("t1_out").collect()}
    batch = spark.read.parquet(f"{SF_SMALL}/events.parquet").select(
        F.col("user_id").cast("string").alias("client"), "ts")
    max_ts = batch.agg(F.max("ts")).collect()[0][0]
    want = {(r.client, r.window_start, r.n) for r in St.quota_breaches_batch(batch, "1 day", 3).collect()
            if r.window_end <= max_ts}
    assert want and want <= got
    # nothing emitted for a window still open at the watermark
    assert all(w <= max_ts for (_, w, _) in got)


def test_revenue_stream_equals_batch(spark):
    path, schema = _events_folder(spark)
    ev = spark.readStream.schema(schema).parquet(path).filter(F.col("event_type") == "purchase").select(
        F.col("ts").alias("created_at"), F.col("value").cast(S.MONEY).alias("total_amount"))
    _run(St.revenue_stream(ev, "1 day", delay="0 seconds"), "t6_out")
    got = {(r.window_start, r.revenue, r.orders) for r in spark.table("t6_out").collect()}
    b = spark.read.parquet(f"{SF_SMALL}/events.parquet").filter(F.col("event_type") == "purchase").select(
        F.col("ts").alias("created_at"), F.col("value").cast(S.MONEY).alias("total_amount"))
    max_ts = b.agg(F.max("created_at")).collect()[0][0]
    want = {(r.window_start, r.revenue, r.orders) for r in St.revenue_batch(b, "1 day").collect()
            if r.window_end <= max_ts}
    assert want == got


def test_new_arrivals_first_sight_only(spark):
    path = os.path.join(_scratch(), "orders")
    t0 = dt.datetime(2024, 1, 30, 9)
    rows = [(1, t0), (2, t0 + dt.timedelta(minutes=1)), (1, t0 + dt.timedelta(minutes=2)), (3, t0)]
    spark.createDataFrame(rows, "order_id long, created_at timestamp_ntz").write.parquet(path)
    s = spark.readStream.schema("order_id long, created_at timestamp_ntz").parquet(path)
    _run(St.new_arrivals(s, "1 hour"), "t2_out")
    assert sorted(r.order_id for r in spark.table("t2_out").collect()) == [1, 2, 3]


def _folders(spark, frames):
    """A folder to which the frames come one by one, each as one file, newest last."""
    path = os.path.join(_scratch(), "in")
    for k, df in enumerate(frames):
        df.coalesce(1).write.parquet(os.path.join(path, f"p{k:03d}"))
    return path


def _status_stream(spark, path, out, ck, **options):
    s = spark.readStream.schema(S.STATUS_UPDATES).option("maxFilesPerTrigger", 1).parquet(path + "/*")
    q = St.live_order_status(s, out, ck, trigger={"availableNow": True}, **options)
    q.awaitTermination(300)
    assert q.exception() is None


def test_live_order_status_drops_finished(spark):
    t0 = dt.datetime(2024, 1, 30, 9)
    rows = [(1, "pending", t0), (1, "preparing", t0 + dt.timedelta(minutes=5)), (2, "pending", t0),
            (2, "completed", t0 + dt.timedelta(minutes=9))]
    later = [(3, "pending", t0 + dt.timedelta(hours=3)), (4, "cancelled", t0 + dt.timedelta(hours=3))]
    frames = [spark.createDataFrame(r, S.STATUS_UPDATES) for r in (rows, later)]
    root = _scratch()
    out = os.path.join(root, "out")
    _status_stream(spark, _folders(spark, frames), out, os.path.join(root, "ck"), buckets=1)
    assert {r.order_id: r.status for r in St.live_queue(spark, out).collect()} == {1: "preparing", 3: "pending"}
    # order 2 was finished three hours before the newest update and has left the live table, 4 has not
    assert {r.order_id for r in Store(spark, out).read("live").collect()} == {1, 3, 4}
    assert {r.order_id for r in Store(spark, out).read("finished").collect()} == {2}
    got = {r.order_id: (r.status, r.ts, r.is_open) for r in St.order_status(spark, out).collect()}
    batch = {r.order_id: (r.status, r.ts, r.is_open) for r in St.latest_status_batch(frames[0].unionByName(frames[1])).collect()}
    assert batch == got


def test_live_status_equals_batch_and_a_replay_changes_nothing(spark):
    updates = requests.status_updates(load(spark, SF_SMALL)).filter(Qy.status_ok("status"))
    parts = [updates.filter(F.pmod(F.xxhash64("ts"), F.lit(3)) == k) for k in range(3)]
    root = _scratch()
    out = os.path.join(root, "out")
    path = _folders(spark, parts)
    _status_stream(spark, path, out, os.path.join(root, "ck"), delay_seconds=10**9, buckets=4)
    want = sorted(map(tuple, St.latest_status_batch(updates).collect()))
    assert sorted(map(tuple, St.order_status(spark, out).collect())) == want
    before = Store(spark, out).commits()
    _status_stream(spark, path, out, os.path.join(root, "ck2"), delay_seconds=10**9, buckets=4)      # all batches again
    assert Store(spark, out).commits() == before
    assert sorted(map(tuple, St.order_status(spark, out).collect())) == want


def test_session_activity_stream_join_equals_batch(spark):
    t = tables(spark)
    sdir, adir = os.path.join(_scratch(), "s"), os.path.join(_scratch(), "a")
    t.sessions.write.parquet(sdir)
    act = spark.createDataFrame([
        (1, 1, dt.datetime(2024, 1, 29, 11), "click"), (2, 1, dt.datetime(2024, 1, 30, 9), "view"),
        (3, 2, dt.datetime(2024, 1, 22, 9), "click"), (4, 1, dt.datetime(2024, 2, 2, 9), "click")],
        "event_id long, customer_id long, ts timestamp_ntz, event_type string")
    act.write.parquet(adir)
    # a later login moves the sessions' watermark on
    later = t.sessions.limit(1).withColumn("created_at", F.lit(dt.datetime(2024, 2, 3)).cast("timestamp_ntz")) \
        .withColumn("customer_id", F.lit(9).cast("long"))
    later.write.mode("append").parquet(sdir)
    s = spark.readStream.schema(t.sessions.schema).parquet(sdir)
    a = spark.readStream.schema(act.schema).parquet(adir)
    _run(St.valid_session_activity(s, a), "t5_out")
    got = sorted((r.session_pk, r.event_id) for r in spark.table("t5_out").collect())
    from thali.operators.joins import valid_session_activity
    want = sorted((r.session_pk, r.event_id) for r in valid_session_activity(t.sessions, act).collect())  # noqa
    # activity 2 falls in both sessions of owner 1: the newest (2) is the one in force
    assert got == want == [(1, 1), (2, 2)]


def test_session_stream_equals_j9_on_shuffled_input(spark):
    """Sessions and activity of sf0.001 in random order over several batches, no later than the delay."""
    t = load(spark, SF_SMALL)
    sessions = t.sessions.filter("customer_id IS NOT NULL").select("id", "customer_id", "created_at", "expires_at")
    end = dt.datetime(2030, 1, 1)
    sdir = _folders(spark, [sessions.filter(F.pmod(F.xxhash64("id"), F.lit(3)) == k) for k in range(3)]
                    + [spark.createDataFrame([(10**9, 10**9, end, end)], sessions.schema)])
    adir = _folders(spark, [t.activity.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k) for k in range(3)]
                    + [spark.createDataFrame([(10**9, 10**9, end, "end")], t.activity.schema)])
    s = spark.readStream.schema(sessions.schema).option("maxFilesPerTrigger", 1).parquet(sdir + "/*")
    a = spark.readStream.schema(t.activity.schema).option("maxFilesPerTrigger", 1).parquet(adir + "/*")
    joined = St.valid_session_activity(s, a, delay="40 days")
    q = _run(joined, "t5_shuffled")
    from thali.operators.joins import valid_session_activity
    cols = ["session_pk", "customer_id", "event_id", "event_type", "ts"]
    want = sorted(map(tuple, valid_session_activity(t.sessions, t.activity).select(*cols).collect()))
    assert sorted(map(tuple, spark.table("t5_shuffled").select(*cols).collect())) == want and want
    plan = q._jsq.explainInternal(False)
    assert "SymmetricHashJoin" in plan
    assert "Python" not in plan and "Pandas" not in plan


def test_stream_sources_hold_no_python_operators():
    import inspect

    source = inspect.getsource(St)
    assert "InPandas" not in source and "pandas_udf" not in source and "mapInArrow" not in source and "F.udf" not in source


def test_ingest_stream_exactly_once_per_batch(spark):
    t = tables(spark)
    root = _scratch()
    orders_path = os.path.join(root, "orders")
    t.orders.write.parquet(orders_path)
    carts_dir = os.path.join(root, "carts")
    os.makedirs(carts_dir)
    line = '{"item_id": 10, "quantity": 2, "price": 20.0}'
    with open(os.path.join(carts_dir, "a.json"), "w") as f:
        f.write('{"cart_id": "c1", "customer_id": 1, "table_number": "T-4", "ts": "2024-01-30T12:00:00", '
                f'"items": [{line}], "pay_ref": null}}\n')
        f.write('{"cart_id": "c2", "customer_id": 2, "table_number": "T-4", "ts": "2024-01-30T12:05:00", '
                f'"items": [{line}], "pay_ref": null}}\n')
        f.write('not json\n')
    from thali.sources.io import read_carts
    stream = read_carts(spark, carts_dir, stream=True).filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    out = os.path.join(root, "out")
    q = St.ingest_stream(stream, orders_path, out, os.path.join(root, "ck"), trigger={"availableNow": True})
    q.awaitTermination(300)
    new = St.ingested(spark, out, "orders")
    assert [(r.order_id, r.table_number) for r in new.collect()] == [(104, "T-4")]
    rej = St.ingested(spark, out, "rejects")
    assert [(r.cart_id, r.reason) for r in rej.collect()] == [("c2", "table_occupied")]


def test_a_killed_writer_leaves_nothing_visible(spark, monkeypatch):
    """Orders and lines of a batch appear together: a writer that dies between its files and its commit shows
    neither, and the batch's replay shows both once."""
    t = tables(spark)
    root = _scratch()
    orders_path, out, ck = (os.path.join(root, x) for x in ("orders", "out", "ck"))
    t.orders.write.parquet(orders_path)
    carts = spark.createDataFrame([(f"c{k}", 1, f"T-{k}", dt.datetime(2024, 2, k, 12), [(10, 2, D("20.00"))] * k, None)
                                   for k in range(1, 6)], S.CART)
    path = _folders(spark, [carts.filter("cart_id < 'c3'"), carts.filter("cart_id >= 'c3'")])

    def run():
        s = spark.readStream.schema(carts.schema).option("maxFilesPerTrigger", 1).parquet(path + "/*")
        q = St.ingest_stream(s, orders_path, out, ck, trigger={"availableNow": True})
        try:
            q.awaitTermination(300)
        except StreamingQueryException:
            pass
        return q.exception()

    real, calls = Store.commit, []

    def dies(self, *a, **k):
        calls.append(k["batch"])
        if len(calls) == 2:
            raise RuntimeError("killed")
        return real(self, *a, **k)

    monkeypatch.setattr(Store, "commit", dies)
    assert run() is not None and calls == [0, 1]
    assert St.ingested(spark, out, "orders").count() == 2 and St.ingested(spark, out, "order_items").count() == 3
    assert len(os.listdir(os.path.join(out, "orders"))) == 2          # the dead writer's files are there, unseen
    assert run() is None
    orders, lines, pays = (St.ingested(spark, out, n) for n in ("orders", "order_items", "payments"))
    assert sorted(r.order_id for r in orders.collect()) == list(range(104, 109))
    assert sorted(r.order_item_id for r in lines.collect()) == list(range(1, 16))
    assert sorted(r.payment_id for r in pays.collect()) == list(range(1, 6))
    assert lines.join(orders, "order_id", "left_anti").count() == 0


def test_attempt_limits_stream_equals_batch(spark):
    path = os.path.join(_scratch(), "attempts")
    t0 = dt.datetime(2024, 1, 30, 9)
    rows = [("a", t0, t0 + dt.timedelta(minutes=m)) for m in range(7)]            # 6 inside 10 min + 1... all inside
    rows += [("a", t0, t0 + dt.timedelta(minutes=12))]                              # expired: not counted
    rows += [("b", t0, t0 + dt.timedelta(minutes=m)) for m in range(3)]
    rows += [("z", t0 + dt.timedelta(hours=5), t0 + dt.timedelta(hours=5))]        # moves the watermark
    schema = "key string, issued_at timestamp_ntz, ts timestamp_ntz"
    spark.createDataFrame(rows, schema).write.parquet(path)
    s = spark.readStream.schema(schema).parquet(path)
    _run(St.attempt_limits(s, max_attempts=5), "t4_out")
    got = [(r.key, r.attempts) for r in spark.table("t4_out").collect()]
    batch = [(r.key, r.attempts) for r in St.attempt_limits(spark.createDataFrame(rows, schema), 5).collect()]
    assert got == batch == [("a", 7)]


def test_session_stream_handles_late_older_session(spark):
    """Batch 1 brings session 2 (10:00) and activity at 11:00; batch 2 brings the older
    session 1 (08:00) and activity at 09:00. As in the batch as-of join, 09:00 belongs to
    session 1 and 11:00 to session 2."""
    root = _scratch()
    sdir, adir = os.path.join(root, "s"), os.path.join(root, "a")
    day = dt.datetime(2024, 1, 30)
    s_schema = "id long, customer_id long, created_at timestamp_ntz, expires_at timestamp_ntz"
    a_schema = "event_id long, customer_id long, ts timestamp_ntz, event_type string"
    spark.createDataFrame([(2, 1, day.replace(hour=10), day.replace(hour=10) + dt.timedelta(hours=24))], s_schema) \
        .coalesce(1).write.parquet(os.path.join(sdir, "p1"))
    spark.createDataFrame([(20, 1, day.replace(hour=11), "click")], a_schema).coalesce(1).write.parquet(os.path.join(adir, "p1"))
    s = spark.readStream.schema(s_schema).option("maxFilesPerTrigger", 1).parquet(sdir + "/*")
    a = spark.readStream.schema(a_schema).option("maxFilesPerTrigger", 1).parquet(adir + "/*")
    ck = os.path.join(root, "ck")
    q = St.valid_session_activity(s, a, delay="1 day").writeStream.format("memory").queryName("t5_late") \
        .outputMode("append").option("checkpointLocation", ck).start()
    q.processAllAvailable()
    spark.createDataFrame([(1, 1, day.replace(hour=8), day.replace(hour=8) + dt.timedelta(hours=24))], s_schema) \
        .coalesce(1).write.parquet(os.path.join(sdir, "p2"))
    spark.createDataFrame([(10, 1, day.replace(hour=9), "view")], a_schema).coalesce(1).write.parquet(os.path.join(adir, "p2"))
    q.processAllAvailable()
    # the result is final, and shown, once no earlier session can arrive any more
    late = day + dt.timedelta(days=3)
    spark.createDataFrame([(3, 9, late, late)], s_schema).coalesce(1).write.parquet(os.path.join(sdir, "p3"))
    spark.createDataFrame([(30, 9, late, "view")], a_schema).coalesce(1).write.parquet(os.path.join(adir, "p3"))
    q.processAllAvailable()
    q.stop()
    got = sorted((r.session_pk, r.event_id) for r in spark.table("t5_late").collect())
    assert got == [(1, 10), (2, 20)]



def test_live_status_late_update_cannot_reopen(spark):
    root = _scratch()
    out = os.path.join(root, "out")
    t0 = dt.datetime(2024, 1, 30, 9)
    rows = [[(1, "completed", t0 + dt.timedelta(minutes=30))], [(1, "preparing", t0 + dt.timedelta(minutes=5))],
            [(2, "pending", t0 + dt.timedelta(hours=9))], [(1, "preparing", t0 + dt.timedelta(minutes=40))]]
    path = _folders(spark, [spark.createDataFrame(r, S.STATUS_UPDATES) for r in rows])
    _status_stream(spark, path, out, os.path.join(root, "ck"))
    assert [(r.order_id, r.status) for r in St.live_queue(spark, out).collect()] == [(2, "pending")]
    assert {(r.order_id, r.status) for r in St.order_status(spark, out).collect()} == {(1, "completed"), (2, "pending")}


def _limiter_brute_force(rows, window, max_requests):
    out, state = set(), {}
    for client, t in sorted(rows, key=lambda r: (r[0], r[1])):
        start, hits = state.get(client, (None, 0))
        if start is None or t >= start + window:
            start, hits = t, 0
        hits += 1
        state[client] = (start, hits)
        if hits > max_requests:
            out.add((client, t, start, hits))
    return out


def _limit_stream(spark, frames, **options):
    root = _scratch()
    out = os.path.join(root, "out")
    path = _folders(spark, frames)
    s = spark.readStream.schema("client string, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(path + "/*")
    q = St.rate_limit(s, out, os.path.join(root, "ck"), trigger={"availableNow": True}, **options)
    q.awaitTermination(300)
    assert q.exception() is None
    return Store(spark, out)


def test_rate_limit_per_client_windows(spark):
    t0 = dt.datetime(2024, 1, 30, 9)
    rows = [("a", t0 + dt.timedelta(minutes=m)) for m in (0, 1, 2, 3, 4, 5, 6, 14, 15, 16, 17)]
    rows += [("b", t0 + dt.timedelta(minutes=m)) for m in (10, 11, 12)]
    rows += [("z", t0 + dt.timedelta(hours=3))]                       # the other windows are long closed then
    schema = "client string, ts timestamp_ntz"
    want = _limiter_brute_force(rows, dt.timedelta(minutes=15), 5)
    for cuts in ([0, 15], [0, 4, 7, 9, 15], [0, *range(1, 16)]):      # however the requests are cut into batches
        frames = [spark.createDataFrame(rows[a:b], schema) for a, b in zip(cuts, cuts[1:])]
        store = _limit_stream(spark, frames, window_seconds=900, max_requests=5, buckets=2)
        got = {(r.client, r.ts, r.window_start, r.hits) for r in store.read("refused").collect()}
        # a: window 09:00–09:15 takes hits 6, 7, 8 (09:05, 09:06, 09:14); 09:15 opens a new window
        assert got == want and {(c, h) for c, _, _, h in got} == {("a", 6), ("a", 7), ("a", 8)}
        assert [r.client for r in store.read("windows").collect()] == ["z"] or len(cuts) > 2
        if len(cuts) == 5:
            break


def test_rate_limit_counts_late_requests_in_the_open_window(spark):
    t0 = dt.datetime(2024, 1, 30, 9)
    frames = [spark.createDataFrame([("a", t0 + dt.timedelta(minutes=m)) for m in ms], "client string, ts timestamp_ntz")
              for ms in ([0, 20], [1, 21])]
    store = _limit_stream(spark, frames, window_seconds=900, max_requests=2, buckets=1)
    got = {(r.ts, r.window_start, r.hits) for r in store.read("refused").collect()}
    assert got == {(t0 + dt.timedelta(minutes=21), t0 + dt.timedelta(minutes=20), 3)}


def test_arrivals_after_expiry_as_stream_and_table(spark):
    t0 = dt.datetime(2024, 1, 30, 9)
    rows = [(1, 0), (1, 30), (1, 90), (1, 151), (2, 5), (1, 400), (None, 7), (3, 0), (3, 60)]
    df = spark.createDataFrame([(k, t0 + dt.timedelta(minutes=m)) for k, m in rows], "order_id long, created_at timestamp_ntz")
    want = {(1, 0, 90, 3), (1, 151, 151, 1), (1, 400, 400, 1), (2, 5, 5, 1), (3, 0, 60, 2)}

    def minutes(found):
        return {(r.order_id, (r.arrived_at - t0).seconds // 60, (r.last_seen - t0).seconds // 60, r.sightings) for r in found}

    assert minutes(St.arrivals(df, "1 hour").collect()) == want
    path = _folders(spark, [df, spark.createDataFrame([(9, t0 + dt.timedelta(hours=20))], df.schema)])
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path + "/*")
    _run(St.arrivals(s, "1 hour"), "t2_islands")
    assert minutes(spark.table("t2_islands").filter("order_id < 9").collect()) == want


def test_a_replayed_table_comes_in_batches_of_many_files(spark):
    """Each batch is written and read by as many tasks as make its rows; the batches keep their order and one checkpoint."""
    at = F.when(F.col("id") != 399, F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7919 % 397 * 60))
    rows = spark.range(0, 400, 1, 8).select("id", at.cast("timestamp_ntz").alias("ts"))
    seen = []

    def start(stream, checkpoint):
        def take(batch, number):
            found = batch.withColumn("file", F.input_file_name()).collect()
            seen.append((number, [r.ts for r in found], {r.id for r in found}, {r.file for r in found}))
        return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    replay.run(rows, 3, "ts", start)
    assert [number for number, *_ in seen] == [0, 1, 2]
    assert sorted(i for _, _, ids, _ in seen for i in ids) == list(range(400))
    assert [len(files) for *_, files in seen] == [8, 8, 8]
    times = [sorted(t or dt.datetime.min for t in ts) for _, ts, _, _ in seen]
    assert all(a[-1] < b[0] for a, b in zip(times, times[1:])) and times[0][0] == dt.datetime.min
