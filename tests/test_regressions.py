"""Cases once answered wrongly: NULL statuses, repeated requests, replays, orphans, clashing keys."""

import datetime as dt
import json
import os
from decimal import Decimal as D

from frames import tables
from pyspark.sql import functions as F

from thali.operators import changes as C
from thali.plans import listings as L
from thali.plans import sales as S
from thali.sources import io
from thali.sources.commits import Store
from thali.sources import schema as Sc
from thali.streaming import streams as St

T0 = dt.datetime(2024, 1, 30, 9, 0)


def test_orphan_lines_do_not_hide_real_items(spark):
    t = tables(spark)
    orphans = spark.createDataFrame([(1, 100, 999, 500, D("1.00")), (2, 888, 10, 70, D("1.00"))], Sc.ORDER_ITEMS)
    t.order_items = t.order_items.unionByName(orphans)
    best = S.best_sellers(t, "all", "2024-01-30", 1).collect()
    assert [(r.item_id, r.total_quantity_sold) for r in best] == [(10, 3)]
    per = {r.category: r.total_revenue for r in S.sales_by_category(t, "all", "2024-01-30").filter("category = 'Starters'").collect()}
    assert per == {"Starters": 60.0}
    stray = spark.createDataFrame([(200, 77, "T-1", D("900.00"), "pending", T0)], Sc.ORDERS)
    t.orders = t.orders.unionByName(stray)
    assert [r.customer_id for r in S.top_customers(t, "all", "2024-01-30", 1).collect()] == [1]
    assert [r.order_id for r in L.orders_listing(t, view_type="all", limit=1).collect()] == [101]


def test_null_statuses_are_refused(spark):
    t = tables(spark)
    asks = spark.createDataFrame([(102, 2)], "order_id long, customer_id long")
    t.payments = t.payments.filter("order_id <> 102")
    change = C.cancel_orders(t, asks)
    assert [r.reason for r in change.rejects.collect()] == ["not_pending"]
    assert change["orders"].filter("order_id = 102").count() == 1
    said = spark.createDataFrame([(2, None, 102, 5, "x", T0)],
                                 "customer_id long, item_id long, order_id long, rating int, review_text string, ts timestamp_ntz")
    assert C.rating_reasons(t, said).first().reason == "order_not_completed"


def test_carts_without_an_id_are_rejected_one_by_one(spark, tmp_path):
    with open(tmp_path / "c.json", "w") as f:
        f.write("{oops\n{worse\n" + json.dumps({"customer_id": 1, "table_number": "T-9", "ts": "2024-01-30T10:00:00", "items": []}))
    change = C.ingest_orders(tables(spark).orders, io.read_carts(spark, str(tmp_path)))
    rejects = change.rejects.collect()
    assert [r.reason for r in rejects] == ["missing_cart_id"] * 3
    assert sorted(r._corrupt_record or "" for r in rejects) == ["", "{oops", "{worse"]
    assert change["orders"].count() == 0


def test_a_replay_is_skipped_and_a_taken_table_is_not(spark):
    t = tables(spark)
    line = [(10, 1, D("20.00"))]
    cart = spark.createDataFrame([("a", 1, "T-7", T0, line, None)],
                                 "cart_id string, customer_id long, table_number string, ts timestamp_ntz, "
                                 "items array<struct<item_id: long, quantity: int, price: decimal(10,2)>>, pay_ref string")
    new = C.ingest_orders(t.orders, cart)["orders"]
    again = C.ingest_orders(t.orders.unionByName(new), cart)
    assert again["orders"].count() == 0 and again.rejects.count() == 0
    other = new.withColumn("customer_id", F.lit(3).cast("long"))
    clash = C.ingest_orders(t.orders.unionByName(other), cart)
    assert clash["orders"].count() == 0 and [r.reason for r in clash.rejects.collect()] == ["table_occupied"]


def test_the_last_request_wins_and_primary_keys_stay_unique(spark):
    t = tables(spark)
    early, late = T0, T0 + dt.timedelta(hours=1)
    asks = spark.createDataFrame(
        [(10, "A2", 1, "5", None, late), (10, "A3", 1, "6", None, early), (None, "New", 1, "7", "no", early),
         (None, "New", 1, "7", "no", early)],
        "item_id long, item_name string, category_id int, price string, is_available string, ts timestamp_ntz")
    items = C.upsert_menu_items(t.menu_items, asks)["menu_items"]
    assert [r.item_name for r in items.filter("item_id = 10").collect()] == ["A2"]
    assert items.filter("item_name = 'New'").select("item_id").distinct().count() == 2
    assert items.count() == items.select("item_id").distinct().count() == 7
    names = spark.createDataFrame([(1, "a", early), (1, "b", late), (None, "c", early), (None, "c", late)],
                                  "category_id int, category_name string, ts timestamp_ntz")
    change = C.upsert_categories(t.menu_category, names)["menu_category"]
    assert change.filter("category_id = 1").first().category_name == "b"
    assert change.count() == change.select("category_id").distinct().count() == 4
    dobs = spark.createDataFrame([(1, "1999-01-03", early), (1, "1980-01-01", late)], "customer_id long, dob string, ts timestamp_ntz")
    assert C.set_birth_dates(t.customers, dobs, "2024-01-30")["customers"].filter("customer_id = 1").first().dob == dt.date(1980, 1, 1)


def test_a_payment_is_recorded_once(spark):
    t = tables(spark)
    paid = spark.createDataFrame([(101, 1, "pay_1", T0), (101, 1, "pay_1", T0)],
                                 "order_id long, customer_id long, razorpay_payment_id string, ts timestamp_ntz")
    first = C.record_payments(t.orders, t.payments, paid)
    assert first["payments"].filter("razorpay_payment_id = 'pay_1'").count() == 1
    assert [r.reason for r in first.rejects.collect()] == ["already_recorded"]
    second = C.record_payments(t.orders, first["payments"], paid)
    assert second["payments"].filter("razorpay_payment_id = 'pay_1'").count() == 1


def test_first_payment_goes_by_time(spark):
    t = tables(spark)
    pays = t.payments.withColumn("payment_id", F.when(F.col("payment_id") == 5, 1).otherwise(F.col("payment_id"))) \
        .withColumn("created_at", F.when(F.col("payment_id") == 1, F.lit(T0 + dt.timedelta(days=9))).otherwise(F.col("created_at")))
    assert C.first_payment_status(pays).filter("order_id = 102").first().first_payment_status == "completed"


def test_admins_keep_their_newest_session(spark):
    rows = [("a", None, None, None, T0, T0 + dt.timedelta(days=9), None, 1, 5),
            ("b", None, None, None, T0 + dt.timedelta(hours=1), T0 + dt.timedelta(days=9), None, 2, 5),
            ("c", 5, None, None, T0, T0 + dt.timedelta(days=9), None, 3, None)]
    kept = C.purge_sessions(spark.createDataFrame(rows, Sc.SESSIONS), "2024-01-30 12:00:00")["sessions"]
    assert sorted(r.id for r in kept.collect()) == [2, 3]


def run_stream(spark, frame, query, tmp_path, mode="append", files=None):
    source = str(tmp_path / "in")
    for i, part in enumerate(files or [frame]):
        part.coalesce(1).write.mode("append").parquet(source)
        name = sorted(os.listdir(source))[-1]
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = query(stream).writeStream.outputMode(mode).format("memory").queryName("out").option(
        "checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table("out").collect(), name


def test_stream_counts_attempts_for_the_whole_lifetime(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    rows = [("A", day, day + dt.timedelta(minutes=1)), ("B", day + dt.timedelta(hours=5), day + dt.timedelta(hours=5, minutes=1)),
            ("A", day, day + dt.timedelta(hours=6)), ("A", day, day + dt.timedelta(hours=7)),
            ("Z", day + dt.timedelta(days=9), day + dt.timedelta(days=9, minutes=1))]
    frames = [spark.createDataFrame([r], "key string, issued_at timestamp, ts timestamp") for r in rows]
    got, _ = run_stream(spark, frames[0], lambda s: St.attempt_limits(s, max_attempts=2, lifetime="1 day"), tmp_path, files=frames)
    assert [(r.key, r.attempts) for r in got] == [("A", 3)]


def test_stream_keeps_large_ids(spark, tmp_path):
    big = 2**53 + 1
    kinds = "id long, customer_id long, created_at timestamp, expires_at timestamp, event_id long, event_type string, ts timestamp"
    rows = spark.createDataFrame([(big, 1, T0, T0 + dt.timedelta(days=1), None, None, None),
                                  (None, 1, None, None, big + 2, "view", T0 + dt.timedelta(hours=1)),
                                  (big + 6, 2, T0 + dt.timedelta(days=3), T0 + dt.timedelta(days=4), None, None, None),
                                  (None, 2, None, None, big + 4, "view", T0 + dt.timedelta(days=3))], kinds)

    def query(s):
        return St.valid_session_activity(s.filter("id is not null"), s.filter("event_id is not null"))

    got, _ = run_stream(spark, rows, query, tmp_path)
    assert [(r.session_pk, r.event_id) for r in got] == [(big, big + 2)]


def test_a_batch_without_times_leaves_its_rejects(spark, tmp_path):
    carts, out = tmp_path / "carts", str(tmp_path / "out")
    os.makedirs(carts)
    tables(spark).orders.write.parquet(str(tmp_path / "orders"))
    with open(carts / "a.json", "w") as f:
        f.write(json.dumps({"cart_id": "x", "customer_id": 1, "table_number": "T-9", "items": []}) + "\n{oops\n")
    for _ in range(2):
        q = St.ingest_stream(io.read_carts(spark, str(carts), stream=True), str(tmp_path / "orders"), out, str(tmp_path / "ck"),
                             trigger={"availableNow": True})
        q.awaitTermination(120)
        with open(carts / "b.json", "w") as f:
            f.write(json.dumps({"cart_id": "y", "customer_id": 1, "table_number": "T-9", "ts": "2024-02-03T10:00:00",
                                "items": [{"item_id": 10, "quantity": 1, "price": 20.0}]}) + "\n")
    rejects = St.ingested(spark, out, "rejects").collect()
    assert sorted(r.reason for r in rejects) == ["empty_cart", "missing_cart_id"]
    assert [(r.order_id, r.table_number) for r in St.ingested(spark, out, "orders").collect()] == [(104, "T-9")]
    store = Store(spark, out)
    assert [store.manifest(n)["batch"] for n in store.commits()] == [0, 1]
    assert [f.split("/")[2] for f in store.files("orders")] == ["month=2024-02"]


def test_admin_profiles(spark):
    t = tables(spark)
    asks = spark.createDataFrame([(1, "boss", "c@example.com"), (2, "boss", None), (1, "", None), (2, "cook", "c@example.com"),
                                  (3, "new", "")], Sc.ADMINS)
    got = sorted((r.admin_id, r.username, r.reason) for r in C.admin_profile_reasons(t.admins, asks).collect())
    assert got == sorted([(1, "boss", "email_taken"), (2, "boss", "username_taken"), (1, "", "missing_username"),
                          (2, "cook", None), (3, "new", None)], key=lambda x: (x[0], x[1]))


def test_parameters_are_read_like_parse_int():
    from thali.operators.ordering import param_int

    assert [param_int(x, 10) for x in (None, "", "0", "12abc", " 7", "x3", "-2", 5, "3.9")] == [10, 10, 10, 12, 7, 10, -2, 5, 3]
