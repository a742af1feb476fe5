"""Change jobs D1–D15 and quality rules V1–V8: accept and reject sides, NULL keys, idempotency."""

import datetime as dt
from decimal import Decimal as D


from frames import tables
from pyspark.sql import functions as F

from thali.functions import quality as Q
from thali.operators import changes as C
from thali.sources import schema as S

AS_OF = "2024-01-30"


def test_phone_and_name_rules(spark):
    df = spark.createDataFrame([("98765 43210", "Asha Rao"), ("5876543210", "A"), (None, "R2D2"), ("12345", " Bo ")],
                               "phone string, name string")
    got = [(r[0], r[1]) for r in df.select(Q.phone_ok("phone"), Q.name_ok("name")).collect()]
    assert got == [(True, True), (False, False), (False, False), (False, True)]


def test_dob_reasons_v4(spark):
    texts = ["", "30-01-2000", "2001-02-30", "2030-01-01", "2011-01-31", "2011-01-30", "1904-01-30",
             "1903-01-29", "2004-02-29", None]
    df = spark.createDataFrame([(x,) for x in texts], "dob string")
    got = [r[0] for r in df.select(Q.dob_reason("dob", AS_OF)).collect()]
    assert got == ["required", "bad_format", "invalid_date", "future", "too_young", None, None,
                   "too_old", None, "required"]


def test_cart_reasons_v6(spark):
    line = "struct<item_id:bigint,quantity:int,price:decimal(10,2)>"
    df = spark.createDataFrame([
        ([], "T-1"), ([(1, 1, D("2.00"))], " "), ([(1, 1, D("0.00"))], "T-1"), ([(1, 2, D("2.00"))], "T-1")],
        f"items array<{line}>, t string")
    got = [r[0] for r in df.select(Q.cart_reason("items", "t")).collect()]
    assert got == ["empty_cart", "missing_table", "invalid_item", None]


def _carts(spark, rows):
    return spark.createDataFrame(rows, S.CART)


def test_ingest_orders_rules_and_totals(spark):
    t = tables(spark)
    ts = dt.datetime(2024, 1, 30, 12)
    good = [(10, 2, D("20.00")), (11, 1, D("40.00"))]
    carts = _carts(spark, [
        ("c1", 1, "T-3", ts, good, None),                      # accepted, cash
        ("c2", 2, "T-3", ts + dt.timedelta(minutes=1), good, "pay_1"),  # same table later → occupied
        ("c3", 2, "T-2", ts, good, None),                      # T-2 has an open order today
        ("c4", 3, "T-4", ts, [], None),                        # empty
        ("c5", 3, None, ts, good, None),                       # missing table
        ("c6", 3, "T-5", ts, [(10, 1, D("0.00"))], None),      # price 0
        ("c1", 1, "T-3", ts + dt.timedelta(hours=1), good, None),  # repeated cart id: first copy wins
        ("c7", 3, "T-4", ts, good, "pay_7"),                   # accepted, online
    ])
    ch = C.ingest_orders(t.orders, carts)
    orders = {r.table_number: r for r in ch["orders"].collect()}
    assert set(orders) == {"T-3", "T-4"} and orders["T-3"].total_amount == D("80.00")
    reasons = {r.cart_id: r.reason for r in ch.rejects.collect()}
    assert reasons == {"c2": "table_occupied", "c3": "table_occupied", "c4": "empty_cart",
                       "c5": "missing_table", "c6": "invalid_item"}
    pays = {r.payment_method: r.payment_status for r in ch["payments"].collect()}
    assert pays == {"cash": "pending", "razorpay": "completed"}
    assert ch["order_items"].count() == 4
    # idempotent: the same carts against the new snapshot add nothing
    again = C.ingest_orders(t.orders.unionByName(ch["orders"]), carts)
    assert again["orders"].count() == 0


def test_status_updates_last_wins_and_rejects(spark):
    t = tables(spark)
    u = spark.createDataFrame([
        (101, "preparing", dt.datetime(2024, 1, 30, 9, 5)),
        (101, "ready", dt.datetime(2024, 1, 30, 9, 10)),
        (101, "served", dt.datetime(2024, 1, 30, 9, 20)),
        (999, "ready", dt.datetime(2024, 1, 30, 9, 20))], S.STATUS_UPDATES)
    ch = C.apply_status_updates(t.orders, u)
    st = {r.order_id: r.status for r in ch["orders"].collect()}
    assert st[101] == "ready" and st[100] == "completed" and st[102] is None
    assert sorted((r.order_id, r.reason) for r in ch.rejects.collect()) == [(101, "invalid_status"), (999, "unknown_order")]


def test_mark_paid_upsert_and_idempotent(spark):
    t = tables(spark)
    marks = spark.createDataFrame([(101,), (103,), (555,), (None,)], "order_id long")
    ch = C.mark_paid(t.orders, t.payments, marks, AS_OF)
    p = ch["payments"]
    by_order = {}
    for r in p.collect():
        by_order.setdefault(r.order_id, []).append((r.payment_status, r.payment_method))
    assert by_order[101] == [("completed", "cash")]
    assert by_order[103] == [("completed", "cash")]          # inserted
    assert sorted(by_order[102]) == [("completed", "razorpay"), ("pending", "cash")]
    assert [r.order_id for r in ch.rejects.collect()] == [555]
    twice = C.mark_paid(t.orders, p, marks, AS_OF)["payments"]
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, p.collect()))


def test_delete_orders_leaves_no_orphans_v7(spark):
    t = tables(spark)
    ch = C.delete_orders(t, spark.createDataFrame([(100,), (777,)], "order_id long"))
    from thali.sources.model import from_frames
    t2 = from_frames(spark, customers=t.customers, menu_category=t.menu_category, menu_items=t.menu_items,
                     orders=ch["orders"], order_items=ch["order_items"], payments=ch["payments"],
                     ratings=ch["ratings"], sessions=t.sessions, admins=t.admins)
    orphans = {r.fk: r.orphans for r in Q.fk_orphans(t2).collect()}
    assert orphans["order_items.order_id"] == 0 and orphans["payments.order_id"] == 0
    assert orphans["ratings.order_id"] == 0
    assert orphans["menu_items.category_id"] == 0
    assert [r.order_id for r in ch.rejects.collect()] == [777]


def test_guarded_deletes_d6(spark):
    t = tables(spark)
    ch = C.guarded_delete_items(t.menu_items, t.order_items, spark.createDataFrame([(10,), (13,), (99,)], "item_id long"))
    assert sorted(r.item_id for r in ch["menu_items"].collect()) == [10, 11, 12, 14]
    assert sorted((r.item_id, r.reason) for r in ch.rejects.collect()) == [(10, "in_orders"), (99, "not_found")]
    cats = C.guarded_delete_categories(t.menu_category, t.menu_items, spark.createDataFrame([(1,), (3,)], "category_id int"))
    assert sorted((r.category_id, r.reason) for r in cats.rejects.collect()) == [(1, "has_items"), (3, "not_found")]


def test_cancel_orders_d10(spark):
    t = tables(spark)
    req = spark.createDataFrame([(101, 1), (101, 2), (100, 1), (999, 1)], "order_id long, customer_id long")
    ch = C.cancel_orders(t, req)
    reasons = sorted((r.order_id, r.customer_id, r.reason) for r in ch.rejects.collect())
    assert reasons == [(100, 1, "not_pending"), (101, 2, "not_found"), (999, 1, "not_found")]
    assert 101 not in [r.order_id for r in ch["orders"].collect()]


def test_dedupe_ratings_null_keys_never_collide_d7(spark):
    t = tables(spark)
    kept = sorted(r.rating_id for r in C.dedupe_ratings(t.ratings)["ratings"].collect())
    assert kept == [1, 3, 4]   # rating 2 repeats (customer 1, item 10)


def test_rating_eligibility_d8(spark):
    t = tables(spark)
    subs = spark.createDataFrame([
        (1, 10, None, 5, "x", dt.datetime(2024, 1, 30, 13)),   # already rated item 10
        (1, 11, None, 4, "x", dt.datetime(2024, 1, 30, 13)),   # ordered 11 in completed 100 → ok
        (1, 12, None, 4, "x", dt.datetime(2024, 1, 30, 13)),   # never ordered
        (1, 99, None, 4, "x", dt.datetime(2024, 1, 30, 13)),   # unknown item
        (2, None, 100, 3, "x", dt.datetime(2024, 1, 30, 13)),  # foreign order
        (1, None, 101, 3, "x", dt.datetime(2024, 1, 30, 13)),  # own, pending
        (1, None, None, 6, "x", dt.datetime(2024, 1, 30, 13)),  # rating out of range
        (3, None, None, 3, "x", dt.datetime(2024, 1, 30, 13)),  # no target
    ], S.RATING_SUBMISSIONS)
    got = [r.reason for r in C.rating_reasons(t, subs).orderBy("item_id", "order_id", "rating").collect()]
    assert sorted(got, key=str) == sorted(["already_rated", None, "not_ordered", "unknown_item", "order_not_found",
                                           "order_not_completed", "bad_rating", "missing_target"], key=str)
    ch = C.eligible_ratings(t, subs)
    assert ch["ratings"].count() == t.ratings.count() + 1


def test_purge_sessions_d11(spark):
    t = tables(spark)
    kept = sorted(r.id for r in C.purge_sessions(t.sessions, "2024-01-30 09:00:00")["sessions"].collect())
    assert kept == [2]    # 1 is older for the same owner, 3 expired


def test_upserts_d12_d13(spark):
    t = tables(spark)
    req = spark.createDataFrame([
        (10, "Samosa XL", 1, "25.50", "TRUE"), (None, " Chai ", 1, " 10abc", None), (11, "Lassi", 1, "abc", "no"),
        (None, "", 1, "5", "true"), (77, "Ghost", 1, "5", "true")], S.MENU_ITEM_REQUESTS)
    ch = C.upsert_menu_items(t.menu_items, req)
    items = {r.item_name: r for r in ch["menu_items"].collect()}
    assert items["Samosa XL"].price == D("25.50") and items["Samosa XL"].is_available is True
    assert items["Chai"].is_available is True and items["Chai"].price == D("10.00") and "Samosa" not in items
    assert sorted(r.reason for r in ch.rejects.collect()) == ["bad_price", "missing_field", "not_found"]
    cats = C.upsert_categories(t.menu_category, spark.createDataFrame(
        [(1, " Snacks "), (None, "Drinks"), (None, "  "), (9, "X")], "category_id int, category_name string"))
    names = sorted(r.category_name for r in cats["menu_category"].collect())
    assert names == ["Drinks", "Snacks", "Uncategorized"]
    assert sorted(r.reason for r in cats.rejects.collect()) == ["missing_name", "not_found"]


def test_birth_dates_d14_and_payments_d15(spark):
    t = tables(spark)
    ch = C.set_birth_dates(t.customers, spark.createDataFrame(
        [(2, "1999-12-31"), (3, "2020-01-01"), (8, "1990-01-01")], "customer_id long, dob string"), AS_OF)
    dob = {r.customer_id: r.dob for r in ch["customers"].collect()}
    assert dob[2] == dt.date(1999, 12, 31) and dob[3] == dt.date(2000, 2, 29)
    assert sorted(r.reason for r in ch.rejects.collect()) == ["not_found", "too_young"]
    pay = C.record_payments(t.orders, t.payments, spark.createDataFrame(
        [(101, 1, "pay_a", dt.datetime(2024, 1, 30, 9, 1)), (101, 2, "pay_b", dt.datetime(2024, 1, 30, 9, 1)),
         (555, 1, "pay_c", dt.datetime(2024, 1, 30, 9, 1)), (101, 1, None, dt.datetime(2024, 1, 30, 9, 1))],
        "order_id long, customer_id long, razorpay_payment_id string, ts timestamp"))
    assert pay["payments"].count() == t.payments.count() + 1
    assert sorted(r.reason for r in pay.rejects.collect()) == ["missing_field", "not_found", "unauthorized"]


def test_duplicate_keys_d9(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "phone string")
    assert [(r.phone, r.n) for r in Q.duplicate_keys(df, ["phone"]).collect()] == [("a", 2)]


def test_delete_ratings_and_end_sessions(spark):
    t = tables(spark)
    ch = C.delete_ratings(t.ratings, spark.createDataFrame([(2,), (99,)], "rating_id long"))
    assert sorted(r.rating_id for r in ch["ratings"].collect()) == [1, 3, 4]
    assert [(r.rating_id, r.reason) for r in ch.rejects.collect()] == [(99, "not_found")]
    s = C.end_sessions(t.sessions, spark.createDataFrame([("a",), ("zz",)], "session_id string"))["sessions"]
    assert sorted(r.session_id for r in s.collect()) == ["b", "c"]


def test_register_customers(spark):
    t = tables(spark)
    req = spark.createDataFrame([
        ("Dev Patel", "98111 22334", dt.datetime(2024, 1, 30, 10)),     # digits only → valid
        ("Dev Two", "9811122334", dt.datetime(2024, 1, 30, 11)),       # same phone later → duplicate
        ("Asha Again", "9876543210", dt.datetime(2024, 1, 30, 10)),    # phone of customer 1 → exists
        ("X", "9000000001", dt.datetime(2024, 1, 30, 10)),             # bad name
        ("Good Name", "12345", dt.datetime(2024, 1, 30, 10)),          # bad phone
    ], "name string, phone string, ts timestamp")
    ch = C.register_customers(t.customers, req)
    new = ch["customers"].filter(~F.col("customer_id").isin(1, 2, 3)).collect()
    assert [(r.name, r.phone) for r in new] == [("Dev Patel", "9811122334")]
    assert sorted(r.reason for r in ch.rejects.collect()) == ["bad_name", "bad_phone", "duplicate", "exists"]


def test_price_mismatches_q8(spark):
    t = tables(spark)
    ts = dt.datetime(2024, 1, 30, 12)
    carts = _carts(spark, [("c1", 1, "T-3", ts, [(10, 1, D("20.00")), (11, 1, D("35.00")), (99, 1, D("1.00"))], None)])
    got = sorted((r.pos, r.item_id, r.cart_price, r.menu_price) for r in C.price_mismatches(carts, t.menu_items).collect())
    assert got == [(1, 11, D("35.00"), D("40.00")), (2, 99, D("1.00"), None)]
