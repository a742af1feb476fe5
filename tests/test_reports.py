"""Reports and listings on tiny frames: quirks Q1–Q12, NULL / empty / tie cases."""

import datetime as dt


from frames import tables
from thali.functions import scalars as Fx
from thali.operators.ordering import param_int
from thali.plans import admin as A
from thali.plans import listings as L
from thali.plans import sales as S

AS_OF = "2024-01-30"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_best_sellers_revenue_and_tie_break(spark):
    t = tables(spark)
    out = S.best_sellers(t, "all", AS_OF, 2).collect()
    # items 10 and 11 both sold 3; the tie is cut by item_id
    assert [(r.item_id, r.total_quantity_sold) for r in out] == [(10, 3), (11, 2)]
    cats = {r.item_id: r.category for r in S.best_sellers(t, "all", AS_OF, 10).collect()}
    assert cats[11] == "Uncategorized" and cats[12] == "Uncategorized"


def test_best_sellers_period_today(spark):
    t = tables(spark)
    out = {r.item_id: r.total_quantity_sold for r in S.best_sellers(t, "today", AS_OF, 10).collect()}
    assert out == {10: 2, 11: 2}


def test_worst_sellers_ignores_period_q1(spark):
    t = tables(spark)
    faithful = {r.item_id: r.total_quantity_sold for r in S.worst_sellers(t, "today", AS_OF, 10).collect()}
    assert faithful == {10: 3, 11: 2, 12: 1, 13: 0}   # 14 unavailable, 13 never sold
    corrected = {r.item_id: r.total_quantity_sold
                 for r in S.worst_sellers(t, "today", AS_OF, 10, corrected=True).collect()}
    assert corrected == {10: 2, 11: 2, 12: 0, 13: 0}


def test_sales_by_category_two_uncategorized_rows_q2(spark):
    t = tables(spark)
    out = rows(S.sales_by_category(t, "all", AS_OF), "category", "total_revenue")
    assert out == [("Starters", 60.0), ("Uncategorized", 60.0), ("Uncategorized", 80.0)]
    fixed = rows(S.sales_by_category(t, "all", AS_OF, corrected=True), "category", "total_revenue")
    assert fixed == [("Starters", 60.0), ("Uncategorized", 140.0)]


def test_payment_method_mix_null_and_fanout_q2_q3(spark):
    t = tables(spark)
    out = rows(S.payment_method_mix(t, "all", AS_OF), "payment_method", "total_amount")
    # order 100 counted twice (two cash payments) + 102 once under cash; NULL method → second 'cash' row
    # raw 'cash': 100 twice (two payments) + 102; raw NULL: 101 + 103 (no payment) → a second 'cash' row
    assert out == [("cash", 60.0), ("cash", 220.0), ("razorpay", 60.0)]
    fixed = rows(S.payment_method_mix(t, "all", AS_OF, corrected=True), "payment_method", "total_amount")
    assert fixed == [("cash", 200.0)]   # each order once, under its latest payment


def test_overview_counts_all_statuses_q4(spark):
    t = tables(spark)
    r = S.sales_overview(t.orders, "all", AS_OF).collect()[0]
    assert (r.total_orders, r.total_customers, r.total_revenue) == (4, 3, 200.0)
    assert r.avg_order_value == 50.0
    empty = S.sales_overview(t.orders.filter("false"), "all", AS_OF).collect()[0]
    assert (empty.total_orders, empty.total_revenue, empty.avg_order_value) == (0, 0.0, 0.0)


def test_dashboard_completed_revenue_only(spark):
    t = tables(spark)
    r = A.dashboard_stats(t, AS_OF).collect()[0]
    assert r.totalOrders == 4 and r.todayOrders == 2 and r.totalRevenue == 80.0
    assert r.pendingOrders == 1 and r.totalCustomers == 3


def test_revenue_trend_sparse_and_spine_q9(spark):
    t = tables(spark)
    sparse = rows(S.revenue_trend(t.orders, AS_OF, 3), "date", "revenue")
    assert sparse == [(dt.date(2024, 1, 29), 60.0), (dt.date(2024, 1, 30), 120.0)]
    spine = S.revenue_trend(t.orders, AS_OF, 3, corrected=True).collect()
    assert len(spine) == 4 and spine[0].revenue == 0.0


def test_orders_listing_active_drops_null_status_p7_and_fans_out(spark):
    t = tables(spark)
    out = L.orders_listing(t, view_type="active", limit=50, as_of=AS_OF).collect()
    ids = sorted(r.order_id for r in out)
    assert ids == [101, 103]            # 100 completed, 102 NULL status
    archive = L.orders_listing(t, view_type="old", limit=50, as_of=AS_OF).collect()
    by_id = {}
    for r in archive:
        by_id.setdefault(r.order_id, []).append(r)
    assert len(by_id[102]) == 2         # two payments with different fields → two rows
    assert len(by_id[100]) == 1 and len(by_id[100][0]["items"]) == 4   # equal payments → items twice


def test_nested_items_sorted_nulls_last_and_empty(spark):
    t = tables(spark)
    extra = spark.createDataFrame([(104, 3, "T-4", None, "pending", dt.datetime(2024, 1, 30, 10))], t.orders.schema)
    t2 = tables(spark, orders=t.orders.unionByName(extra))
    out = {r.order_id: r["items"] for r in L.customer_orders_nested(t2).collect()}
    assert out[104] == []
    assert [i.item_name for i in out[100]] == ["Lassi", "Lassi", "Samosa", "Samosa"]


def test_menu_with_ratings_inner_category_q12(spark):
    t = tables(spark)
    out = {r.item_id: (r.avg_rating, r.rating_count) for r in A.menu_with_ratings(t).collect()}
    assert 11 not in out and 14 not in out
    assert out[10] == (4.5, 2) and out[13] == (0.0, 0)


def test_round_half_up_exact(spark):
    df = spark.createDataFrame([(7, 2), (1, 3), (0, 0)], "s long, n long")
    got = [r[0] for r in df.select(Fx.round_half_up_ratio("s", "n", 1)).collect()]
    assert got == [3.5, 0.3, None]


def test_recent_reviews_masks_and_skips_empty(spark):
    t = tables(spark)
    out = A.recent_reviews(t, 10, 0).collect()
    assert [r.rating_id for r in out] == [1, 4]
    assert out[0].masked_phone == "98XXXXXX10" and out[1].masked_phone is None


def test_table_availability_and_map(spark):
    t = tables(spark)
    av = {r.table_number: (r.occupied, r.available) for r in A.table_availability(t.orders, AS_OF).collect()}
    assert av["T-2"] == (True, False) and av["T-1"] == (False, True)
    m = A.status_map(A.table_availability(t.orders, AS_OF)).collect()[0].tableStatus
    assert m["T-2"] is False and m["T-5"] is True


def test_kitchen_queue_oldest_first(spark):
    t = tables(spark)
    out = L.kitchen_queue(t, t.orders, "2024-01-30 09:25:30").collect()
    assert [r.order_id for r in out] == [101]
    r = out[0]
    assert r.timer == "25:30" and r.age_class == "urgent" and r.table_label == "2"


def test_customer_report_average_q7(spark):
    t = tables(spark)
    out = {r.customer_id: r for r in L.customer_report_stats(t).collect()}
    assert out[1].total_orders == 2 and out[1].total_spent == 80.0 and out[1].avg_spent == 40.0
    assert out[3].initials == "CD"


def test_param_defaults_o6():
    assert param_int(None, 10) == 10 and param_int("abc", 10) == 10 and param_int("0", 10) == 10
    assert param_int("5", 10) == 5
