"""Physical layouts: partitioned by month (pruning) and bucketed by join key (no shuffle)."""

import tempfile

from conftest import SF_SMALL
from thali.plans import listings as L
from thali.plans import sales as S
from thali.sources import layout
from thali.sources.model import ORDERS_AS_OF, load


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_partitioned_layout_prunes_and_matches(spark):
    t = load(spark, SF_SMALL)
    out = tempfile.mkdtemp(prefix="thali-layout-")
    layout.write_partitioned(t, out)
    p = layout.load_partitioned(spark, out)
    for period in ("today", "week", "month"):
        assert _same(S.best_sellers(p, period, ORDERS_AS_OF, 10), S.best_sellers(t, period, ORDERS_AS_OF, 10))
        assert _same(S.sales_overview(p.orders, period, ORDERS_AS_OF), S.sales_overview(t.orders, period, ORDERS_AS_OF))
    plan = _plan(S.best_sellers(p, "month", ORDERS_AS_OF, 10))
    assert "PartitionFilters: [isnotnull(order_month" in plan
    assert "/orders]" not in plan and "LeftSemi" not in plan          # lines alone: no join to orders
    assert _same(S.payment_method_mix(p, "week", ORDERS_AS_OF), S.payment_method_mix(t, "week", ORDERS_AS_OF))


def test_bucketed_layout_joins_without_shuffle(spark):
    t = load(spark, SF_SMALL)
    wh = tempfile.mkdtemp(prefix="thali-wh-")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        db = "thali_bucketed_test"
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {db} LOCATION '{wh}'")
        layout.write_bucketed(t, db, 4)
        b = layout.load_bucketed(spark, db)
        j = b.order_items.join(b.orders, "order_id").join(b.payments, "order_id")
        plan = _plan(j)
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert _same(L.with_items_text(L.customer_orders_nested(b)), L.with_items_text(L.customer_orders_nested(t)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
