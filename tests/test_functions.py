"""Scalar functions, predicates and small operators not covered by a registered query."""

import datetime as dt
from decimal import ROUND_HALF_UP
from decimal import Decimal as D

from frames import tables
from thali.functions import predicates as P
from thali.functions import quality as Q
from thali.functions import scalars as Fx
from thali.operators import joins as J
from thali.operators import ordering as O

def test_line_total_birthday(spark):
    df = spark.createDataFrame([("", 2, D("3.50"), dt.date(1990, 1, 30)), ("x", 0, D("1.00"), None)],
                               "s string, q int, p decimal(10,2), dob date")
    got = df.select(Fx.line_total("q", "p"),
                    Fx.birthday_on("dob", "2024-01-30"), Fx.paise("p")).collect()
    assert [tuple(r) for r in got] == [(D("7.00"), True, 350), (D("0.00"), None, 100)]


def test_unexpired_and_within_hours(spark):
    t = tables(spark)
    live = sorted(r.id for r in t.sessions.filter(P.unexpired("expires_at", "2024-01-30 09:00:00")).collect())
    assert live == [1, 2]
    recent = sorted(r.order_id for r in t.orders.filter(P.within_hours("created_at", "2024-01-30 10:00:00", 24)).collect())
    assert recent == [100, 101]          # 102 is 25 hours old


def test_postgres_null_order_and_oldest_first(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (3, "a")], "k int, v string")
    assert [r.k for r in df.orderBy(O.pg_asc("v")).collect()] == [3, 2, 1]       # NULLs last on ASC
    assert [r.k for r in df.orderBy(O.pg_desc("v")).collect()] == [1, 2, 3]      # NULLs first on DESC
    t = tables(spark)
    assert [r.order_id for r in O.oldest_first(t.orders).collect()] == [103, 102, 100, 101]


def test_semi_and_outer_with_condition(spark):
    t = tables(spark)
    sold = sorted(r.item_id for r in J.semi(t.menu_items, t.order_items, ["item_id"]).collect())
    assert sold == [10, 11, 12]
    cond = (t.menu_items.item_id == t.order_items.item_id) & (t.order_items.quantity > 1)
    j = J.outer_with_condition(t.menu_items, t.order_items, cond)
    assert j.count() == 5 and j.filter(t.order_items.order_id.isNotNull()).count() == 1


def test_not_null_violations(spark):
    t = tables(spark)
    r = Q.not_null_violations(t.customers, ["phone", "dob"]).collect()[0]
    assert (r.phone, r.dob) == (1, 1)


def test_to_fixed_rounds_the_exact_binary_value(spark):
    values = [1.005, 2.675, 0.125, 0.375, 1.0, 0.0, 0.995, 9.995, -1.005, -0.001, 1e-9, 0.5, 1.5, 2.5, 123456789.125, 0.015, 1.45]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 3):
        step = D(1).scaleb(-digits)
        want = [("-" if v < 0 else "") + str(abs(D(v)).quantize(step, rounding=ROUND_HALF_UP)) for v in values]
        assert [r[0] for r in df.select(Fx.fixed("v", digits)).collect()] == want
