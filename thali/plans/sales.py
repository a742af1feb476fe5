"""Sales reports.

Plan shape shared by the item reports: lines are reduced to one row per item
by a partial+final hash aggregate *before* any dimension join, so the joins
see one row per item instead of one per line, and a hot item costs one row
per map partition (map-side combine). A period filter is applied to `orders`
first and enters as a semi-join, which also drops lines without an order, as the
reference's inner join does. Parquet enforces no foreign keys; where they are known to
hold (``quality.fk_orphans``), ``check_fk=False`` skips joins that would drop nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thali.functions.predicates import as_date, as_timestamp, period_predicate, period_filter, ts_literal
from thali.functions.scalars import hour_of, money, to_day
from thali.operators.ordering import param_int, top_k
from thali.sources.model import Tables

import datetime as dt


def lines_in_period(t: Tables, period: str | None, as_of, check_fk: bool = True) -> DataFrame:
    """Order lines whose order falls in the period (inner join to orders, as a semi-join).

    On the partitioned layout, lines carry their order's time
    (``order_created_at``, written once by ``thali.sources.layout``), so the
    period becomes a partition-pruned filter on the lines and no join is needed.
    """
    lines = t.order_items.select("order_id", "item_id", "quantity", "price")
    pred = period_predicate("created_at", period, as_of)
    if "order_created_at" in t.order_items.columns:
        # written from the join with orders: a line has a time if its order exists
        return period_filter(t.order_items, "order_created_at", period, as_of) \
            .filter(F.col("order_created_at").isNotNull()).select("order_id", "item_id", "quantity", "price")
    if pred is None and not check_fk:
        return lines
    orders = t.orders.select("order_id", "created_at")
    if pred is not None:
        orders = orders.filter(pred)
    return lines.join(orders.select("order_id"), "order_id", "left_semi")


def item_sales(lines: DataFrame) -> DataFrame:
    """One row per item: quantity and revenue (decimal, exact)."""
    return lines.groupBy("item_id").agg(
        F.sum("quantity").alias("total_quantity_sold"),
        F.sum(F.col("quantity") * F.col("price")).alias("total_revenue"))


def best_sellers(t: Tables, period: str | None = "all", as_of=None, limit: int | str | None = 10,
                 check_fk: bool = True) -> DataFrame:
    """R2: items by quantity sold in the period, with revenue and category; top `limit`.

    Sold items meet the menu first (inner join, one row per item), then the top `limit` is
    cut, and only that meets the categories: a left join on their key cannot drop or add rows.
    """
    limit = param_int(limit, 10)
    sales = item_sales(lines_in_period(t, period, as_of, check_fk))
    order = [F.col("total_quantity_sold").desc_nulls_first(), F.col("item_id").asc()]
    if not check_fk:
        # every sold item is known to exist: the cut comes first and menu_items is only probed
        sales = F.broadcast(top_k(sales.filter(F.col("item_id").isNotNull()), order, limit))
    sold = top_k(t.menu_items.join(sales, "item_id"), order, limit)
    rows = sold.join(t.menu_category, "category_id", "left").select(
        "item_id", F.col("item_name").alias("name"), money("price").alias("price"),
        F.coalesce("category_name", F.lit("Uncategorized")).alias("category"), "image_url",
        F.col("total_quantity_sold").cast("long").alias("total_quantity_sold"),
        money("total_revenue").alias("total_revenue"))
    return top_k(rows, [F.col("total_quantity_sold").desc_nulls_first(), F.col("item_id").asc()], limit)


def worst_sellers(t: Tables, period: str | None = "all", as_of=None, limit: int | str | None = 10,
                  corrected: bool = False) -> DataFrame:
    """Available items by quantity ascending; never-sold items count 0.

    Faithful (Q1): the reference puts the date test in the ON clause of an
    outer-joined `orders`, so the sums are all-time whatever the period.
    ``corrected=True`` counts only lines of orders in the period.
    """
    limit = param_int(limit, 10)
    # faithful: orders are outer-joined, so a line without an order counts
    lines = lines_in_period(t, period if corrected else None, as_of, check_fk=corrected)
    sales = item_sales(lines)
    sold = F.coalesce("total_quantity_sold", F.lit(0))
    items = top_k(t.menu_items.filter(F.col("is_available")).join(sales, "item_id", "left"),
                  [sold.asc(), F.col("item_id").asc()], limit)
    rows = items.join(t.menu_category, "category_id", "left").select(
        "item_id", F.col("item_name").alias("name"), money("price").alias("price"),
        F.coalesce("category_name", F.lit("Uncategorized")).alias("category"), "image_url",
        F.coalesce("total_quantity_sold", F.lit(0)).cast("long").alias("total_quantity_sold"),
        money(F.coalesce("total_revenue", F.lit(0))).alias("total_revenue"))
    return top_k(rows, [F.col("total_quantity_sold").asc_nulls_last(), F.col("item_id").asc()], limit)


def sales_by_category(t: Tables, period: str | None = "all", as_of=None, corrected: bool = False) -> DataFrame:
    """Revenue per category name.

    Faithful (Q2, Q5): grouped by the raw category name, so NULL and a real
    'Uncategorized' give two rows with one label and same-named categories merge.
    ``corrected=True`` groups by the label.
    """
    sales = item_sales(lines_in_period(t, period, as_of)).select("item_id", "total_revenue")
    per_item = sales.join(t.menu_items.select("item_id", "category_id"), "item_id")
    named = per_item.join(t.menu_category, "category_id", "left")
    label = F.coalesce("category_name", F.lit("Uncategorized"))
    if corrected:
        out = named.groupBy(label.alias("category")).agg(F.sum("total_revenue").alias("total_revenue"))
    else:
        out = named.groupBy("category_name").agg(F.sum("total_revenue").alias("total_revenue")) \
            .select(label.alias("category"), "total_revenue")
    return out.select("category", money("total_revenue").alias("total_revenue")) \
        .orderBy(F.col("total_revenue").desc_nulls_first(), F.col("category").asc_nulls_last())


def revenue_trend(orders: DataFrame, as_of=None, days: int | str | None = 7, corrected: bool = False) -> DataFrame:
    """Revenue per day since as_of - days (faithful: days without orders are absent, Q9).

    ``corrected=True`` fills the missing days with 0 from a date spine.
    """
    days = param_int(days, 7)
    start = as_timestamp(as_date(as_of)) - dt.timedelta(days=days)
    recent = orders.filter(F.col("created_at") >= ts_literal(start))
    out = recent.groupBy(to_day("created_at").alias("date")).agg(
        F.coalesce(F.sum("total_amount"), F.lit(0)).alias("revenue"))
    if corrected:
        spark = orders.sparkSession
        spine = spark.range(1).select(F.explode(F.sequence(
            F.lit(start.date()), F.lit(as_date(as_of)))).alias("date"))
        out = spine.join(out, "date", "left").select("date", F.coalesce("revenue", F.lit(0)).alias("revenue"))
    return out.select("date", money("revenue").alias("revenue")).orderBy("date")


def payment_method_mix(t: Tables, period: str | None = "all", as_of=None, corrected: bool = False) -> DataFrame:
    """Order amount per payment method; an order with no payment counts as 'cash'.

    Faithful: grouped by the raw method (Q2: NULL and 'cash' are two rows) and
    an order with several payments is counted once per payment (Q3).
    ``corrected=True`` groups by the label and counts each order once, under
    its latest payment.
    """
    orders = period_filter(t.orders.select("order_id", "total_amount", "created_at"), "created_at", period, as_of)
    pays = t.payments.select("order_id", "payment_method", "payment_id", "created_at")
    if corrected:
        pays = pays.groupBy("order_id").agg(
            F.max_by("payment_method", F.struct("created_at", "payment_id")).alias("payment_method"))
    pays = pays.select("order_id", "payment_method")
    joined = orders.join(pays, "order_id", "left")
    label = F.coalesce("payment_method", F.lit("cash"))
    if corrected:
        out = joined.groupBy(label.alias("payment_method")).agg(
            F.coalesce(F.sum("total_amount"), F.lit(0)).alias("total_amount"))
    else:
        out = joined.groupBy(F.col("payment_method").alias("raw")).agg(
            F.coalesce(F.sum("total_amount"), F.lit(0)).alias("total_amount")) \
            .select(F.coalesce("raw", F.lit("cash")).alias("payment_method"), "total_amount")
    return out.select("payment_method", money("total_amount").alias("total_amount")) \
        .orderBy(F.col("total_amount").desc_nulls_first())


def peak_hours(orders: DataFrame, period: str | None = "week", as_of=None) -> DataFrame:
    """Orders per hour of day; the default period is a week."""
    recent = period_filter(orders.select("created_at"), "created_at", period or "week", as_of)
    return recent.groupBy(hour_of("created_at").alias("hour")).agg(
        F.count(F.lit(1)).alias("order_count")).orderBy("hour")


def sales_overview(orders: DataFrame, period: str | None = "all", as_of=None) -> DataFrame:
    """Orders, distinct customers, revenue and average order value; all statuses (Q4)."""
    o = period_filter(orders.select("customer_id", "total_amount", "created_at"), "created_at", period, as_of)
    return o.agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.countDistinct("customer_id").alias("total_customers"),
        money(F.coalesce(F.sum("total_amount"), F.lit(0))).alias("total_revenue"),
        F.coalesce(money(F.sum("total_amount")) / F.count("total_amount"), F.lit(0.0)).alias("avg_order_value"))


def top_customers(t: Tables, period: str | None = "all", as_of=None, limit: int = 20,
                  check_fk: bool = True) -> DataFrame:
    """The biggest spenders in the period with order count and last order.

    Orders are reduced per customer before the join. ``check_fk=False`` (customers known to
    exist) cuts the top `limit` first, so the join sees only `limit` rows.
    """
    o = period_filter(t.orders.select("order_id", "customer_id", "total_amount", "created_at"),
                      "created_at", period, as_of)
    per = o.groupBy("customer_id").agg(
        F.count("order_id").alias("total_orders"),
        F.coalesce(F.sum("total_amount"), F.lit(0)).alias("total_spent"),
        F.max("created_at").alias("last_order_date"))
    if not check_fk:
        per = F.broadcast(top_k(per.filter(F.col("customer_id").isNotNull()),
                                [F.col("total_spent").desc_nulls_first(), F.col("customer_id").asc()], limit))
    rows = t.customers.select("customer_id", "name", "phone").join(per, "customer_id").select(
        "customer_id", "name", "phone", "total_orders", money("total_spent").alias("total_spent"),
        "last_order_date")
    return top_k(rows, [F.col("total_spent").desc_nulls_first(), F.col("customer_id").asc()], limit)
