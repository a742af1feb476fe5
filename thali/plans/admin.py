"""Back-office, customer, rating and menu reports.

Each KPI report is one aggregate per table (the reference sends one query per
number). Per-customer reports are written for all customers at once and can
be narrowed with a filter — never a loop over customers.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thali.functions import scalars as S
from thali.functions.predicates import (as_date, day_range, non_empty, optional_eq,
                                        period_predicate, ts_literal, within_hours)
from thali.operators.aggregates import count_if, sum_if
from thali.operators.joins import exists_flag
from thali.operators.ordering import page, param_int
from thali.sources.model import Tables
from thali.sources.schema import DEFAULT_TABLES, OPEN_STATUSES


def _start_of(as_of):
    return ts_literal(as_date(as_of))


def dashboard_stats(t: Tables, as_of=None) -> DataFrame:
    """Six KPIs in two passes (orders, customers); revenue counts completed orders only.

    'today' is ``created_at >= start of as_of`` (no upper bound), as in the reference.
    """
    today = F.col("created_at") >= _start_of(as_of)
    done = F.col("status") == "completed"
    o = t.orders.select("status", "total_amount", "created_at").agg(
        F.count(F.lit(1)).alias("totalOrders"),
        count_if(today).alias("todayOrders"),
        S.money(sum_if(done, F.col("total_amount"))).alias("totalRevenue"),
        S.money(sum_if(done & today, F.col("total_amount"))).alias("todayRevenue"),
        count_if(F.col("status").isin(*OPEN_STATUSES)).alias("pendingOrders"))
    c = t.customers.select("customer_id").agg(F.count(F.lit(1)).alias("totalCustomers"))
    # Two one-row aggregates side by side without a cross join: union, then max.
    both = o.unionByName(c, allowMissingColumns=True)
    return both.agg(*[F.max(n).alias(n) for n in
                      ("totalOrders", "todayOrders", "totalRevenue", "todayRevenue",
                       "pendingOrders", "totalCustomers")])


def customer_stats(customers: DataFrame, as_of=None) -> DataFrame:
    """Customers in total and joined on as_of."""
    return customers.select("created_at").agg(
        F.count(F.lit(1)).alias("totalCustomers"),
        count_if(day_range("created_at", as_of)).alias("todayCustomers"))


def customers_with_stats(t: Tables) -> DataFrame:
    """Every customer with order count, completed spend and last order.

    Orders are reduced per customer before the left join; COUNT(DISTINCT
    order_id) equals COUNT(order_id) because order_id is the key (V8).
    """
    per = t.orders.groupBy("customer_id").agg(
        F.count("order_id").alias("total_orders"),
        sum_if(F.col("status") == "completed", F.col("total_amount")).alias("total_spent"),
        F.max("created_at").alias("last_order_date"))
    c = t.customers.select("customer_id", "name", "phone", "dob", F.col("created_at").alias("joined_date"))
    return c.join(per, "customer_id", "left").select(
        "customer_id", "name", "phone", "dob", "joined_date",
        F.coalesce("total_orders", F.lit(0)).cast("long").alias("total_orders"),
        S.money(F.coalesce("total_spent", F.lit(0))).alias("total_spent"),
        "last_order_date",
    ).orderBy(F.col("total_orders").desc_nulls_first(), F.col("joined_date").desc_nulls_first(),
              F.col("customer_id").asc())


def customer_reviews(t: Tables, customer_id: int | None = None) -> DataFrame:
    """A customer's (or every customer's) ratings with the item, newest first."""
    r = t.ratings
    if customer_id is not None:
        r = r.filter(F.col("customer_id") == F.lit(customer_id))
    items = t.menu_items.select("item_id", "item_name", F.col("image_url").alias("item_image"))
    return r.join(items, "item_id", "left").select(
        "rating_id", "customer_id", "rating_value", "review_text", "item_id", "order_id", "created_at",
        "item_name", "item_image").orderBy(F.col("created_at").desc_nulls_first(), F.col("rating_id").desc())


def notifications(t: Tables, now) -> DataFrame:
    """Up to three alert rows, each present only when its count is positive."""
    n24 = within_hours("created_at", now, 24) & F.col("status").isin(*OPEN_STATUSES)
    today = day_range("created_at", now)
    counts = t.orders.select("status", "created_at").agg(
        count_if(n24).alias("pending"), count_if(today).alias("today"))
    order_rows = counts.select(F.explode(F.array(
        F.struct(F.lit("order").alias("type"),
                 F.format_string("%d pending order(s) need attention", "pending").alias("message"),
                 F.lit("high").alias("priority"), F.col("pending").alias("n")),
        F.struct(F.lit("info").alias("type"),
                 F.format_string("%d new order(s) today", "today").alias("message"),
                 F.lit("medium").alias("priority"), F.col("today").alias("n")))).alias("r")).select("r.*")
    cust = t.customers.select("created_at").agg(count_if(today).alias("n")).select(
        F.lit("user").alias("type"),
        F.format_string("%d new customer(s) registered today", "n").alias("message"),
        F.lit("low").alias("priority"), "n")
    return order_rows.unionByName(cust).filter(F.col("n") > 0).select("type", "message", "priority")


def ratings_listing(t: Tables) -> DataFrame:
    """Ratings with customer, item and category, newest first; kind and stars."""
    c = t.customers.select("customer_id", F.col("name").alias("customer_name"),
                           F.col("phone").alias("customer_phone"))
    cat = t.menu_category.select("category_id", F.col("category_name").alias("item_category"))
    # the category goes to the items first, so ratings are never dealt by its few values
    items = t.menu_items.select("item_id", "item_name", F.col("image_url").alias("item_image"), "category_id").join(
        cat, "category_id", "left").drop("category_id")
    r = t.ratings.join(c, "customer_id").join(items, "item_id", "left")
    return r.select(
        "rating_id", "customer_id", "order_id", "rating_value", "review_text", "item_id", "created_at",
        "customer_name", "customer_phone", "item_name", "item_image", "item_category",
        S.rating_kind("item_id").alias("rating_kind"), S.stars("rating_value").alias("stars"),
    ).orderBy(F.col("created_at").desc_nulls_first(), F.col("rating_id").desc())


def ratings_summary(ratings: DataFrame, as_of=None) -> DataFrame:
    """One pass: total, average (and its 2-decimal text), star buckets, today, week, with text."""
    v = F.col("rating_value")
    week = period_predicate("created_at", "week", as_of)
    out = ratings.select("rating_value", "created_at", "review_text").agg(
        F.count(F.lit(1)).alias("total_ratings"),
        F.sum(v).alias("_sum"), F.count(v).alias("_n"),
        count_if(v == 5).alias("five_star"), count_if(v == 4).alias("four_star"),
        count_if(v == 3).alias("three_star"), count_if(v == 2).alias("two_star"),
        count_if(v == 1).alias("one_star"),
        count_if(day_range("created_at", as_of)).alias("today_ratings"),
        count_if(week).alias("week_ratings"),
        count_if(non_empty("review_text")).alias("with_review"))
    avg = F.col("_sum") / F.col("_n")
    return out.select(
        "total_ratings",
        F.coalesce(avg, F.lit(0.0)).alias("average_rating"),
        S.fixed(F.coalesce(avg, F.lit(0.0)), 2).alias("average_rating_text"),
        "five_star", "four_star", "three_star", "two_star", "one_star",
        "today_ratings", "week_ratings", "with_review")


def menu_with_ratings(t: Tables, category_id=None) -> DataFrame:
    """Available items of real categories (INNER join, Q12) with average rating (1 dp) and count.

    Ratings are reduced per item (sum, count) before the join.
    """
    per = t.ratings.filter(F.col("item_id").isNotNull()).groupBy("item_id").agg(
        F.sum("rating_value").alias("_s"), F.count("rating_id").alias("rating_count"))
    items = t.menu_items.filter(F.col("is_available"))
    cond = optional_eq("category_id", category_id)
    if cond is not None:
        items = items.filter(cond)
    j = items.join(t.menu_category, "category_id").join(per, "item_id", "left")
    return j.select(
        "item_id", "item_name", "category_id", "category_name", S.money("price").alias("price"),
        "image_url", "description", "is_available",
        F.coalesce(S.round_half_up_ratio("_s", "rating_count", 1), F.lit(0.0)).alias("avg_rating"),
        F.coalesce("rating_count", F.lit(0)).cast("long").alias("rating_count"),
    ).orderBy(F.col("category_name").asc_nulls_last(), F.col("item_name").asc_nulls_last(), F.col("item_id"))


def menu_items_admin(t: Tables) -> DataFrame:
    """All items with their category; an unknown category gives NULL, the item stays."""
    j = t.menu_items.join(t.menu_category, "category_id", "left")
    return j.select("item_id", "item_name", "category_id", "category_name", S.money("price").alias("price"),
                    "image_url", "description", "is_available") \
        .orderBy(F.col("category_name").asc_nulls_last(), F.col("item_name").asc_nulls_last(), F.col("item_id"))


def categories(t: Tables) -> DataFrame:
    """Category list by name."""
    return t.menu_category.select("category_id", "category_name") \
        .orderBy(F.col("category_name").asc_nulls_last(), "category_id")


def profile_summary(t: Tables, customer_id: int | None = None) -> DataFrame:
    """Per customer: all orders counted, completed spend."""
    o = t.orders
    c = t.customers
    if customer_id is not None:
        o = o.filter(F.col("customer_id") == F.lit(customer_id))
        c = c.filter(F.col("customer_id") == F.lit(customer_id))
    per = o.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("totalOrders"),
        sum_if(F.col("status") == "completed", F.col("total_amount")).alias("totalSpent"))
    return c.join(per, "customer_id", "left").select(
        F.col("customer_id").alias("id"), "name", "phone", F.col("created_at").alias("joinDate"),
        F.coalesce("totalOrders", F.lit(0)).cast("long").alias("totalOrders"),
        S.money(F.coalesce("totalSpent", F.lit(0))).alias("totalSpent"))


def ordered_items(t: Tables, customer_id: int | None = None) -> DataFrame:
    """Items each customer received (completed orders): times, last time, already rated."""
    o = t.orders.filter(F.col("status") == "completed")
    if customer_id is not None:
        o = o.filter(F.col("customer_id") == F.lit(customer_id))
    lines = t.order_items.select("order_id", "item_id", "order_item_id") \
        .join(o.select("order_id", "customer_id", "created_at"), "order_id")
    per = lines.groupBy("customer_id", "item_id").agg(
        F.count("order_item_id").alias("times_ordered"), F.max("created_at").alias("last_ordered"))
    # The exists flag joins on (customer, item), the key `per` is already partitioned by:
    # done first, it costs no reshuffle of `per`.
    per = exists_flag(per, t.ratings, ["customer_id", "item_id"], "already_rated")
    items = t.menu_items.select("item_id", "item_name", "price", "image_url", "description", "category_id").join(
        t.menu_category, "category_id", "left")
    j = per.join(items, "item_id")
    return j.select("customer_id", "item_id", "item_name", S.money("price").alias("price"), "image_url",
                    "description", "category_name", "times_ordered", "last_ordered", "already_rated") \
        .orderBy(F.col("customer_id"), F.col("last_ordered").desc_nulls_first(), F.col("item_id"))


def recent_reviews(t: Tables, limit: int | None = 10, offset: int | None = 0, item_id=None) -> DataFrame:
    """Latest non-empty reviews with masked phone (F9), one page, optional item.

    Reviews meet their customers (inner join), the page is cut, and only the page meets the
    items: a left join on their key cannot drop or add rows.
    """
    limit, offset = param_int(limit, 10), param_int(offset, 0)
    r = t.ratings.filter(non_empty("review_text"))
    cond = optional_eq("item_id", item_id)
    if cond is not None:
        r = r.filter(cond)
    order = [F.col("created_at").desc_nulls_first(), F.col("rating_id").desc()]
    c = t.customers.select("customer_id", F.col("name").alias("customer_name"), "phone")
    items = t.menu_items.select("item_id", "item_name", F.col("image_url").alias("item_image"))
    shown = page(r.join(c, "customer_id"), order, limit, offset)
    return shown.join(items, "item_id", "left").select(
        "rating_id", "customer_id", "rating_value", "review_text", "item_id", "created_at",
        "customer_name", S.mask_phone("phone").alias("masked_phone"), "item_name", "item_image").orderBy(*order)


def table_availability(orders: DataFrame, as_of=None, tables=DEFAULT_TABLES) -> DataFrame:
    """Per table: occupied today by an open order, and free among the listed tables.

    One row per listed table plus any occupied table not in the list
    (`listed` false, `available` NULL) — the three parts of the reference's
    answer (occupied, available, status map) as one frame; see ``status_map``.
    """
    spark = orders.sparkSession
    occupied = orders.filter(F.col("status").isin(*OPEN_STATUSES) & day_range("created_at", as_of)) \
        .select("table_number").distinct().withColumn("occupied", F.lit(True))
    listed = spark.createDataFrame([(x,) for x in tables], "table_number string") \
        .withColumn("listed", F.lit(True))
    j = listed.join(occupied, "table_number", "full_outer")
    occ = F.coalesce("occupied", F.lit(False))
    return j.select("table_number", F.coalesce("listed", F.lit(False)).alias("listed"), occ.alias("occupied"),
                    F.when(F.col("listed"), ~occ).alias("available")).orderBy("table_number")


def status_map(availability: DataFrame) -> DataFrame:
    """R25's tableStatus: one row holding a map table → is free, over the listed tables."""
    listed = availability.filter(F.col("listed"))
    return listed.agg(F.map_from_entries(F.collect_list(F.struct("table_number", "available"))).alias("tableStatus"))
