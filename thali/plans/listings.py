"""Nested order listings and the page-side reports built on them.

An order row of the reference is (order ⋈ customer ⋈ payment ⋈ lines ⋈ item)
grouped by order and payment columns. Here that becomes three bounded pieces:

* payment groups: payments reduced to (order, payment columns, k = rows);
* item arrays: lines of each order collected once (few per order);
* the order rows, joined to both.

An order with k equal payment rows gets its items k times — the reference's
fan-out (Q3) — via ``repeat_array`` instead of a payments×lines join. Pages are
cut *before* the item arrays are attached, so a 50-row page never waits on
every order's array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thali.functions import scalars as S
from thali.functions.predicates import before_day, conjunction, csv_list, day_range, in_list
from thali.operators.aggregates import canonical_text, nested_array, repeat_array
from thali.operators.ordering import SHALLOW, leading_int, oldest_first, page, param_int, pg_asc, pg_desc, top_k_per_group
from thali.sources.io import cut_lineage
from thali.sources.model import Tables

LISTING_ITEM_FIELDS = ("order_item_id", "quantity", "price", "item_name")
HISTORY_ITEM_FIELDS = ("order_item_id", "quantity", "price", "item_name", "image_url")


def named_lines(t: Tables, orders: DataFrame | None = None) -> DataFrame:
    """order_items LEFT JOIN menu_items, optionally only for the given orders (semi-join)."""
    lines = t.order_items.select("order_id", "order_item_id", "quantity", "price", "item_id")
    if orders is not None:
        lines = lines.join(orders.select("order_id"), "order_id", "left_semi")
    return lines.join(t.menu_items.select("item_id", "item_name", "image_url"), "item_id", "left")


def item_arrays(t: Tables, fields=LISTING_ITEM_FIELDS, sort_by: str | None = "item_name",
                orders: DataFrame | None = None) -> DataFrame:
    return nested_array(named_lines(t, orders), "order_id", list(fields), sort_by=sort_by)


def payment_groups(t: Tables, with_ref: bool) -> DataFrame:
    """Payments reduced to (order, payment columns) with k = rows.

    A plain aggregate on purpose: its partial step combines an order's
    payments map-side, so even an order holding a large share of all payments
    reaches the shuffle as a few rows.
    """
    cols = ["order_id", "payment_status", "payment_method"] + (["razorpay_payment_id"] if with_ref else [])
    return t.payments.select(*cols).groupBy(*cols).agg(F.count(F.lit(1)).alias("_k"))


def _finish_items(j: DataFrame, fields) -> DataFrame:
    """`items` (NULL → []) repeated k times for k equal payment rows, in name order."""
    empty = F.array().cast(j.schema["items"].dataType)
    arr = F.coalesce(F.col("items"), empty)
    repeated = repeat_array(arr, F.col("_k"))
    # Re-sort after repetition so equal names stay adjacent, as ORDER BY inside json_agg does;
    # only orders with several equal payment rows need it.
    resorted = F.sort_array(F.transform(repeated, lambda x: F.struct(
        x["item_name"].isNull().alias("_n"), x["item_name"].alias("_key"), *[x[f].alias(f) for f in fields])))
    final = F.when(F.coalesce(F.col("_k"), F.lit(1)) > 1,
                   F.transform(resorted, lambda x: F.struct(*[x[f].alias(f) for f in fields]))).otherwise(arr)
    return j.withColumn("items", final).drop("_k")


def attach_items(rows: DataFrame, arrays: DataFrame, fields) -> DataFrame:
    """Attach each order's array (``[]`` when it has no lines), repeated k times."""
    return _finish_items(rows.join(arrays, "order_id", "left"), fields)


def nest_items_into(rows: DataFrame, lines: DataFrame, fields, sort_by: str = "item_name") -> DataFrame:
    """Give each row its order's item array in one pass: rows ⋈ lines on order_id, then a
    group by the row's own columns. The join leaves both sides hash-partitioned on
    order_id, which also serves the grouping, so `rows` is used once and nothing is
    shuffled twice."""
    keyed = F.when(F.col(fields[0]).isNotNull(), F.struct(
        F.col(sort_by).isNull().alias("_null_key"), F.col(sort_by).alias(sort_by),
        *[F.col(f) for f in fields if f != sort_by]))
    j = rows.join(lines.select("order_id", *fields), "order_id", "left")
    grouped = j.groupBy(*rows.columns).agg(F.sort_array(F.collect_list(keyed)).alias("_arr"))
    items = F.transform("_arr", lambda x: F.struct(*[x[f].alias(f) for f in fields]))
    return _finish_items(grouped.withColumn("items", items).drop("_arr"), fields)


def orders_listing(t: Tables, status: str | None = None, date_filter: str | None = None,
                   view_type: str = "active", limit: int = 50, offset: int = 0, as_of=None,
                   orders: DataFrame | None = None) -> DataFrame:
    """The admin order listing: filters, newest first, one page, nested items.

    Faithful: `view_type` other than 'active' means no filter (Q6); 'active'
    keeps status != 'completed' (NULL status dropped, cancelled kept, P7); an
    order with several payments gives several rows (Q3). Ties on created_at are
    broken by order_id, newest first.

    An order that has its customer (inner join) yields at least one row, so the page's rows
    come from the first offset+limit such orders. They are computed once (written to the checkpoint
    folder, at most ``SHALLOW`` of them) and only they meet payments and lines. A deeper page is cut
    out of all rows by range (``deep_page``). `limit` and `offset` may be request texts.
    """
    limit, offset = leading_int(limit, 50), leading_int(offset, 0)
    o = orders if orders is not None else t.orders
    preds = []
    if view_type == "active":
        preds.append(F.col("status") != "completed")
    statuses = csv_list(status)
    if statuses:
        preds.append(in_list("status", statuses))
    if date_filter == "today":
        preds.append(day_range("created_at", as_of))
    elif date_filter == "old":
        preds.append(before_day("created_at", as_of))
    o = o.filter(conjunction(preds))
    c = t.customers.select("customer_id", F.col("name").alias("customer_name"),
                           F.col("phone").alias("customer_phone"))
    order = [pg_desc("created_at"), pg_desc("order_id"), pg_asc("payment_status"), pg_asc("payment_method"),
             pg_asc("razorpay_payment_id")]
    cols = ["order_id", "customer_id", "customer_name", "customer_phone", "table_number", "total_amount",
            "status", "created_at", "payment_status", "payment_method", "razorpay_payment_id", "_k"]
    pay_cols = ["order_id", "payment_status", "payment_method", "razorpay_payment_id"]
    pays = t.payments.select(*pay_cols)
    if offset + limit <= SHALLOW:
        first = cut_lineage(o.join(c, "customer_id").orderBy(*order[:2]).limit(offset + limit))
        pays = pays.join(F.broadcast(first.select("order_id")), "order_id", "left_semi")
    else:
        first = o.join(c, "customer_id")
    pays = pays.groupBy(*pay_cols).agg(F.count(F.lit(1)).alias("_k"))
    rows = page(first.join(pays, "order_id", "left").select(*cols), order, limit, offset)
    if limit > SHALLOW:
        ids = rows.select("order_id").distinct()
    else:
        rows = cut_lineage(rows)            # at most `limit` rows, used twice
        ids = F.broadcast(rows.select("order_id").distinct())
    return attach_items(rows, item_arrays(t, LISTING_ITEM_FIELDS, sort_by="item_name", orders=ids), LISTING_ITEM_FIELDS)


def customer_orders_nested(t: Tables, customer_id: int | None = None) -> DataFrame:
    """Orders with payment columns and items ordered by name, for one customer or all."""
    o = t.orders
    if customer_id is not None:
        o = o.filter(F.col("customer_id") == F.lit(customer_id))
    rows = o.join(payment_groups(t, with_ref=False), "order_id", "left").select(
        "customer_id", "order_id", "table_number", "total_amount", "status", "created_at",
        "payment_status", "payment_method", "_k")
    arrays = item_arrays(t, LISTING_ITEM_FIELDS, "item_name", orders=o if customer_id is not None else None)
    return attach_items(rows, arrays, LISTING_ITEM_FIELDS)


def order_history(t: Tables, customer_id: int | None = None, limit: int | None = 20,
                  offset: int | None = 0) -> DataFrame:
    """Each customer's page of orders, newest first, items with images.

    For all customers at once the page is a per-customer ``row_number`` window
    (partial WindowGroupLimit before the shuffle bounds a hot customer).
    """
    limit, offset = param_int(limit, 20), param_int(offset, 0)
    o = t.orders
    if customer_id is not None:
        o = o.filter(F.col("customer_id") == F.lit(customer_id))
    rows = o.join(payment_groups(t, with_ref=True), "order_id", "left").select(
        "customer_id", "order_id", "table_number", "total_amount", "status", "created_at",
        "payment_status", "payment_method", "razorpay_payment_id", "_k")
    rows = top_k_per_group(rows, ["customer_id"], [
        pg_desc("created_at"), pg_desc("order_id"), pg_asc("payment_status"), pg_asc("payment_method"),
        pg_asc("razorpay_payment_id")], limit, offset)
    # Arrays only for the orders on some customer's page (with long histories most orders
    # are off-page), built in one pass over the paged rows.
    return nest_items_into(rows, named_lines(t), HISTORY_ITEM_FIELDS)


def with_items_text(df: DataFrame, fields=LISTING_ITEM_FIELDS) -> DataFrame:
    """Replace the nested array by its canonical text (for engine-neutral comparison)."""
    return df.withColumn("items_text", canonical_text(F.col("items"), list(fields))) \
        .withColumn("n_items", F.size("items").cast("long")).drop("items")


def kitchen_queue(t: Tables, orders: DataFrame, now, status: str = "pending,preparing",
                  limit: int = 50) -> DataFrame:
    """Open tickets, oldest first, with elapsed mm:ss, age class and table label.

    The page is the reference's: the newest `limit` open orders, then shown
    oldest first.
    """
    listing = orders_listing(t, status=status, view_type="active", limit=limit, orders=orders)
    secs = S.elapsed_seconds("created_at", now)
    return listing.select(
        "order_id", "table_number", S.table_label("table_number").alias("table_label"),
        "created_at", secs.alias("elapsed_seconds"), S.mm_ss(secs).alias("timer"),
        S.age_class("created_at", now).alias("age_class"),
        F.size("items").cast("long").alias("n_items"), "items"
    ).transform(oldest_first)


def archive_stats(t: Tables, limit: int = 50, as_of=None) -> DataFrame:
    """Rows fetched by the archive view (view_type=old: no filter, newest `limit`)
    and the revenue of the completed ones (A15, F20 per row)."""
    listing = orders_listing(t, view_type="old", limit=limit, as_of=as_of)
    return listing.agg(
        F.count(F.lit(1)).alias("archived_count"),
        S.money(F.coalesce(F.sum(F.when(F.col("status") == "completed", F.col("total_amount"))), F.lit(0)))
        .alias("archived_revenue"),
        F.count(F.when(S.is_paid("payment_status", "payment_method"), 1)).alias("paid_count"))


def customer_report_stats(t: Tables) -> DataFrame:
    """Per customer over the rows of R12: orders (rows, Q3 fan-out kept), completed
    spend, average = completed spend / all orders (Q7), last order, initials."""
    # One row per (order, payment status, method) group, as R12 returns them.
    rows = t.orders.join(payment_groups(t, with_ref=False), "order_id", "left") \
        .select("customer_id", "total_amount", "status", "created_at")
    per = rows.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum(F.when(F.col("status") == "completed", F.col("total_amount")).otherwise(0)).alias("total_spent"),
        F.max("created_at").alias("last_order"))
    c = t.customers.select("customer_id", "name")
    out = c.join(per, "customer_id", "left")
    n = F.coalesce("total_orders", F.lit(0)).cast("long")
    spent = F.coalesce("total_spent", F.lit(0))
    avg = F.when(n > 0, S.money(spent) / n).otherwise(F.lit(0.0))
    return out.select(
        "customer_id", S.initials("name").alias("initials"), n.alias("total_orders"),
        S.money(spent).alias("total_spent"), avg.alias("avg_spent"), "last_order",
        # as the page shows them
        F.concat(F.lit("₹"), S.fixed(S.money(spent), 0)).alias("spent_text"),
        F.concat(F.lit("₹"), S.fixed(avg, 0)).alias("avg_text"),
        F.coalesce(F.date_format("last_order", "d MMM"), F.lit("-")).alias("last_order_text"))
