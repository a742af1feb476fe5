"""Request tables for the change jobs, derived from the driver's tables.

The reference receives these one HTTP request at a time; here they are whole
tables whose size grows with the data. The rules are fixed so that every
reject path occurs (FIXTURES.md §3). Hand-made edge cases live in the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thali.sources.model import Tables
from thali.sources.schema import ORDER_STATUSES, PRICE


def status_updates(t: Tables) -> DataFrame:
    """Two updates per order for even/odd event pairs; 'signup' events carry a bad
    status; 'error' events point at orders that do not exist."""
    e = t.raw("events")
    k = F.col("event_id")
    statuses = F.array(*[F.lit(s) for s in ORDER_STATUSES])
    status = F.when(F.col("event_type") == "signup", F.lit("served")).otherwise(
        F.element_at(statuses, (k % 5 + 1).cast("int")))
    order = F.when(F.col("event_type") == "error", -1 - k).otherwise(F.floor(k / 2) * 3)
    return e.select(order.cast("long").alias("order_id"), status.alias("status"),
                    F.col("ts").cast("timestamp_ntz").alias("ts"))


def cash_marks(t: Tables) -> DataFrame:
    """Orders marked paid in cash: every event points at order event_id * 2
    (known orders without, with one and with two payments, and unknown ones)."""
    return t.raw("events").select((F.col("event_id") * 2).alias("order_id"))


def cancellations(t: Tables) -> DataFrame:
    """Every order is asked to be cancelled; a third of the asks come from the wrong customer."""
    o = t.raw("orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("order_id"),
                    F.when(k % 3 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("customer_id"))


def rating_submissions(t: Tables) -> DataFrame:
    """Events as rating submissions: clicks/views rate item k, purchases rate order
    k * 150 + user (own or foreign), rating = event_id % 7 (0 and 6 are out of range)."""
    e = t.raw("events")
    item = F.get_json_object("props", "$.k").cast("long")
    is_order = F.col("event_type").isin("purchase", "signup")
    return e.select(
        F.col("user_id").alias("customer_id"),
        F.when(is_order, F.lit(None).cast("long")).otherwise(item).alias("item_id"),
        F.when(is_order, item * 150 + F.col("user_id")).cast("long").alias("order_id"),
        (F.col("event_id") % 7).cast("int").alias("rating"),
        F.col("props").alias("review_text"),
        F.col("ts").cast("timestamp_ntz").alias("ts"))


def bought_ratings(t: Tables) -> DataFrame:
    """Every order line as a rating of its item by the customer, at the order's time."""
    o = t.orders.select("order_id", "customer_id", "created_at")
    rating = (1 + (F.col("customer_id") + F.col("item_id")) % 5).cast("int")
    return t.order_items.select("order_id", "item_id").join(o, "order_id").select(
        "customer_id", "item_id", F.lit(None).cast("long").alias("order_id"), rating.alias("rating"),
        F.lit("as ordered").alias("review_text"), F.col("created_at").alias("ts"))


def profile_requests(t: Tables) -> DataFrame:
    """Every admin asks for a profile: some without a user name, some with one or an e-mail of others."""
    k = F.col("admin_id")
    name = (F.when(k % 7 == 0, "").when(k % 3 == 0, F.concat(F.lit("shared"), F.floor(k / 40).cast("string")))
            .otherwise(F.col("username")))
    mail = F.when(k % 5 == 0, F.concat(F.lit("a"), F.floor(k / 6).cast("string"), F.lit("@example.com"))).otherwise(F.col("email"))
    return t.admins.select("admin_id", name.alias("username"), mail.alias("email"))


def birth_dates(t: Tables) -> DataFrame:
    """Two date-of-birth texts per customer, an hour apart: years 1890..2039, days 1..31 (some
    impossible), every 13th text malformed; the second lies 7 years before the first."""
    hours = F.explode(F.array(F.lit(0), F.lit(1))).alias("hour")
    c = t.raw("customer").select("c_custkey", hours)
    n, k = F.col("c_custkey"), F.col("c_custkey") - 7 * F.col("hour") + 7
    text = F.concat_ws("-", F.lpad((1890 + k % 150).cast("string"), 4, "0"),
                       F.lpad((1 + k % 12).cast("string"), 2, "0"),
                       F.lpad((1 + k % 31).cast("string"), 2, "0"))
    text = F.when(n % 13 == 0, F.concat(F.lit("dob "), n.cast("string"))).otherwise(text)
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(hours=F.col("hour"))
    return c.select(n.alias("customer_id"), text.alias("dob"), at.alias("ts"))


def menu_item_requests(t: Tables) -> DataFrame:
    """Item upserts from parts: every 4th is an insert, every 9th has a bad price,
    availability given as 'true', 'TRUE', 'no' or NULL."""
    p = t.raw("part")
    k = F.col("p_partkey")
    avail = (F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 3 == 0, "true")
             .when(k % 3 == 1, "TRUE").otherwise("no"))
    price = F.when(k % 9 == 0, F.lit("abc")).otherwise(F.col("p_retailprice").cast(PRICE).cast("string"))
    return p.select(F.when(k % 4 == 0, F.lit(None).cast("long")).otherwise(k).alias("item_id"),
                    F.concat(F.col("p_name"), F.lit(" special")).alias("item_name"),
                    F.substring("p_brand", 7, 10).cast("int").alias("category_id"),
                    price.alias("price"), avail.alias("is_available"))


def carts(t: Tables) -> DataFrame:
    """Every order re-submitted as a cart of its lines (price = the bound line price),
    stamped at the order's date plus a key-derived time; every 97th cart lacks a
    table and every 89th is paid online."""
    o = t.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    line = F.struct(F.col("l_partkey").alias("item_id"), F.col("l_quantity").cast("int").alias("quantity"),
                    F.col("l_extendedprice").cast(PRICE).alias("price"))
    per = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(
        F.struct(F.col("l_linenumber"), line.alias("x")))).alias("xs"))
    k = F.col("o_orderkey")
    ts = F.col("o_orderdate").cast("timestamp_ntz") + F.make_interval(mins=(k % 600).cast("int"))
    return o.join(per, o.o_orderkey == per.l_orderkey, "left").select(
        F.concat(F.lit("cart-"), k.cast("string")).alias("cart_id"),
        F.col("o_custkey").alias("customer_id"),
        F.when(k % 97 == 0, F.lit(None).cast("string")).otherwise(
            F.concat(F.lit("T-"), (1 + k % 5).cast("string"))).alias("table_number"),
        ts.alias("ts"),
        F.coalesce(F.transform("xs", lambda s: s["x"]),
                   F.array().cast("array<struct<item_id:bigint,quantity:int,price:decimal(10,2)>>")).alias("items"),
        F.when(k % 89 == 0, F.concat(F.lit("pay_"), k.cast("string"))).alias("pay_ref"))

