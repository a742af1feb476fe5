"""Binding of the driver's tables to the restaurant model.

Each model table is a narrow, lazy projection of one driver table (no shuffle,
except the tiny ``menu_category`` distinct and the ``payments`` union), so
filters and column pruning still reach the Parquet scans. The rules are
described in FIXTURES.md §2; the SQL twins in ``thali.plans.oracle`` inline
the same rules as CTEs.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thali.sources.driver import read_table
from thali.sources.schema import MONEY, PRICE

# Reference dates of the driver data (orders end on 2001-08-01, events on 2024-01-30).
ORDERS_AS_OF = "2001-08-01"
EVENTS_AS_OF = "2024-01-30"


def _i(c: Column) -> Column:
    return c.cast("int")


def bind_customers(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    phone = F.when(k % 17 == 0, F.lit("12345")).otherwise((F.lit(9000000000) + k).cast("string"))
    dob = F.when(k % 4 == 0, F.lit(None).cast("date")).otherwise(
        F.make_date(_i(1950 + k % 60), _i(1 + k % 12), _i(1 + k % 28)))
    created = F.make_date(_i(1995 + k % 7), _i(1 + k % 7), _i(1 + k % 28)).cast("timestamp_ntz")
    return customer.select(
        k.alias("customer_id"), F.col("c_name").alias("name"), phone.alias("phone"),
        created.alias("created_at"), dob.alias("dob"))


def _category_id() -> Column:
    return F.substring("p_brand", 7, 10).cast("int")


def bind_menu_items(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    return part.select(
        k.alias("item_id"),
        F.col("p_name").alias("item_name"),
        F.when(k % 31 != 0, _category_id()).alias("category_id"),
        F.col("p_retailprice").cast(PRICE).alias("price"),
        F.concat(F.lit("img/"), k.cast("string"), F.lit(".jpg")).alias("image_url"),
        F.col("p_type").alias("description"),
        (F.col("p_size") % 7 != 0).alias("is_available"),
    )


def bind_menu_category(part: DataFrame) -> DataFrame:
    # One category per brand; the brand name is a function of the id.
    return part.select(_category_id().alias("category_id"), F.col("p_brand").alias("category_name")).distinct()


def order_status(key: Column, orderstatus: Column) -> Column:
    return (F.when(key % 23 == 0, "cancelled")
            .when(orderstatus == "F", "completed")
            .when(orderstatus == "O", "pending")
            .when(key % 2 == 0, "preparing")
            .otherwise("ready"))


def bind_orders(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    return orders.select(
        k.alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.concat(F.lit("T-"), (1 + k % 5).cast("string")).alias("table_number"),
        F.col("o_totalprice").cast(MONEY).alias("total_amount"),
        order_status(k, F.col("o_orderstatus")).alias("status"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
    )


def bind_order_items(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("order_item_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").cast(MONEY).alias("price"),
    )


def bind_payments(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    online = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    method = F.when(online, "razorpay").otherwise("cash")
    status = F.when((F.col("o_orderstatus") == "F") | online, "completed").otherwise("pending")
    base = orders.select(
        "o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus", "o_orderpriority")
    first = base.filter(k % 10 != 0).select(
        (k * 2).alias("payment_id"), k.alias("order_id"),
        F.col("o_totalprice").cast(MONEY).alias("amount"),
        status.alias("payment_status"), method.alias("payment_method"),
        F.when(online, F.concat(F.lit("pay_"), k.cast("string"))).alias("razorpay_payment_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"))
    second = base.filter(k % 50 == 1).select(
        (k * 2 + 1).alias("payment_id"), k.alias("order_id"),
        F.col("o_totalprice").cast(MONEY).alias("amount"),
        F.lit("completed").alias("payment_status"), F.lit("razorpay").alias("payment_method"),
        F.concat(F.lit("pay_"), k.cast("string")).alias("razorpay_payment_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"))
    return first.unionByName(second)


def bind_ratings(events: DataFrame) -> DataFrame:
    et = F.col("event_type")
    review = F.when(et == "signup", F.lit(None).cast("string")).when(et == "error", F.lit("")).otherwise(F.col("props"))
    item = F.when(et == "purchase", F.lit(None).cast("long")).otherwise(
        F.get_json_object("props", "$.k").cast("long"))
    order = F.when(et == "purchase", F.col("event_id"))
    return events.select(
        F.col("event_id").alias("rating_id"),
        F.col("user_id").alias("customer_id"),
        (1 + F.col("event_id") % 5).cast("int").alias("rating_value"),
        review.alias("review_text"),
        F.col("ts").cast("timestamp_ntz").alias("created_at"),
        item.alias("item_id"),
        order.cast("long").alias("order_id"),
    )


def bind_admins(supplier: DataFrame) -> DataFrame:
    """Staff accounts: every tenth user name is shared by two, e-mails by three; every fourth has none."""
    k = F.col("s_suppkey")
    return supplier.select(
        k.alias("admin_id"),
        F.when(k % 10 == 0, F.concat(F.lit("shared"), F.floor(k / 20).cast("string"))).otherwise(
            F.lower(F.col("s_name"))).alias("username"),
        F.when(k % 4 != 0, F.concat(F.lit("a"), F.floor(k / 3).cast("string"), F.lit("@example.com"))).alias("email"))


def bind_sessions(events: DataFrame) -> DataFrame:
    """Each signup opens its user's session; each error report one of the admin who reads it."""
    ts = F.col("ts").cast("timestamp_ntz")
    owner = F.col("event_type") == "signup"
    return events.filter(F.col("event_type").isin("signup", "error")).select(
        F.concat(F.lit("s-"), F.col("event_id").cast("string")).alias("session_id"),
        F.when(owner, F.col("user_id")).alias("customer_id"),
        F.lit(None).cast("string").alias("ip_address"),
        F.lit(None).cast("string").alias("user_agent"),
        ts.alias("created_at"),
        (ts + F.expr("INTERVAL 24 HOURS")).alias("expires_at"),
        ts.alias("last_activity"),
        F.col("event_id").alias("id"),
        F.when(~owner, F.col("user_id")).alias("admin_id"),
    )


def bind_activity(events: DataFrame) -> DataFrame:
    """Every non-signup event is activity of its user."""
    return events.filter(F.col("event_type") != "signup").select(
        F.col("event_id"), F.col("user_id").alias("customer_id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type"))


def bind_live_orders(events: DataFrame) -> DataFrame:
    """Orders with real clock times (purchase events), for hour-of-day and queue reports.

    Driver orders carry dates only, so reports that need the time of day run on
    this table with the same schema as ``orders``.
    """
    k = F.col("event_id")
    status = (F.when(k % 5 == 0, "pending").when(k % 5 == 1, "preparing").when(k % 5 == 2, "ready")
              .when(k % 5 == 3, "completed").otherwise("cancelled"))
    return events.filter(F.col("event_type") == "purchase").select(
        k.alias("order_id"),
        F.col("user_id").alias("customer_id"),
        F.concat(F.lit("T-"), (1 + k % 5).cast("string")).alias("table_number"),
        F.col("value").cast(MONEY).alias("total_amount"),
        status.alias("status"),
        F.col("ts").cast("timestamp_ntz").alias("created_at"),
    )


@dataclass
class Tables:
    """Lazy model tables over one driver folder."""

    spark: SparkSession
    sf_dir: str
    _raw: dict = field(default_factory=dict, repr=False)

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = read_table(self.spark, self.sf_dir, name)
        return self._raw[name]

    @cached_property
    def customers(self) -> DataFrame:
        return bind_customers(self.raw("customer"))

    @cached_property
    def menu_items(self) -> DataFrame:
        return bind_menu_items(self.raw("part"))

    @cached_property
    def menu_category(self) -> DataFrame:
        return bind_menu_category(self.raw("part"))

    @cached_property
    def orders(self) -> DataFrame:
        return bind_orders(self.raw("orders"))

    @cached_property
    def order_items(self) -> DataFrame:
        return bind_order_items(self.raw("lineitem"))

    @cached_property
    def payments(self) -> DataFrame:
        return bind_payments(self.raw("orders"))

    @cached_property
    def ratings(self) -> DataFrame:
        return bind_ratings(self.raw("events"))

    @cached_property
    def sessions(self) -> DataFrame:
        return bind_sessions(self.raw("events"))

    @cached_property
    def admins(self) -> DataFrame:
        return bind_admins(self.raw("supplier"))

    @cached_property
    def activity(self) -> DataFrame:
        return bind_activity(self.raw("events"))

    @cached_property
    def live_orders(self) -> DataFrame:
        return bind_live_orders(self.raw("events"))


def from_frames(spark: SparkSession, **frames: DataFrame) -> Tables:
    """Tables over given model frames (tests, or snapshots written by change jobs)."""
    t = Tables(spark, "")
    for name, df in frames.items():
        setattr(t, name, df)
    return t


def load(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)
