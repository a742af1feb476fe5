"""Physical layout for scale: the model tables written once, partitioned and bucketed.

Two layouts, both plain Spark writes:

* ``write_partitioned``: Parquet folders partitioned by the order's month.
  ``order_items`` carries its order's date (``order_created_at``), so a period
  filter prunes line files directly instead of semi-joining `orders`.
* ``write_bucketed``: catalog tables bucketed (and sorted) by their join key —
  orders, order_items and payments by ``order_id`` with one bucket count — so
  the joins on ``order_id`` read co-partitioned buckets and shuffle nothing.
  Needs the session catalog (a metastore on a cluster).

``load_partitioned`` / ``load_bucketed`` return ``Tables`` over either layout;
every report runs on them unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thali.sources.model import Tables, from_frames

MODEL_TABLES = ("customers", "menu_category", "menu_items", "orders", "order_items", "payments",
                "ratings", "sessions", "admins")

# Join key each table is bucketed by.
BUCKET_KEYS = {"orders": "order_id", "order_items": "order_id", "payments": "order_id",
               "customers": "customer_id", "menu_items": "item_id", "ratings": "customer_id",
               "sessions": "customer_id"}


def _month(col: str):
    return F.date_format(F.col(col), "yyyy-MM")


def with_order_date(t: Tables) -> DataFrame:
    """order_items with its order's created_at (one join, paid once at layout time)."""
    return t.order_items.join(
        t.orders.select("order_id", F.col("created_at").alias("order_created_at")), "order_id", "left")


def write_partitioned(t: Tables, out_dir: str) -> None:
    """Model tables as Parquet; orders, order_items and payments partitioned by month."""
    t.orders.withColumn("order_month", _month("created_at")).write.mode("overwrite") \
        .partitionBy("order_month").parquet(f"{out_dir}/orders")
    with_order_date(t).withColumn("order_month", _month("order_created_at")).write.mode("overwrite") \
        .partitionBy("order_month").parquet(f"{out_dir}/order_items")
    t.payments.withColumn("pay_month", _month("created_at")).write.mode("overwrite") \
        .partitionBy("pay_month").parquet(f"{out_dir}/payments")
    for name in ("customers", "menu_category", "menu_items", "ratings", "sessions", "admins"):
        getattr(t, name).write.mode("overwrite").parquet(f"{out_dir}/{name}")


def load_partitioned(spark: SparkSession, out_dir: str) -> Tables:
    """Tables over the partitioned layout. The partition columns stay visible
    (`order_month` on orders and order_items): period filters add a predicate
    on them (``predicates.month_guard``), which Spark turns into partition pruning."""
    return from_frames(spark, **{name: spark.read.parquet(f"{out_dir}/{name}") for name in MODEL_TABLES})


def write_bucketed(t: Tables, database: str, buckets: int) -> None:
    """Model tables as catalog tables bucketed and sorted by their join key."""
    spark = t.spark
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name in MODEL_TABLES:
        df = getattr(t, name)
        w = df.write.mode("overwrite").format("parquet")
        key = BUCKET_KEYS.get(name)
        if key:
            w = w.bucketBy(buckets, key).sortBy(key)
        w.saveAsTable(f"{database}.{name}")


def load_bucketed(spark: SparkSession, database: str) -> Tables:
    return from_frames(spark, **{name: spark.table(f"{database}.{name}") for name in MODEL_TABLES})
