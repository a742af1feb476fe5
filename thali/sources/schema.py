"""Model schemas: fixed by the DDL of the order-management schema, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# The order status domain, and the statuses of an open (unfinished) order.
ORDER_STATUSES = ("pending", "preparing", "ready", "completed", "cancelled")
OPEN_STATUSES = ("pending", "preparing", "ready")

# The restaurant's table names.
DEFAULT_TABLES = ("T-1", "T-2", "T-3", "T-4", "T-5")

MONEY = T.DecimalType(12, 2)
PRICE = T.DecimalType(10, 2)

CUSTOMERS = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("phone", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("dob", T.DateType()),
])

MENU_CATEGORY = T.StructType([
    T.StructField("category_id", T.IntegerType()),
    T.StructField("category_name", T.StringType(), False),
])

MENU_ITEMS = T.StructType([
    T.StructField("item_id", T.LongType()),
    T.StructField("item_name", T.StringType()),
    T.StructField("category_id", T.IntegerType()),
    T.StructField("price", PRICE),
    T.StructField("image_url", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("is_available", T.BooleanType()),
])

ORDERS = T.StructType([
    T.StructField("order_id", T.LongType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("table_number", T.StringType()),
    T.StructField("total_amount", MONEY),
    T.StructField("status", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

ORDER_ITEMS = T.StructType([
    T.StructField("order_item_id", T.LongType()),
    T.StructField("order_id", T.LongType()),
    T.StructField("item_id", T.LongType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("price", MONEY),
])

PAYMENTS = T.StructType([
    T.StructField("payment_id", T.LongType()),
    T.StructField("order_id", T.LongType()),
    T.StructField("amount", MONEY),
    T.StructField("payment_status", T.StringType()),
    T.StructField("payment_method", T.StringType()),
    T.StructField("razorpay_payment_id", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

RATINGS = T.StructType([
    T.StructField("rating_id", T.LongType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("rating_value", T.IntegerType()),
    T.StructField("review_text", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("item_id", T.LongType()),
    T.StructField("order_id", T.LongType()),
])

ADMINS = T.StructType([
    T.StructField("admin_id", T.LongType()),
    T.StructField("username", T.StringType()),
    T.StructField("email", T.StringType()),
])

SESSIONS = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("ip_address", T.StringType()),
    T.StructField("user_agent", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("expires_at", T.TimestampNTZType()),
    T.StructField("last_activity", T.TimestampNTZType()),
    T.StructField("id", T.LongType()),
    T.StructField("admin_id", T.LongType()),
])

CART_LINE = T.StructType([
    T.StructField("item_id", T.LongType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("price", PRICE),
])

CART = T.StructType([
    T.StructField("cart_id", T.StringType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("table_number", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("items", T.ArrayType(CART_LINE)),
    T.StructField("pay_ref", T.StringType()),
])

STATUS_UPDATES = T.StructType([
    T.StructField("order_id", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
])

RATING_SUBMISSIONS = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("item_id", T.LongType()),
    T.StructField("order_id", T.LongType()),
    T.StructField("rating", T.IntegerType()),
    T.StructField("review_text", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
])

MENU_ITEM_REQUESTS = T.StructType([
    T.StructField("item_id", T.LongType()),
    T.StructField("item_name", T.StringType()),
    T.StructField("category_id", T.IntegerType()),
    T.StructField("price", T.StringType()),
    T.StructField("is_available", T.StringType()),
])

CLIENT_REQUESTS = T.StructType([
    T.StructField("client", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])
