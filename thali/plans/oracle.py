"""SQL twins of the registered queries, for an independent engine (DuckDB).

Only the driver's tables exist there, so every statement starts with the
model bindings of FIXTURES.md §2 as CTEs (``m_*``), then states what the
report computes in plain SQL of its own (aggregate first, then join). The
twins are written from the reports' semantics, not from our DataFrame plans,
so they check the plans independently.
"""

from __future__ import annotations

MODEL_CTES = """
m_customers AS (
  SELECT c_custkey AS customer_id, c_name AS name,
         CASE WHEN c_custkey % 17 = 0 THEN '12345' ELSE CAST(9000000000 + c_custkey AS VARCHAR) END AS phone,
         CAST(make_date(CAST(1995 + c_custkey % 7 AS INT), CAST(1 + c_custkey % 7 AS INT),
                        CAST(1 + c_custkey % 28 AS INT)) AS TIMESTAMP) AS created_at,
         CASE WHEN c_custkey % 4 = 0 THEN NULL
              ELSE make_date(CAST(1950 + c_custkey % 60 AS INT), CAST(1 + c_custkey % 12 AS INT),
                             CAST(1 + c_custkey % 28 AS INT)) END AS dob
  FROM customer),
m_menu_items AS (
  SELECT p_partkey AS item_id, p_name AS item_name, CASE WHEN p_partkey % 31 <> 0 THEN CAST(substr(p_brand, 7) AS INT) END AS category_id,
         CAST(p_retailprice AS DECIMAL(10,2)) AS price, 'img/' || CAST(p_partkey AS VARCHAR) || '.jpg' AS image_url,
         p_type AS description, p_size % 7 <> 0 AS is_available
  FROM part),
m_menu_category AS (
  SELECT DISTINCT CAST(substr(p_brand, 7) AS INT) AS category_id, p_brand AS category_name
  FROM part),
m_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, 'T-' || CAST(1 + o_orderkey % 5 AS VARCHAR) AS table_number,
         CAST(o_totalprice AS DECIMAL(12,2)) AS total_amount,
         CASE WHEN o_orderkey % 23 = 0 THEN 'cancelled' WHEN o_orderstatus = 'F' THEN 'completed'
              WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderkey % 2 = 0 THEN 'preparing' ELSE 'ready' END AS status,
         CAST(o_orderdate AS TIMESTAMP) AS created_at
  FROM orders),
m_order_items AS (
  SELECT l_orderkey * 10 + l_linenumber AS order_item_id, l_orderkey AS order_id, l_partkey AS item_id,
         CAST(l_quantity AS INT) AS quantity, CAST(l_extendedprice AS DECIMAL(12,2)) AS price
  FROM lineitem),
m_payments AS (
  SELECT o_orderkey * 2 AS payment_id, o_orderkey AS order_id, CAST(o_totalprice AS DECIMAL(12,2)) AS amount,
         CASE WHEN o_orderstatus = 'F' OR o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'completed' ELSE 'pending' END
           AS payment_status,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'razorpay' ELSE 'cash' END AS payment_method,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'pay_' || CAST(o_orderkey AS VARCHAR) END
           AS razorpay_payment_id,
         CAST(o_orderdate AS TIMESTAMP) AS created_at
  FROM orders WHERE o_orderkey % 10 <> 0
  UNION ALL
  SELECT o_orderkey * 2 + 1, o_orderkey, CAST(o_totalprice AS DECIMAL(12,2)), 'completed', 'razorpay',
         'pay_' || CAST(o_orderkey AS VARCHAR), CAST(o_orderdate AS TIMESTAMP)
  FROM orders WHERE o_orderkey % 50 = 1),
m_ratings AS (
  SELECT event_id AS rating_id, user_id AS customer_id, CAST(1 + event_id % 5 AS INT) AS rating_value,
         CASE WHEN event_type = 'signup' THEN NULL WHEN event_type = 'error' THEN '' ELSE props END AS review_text,
         CAST(ts AS TIMESTAMP) AS created_at,
         CASE WHEN event_type = 'purchase' THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS item_id,
         CASE WHEN event_type = 'purchase' THEN event_id END AS order_id
  FROM events),
m_sessions AS (
  SELECT 's-' || CAST(event_id AS VARCHAR) AS session_id, CASE WHEN event_type = 'signup' THEN user_id END AS customer_id,
         CAST(ts AS TIMESTAMP) AS created_at, CAST(ts AS TIMESTAMP) + INTERVAL '24' HOUR AS expires_at, event_id AS id,
         CASE WHEN event_type = 'error' THEN user_id END AS admin_id
  FROM events WHERE event_type IN ('signup', 'error')),
m_admins AS (
  SELECT s_suppkey AS admin_id,
         CASE WHEN s_suppkey % 10 = 0 THEN 'shared' || (s_suppkey // 20) ELSE lower(s_name) END AS username,
         CASE WHEN s_suppkey % 4 <> 0 THEN 'a' || (s_suppkey // 3) || '@example.com' END AS email
  FROM supplier),
m_activity AS (
  SELECT event_id, user_id AS customer_id, CAST(ts AS TIMESTAMP) AS ts, event_type
  FROM events WHERE event_type <> 'signup'),
m_live_orders AS (
  SELECT event_id AS order_id, user_id AS customer_id, 'T-' || CAST(1 + event_id % 5 AS VARCHAR) AS table_number,
         CAST(value AS DECIMAL(12,2)) AS total_amount,
         CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'preparing' WHEN 2 THEN 'ready'
              WHEN 3 THEN 'completed' ELSE 'cancelled' END AS status,
         CAST(ts AS TIMESTAMP) AS created_at
  FROM events WHERE event_type = 'purchase')
"""


def with_model(body: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + MODEL_CTES.strip() + ",\n" + body.strip()


def period_sql(col: str, period: str | None, as_of: str) -> str:
    """The reference's date fragment with CURRENT_DATE fixed to as_of."""
    if period == "today":
        return f"AND CAST({col} AS DATE) = DATE '{as_of}'"
    if period == "week":
        return f"AND {col} >= DATE '{as_of}' - INTERVAL '7 days'"
    if period == "month":
        return f"AND {col} >= DATE '{as_of}' - INTERVAL '30 days'"
    return ""


# Text of a nested item array: 'f1|f2|…' pieces joined by ';', by item name (NULL last), then line.
def items_text_sql(fields: list[str], alias: str = "items_text") -> str:
    piece = " || '|' || ".join(f"COALESCE(CAST({f} AS VARCHAR), '~')" for f in fields)
    return (f"COALESCE(string_agg({piece}, ';' ORDER BY it.item_name NULLS LAST, li.order_item_id, li.quantity, li.price) FILTER (WHERE li.order_item_id IS NOT NULL), '')"
            f" AS {alias}, count(li.order_item_id) AS n_items")
