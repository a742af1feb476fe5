"""Registered queries: each name maps to a Spark plan over the driver tables and,
where SQL can state it, the SQL twin run by an independent engine.

Parameters are the reference's defaults; dates are the data's reference dates
(orders 2001-08-01, events 2024-01-30) instead of the wall clock.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thali.functions import predicates as P
from thali.functions import quality as Qy
from thali.functions import scalars as Fx
from thali.operators import changes as D
from thali.operators import limiter
from thali.operators.aggregates import canonical_text, daily_sketches, distinct_over
from thali.operators.joins import anti, outer_with_condition, valid_session_activity
from thali.operators.ordering import deep_page, keyset_page, pg_asc, pg_desc
from thali.plans import admin as A
from thali.plans import listings as L
from thali.plans import sales as S
from thali.plans.oracle import MODEL_CTES, items_text_sql, period_sql, with_model
from thali.sources import requests as Rq
from thali.sources.model import EVENTS_AS_OF, ORDERS_AS_OF, Tables, load
from thali.sources import io
from thali.sources.commits import Store
from thali.streaming import replay
from thali.streaming import streams as St

OA = ORDERS_AS_OF
EA = EVENTS_AS_OF
ORDERS_NOW = "2001-08-01 12:00:00"
EVENTS_NOW = "2024-01-30 23:59:00"


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None
    note: str = ""


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None, note: str = "", recursive: bool = False):
    def deco(fn: Callable[[Tables], DataFrame]):
        REGISTRY[name] = Query(fn, with_model(sql, recursive) if sql else None, note)
        return fn
    return deco


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return REGISTRY[name].build(load(spark, sf_dir))


# ---------------------------------------------------------------- R1–R8 sales

def _overview_sql(period):
    return f"""
m_sel AS (SELECT customer_id, total_amount FROM m_orders WHERE TRUE {period_sql('created_at', period, OA)})
SELECT count(*) AS total_orders, count(DISTINCT customer_id) AS total_customers,
       CAST(coalesce(sum(total_amount), 0) AS DOUBLE) AS total_revenue,
       coalesce(CAST(sum(total_amount) AS DOUBLE) / count(total_amount), 0) AS avg_order_value
FROM m_sel"""


register("sales_overview", _overview_sql(None))(lambda t: S.sales_overview(t.orders, "all", OA))
register("sales_overview_week", _overview_sql("week"))(lambda t: S.sales_overview(t.orders, "week", OA))


def _sold_sql(period):
    """Quantity and revenue per item over lines whose order falls in the period."""
    return f"""m_sold AS (
  SELECT li.item_id, sum(li.quantity) AS qty, sum(li.quantity * li.price) AS rev
  FROM m_order_items li
  WHERE li.order_id IN (SELECT order_id FROM m_orders WHERE TRUE {period_sql('created_at', period, OA)})
  GROUP BY li.item_id)"""


def _best_sql(period, limit=10):
    return f"""
{_sold_sql(period)}
SELECT it.item_id, it.item_name AS name, CAST(it.price AS DOUBLE) AS price,
       coalesce(cat.category_name, 'Uncategorized') AS category, it.image_url,
       CAST(s.qty AS BIGINT) AS total_quantity_sold, CAST(s.rev AS DOUBLE) AS total_revenue
FROM m_sold s
JOIN m_menu_items it ON it.item_id = s.item_id
LEFT JOIN m_menu_category cat ON cat.category_id = it.category_id
ORDER BY total_quantity_sold DESC, item_id LIMIT {limit}"""


register("best_sellers", _best_sql(None))(lambda t: S.best_sellers(t, "all", OA, 10))
register("best_sellers_month", _best_sql("month"))(lambda t: S.best_sellers(t, "month", OA, 10))


def _worst_sql(period, corrected=False, limit=10):
    # Faithful: all-time sums whatever the period; corrected: lines of orders in the period.
    sold = _sold_sql(period if corrected else None)
    return f"""
{sold}
SELECT it.item_id, it.item_name AS name, CAST(it.price AS DOUBLE) AS price,
       coalesce(cat.category_name, 'Uncategorized') AS category, it.image_url,
       CAST(coalesce(s.qty, 0) AS BIGINT) AS total_quantity_sold, CAST(coalesce(s.rev, 0) AS DOUBLE) AS total_revenue
FROM m_menu_items it
LEFT JOIN m_menu_category cat ON cat.category_id = it.category_id
LEFT JOIN m_sold s ON s.item_id = it.item_id
WHERE it.is_available
ORDER BY total_quantity_sold, item_id LIMIT {limit}"""


register("worst_sellers", _worst_sql("week"), "faithful: period ignored (Q1)")(
    lambda t: S.worst_sellers(t, "week", OA, 10))
register("worst_sellers_corrected_month", _worst_sql("month", corrected=True))(
    lambda t: S.worst_sellers(t, "month", OA, 10, corrected=True))


def _category_sql(period):
    # Grouped by the raw name (Q2): a NULL name and a real 'Uncategorized' stay two rows.
    return f"""
{_sold_sql(period)}
SELECT coalesce(cat.category_name, 'Uncategorized') AS category, CAST(sum(s.rev) AS DOUBLE) AS total_revenue
FROM m_sold s
JOIN m_menu_items it ON it.item_id = s.item_id
LEFT JOIN m_menu_category cat ON cat.category_id = it.category_id
GROUP BY cat.category_name"""


register("sales_by_category", _category_sql(None))(lambda t: S.sales_by_category(t, "all", OA))
register("sales_by_category_month", _category_sql("month"))(lambda t: S.sales_by_category(t, "month", OA))

register("revenue_trend", f"""
SELECT d AS date, CAST(sum(total_amount) AS DOUBLE) AS revenue
FROM (SELECT CAST(created_at AS DATE) AS d, total_amount FROM m_orders
      WHERE created_at >= DATE '{OA}' - INTERVAL '30 days') x
GROUP BY d""")(lambda t: S.revenue_trend(t.orders, OA, 30))

register("payment_method_mix", """
m_joined AS (SELECT od.total_amount, py.payment_method AS raw_method
             FROM m_orders od LEFT JOIN m_payments py ON py.order_id = od.order_id)
SELECT coalesce(raw_method, 'cash') AS payment_method, CAST(sum(total_amount) AS DOUBLE) AS total_amount
FROM m_joined GROUP BY raw_method""", "faithful: NULL and 'cash' are two rows (Q2), fan-out kept (Q3)")(
    lambda t: S.payment_method_mix(t, "all", OA))

register("peak_hours", f"""
SELECT h AS hour, count(*) AS order_count
FROM (SELECT CAST(hour(created_at) AS INT) AS h FROM m_live_orders
      WHERE created_at >= DATE '{EA}' - INTERVAL '7 days') x
GROUP BY h""", "on purchase events: driver orders have no time of day")(
    lambda t: S.peak_hours(t.live_orders, "week", EA))

register("top_customers", """
m_spend AS (SELECT customer_id, count(order_id) AS n, sum(total_amount) AS spent, max(created_at) AS last_at
            FROM m_orders GROUP BY customer_id)
SELECT cu.customer_id, cu.name, cu.phone, sp.n AS total_orders, CAST(sp.spent AS DOUBLE) AS total_spent,
       sp.last_at AS last_order_date
FROM m_spend sp JOIN m_customers cu ON cu.customer_id = sp.customer_id
ORDER BY total_spent DESC, customer_id LIMIT 20""")(lambda t: S.top_customers(t, "all", OA))

# ------------------------------------------------------- R9–R19, R22–R25 admin

register("dashboard_stats", f"""
SELECT count(*) AS totalOrders,
       count(*) FILTER (WHERE created_at >= TIMESTAMP '{OA} 00:00:00') AS todayOrders,
       CAST(coalesce(sum(total_amount) FILTER (WHERE status = 'completed'), 0) AS DOUBLE) AS totalRevenue,
       CAST(coalesce(sum(total_amount) FILTER (WHERE status = 'completed'
                                               AND created_at >= TIMESTAMP '{OA} 00:00:00'), 0) AS DOUBLE) AS todayRevenue,
       count(*) FILTER (WHERE status IN ('pending', 'preparing', 'ready')) AS pendingOrders,
       (SELECT count(*) FROM m_customers) AS totalCustomers
FROM m_orders""")(lambda t: A.dashboard_stats(t, OA))

register("customer_stats", """
SELECT count(*) AS totalCustomers, count(*) FILTER (WHERE CAST(created_at AS DATE) = DATE '1999-03-04') AS todayCustomers
FROM m_customers""")(lambda t: A.customer_stats(t.customers, "1999-03-04"))

register("customers_with_stats", """
m_per AS (SELECT customer_id, count(DISTINCT order_id) AS n,
                 sum(total_amount) FILTER (WHERE status = 'completed') AS spent, max(created_at) AS last_at
          FROM m_orders GROUP BY customer_id)
SELECT cu.customer_id, cu.name, cu.phone, cu.dob, cu.created_at AS joined_date,
       coalesce(pr.n, 0) AS total_orders, CAST(coalesce(pr.spent, 0) AS DOUBLE) AS total_spent,
       pr.last_at AS last_order_date
FROM m_customers cu LEFT JOIN m_per pr ON pr.customer_id = cu.customer_id""")(A.customers_with_stats)

register("customer_reviews", """
SELECT rt.rating_id, rt.customer_id, rt.rating_value, rt.review_text, rt.item_id, rt.order_id, rt.created_at,
       it.item_name, it.image_url AS item_image
FROM m_ratings rt LEFT JOIN m_menu_items it ON it.item_id = rt.item_id""", "all customers at once")(
    lambda t: A.customer_reviews(t))

register("notifications", f"""
m_counts AS (
  SELECT count(*) FILTER (WHERE status IN ('pending', 'preparing', 'ready')
                            AND created_at > TIMESTAMP '{ORDERS_NOW}' - INTERVAL '24 hours') AS pend,
         count(*) FILTER (WHERE CAST(created_at AS DATE) = DATE '{OA}') AS today
  FROM m_orders),
m_new AS (SELECT count(*) FILTER (WHERE CAST(created_at AS DATE) = DATE '{OA}') AS joined FROM m_customers),
m_rows AS (
  SELECT 'order' AS type, pend || ' pending order(s) need attention' AS message, 'high' AS priority, pend AS n FROM m_counts
  UNION ALL SELECT 'info', today || ' new order(s) today', 'medium', today FROM m_counts
  UNION ALL SELECT 'user', joined || ' new customer(s) registered today', 'low', joined FROM m_new)
SELECT type, message, priority FROM m_rows WHERE n > 0""")(
    lambda t: A.notifications(t, ORDERS_NOW))

register("ratings_listing", """
SELECT rt.rating_id, rt.customer_id, rt.order_id, rt.rating_value, rt.review_text, rt.item_id, rt.created_at,
       cu.name AS customer_name, cu.phone AS customer_phone, it.item_name, it.image_url AS item_image,
       cat.category_name AS item_category,
       CASE WHEN rt.item_id IS NULL THEN 'order' ELSE 'item' END AS rating_kind,
       repeat('★', rt.rating_value) || repeat('☆', 5 - rt.rating_value) AS stars
FROM m_ratings rt
JOIN m_customers cu ON cu.customer_id = rt.customer_id
LEFT JOIN m_menu_items it ON it.item_id = rt.item_id
LEFT JOIN m_menu_category cat ON cat.category_id = it.category_id""")(A.ratings_listing)

register("ratings_summary", f"""
m_agg AS (
  SELECT count(*) AS total_ratings, sum(rating_value) AS s, count(rating_value) AS c,
         count(*) FILTER (WHERE rating_value = 5) AS five_star, count(*) FILTER (WHERE rating_value = 4) AS four_star,
         count(*) FILTER (WHERE rating_value = 3) AS three_star, count(*) FILTER (WHERE rating_value = 2) AS two_star,
         count(*) FILTER (WHERE rating_value = 1) AS one_star,
         count(*) FILTER (WHERE CAST(created_at AS DATE) = DATE '{EA}') AS today_ratings,
         count(*) FILTER (WHERE created_at >= DATE '{EA}' - INTERVAL '7 days') AS week_ratings,
         count(*) FILTER (WHERE coalesce(review_text, '') <> '') AS with_review
  FROM m_ratings)
SELECT total_ratings, coalesce(CAST(s AS DOUBLE) / c, 0) AS average_rating,
       -- printf is exact but rounds ties to even; toFixed takes the greater of the two
       printf('%.2f', CASE WHEN (8.0 * s / c) % 2 = 1 THEN CAST(s AS DOUBLE) / c + 0.001 ELSE coalesce(CAST(s AS DOUBLE) / c, 0) END)
         AS average_rating_text,
       five_star, four_star, three_star, two_star, one_star, today_ratings, week_ratings, with_review
FROM m_agg""")(lambda t: A.ratings_summary(t.ratings, EA))

register("menu_with_ratings", """
m_rated AS (SELECT item_id, sum(rating_value) AS s, count(rating_id) AS c FROM m_ratings GROUP BY item_id)
SELECT it.item_id, it.item_name, it.category_id, cat.category_name, CAST(it.price AS DOUBLE) AS price,
       it.image_url, it.description, it.is_available,
       coalesce((20 * rr.s + rr.c) // (2 * rr.c) / 10.0, 0) AS avg_rating, coalesce(rr.c, 0) AS rating_count
FROM m_menu_items it
JOIN m_menu_category cat ON cat.category_id = it.category_id
LEFT JOIN m_rated rr ON rr.item_id = it.item_id
WHERE it.is_available""")(lambda t: A.menu_with_ratings(t))

register("menu_items_admin", """
SELECT it.item_id, it.item_name, it.category_id, cat.category_name, CAST(it.price AS DOUBLE) AS price,
       it.image_url, it.description, it.is_available
FROM m_menu_items it LEFT JOIN m_menu_category cat ON cat.category_id = it.category_id""")(A.menu_items_admin)

register("categories", "SELECT category_id, category_name FROM m_menu_category")(A.categories)

register("profile_summary", """
m_sum AS (SELECT customer_id, count(*) AS n, sum(total_amount) FILTER (WHERE status = 'completed') AS spent
          FROM m_orders GROUP BY customer_id)
SELECT cu.customer_id AS id, cu.name, cu.phone, cu.created_at AS joinDate, coalesce(ms.n, 0) AS totalOrders,
       CAST(coalesce(ms.spent, 0) AS DOUBLE) AS totalSpent
FROM m_customers cu LEFT JOIN m_sum ms ON ms.customer_id = cu.customer_id""", "all customers at once")(lambda t: A.profile_summary(t))

register("ordered_items", """
m_got AS (SELECT od.customer_id, li.item_id, count(li.order_item_id) AS times_ordered, max(od.created_at) AS last_ordered
          FROM m_order_items li JOIN m_orders od ON od.order_id = li.order_id
          WHERE od.status = 'completed' GROUP BY od.customer_id, li.item_id),
m_rated AS (SELECT DISTINCT customer_id, item_id FROM m_ratings WHERE item_id IS NOT NULL)
SELECT g.customer_id, g.item_id, it.item_name, CAST(it.price AS DOUBLE) AS price, it.image_url, it.description,
       cat.category_name, g.times_ordered, g.last_ordered, rr.item_id IS NOT NULL AS already_rated
FROM m_got g
JOIN m_menu_items it ON it.item_id = g.item_id
LEFT JOIN m_menu_category cat ON cat.category_id = it.category_id
LEFT JOIN m_rated rr ON rr.customer_id = g.customer_id AND rr.item_id = g.item_id""",
         "all customers at once")(lambda t: A.ordered_items(t))

def _reviews_sql(offset: int, limit: int = 10) -> str:
    """A page of the newest non-empty reviews with the phone masked to its first two and last two digits."""
    return f"""
m_texts AS (SELECT * FROM m_ratings WHERE coalesce(review_text, '') <> '')
SELECT tx.rating_id, tx.customer_id, tx.rating_value, tx.review_text, tx.item_id, tx.created_at,
       cu.name AS customer_name, substr(cu.phone, 1, 2) || repeat('X', 6) || substr(cu.phone, 9, 2) AS masked_phone,
       it.item_name, it.image_url AS item_image
FROM m_texts tx
JOIN m_customers cu ON cu.customer_id = tx.customer_id
LEFT JOIN m_menu_items it ON it.item_id = tx.item_id
ORDER BY tx.created_at DESC, tx.rating_id DESC LIMIT {limit} OFFSET {offset}"""


register("recent_reviews", _reviews_sql(0))(lambda t: A.recent_reviews(t, 10, 0))

register("table_availability", f"""
m_listed AS (SELECT * FROM (VALUES ('T-1'), ('T-2'), ('T-3'), ('T-4'), ('T-5')) v(table_number)),
m_occ AS (SELECT DISTINCT table_number FROM m_orders
          WHERE status IN ('pending', 'preparing', 'ready') AND CAST(created_at AS DATE) = DATE '{OA}')
SELECT COALESCE(l.table_number, o.table_number) AS table_number, l.table_number IS NOT NULL AS listed,
       o.table_number IS NOT NULL AS occupied,
       CASE WHEN l.table_number IS NOT NULL THEN o.table_number IS NULL END AS available
FROM m_listed l FULL OUTER JOIN m_occ o ON l.table_number = o.table_number""")(
    lambda t: A.table_availability(t.orders, OA))

# ------------------------------------------------------------ nested listings

_LIST_FIELDS = ["li.order_item_id", "li.quantity", "li.price", "it.item_name"]
_HIST_FIELDS = ["li.order_item_id", "li.quantity", "li.price", "it.item_name", "it.image_url"]

register("customer_orders_nested", f"""
SELECT od.customer_id, od.order_id, od.table_number, od.total_amount, od.status, od.created_at,
       py.payment_status, py.payment_method, {items_text_sql(_LIST_FIELDS)}
FROM m_orders od
LEFT JOIN m_payments py ON od.order_id = py.order_id
LEFT JOIN m_order_items li ON od.order_id = li.order_id
LEFT JOIN m_menu_items it ON li.item_id = it.item_id
GROUP BY od.customer_id, od.order_id, od.table_number, od.total_amount, od.status, od.created_at,
         py.payment_status, py.payment_method""", "all customers at once; items as canonical text")(
    lambda t: L.with_items_text(L.customer_orders_nested(t)))

register("orders_listing", f"""
m_page AS (
  SELECT od.order_id, od.customer_id, cu.name AS customer_name, cu.phone AS customer_phone, od.table_number,
         od.total_amount, od.status, od.created_at, py.payment_status, py.payment_method, py.razorpay_payment_id
  FROM m_orders od
  INNER JOIN m_customers cu ON od.customer_id = cu.customer_id
  LEFT JOIN m_payments py ON od.order_id = py.order_id
  WHERE od.status != 'completed'
  GROUP BY od.order_id, od.customer_id, cu.name, cu.phone, od.table_number, od.total_amount, od.status, od.created_at,
           py.payment_status, py.payment_method, py.razorpay_payment_id
  ORDER BY od.created_at DESC, od.order_id DESC, py.payment_status, py.payment_method, py.razorpay_payment_id
  LIMIT 50 OFFSET 0)
SELECT pg.order_id, pg.customer_id, pg.customer_name, pg.customer_phone, pg.table_number, pg.total_amount,
       pg.status, pg.created_at, pg.payment_status, pg.payment_method, pg.razorpay_payment_id,
       {items_text_sql(_LIST_FIELDS)}
FROM m_page pg
LEFT JOIN m_payments py ON pg.order_id = py.order_id
     AND py.payment_status IS NOT DISTINCT FROM pg.payment_status
     AND py.payment_method IS NOT DISTINCT FROM pg.payment_method
     AND py.razorpay_payment_id IS NOT DISTINCT FROM pg.razorpay_payment_id
LEFT JOIN m_order_items li ON pg.order_id = li.order_id
LEFT JOIN m_menu_items it ON li.item_id = it.item_id
GROUP BY ALL""",
         "view_type=active, newest 50")(
    lambda t: L.with_items_text(L.orders_listing(t, view_type="active", limit=50, offset=0, as_of=OA)))

register("order_history", f"""
m_rows AS (
  SELECT od.customer_id, od.order_id, od.table_number, od.total_amount, od.status, od.created_at,
         py.payment_status, py.payment_method, py.razorpay_payment_id
  FROM m_orders od LEFT JOIN m_payments py ON od.order_id = py.order_id
  GROUP BY ALL),
m_paged AS (
  SELECT * FROM m_rows QUALIFY row_number() OVER (PARTITION BY customer_id
     ORDER BY created_at DESC, order_id DESC, payment_status, payment_method, razorpay_payment_id) <= 20)
SELECT pg.customer_id, pg.order_id, pg.table_number, pg.total_amount, pg.status, pg.created_at,
       pg.payment_status, pg.payment_method, pg.razorpay_payment_id, {items_text_sql(_HIST_FIELDS)}
FROM m_paged pg
LEFT JOIN m_payments py ON pg.order_id = py.order_id
     AND py.payment_status IS NOT DISTINCT FROM pg.payment_status
     AND py.payment_method IS NOT DISTINCT FROM pg.payment_method
     AND py.razorpay_payment_id IS NOT DISTINCT FROM pg.razorpay_payment_id
LEFT JOIN m_order_items li ON pg.order_id = li.order_id
LEFT JOIN m_menu_items it ON li.item_id = it.item_id
GROUP BY ALL""", "every customer's first page of 20")(
    lambda t: L.with_items_text(L.order_history(t), L.HISTORY_ITEM_FIELDS))

register("kitchen_queue", f"""
m_page AS (
  SELECT od.order_id, od.table_number, od.created_at, py.payment_status, py.payment_method, py.razorpay_payment_id
  FROM m_live_orders od
  INNER JOIN m_customers cu ON od.customer_id = cu.customer_id
  LEFT JOIN m_payments py ON od.order_id = py.order_id
  WHERE od.status != 'completed' AND od.status IN ('pending', 'preparing')
  GROUP BY ALL
  ORDER BY od.created_at DESC, od.order_id DESC, py.payment_status, py.payment_method, py.razorpay_payment_id
  LIMIT 50)
SELECT pg.order_id, pg.table_number, regexp_replace(pg.table_number, '^(.*?)T-', '\\1') AS table_label, pg.created_at,
       CAST(floor(epoch_us(TIMESTAMP '{EVENTS_NOW}' - pg.created_at) / 1000000) AS BIGINT) AS elapsed_seconds,
       lpad(CAST(CAST(floor(epoch_us(TIMESTAMP '{EVENTS_NOW}' - pg.created_at) / 1000000) AS BIGINT) // 60 AS VARCHAR), 2, '0')
         || ':' || lpad(CAST(CAST(floor(epoch_us(TIMESTAMP '{EVENTS_NOW}' - pg.created_at) / 1000000) AS BIGINT) % 60 AS VARCHAR), 2, '0')
         AS timer,
       CASE WHEN epoch_us(TIMESTAMP '{EVENTS_NOW}' - pg.created_at) / 60000000.0 > 20 THEN 'urgent'
            WHEN epoch_us(TIMESTAMP '{EVENTS_NOW}' - pg.created_at) / 60000000.0 > 10 THEN 'warning' ELSE '' END AS age_class,
       {items_text_sql(_LIST_FIELDS)}
FROM m_page pg
LEFT JOIN m_payments py ON pg.order_id = py.order_id
     AND py.payment_status IS NOT DISTINCT FROM pg.payment_status
     AND py.payment_method IS NOT DISTINCT FROM pg.payment_method
     AND py.razorpay_payment_id IS NOT DISTINCT FROM pg.razorpay_payment_id
LEFT JOIN m_order_items li ON pg.order_id = li.order_id
LEFT JOIN m_menu_items it ON li.item_id = it.item_id
GROUP BY pg.order_id, pg.table_number, pg.created_at, pg.payment_status, pg.payment_method,
         pg.razorpay_payment_id""", "purchase events as live orders; lines of the same order ids")(
    lambda t: L.with_items_text(L.kitchen_queue(t, t.live_orders, EVENTS_NOW)))

register("archive_stats", """
m_page AS (
  SELECT od.order_id, od.status, od.total_amount, od.created_at, py.payment_status, py.payment_method, py.razorpay_payment_id
  FROM m_orders od
  INNER JOIN m_customers cu ON od.customer_id = cu.customer_id
  LEFT JOIN m_payments py ON od.order_id = py.order_id
  GROUP BY ALL
  ORDER BY od.created_at DESC, od.order_id DESC, py.payment_status, py.payment_method, py.razorpay_payment_id
  LIMIT 50)
SELECT COUNT(*) AS archived_count,
       CAST(COALESCE(SUM(CASE WHEN status = 'completed' THEN total_amount END), 0) AS DOUBLE) AS archived_revenue,
       COUNT(CASE WHEN payment_status = 'completed' OR (payment_method IS NOT NULL AND payment_method != 'cash')
             THEN 1 END) AS paid_count
FROM m_page""")(lambda t: L.archive_stats(t, 50, OA))

register("customer_report_stats", """
m_rows AS (
  SELECT od.customer_id, od.order_id, od.total_amount, od.status, od.created_at, py.payment_status, py.payment_method
  FROM m_orders od LEFT JOIN m_payments py ON od.order_id = py.order_id
  GROUP BY ALL)
SELECT cu.customer_id,
       upper(substr(array_to_string(list_transform(string_split_regex(trim(cu.name), '\\s+'), lambda w: substr(w, 1, 1)), ''), 1, 2))
         AS initials,
       COUNT(r.order_id) AS total_orders,
       CAST(COALESCE(SUM(CASE WHEN r.status = 'completed' THEN r.total_amount ELSE 0 END), 0) AS DOUBLE) AS total_spent,
       CASE WHEN COUNT(r.order_id) > 0
            THEN CAST(COALESCE(SUM(CASE WHEN r.status = 'completed' THEN r.total_amount ELSE 0 END), 0) AS DOUBLE)
                 / COUNT(r.order_id) ELSE 0.0 END AS avg_spent,
       MAX(r.created_at) AS last_order,
       -- printf rounds exact ties to even, toFixed up
       '₹' || printf('%.0f', total_spent + CASE WHEN (total_spent * 2) % 2 = 1 THEN 0.1 ELSE 0 END) AS spent_text,
       '₹' || printf('%.0f', avg_spent + CASE WHEN (avg_spent * 2) % 2 = 1 THEN 0.1 ELSE 0 END) AS avg_text,
       coalesce(strftime(last_order, '%-d %b'), '-') AS last_order_text
FROM m_customers cu LEFT JOIN m_rows r ON cu.customer_id = r.customer_id
GROUP BY cu.customer_id, cu.name""", "per customer over R12's rows, with the page's texts")(L.customer_report_stats)

# ------------------------------------------------ primitives P / J / A / O / F


register("p12_birthday_customers", f"""
SELECT customer_id, name, dob FROM m_customers
WHERE month(dob) = 3 AND day(dob) = 15""")(
    lambda t: t.customers.filter(P.customer_segment("birthday", "2024-03-15")).select("customer_id", "name", "dob"))

register("p13_search_customers", """
SELECT customer_id, name, phone FROM m_customers
WHERE lower(name) LIKE '%' || lower(trim('  Customer#00000012 ')) || '%' OR phone LIKE '%' || lower(trim('  Customer#00000012 ')) || '%'""")(
    lambda t: t.customers.filter(P.search_customers("  Customer#00000012 ")).select("customer_id", "name", "phone"))

register("j7_unsold_items_week", f"""
SELECT item_id, item_name FROM m_menu_items i
WHERE NOT EXISTS (SELECT 1 FROM m_order_items oi JOIN m_orders od ON od.order_id = oi.order_id
                  WHERE oi.item_id = i.item_id {period_sql('od.created_at', 'week', OA)})""")(
    lambda t: anti(t.menu_items, S.lines_in_period(t, "week", OA), ["item_id"]).select("item_id", "item_name"))

register("j9_valid_session_activity", """
SELECT s.id AS session_pk, a.customer_id, a.event_id, a.event_type, a.ts
FROM m_activity a ASOF JOIN m_sessions s
  ON a.customer_id = s.customer_id AND a.ts >= s.created_at
WHERE a.ts < s.expires_at""")(
    lambda t: valid_session_activity(t.sessions, t.activity).drop("session_start"))

register("f_scalar_showcase", f"""
SELECT c.customer_id,
       substr(c.phone, 1, 2) || repeat('X', 6) || substr(c.phone, 9, 2) AS masked_phone,
       regexp_matches(regexp_replace(c.phone, '\\D', '', 'g'), '^[6-9][0-9]{{9}}$') AS phone_ok,
       upper(substr(array_to_string(list_transform(string_split_regex(trim(c.name), '\\s+'), lambda w: substr(w, 1, 1)), ''), 1, 2)) AS initials,
       CASE WHEN c.dob IS NULL THEN NULL ELSE
         CAST(year(DATE '{EA}') - year(c.dob)
              - CASE WHEN month(DATE '{EA}') < month(c.dob)
                       OR (month(DATE '{EA}') = month(c.dob) AND day(DATE '{EA}') < day(c.dob)) THEN 1 ELSE 0 END AS INT) END
         AS age,
       strftime(c.created_at, '%d %b %Y') AS joined_text
FROM m_customers c""", "F9 F12 F13 F16 F23 F27")(
    lambda t: t.customers.select(
        "customer_id", Fx.mask_phone("phone").alias("masked_phone"), Qy.phone_ok("phone").alias("phone_ok"),
        Fx.initials("name").alias("initials"), Fx.age_years("dob", EA).alias("age"),
        Fx.short_date("created_at").alias("joined_text")))

# ------------------------------------------------------------ V quality rules

register("v7_fk_orphans", """
SELECT 'menu_items.category_id' AS fk, 'menu_category.category_id' AS parent,
       (SELECT COUNT(*) FROM m_menu_items c WHERE c.category_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM m_menu_category p WHERE p.category_id = c.category_id)) AS orphans
UNION ALL SELECT 'order_items.order_id', 'orders.order_id', (SELECT COUNT(*) FROM m_order_items c WHERE c.order_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM m_orders p WHERE p.order_id = c.order_id))
UNION ALL SELECT 'order_items.item_id', 'menu_items.item_id', (SELECT COUNT(*) FROM m_order_items c WHERE c.item_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM m_menu_items p WHERE p.item_id = c.item_id))
UNION ALL SELECT 'orders.customer_id', 'customers.customer_id', (SELECT COUNT(*) FROM m_orders c WHERE c.customer_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM m_customers p WHERE p.customer_id = c.customer_id))
UNION ALL SELECT 'payments.order_id', 'orders.order_id', (SELECT COUNT(*) FROM m_payments c WHERE c.order_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM m_orders p WHERE p.order_id = c.order_id))
UNION ALL SELECT 'ratings.customer_id', 'customers.customer_id', (SELECT COUNT(*) FROM m_ratings c WHERE c.customer_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM m_customers p WHERE p.customer_id = c.customer_id))
UNION ALL SELECT 'ratings.item_id', 'menu_items.item_id', (SELECT COUNT(*) FROM m_ratings c WHERE c.item_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM m_menu_items p WHERE p.item_id = c.item_id))
UNION ALL SELECT 'ratings.order_id', 'orders.order_id', (SELECT COUNT(*) FROM m_ratings c WHERE c.order_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM m_orders p WHERE p.order_id = c.order_id))
UNION ALL SELECT 'sessions.customer_id', 'customers.customer_id', (SELECT COUNT(*) FROM m_sessions c WHERE c.customer_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM m_customers p WHERE p.customer_id = c.customer_id))
UNION ALL SELECT 'sessions.admin_id', 'admins.admin_id', (SELECT COUNT(*) FROM m_sessions c WHERE c.admin_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM m_admins p WHERE p.admin_id = c.admin_id))""")(Qy.fk_orphans)

register("v1_v2_customer_violations", """
SELECT customer_id,
       NOT COALESCE(regexp_matches(regexp_replace(phone, '\\D', '', 'g'), '^[6-9][0-9]{9}$'), false) AS bad_phone,
       NOT COALESCE(length(trim(name)) >= 2 AND regexp_matches(trim(name), '^[A-Za-z\\s]+$'), false) AS bad_name
FROM m_customers""")(
    lambda t: Qy.validate_customers(t.customers).select(
        "customer_id", F.array_contains("violations", "phone").alias("bad_phone"),
        F.array_contains("violations", "name").alias("bad_name")))

register("d9_duplicate_phones", """
SELECT phone, COUNT(*) AS n FROM m_customers WHERE phone IS NOT NULL GROUP BY phone HAVING COUNT(*) > 1""")(
    lambda t: Qy.duplicate_keys(t.customers, ["phone"]))

register("d9_duplicate_usernames", """
SELECT username, COUNT(*) AS n FROM m_admins WHERE username IS NOT NULL GROUP BY username HAVING COUNT(*) > 1""")(
    lambda t: Qy.duplicate_keys(t.admins, ["username"]))

register("j8_admin_profile_reasons", """
m_asks AS (SELECT admin_id, CASE WHEN admin_id % 7 = 0 THEN '' WHEN admin_id % 3 = 0 THEN 'shared' || (admin_id // 40) ELSE username END
                  AS username, CASE WHEN admin_id % 5 = 0 THEN 'a' || (admin_id // 6) || '@example.com' ELSE email END AS email
           FROM m_admins)
SELECT s.admin_id, s.username, s.email,
       CASE WHEN coalesce(s.username, '') = '' THEN 'missing_username'
            WHEN EXISTS (SELECT 1 FROM m_admins o WHERE o.username = s.username AND o.admin_id <> s.admin_id) THEN 'username_taken'
            WHEN EXISTS (SELECT 1 FROM m_admins o WHERE o.email = s.email AND o.admin_id <> s.admin_id) THEN 'email_taken' END AS reason
FROM m_asks s""", "every admin asks for a changed profile")(
    lambda t: D.admin_profile_reasons(t.admins, Rq.profile_requests(t)))

# ------------------------------------------------------------ D change jobs

register("d2_occupied_tables", f"""
SELECT DISTINCT table_number FROM m_orders
WHERE status IN ('pending', 'preparing', 'ready') AND CAST(created_at AS DATE) = DATE '{OA}'""")(
    lambda t: D.occupied_tables(t.orders, OA))

_UPDATES_SQL = """
m_updates AS (
  SELECT CAST(CASE WHEN event_type = 'error' THEN -1 - event_id ELSE floor(event_id / 2) * 3 END AS BIGINT) AS order_id,
         CASE WHEN event_type = 'signup' THEN 'served'
              ELSE (['pending', 'preparing', 'ready', 'completed', 'cancelled'])[event_id % 5 + 1] END AS status,
         CAST(ts AS TIMESTAMP) AS ts
  FROM events)"""

register("d3_status_snapshot", _UPDATES_SQL + """,
m_latest AS (
  SELECT order_id, status FROM m_updates
  WHERE status IN ('pending', 'preparing', 'ready', 'completed', 'cancelled')
  QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY ts DESC, status DESC) = 1)
SELECT o.order_id, o.customer_id, o.table_number, CAST(o.total_amount AS DOUBLE) AS total_amount,
       COALESCE(l.status, o.status) AS status, o.created_at
FROM m_orders o LEFT JOIN m_latest l ON o.order_id = l.order_id""")(
    lambda t: D.apply_status_updates(t.orders, Rq.status_updates(t))["orders"]
    .withColumn("total_amount", Fx.money("total_amount")))

register("d3_status_rejects", _UPDATES_SQL + """
SELECT order_id, status, ts, 'invalid_status' AS reason FROM m_updates
WHERE status NOT IN ('pending', 'preparing', 'ready', 'completed', 'cancelled')
UNION ALL
SELECT order_id, status, ts, 'unknown_order' FROM m_updates u
WHERE status IN ('pending', 'preparing', 'ready', 'completed', 'cancelled')
  AND NOT EXISTS (SELECT 1 FROM m_orders o WHERE o.order_id = u.order_id)""")(
    lambda t: D.apply_status_updates(t.orders, Rq.status_updates(t)).rejects)

register("d4_mark_paid_payments", f"""
m_marks AS (SELECT DISTINCT event_id * 2 AS order_id FROM events),
m_known AS (SELECT m.order_id FROM m_marks m WHERE EXISTS (SELECT 1 FROM m_orders o WHERE o.order_id = m.order_id))
SELECT p.payment_id, p.order_id, CAST(p.amount AS DOUBLE) AS amount,
       CASE WHEN k.order_id IS NOT NULL THEN 'completed' ELSE p.payment_status END AS payment_status,
       CASE WHEN k.order_id IS NOT NULL THEN 'cash' ELSE p.payment_method END AS payment_method,
       p.razorpay_payment_id, p.created_at
FROM m_payments p LEFT JOIN m_known k ON p.order_id = k.order_id
UNION ALL
SELECT (SELECT max(payment_id) FROM m_payments) + row_number() OVER (ORDER BY k.order_id), k.order_id,
       CAST(o.total_amount AS DOUBLE), 'completed', 'cash', NULL, TIMESTAMP '{ORDERS_NOW}'
FROM m_known k JOIN m_orders o ON o.order_id = k.order_id
WHERE NOT EXISTS (SELECT 1 FROM m_payments p WHERE p.order_id = k.order_id)""")(
    lambda t: D.mark_paid(t.orders, t.payments, Rq.cash_marks(t), ORDERS_NOW)["payments"].withColumn(
        "amount", Fx.money("amount")))

register("d10_cancel_rejects", """
m_req AS (SELECT DISTINCT o_orderkey AS order_id,
                 CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS customer_id
          FROM orders),
m_first_pay AS (SELECT order_id, arg_min(payment_status, (created_at, payment_id)) AS first_status FROM m_payments GROUP BY order_id)
SELECT * FROM (
  SELECT r.order_id, r.customer_id,
         CASE WHEN o.order_id IS NULL OR o.customer_id != r.customer_id THEN 'not_found'
              WHEN o.status != 'pending' THEN 'not_pending'
              WHEN f.first_status = 'completed' THEN 'paid' END AS reason
  FROM m_req r LEFT JOIN m_orders o ON r.order_id = o.order_id LEFT JOIN m_first_pay f ON r.order_id = f.order_id) x
WHERE reason IS NOT NULL""")(lambda t: D.cancel_orders(t, Rq.cancellations(t)).rejects)



def _kept(change: D.Change) -> DataFrame:
    parts = [change[name].select(F.lit(name).alias("kept"), F.col(key).alias("id"))
             for name, key in (("orders", "order_id"), ("order_items", "order_item_id"), ("payments", "payment_id"),
                               ("ratings", "rating_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


register("d5_rows_after_cancel", """
m_req AS (SELECT DISTINCT o_orderkey AS order_id,
                 CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 1 ELSE o_custkey END AS customer_id
          FROM orders),
m_first_pay AS (SELECT order_id, arg_min(payment_status, (created_at, payment_id)) AS first_status FROM m_payments GROUP BY order_id),
m_gone AS (SELECT r.order_id FROM m_req r JOIN m_orders o ON r.order_id = o.order_id AND o.customer_id = r.customer_id
           LEFT JOIN m_first_pay f ON r.order_id = f.order_id
           WHERE o.status = 'pending' AND f.first_status IS DISTINCT FROM 'completed')
SELECT 'orders' AS kept, order_id AS id FROM m_orders WHERE order_id NOT IN (SELECT order_id FROM m_gone)
UNION ALL SELECT 'order_items', order_item_id FROM m_order_items WHERE order_id NOT IN (SELECT order_id FROM m_gone)
UNION ALL SELECT 'payments', payment_id FROM m_payments WHERE order_id NOT IN (SELECT order_id FROM m_gone)
UNION ALL SELECT 'ratings', rating_id FROM m_ratings WHERE order_id IS NULL OR order_id NOT IN (SELECT order_id FROM m_gone)""",
         "every row that is left in the four tables")(lambda t: _kept(D.cancel_orders(t, Rq.cancellations(t))))

register("d6_item_delete_rejects", """
m_ids AS (SELECT DISTINCT p_partkey * 3 AS item_id FROM part)
SELECT item_id, 'not_found' AS reason FROM m_ids i WHERE NOT EXISTS (SELECT 1 FROM m_menu_items m WHERE m.item_id = i.item_id)
UNION ALL
SELECT item_id, 'in_orders' FROM m_ids i WHERE EXISTS (SELECT 1 FROM m_menu_items m WHERE m.item_id = i.item_id)
  AND EXISTS (SELECT 1 FROM m_order_items oi WHERE oi.item_id = i.item_id)""")(
    lambda t: D.guarded_delete_items(t.menu_items, t.order_items, t.raw("part").select(
        (F.col("p_partkey") * 3).alias("item_id"))).rejects)

register("d6_category_delete_rejects", """
m_ids AS (SELECT DISTINCT category_id * 2 AS category_id FROM m_menu_category)
SELECT category_id, 'not_found' AS reason FROM m_ids WHERE category_id NOT IN (SELECT category_id FROM m_menu_category)
UNION ALL
SELECT category_id, 'has_items' FROM m_ids WHERE category_id IN (SELECT category_id FROM m_menu_category)
  AND category_id IN (SELECT category_id FROM m_menu_items WHERE category_id IS NOT NULL)""")(
    lambda t: D.guarded_delete_categories(t.menu_category, t.menu_items, t.menu_category.select(
        (F.col("category_id") * 2).alias("category_id"))).rejects)

register("d6_items_after_delete", f"""
m_recent AS (SELECT DISTINCT li.item_id FROM m_order_items li JOIN m_orders od ON od.order_id = li.order_id
             WHERE TRUE {period_sql('od.created_at', 'week', OA)})
SELECT item_id, item_name FROM m_menu_items WHERE item_id IN (SELECT item_id FROM m_recent)""",
         "all items asked to go, guarded by a week's lines")(
    lambda t: D.guarded_delete_items(t.menu_items, S.lines_in_period(t, "week", OA), t.menu_items.select("item_id"))[
        "menu_items"].select("item_id", "item_name"))

register("d7_dedupe_ratings", """
m_first_item AS (SELECT customer_id, item_id, arg_min(rating_id, (created_at, rating_id)) AS rid
                 FROM m_ratings WHERE item_id IS NOT NULL GROUP BY customer_id, item_id),
m_first_order AS (SELECT customer_id, order_id, arg_min(rating_id, (created_at, rating_id)) AS rid
                  FROM m_ratings WHERE order_id IS NOT NULL GROUP BY customer_id, order_id)
SELECT rating_id, customer_id, rating_value, item_id, order_id FROM m_ratings r
WHERE (item_id IS NULL OR rating_id IN (SELECT rid FROM m_first_item))
  AND (order_id IS NULL OR rating_id IN (SELECT rid FROM m_first_order))""")(
    lambda t: D.dedupe_ratings(t.ratings)["ratings"].select(
        "rating_id", "customer_id", "rating_value", "item_id", "order_id"))

_RATING_SQL = """
m_sub AS (
  SELECT user_id AS customer_id,
         CASE WHEN event_type IN ('purchase', 'signup') THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS item_id,
         CASE WHEN event_type IN ('purchase', 'signup') THEN CAST(json_extract_string(props, '$.k') AS BIGINT) * 150 + user_id END AS order_id,
         CAST(event_id % 7 AS INT) AS rating, CAST(ts AS TIMESTAMP) AS ts, event_id
  FROM events),
m_said AS (
SELECT s.ts, s.event_id, s.customer_id, s.item_id, s.order_id, s.rating,
  CASE WHEN s.rating IS NULL OR s.rating < 1 OR s.rating > 5 THEN 'bad_rating'
       WHEN s.item_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m_menu_items i WHERE i.item_id = s.item_id) THEN 'unknown_item'
       WHEN s.item_id IS NOT NULL AND NOT EXISTS (
            SELECT 1 FROM m_orders o JOIN m_order_items oi ON o.order_id = oi.order_id
            WHERE o.customer_id = s.customer_id AND oi.item_id = s.item_id AND o.status = 'completed') THEN 'not_ordered'
       WHEN s.item_id IS NOT NULL AND EXISTS (
            SELECT 1 FROM m_ratings r WHERE r.customer_id = s.customer_id AND r.item_id = s.item_id) THEN 'already_rated'
       WHEN s.item_id IS NOT NULL THEN NULL
       WHEN s.order_id IS NULL THEN 'missing_target'
       WHEN NOT EXISTS (SELECT 1 FROM m_orders o WHERE o.order_id = s.order_id AND o.customer_id = s.customer_id)
            THEN 'order_not_found'
       WHEN (SELECT o.status FROM m_orders o WHERE o.order_id = s.order_id) != 'completed' THEN 'order_not_completed'
       WHEN EXISTS (SELECT 1 FROM m_ratings r WHERE r.customer_id = s.customer_id AND r.order_id = s.order_id)
            THEN 'already_rated' END AS reason
FROM m_sub s)"""

register("d8_accepted_ratings", """
SELECT (SELECT max(rating_id) FROM m_ratings) + row_number() OVER (ORDER BY min(od.created_at), od.customer_id, li.item_id) AS rating_id,
       od.customer_id, li.item_id, CAST(1 + (od.customer_id + li.item_id) % 5 AS INT) AS rating_value, min(od.created_at) AS created_at
FROM m_order_items li JOIN m_orders od ON od.order_id = li.order_id JOIN m_menu_items it ON it.item_id = li.item_id
WHERE NOT EXISTS (SELECT 1 FROM m_ratings r WHERE r.customer_id = od.customer_id AND r.item_id = li.item_id)
GROUP BY od.customer_id, li.item_id HAVING bool_or(od.status = 'completed')""",
         "every line rated by its customer: the new ratings")(
    lambda t: D.eligible_ratings(t, Rq.bought_ratings(t))["ratings"].join(
        t.ratings.select("rating_id"), "rating_id", "left_anti").select(
        "rating_id", "customer_id", "item_id", "rating_value", "created_at"))

register("d8_rating_reasons", _RATING_SQL + """
SELECT customer_id, item_id, order_id, rating, reason FROM m_said""")(
    lambda t: D.rating_reasons(t, Rq.rating_submissions(t)).select(
        "customer_id", "item_id", "order_id", "rating", "reason"))

register("d11_purge_sessions", f"""
SELECT id, customer_id, admin_id, created_at, expires_at FROM m_sessions
WHERE expires_at > TIMESTAMP '{EVENTS_NOW}'
QUALIFY row_number() OVER (PARTITION BY customer_id, admin_id ORDER BY created_at DESC, id) = 1""")(
    lambda t: D.purge_sessions(t.sessions, EVENTS_NOW)["sessions"].select(
        "id", "customer_id", "admin_id", "created_at", "expires_at"))

_MENU_REQUESTS_SQL = """
m_req AS (
  SELECT CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey END AS item_id, p_name || ' special' AS item_name,
         CAST(substr(p_brand, 7) AS INT) AS category_id,
         CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_retailprice AS DECIMAL(10,2)) END AS price,
         p_partkey % 5 = 0 OR p_partkey % 3 <> 2 AS is_available
  FROM part)"""

register("d12_menu_snapshot", _MENU_REQUESTS_SQL + """
SELECT it.item_id, it.item_name, it.category_id, it.price, it.image_url, it.is_available FROM m_menu_items it
WHERE it.item_id NOT IN (SELECT item_id FROM m_req WHERE price IS NOT NULL AND item_id IS NOT NULL)
UNION ALL SELECT item_id, item_name, category_id, price, NULL, is_available FROM m_req WHERE price IS NOT NULL""",
         "replaced and inserted items; new ids are hashes: compared as NULL")(
    lambda t: D.upsert_menu_items(t.menu_items, Rq.menu_item_requests(t))["menu_items"].join(
        t.menu_items.select("item_id", F.lit(True).alias("old")), "item_id", "left").select(
        F.when(F.col("old"), F.col("item_id")).alias("item_id"), "item_name", "category_id", "price", "image_url",
        "is_available"))

register("d12_menu_item_rejects", """
m_req AS (
  SELECT CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_partkey END AS item_id, p_name || ' special' AS item_name,
         CASE WHEN p_partkey % 9 = 0 THEN 'abc' ELSE CAST(CAST(p_retailprice AS DECIMAL(10,2)) AS VARCHAR) END AS price
  FROM part)
SELECT item_id, item_name, 'bad_price' AS reason FROM m_req
WHERE regexp_extract(ltrim(price), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?', 0) = ''""",
         "every item id in the requests exists")(
    lambda t: D.upsert_menu_items(t.menu_items, Rq.menu_item_requests(t)).rejects)

_BIRTH_SQL = f"""
m_hours AS (SELECT c_custkey, h, c_custkey - 7 * h + 7 AS k FROM customer, (SELECT unnest([0, 1]) AS h)),
m_req AS (
  SELECT c_custkey AS customer_id, h,
         CASE WHEN c_custkey % 13 = 0 THEN 'dob ' || CAST(c_custkey AS VARCHAR)
              ELSE lpad(CAST(1890 + k % 150 AS VARCHAR), 4, '0') || '-' || lpad(CAST(1 + k % 12 AS VARCHAR), 2, '0')
                   || '-' || lpad(CAST(1 + k % 31 AS VARCHAR), 2, '0') END AS dob
  FROM m_hours),
m_parsed AS (SELECT *, TRY_CAST(dob AS DATE) AS d FROM m_req),
m_judged AS (SELECT customer_id, dob, d, h,
  CASE WHEN dob IS NULL OR dob = '' THEN 'required'
       WHEN NOT regexp_matches(dob, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN 'bad_format'
       WHEN d IS NULL THEN 'invalid_date'
       WHEN d > DATE '{EA}' THEN 'future'
       WHEN year(DATE '{EA}') - year(d) - CASE WHEN month(DATE '{EA}') < month(d)
            OR (month(DATE '{EA}') = month(d) AND day(DATE '{EA}') < day(d)) THEN 1 ELSE 0 END < 13 THEN 'too_young'
       WHEN year(DATE '{EA}') - year(d) - CASE WHEN month(DATE '{EA}') < month(d)
            OR (month(DATE '{EA}') = month(d) AND day(DATE '{EA}') < day(d)) THEN 1 ELSE 0 END > 120 THEN 'too_old'
  END AS reason
FROM m_parsed)"""

register("d14_birth_dates", _BIRTH_SQL + """,
m_last AS (SELECT customer_id, arg_max(d, h) AS d FROM m_judged WHERE reason IS NULL GROUP BY customer_id)
SELECT cu.customer_id, coalesce(la.d, cu.dob) AS dob
FROM m_customers cu LEFT JOIN m_last la ON la.customer_id = cu.customer_id""")(
    lambda t: D.set_birth_dates(t.customers, Rq.birth_dates(t), EA)["customers"].select("customer_id", "dob"))

register("d14_birth_date_reasons", _BIRTH_SQL + """
SELECT customer_id, dob, reason FROM m_judged""")(
    lambda t: Rq.birth_dates(t).select("customer_id", "dob", Qy.dob_reason("dob", EA).alias("reason")))

_CARTS_SQL = """
m_cart_lines AS (
  SELECT l_orderkey, count(*) AS n,
         bool_or(l_partkey = 0 OR CAST(l_quantity AS INT) = 0 OR CAST(l_extendedprice AS DECIMAL(10,2)) = 0) AS bad,
         sum(CAST(l_extendedprice AS DECIMAL(10,2)) * CAST(l_quantity AS INT)) AS total
  FROM lineitem GROUP BY l_orderkey),
m_carts AS (
  SELECT 'cart-' || o_orderkey AS cart_id, o_custkey AS customer_id,
         CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE 'T-' || CAST(1 + o_orderkey % 5 AS VARCHAR) END AS table_number,
         CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 600) * INTERVAL 1 MINUTE AS ts,
         o_orderkey % 89 = 0 AS online, coalesce(cl.n, 0) AS n, coalesce(cl.bad, false) AS bad, cl.total
  FROM orders LEFT JOIN m_cart_lines cl ON cl.l_orderkey = o_orderkey),
m_checked AS (
  SELECT ct.*, CAST(ct.ts AS DATE) AS day,
         CASE WHEN n = 0 THEN 'empty_cart' WHEN coalesce(trim(table_number), '') = '' THEN 'missing_table'
              WHEN bad THEN 'invalid_item' END AS static_reason,
         EXISTS (SELECT 1 FROM m_orders od WHERE od.table_number = ct.table_number
                  AND od.status IN ('pending', 'preparing', 'ready')
                  AND CAST(od.created_at AS DATE) = CAST(ct.ts AS DATE)) AS occupied
  FROM m_carts ct),
m_first AS (
  SELECT table_number, day, ts AS w_ts, cart_id AS w_cart FROM m_checked
  WHERE static_reason IS NULL AND NOT occupied
  QUALIFY row_number() OVER (PARTITION BY table_number, day ORDER BY ts, cart_id) = 1),
m_decided AS (
  SELECT ck.*,
         CASE WHEN static_reason IN ('empty_cart', 'missing_table') THEN static_reason
              WHEN occupied OR (fs.w_ts IS NOT NULL AND (ck.ts > fs.w_ts OR (ck.ts = fs.w_ts AND ck.cart_id > fs.w_cart)))
                THEN 'table_occupied'
              ELSE static_reason END AS reason
  FROM m_checked ck LEFT JOIN m_first fs ON fs.table_number = ck.table_number AND fs.day = ck.day)"""

register("d1_ingest_rejects", _CARTS_SQL + """
SELECT cart_id, customer_id, table_number, ts, reason FROM m_decided WHERE reason IS NOT NULL""",
         "every order re-sent as a cart of its lines")(
    lambda t: _ingested(t).rejects)

#: Accepted carts with the ids that serial columns give them.
_ACCEPTED_SQL = _CARTS_SQL + """,
m_new AS (
  SELECT *, row_number() OVER (ORDER BY ts, cart_id) - 1 AS place, sum(n) OVER (ORDER BY ts, cart_id) - n AS lines_before
  FROM m_decided WHERE reason IS NULL)"""
_NEW_ORDERS_SQL = _ACCEPTED_SQL + """
SELECT CAST((SELECT max(order_id) FROM m_orders) + 1 + place AS BIGINT) AS order_id, customer_id, table_number,
       CAST(total AS DECIMAL(12,2)) AS total_amount, 'pending' AS status, ts AS created_at
FROM m_new"""
_NEW_LINES_SQL = _ACCEPTED_SQL + """
SELECT CAST((SELECT max(order_item_id) FROM m_order_items) + lines_before + row_number() OVER (
              PARTITION BY cart_id ORDER BY l_linenumber, l_partkey, CAST(l_quantity AS INT), CAST(l_extendedprice AS DECIMAL(10,2))) AS BIGINT)
         AS order_item_id,
       CAST((SELECT max(order_id) FROM m_orders) + 1 + place AS BIGINT) AS order_id, l_partkey AS item_id,
       CAST(l_quantity AS INT) AS quantity, CAST(l_extendedprice AS DECIMAL(12,2)) AS price
FROM m_new JOIN lineitem ON 'cart-' || l_orderkey = cart_id"""


def _ingested(t: Tables) -> D.Change:
    return D.ingest_orders(t.orders, Rq.carts(t), D.order_ids(t))


register("d1_ingest_orders", _NEW_ORDERS_SQL, "accepted carts")(lambda t: _ingested(t)["orders"])
register("d1_ingest_lines", _NEW_LINES_SQL, "lines of the accepted carts")(lambda t: _ingested(t)["order_items"])
register("d1_ingest_payments", _ACCEPTED_SQL + """
SELECT CAST((SELECT max(payment_id) FROM m_payments) + 1 + place AS BIGINT) AS payment_id,
       CAST((SELECT max(order_id) FROM m_orders) + 1 + place AS BIGINT) AS order_id, CAST(total AS DECIMAL(12,2)) AS amount,
       CASE WHEN online THEN 'completed' ELSE 'pending' END AS payment_status,
       CASE WHEN online THEN 'razorpay' ELSE 'cash' END AS payment_method,
       CASE WHEN online THEN 'pay_' || substr(cart_id, 6) END AS razorpay_payment_id, ts AS created_at
FROM m_new""", "payments of the accepted carts")(lambda t: _ingested(t)["payments"])
register("d13_category_snapshot", """
m_req AS (SELECT DISTINCT CASE WHEN CAST(substr(p_brand, 7) AS INT) % 2 = 0 THEN CAST(substr(p_brand, 7) AS INT) END
                   AS category_id, trim(' Menu ' || p_brand || ' ') AS category_name FROM part),
m_ren AS (SELECT rq.category_id, rq.category_name FROM m_req rq
          JOIN m_menu_category mc ON mc.category_id = rq.category_id)
SELECT mc.category_id, mc.category_name FROM m_menu_category mc
WHERE mc.category_id NOT IN (SELECT category_id FROM m_ren)
UNION ALL SELECT category_id, category_name FROM m_ren
UNION ALL SELECT NULL, category_name FROM m_req WHERE category_id IS NULL""",
         "rename even brands, insert odd ones; new ids are hashes: compared as NULL")(
    lambda t: D.upsert_categories(t.menu_category, t.raw("part").select(
        F.when(F.substring("p_brand", 7, 10).cast("int") % 2 == 0, F.substring("p_brand", 7, 10).cast("int"))
        .alias("category_id"), F.concat(F.lit(" Menu "), F.col("p_brand"), F.lit(" ")).alias("category_name"))
        .distinct())["menu_category"].join(t.menu_category.select("category_id", F.lit(True).alias("old")), "category_id", "left")
    .select(F.when(F.col("old"), F.col("category_id")).alias("category_id"), "category_name"))
register("d15_record_payments_rejects", """
m_req AS (SELECT event_id AS order_id, user_id AS customer_id FROM events)
SELECT rq.order_id, rq.customer_id,
       CASE WHEN od.order_id IS NULL THEN 'not_found' ELSE 'unauthorized' END AS reason
FROM m_req rq LEFT JOIN m_orders od ON od.order_id = rq.order_id
WHERE od.order_id IS NULL OR od.customer_id <> rq.customer_id""", "events as verified payments")(
    lambda t: D.record_payments(t.orders, t.payments, t.raw("events").select(
        F.col("event_id").alias("order_id"), F.col("user_id").alias("customer_id"),
        F.concat(F.lit("pay_e"), F.col("event_id").cast("string")).alias("razorpay_payment_id"),
        F.col("ts"))).rejects)

register("d15_recorded_payments", """
SELECT (SELECT max(payment_id) FROM m_payments) + row_number() OVER (ORDER BY od.created_at, od.order_id) AS payment_id,
       od.order_id, od.total_amount AS amount, 'pay_' || od.order_id AS razorpay_payment_id, od.created_at
FROM m_orders od
WHERE NOT EXISTS (SELECT 1 FROM m_payments p WHERE p.order_id = od.order_id AND p.razorpay_payment_id = 'pay_' || od.order_id)""",
         "every order paid by its customer, twice in the batch; known references are not recorded again")(
    lambda t: D.record_payments(t.orders, t.payments, _own_payments(t))["payments"].join(
        t.payments.select("payment_id"), "payment_id", "left_anti").select(
        "payment_id", "order_id", "amount", "razorpay_payment_id", "created_at"))


def _own_payments(t: Tables) -> DataFrame:
    paid = t.orders.select("order_id", "customer_id", F.concat(F.lit("pay_"), F.col("order_id").cast("string"))
                           .alias("razorpay_payment_id"), F.col("created_at").alias("ts"))
    return paid.unionByName(paid.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR")))


# ------------------------------------------- T streams: batch twins (same code)


def _attempts(t):
    """Attempts for T4: each signup issues a code; the user's later events try the newest
    code while it lives (the as-of join of J9, never all pairs of a user)."""
    return valid_session_activity(t.sessions, t.activity).select(
        F.col("customer_id").cast("string").alias("key"), F.col("session_start").alias("issued_at"), "ts")


register("t1_quota_breaches_daily", """
SELECT CAST(user_id AS VARCHAR) AS client, date_trunc('day', ts) AS window_start,
       date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, COUNT(*) AS n
FROM events GROUP BY 1, 2, 3 HAVING COUNT(*) > 5""", "1-day windows, max 5 (FIXTURES quota case)")(
    lambda t: St.quota_breaches_batch(
        t.raw("events").select(F.col("user_id").cast("string").alias("client"), "ts"), "1 day", 5))

register("t6_revenue_hourly", """
SELECT date_trunc('hour', created_at) AS window_start, date_trunc('hour', created_at) + INTERVAL 1 HOUR AS window_end,
       CAST(SUM(total_amount) AS DOUBLE) AS revenue, COUNT(*) AS orders
FROM m_live_orders GROUP BY 1, 2""")(lambda t: St.revenue_batch(t.live_orders, "1 hour"))

register("t3_latest_status", _UPDATES_SQL + """
SELECT order_id, arg_max(status, (ts, status)) AS status, MAX(ts) AS ts,
       arg_max(status, (ts, status)) IN ('pending', 'preparing', 'ready') AS is_open
FROM m_updates WHERE status IN ('pending', 'preparing', 'ready', 'completed', 'cancelled') GROUP BY order_id""")(
    lambda t: St.latest_status_batch(Rq.status_updates(t).filter(Qy.status_ok("status"))))

register("t1_exact_limiter", """
m_req AS (SELECT CAST(user_id AS VARCHAR) AS client, CAST(ts AS TIMESTAMP) AS ts FROM events),
m_opens AS (
  SELECT client, min(ts) AS start FROM m_req GROUP BY client
  UNION ALL
  SELECT o.client, min(r.ts) FROM m_opens o JOIN m_req r ON r.client = o.client AND r.ts >= o.start + INTERVAL 1 DAY
  GROUP BY o.client, o.start),
m_in AS (SELECT r.client, r.ts, o.start FROM m_req r ASOF JOIN m_opens o ON r.client = o.client AND r.ts >= o.start)
SELECT client, ts, start AS window_start, hits FROM (
  SELECT *, row_number() OVER (PARTITION BY client, start ORDER BY ts) AS hits FROM m_in) WHERE hits > 2""",
         "a window per client of one day from its first request on, 2 requests in each", recursive=True)(
    lambda t: limiter.rate_limit(t.raw("events").select(F.col("user_id").cast("string").alias("client"), "ts"), 86_400, 2))

_SEEN_SQL = _UPDATES_SQL + """,
m_seen AS (SELECT order_id, ts, lag(ts) OVER (PARTITION BY order_id ORDER BY ts) AS before FROM m_updates),
m_island AS (SELECT *, count(*) FILTER (WHERE before IS NULL OR ts - before > INTERVAL 6 HOURS)
                         OVER (PARTITION BY order_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m_seen)"""
register("t2_arrivals", _SEEN_SQL + """
SELECT order_id, min(ts) AS arrived_at, max(ts) AS last_seen, count(*) AS sightings FROM m_island GROUP BY order_id, k""",
         "an order id arrives anew after six hours unseen")(
    lambda t: St.arrivals(Rq.status_updates(t), "6 hours", "order_id", "ts"))

register("q8_cart_price_mismatches", """
m_pos AS (
  SELECT 'cart-' || l_orderkey AS cart_id,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, CAST(l_quantity AS INT),
                                 CAST(l_extendedprice AS DECIMAL(10,2))) - 1 AS INTEGER) AS pos,
         l_partkey AS item_id, CAST(l_extendedprice AS DECIMAL(10,2)) AS cart_price
  FROM lineitem)
SELECT ps.cart_id, ps.pos, ps.item_id, ps.cart_price, it.price AS menu_price
FROM m_pos ps LEFT JOIN m_menu_items it ON it.item_id = ps.item_id
WHERE it.price IS NULL OR ps.cart_price <> it.price""", "corrected Q8 over carts re-sent from orders")(
    lambda t: D.price_mismatches(Rq.carts(t), t.menu_items))

register("t4_attempt_limits", """
m_att AS (
  SELECT CAST(a.customer_id AS VARCHAR) AS key, s.created_at AS issued_at, a.ts
  FROM m_activity a ASOF JOIN m_sessions s ON a.customer_id = s.customer_id AND a.ts >= s.created_at
  WHERE a.ts < s.expires_at)
SELECT key, issued_at, COUNT(*) AS attempts FROM m_att
WHERE ts >= issued_at AND ts < issued_at + INTERVAL 1 DAY GROUP BY key, issued_at HAVING COUNT(*) > 1""",
         "signups issue codes; the user's later events try the newest code within its day (max 1)")(
    lambda t: St.attempt_limits(_attempts(t), max_attempts=1, lifetime="1 day"))

# ----------------------------------------- more primitives with their own key


register("a12_nested_items", f"""
SELECT od.order_id, {items_text_sql(_LIST_FIELDS)}
FROM m_orders od
LEFT JOIN m_order_items li ON od.order_id = li.order_id
LEFT JOIN m_menu_items it ON li.item_id = it.item_id
GROUP BY od.order_id""", "every order's item array (no payment fan-out), as canonical text")(
    lambda t: t.orders.select("order_id").join(L.item_arrays(t), "order_id", "left").select(
        "order_id", canonical_text(F.col("items"), list(L.LISTING_ITEM_FIELDS)).alias("items_text"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items")))

register("o3_reviews_page_two", _reviews_sql(10), "second page (offset 10)")(
    lambda t: A.recent_reviews(t, 10, 10))

register("p6_open_orders_by_table", """
SELECT table_number, status, COUNT(*) AS orders FROM m_orders
WHERE status IN ('pending', 'preparing', 'ready') GROUP BY table_number, status""")(
    lambda t: t.orders.filter(P.in_list("status", P.csv_list(" pending, preparing ,ready")))
    .groupBy("table_number", "status").agg(F.count(F.lit(1)).alias("orders")))

register("a3_daily_customers", f"""
SELECT CAST(created_at AS DATE) AS day, COUNT(DISTINCT customer_id) AS customers, COUNT(*) AS orders
FROM m_orders WHERE created_at >= DATE '{OA}' - INTERVAL '30 days' GROUP BY 1""")(
    lambda t: P.period_filter(t.orders, "created_at", "month", OA).groupBy(Fx.to_day("created_at").alias("day"))
    .agg(F.countDistinct("customer_id").alias("customers"), F.count(F.lit(1)).alias("orders")))

register("f3_f24_amount_text", """
SELECT order_id, printf('%.2f', total_amount) AS amount_text, CAST(round(total_amount * 100) AS BIGINT) AS paise,
       quantity_total
FROM m_orders o JOIN (SELECT order_id AS oid, CAST(SUM(quantity) AS BIGINT) AS quantity_total
                      FROM m_order_items GROUP BY order_id) q ON o.order_id = q.oid""")(
    lambda t: t.orders.join(t.order_items.groupBy("order_id").agg(
        F.sum("quantity").cast("long").alias("quantity_total")), "order_id").select(
        "order_id", Fx.fixed("total_amount", 2).alias("amount_text"), Fx.paise("total_amount").alias("paise"),
        "quantity_total"))


register("o3_keyset_page", """
SELECT order_id, customer_id, status, created_at FROM m_orders
WHERE created_at < TIMESTAMP '2001-07-20 00:00:00'
   OR (created_at = TIMESTAMP '2001-07-20 00:00:00' AND order_id < 7000)
ORDER BY created_at DESC, order_id DESC LIMIT 20""", "deep page by cursor (created_at, order_id), no offset scan")(
    lambda t: keyset_page(t.orders.select("order_id", "customer_id", "status", "created_at"),
                          "created_at", "order_id", 20, after=("2001-07-20 00:00:00", 7000)))

register("r11_users_with_dob_search", """
m_per AS (SELECT customer_id, count(DISTINCT order_id) AS n,
                 sum(total_amount) FILTER (WHERE status = 'completed') AS spent, max(created_at) AS last_at
          FROM m_orders GROUP BY customer_id)
SELECT cu.customer_id, cu.name, cu.phone, cu.dob, cu.created_at AS joined_date,
       coalesce(pr.n, 0) AS total_orders, CAST(coalesce(pr.spent, 0) AS DOUBLE) AS total_spent,
       pr.last_at AS last_order_date
FROM m_customers cu LEFT JOIN m_per pr ON pr.customer_id = cu.customer_id
WHERE cu.dob IS NOT NULL
  AND (position('customer#0000001' IN lower(cu.name)) > 0 OR position('customer#0000001' IN cu.phone) > 0)""",
         "the users page: R11 with the with_dob segment (P12) and a search (P13)")(
    lambda t: A.customers_with_stats(t).filter(P.customer_segment("with_dob", EA))
    .filter(P.search_customers(" Customer#0000001 ")))

register("v8_null_counts", """
SELECT count(*) FILTER (WHERE rating_id IS NULL) AS rating_id, count(*) FILTER (WHERE review_text IS NULL) AS review_text,
       count(*) FILTER (WHERE item_id IS NULL) AS item_id, count(*) FILTER (WHERE order_id IS NULL) AS order_id
FROM m_ratings""", "NULLs per column, in one pass")(
    lambda t: Qy.not_null_violations(t.ratings, ["rating_id", "review_text", "item_id", "order_id"]))

register("p10_menu_category_3", """
m_rated AS (SELECT item_id, sum(rating_value) AS s, count(rating_id) AS c FROM m_ratings GROUP BY item_id)
SELECT it.item_id, it.item_name, it.category_id, cat.category_name, CAST(it.price AS DOUBLE) AS price,
       it.image_url, it.description, it.is_available,
       coalesce((20 * rr.s + rr.c) // (2 * rr.c) / 10.0, 0) AS avg_rating, coalesce(rr.c, 0) AS rating_count
FROM m_menu_items it
JOIN m_menu_category cat ON cat.category_id = it.category_id
LEFT JOIN m_rated rr ON rr.item_id = it.item_id
WHERE it.is_available AND it.category_id = 3""", "the public menu for one category (P10; 'all' or absent = no filter)")(
    lambda t: A.menu_with_ratings(t, category_id=3))

# ------------------------------------------------ parameters and corrected variants

register("sales_overview_today", _overview_sql("today"))(lambda t: S.sales_overview(t.orders, "today", OA))

register("sales_by_category_corrected", f"""
{_sold_sql(None)}
SELECT coalesce(cat.category_name, 'Uncategorized') AS category, CAST(sum(s.rev) AS DOUBLE) AS total_revenue
FROM m_sold s JOIN m_menu_items it ON it.item_id = s.item_id
LEFT JOIN m_menu_category cat ON cat.category_id = it.category_id
GROUP BY 1""", "grouped by the label")(lambda t: S.sales_by_category(t, "all", OA, corrected=True))

register("revenue_trend_corrected", f"""
m_days AS (SELECT CAST(unnest(generate_series(DATE '{OA}' - INTERVAL 40 DAY, DATE '{OA}', INTERVAL 1 DAY)) AS DATE) AS d),
m_rev AS (SELECT CAST(created_at AS DATE) AS d, sum(total_amount) AS rev FROM m_orders GROUP BY 1)
SELECT m_days.d AS date, CAST(coalesce(rev, 0) AS DOUBLE) AS revenue FROM m_days LEFT JOIN m_rev ON m_rev.d = m_days.d""",
         "days without orders count 0 (Q9)")(lambda t: S.revenue_trend(t.orders, OA, 40, corrected=True))

register("payment_method_mix_corrected", """
m_last AS (SELECT order_id, arg_max(payment_method, (created_at, payment_id)) AS payment_method FROM m_payments GROUP BY order_id)
SELECT coalesce(la.payment_method, 'cash') AS payment_method, CAST(sum(od.total_amount) AS DOUBLE) AS total_amount
FROM m_orders od LEFT JOIN m_last la ON la.order_id = od.order_id GROUP BY 1""", "each order once, under its latest payment")(
    lambda t: S.payment_method_mix(t, "all", OA, corrected=True))

register("customer_orders_of_one", f"""
SELECT od.customer_id, od.order_id, od.table_number, od.total_amount, od.status, od.created_at,
       py.payment_status, py.payment_method, {items_text_sql(_LIST_FIELDS)}
FROM m_orders od
LEFT JOIN m_payments py ON od.order_id = py.order_id
LEFT JOIN m_order_items li ON od.order_id = li.order_id
LEFT JOIN m_menu_items it ON li.item_id = it.item_id
WHERE od.customer_id = 7
GROUP BY od.customer_id, od.order_id, od.table_number, od.total_amount, od.status, od.created_at,
         py.payment_status, py.payment_method""", "R12 for customer 7")(
    lambda t: L.with_items_text(L.customer_orders_nested(t, 7)))


def _filtered_listing_sql(where: str, limit: int, offset: int) -> str:
    return f"""
m_page AS (
  SELECT od.order_id, od.customer_id, cu.name AS customer_name, cu.phone AS customer_phone, od.table_number,
         od.total_amount, od.status, od.created_at, py.payment_status, py.payment_method, py.razorpay_payment_id
  FROM m_orders od JOIN m_customers cu ON od.customer_id = cu.customer_id
  LEFT JOIN m_payments py ON od.order_id = py.order_id
  WHERE {where}
  GROUP BY ALL
  ORDER BY od.created_at DESC, od.order_id DESC, py.payment_status, py.payment_method, py.razorpay_payment_id
  LIMIT {limit} OFFSET {offset})
SELECT pg.*, {items_text_sql(_LIST_FIELDS)}
FROM m_page pg
LEFT JOIN m_payments py ON pg.order_id = py.order_id
     AND py.payment_status IS NOT DISTINCT FROM pg.payment_status
     AND py.payment_method IS NOT DISTINCT FROM pg.payment_method
     AND py.razorpay_payment_id IS NOT DISTINCT FROM pg.razorpay_payment_id
LEFT JOIN m_order_items li ON pg.order_id = li.order_id
LEFT JOIN m_menu_items it ON li.item_id = it.item_id
GROUP BY ALL"""


register("orders_listing_old_by_status", _filtered_listing_sql(
    f"od.status != 'completed' AND od.status IN ('pending', 'ready') AND CAST(od.created_at AS DATE) < DATE '2001-03-01'", 30, 15),
    "status and date filters, second page")(
    lambda t: L.with_items_text(L.orders_listing(t, status="pending, ready", date_filter="old", limit=30, offset=15,
                                                 as_of="2001-03-01")))
register("orders_listing_today", _filtered_listing_sql("CAST(od.created_at AS DATE) = DATE '2001-03-01'", 40, 0),
         "date_filter=today, any status")(
    lambda t: L.with_items_text(L.orders_listing(t, date_filter="today", view_type="all", limit=40, as_of="2001-03-01")))

register("recent_reviews_of_item", """
SELECT tx.rating_id, tx.customer_id, tx.rating_value, tx.review_text, tx.item_id, tx.created_at, cu.name AS customer_name,
       substr(cu.phone, 1, 2) || repeat('X', 6) || substr(cu.phone, 9, 2) AS masked_phone, it.item_name, it.image_url AS item_image
FROM m_ratings tx JOIN m_customers cu ON cu.customer_id = tx.customer_id
LEFT JOIN m_menu_items it ON it.item_id = tx.item_id
WHERE coalesce(tx.review_text, '') <> '' AND tx.item_id = 5 ORDER BY tx.created_at DESC, tx.rating_id DESC LIMIT 10""")(
    lambda t: A.recent_reviews(t, 10, 0, item_id=5))

register("f3_to_fixed", """
SELECT event_id, printf('%.2f', CASE WHEN (value * 8) % 2 = 1 THEN value + 0.001 ELSE value END) AS two,
       printf('%.1f', CASE WHEN (value * 4) % 2 = 1 THEN value + 0.01 ELSE value END) AS one,
       printf('%.0f', CASE WHEN (value * 2) % 2 = 1 THEN value + 0.1 ELSE value END) AS zero
FROM events WHERE value >= 0""", "toFixed of whole-table doubles; printf rounds exact ties to even")(
    lambda t: t.raw("events").filter(F.col("value") >= 0).select(
        "event_id", Fx.fixed("value", 2).alias("two"), Fx.fixed("value", 1).alias("one"), Fx.fixed("value", 0).alias("zero")))

register("f18_age_classes", """
SELECT order_id, CASE WHEN epoch_us(TIMESTAMP '2024-01-15 12:00:00' - created_at) / 60000000.0 > 20 THEN 'urgent'
                      WHEN epoch_us(TIMESTAMP '2024-01-15 12:00:00' - created_at) / 60000000.0 > 10 THEN 'warning' ELSE '' END AS age_class
FROM m_live_orders""", "every live order at one moment of the period")(
    lambda t: t.live_orders.select("order_id", Fx.age_class("created_at", "2024-01-15 12:00:00").alias("age_class")))

# --------------------------------------------- sources, sinks and streams end to end

register("s2_carts_from_json", _CARTS_SQL + """
SELECT cart_id, customer_id, table_number, ts, n AS n_items, CAST(total AS DOUBLE) AS total FROM m_carts""",
         "carts written as JSON lines and read back by S2")(lambda t: _json_carts(t))


def _json_carts(t: Tables) -> DataFrame:
    path = replay.scratch(t.spark, "carts")
    io.write_json(Rq.carts(t).withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")), path)
    total = F.aggregate("items", F.lit(0).cast("decimal(22,2)"), lambda a, x: (a + x["price"] * x["quantity"]).cast("decimal(22,2)"))
    return io.read_carts(t.spark, path).filter(F.col("_corrupt_record").isNull()).select(
        "cart_id", "customer_id", "table_number", F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.size("items").cast("long").alias("n_items"),
        F.when(F.size("items") > 0, Fx.money(total)).alias("total"))


register("s3_order_documents", f"""
SELECT od.order_id, od.status, {items_text_sql(_LIST_FIELDS)}
FROM m_orders od
LEFT JOIN m_order_items li ON od.order_id = li.order_id
LEFT JOIN m_menu_items it ON li.item_id = it.item_id
GROUP BY od.order_id, od.status""", "orders with their items as JSON documents (S3), written and parsed again")(
    lambda t: _documents(t))


def _documents(t: Tables) -> DataFrame:
    orders = t.orders.select("order_id", "status").join(L.item_arrays(t), "order_id", "left")
    path = replay.scratch(t.spark, "documents")
    io.as_json_column(orders).write.text(path)
    back = t.spark.read.text(path).select(F.from_json("value", orders.schema).alias("o")).select("o.*")
    return back.select("order_id", "status", canonical_text(F.col("items"), list(L.LISTING_ITEM_FIELDS)).alias("items_text"),
                       F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"))


register("s4_appended_payments", """
SELECT payment_method, count(*) AS payments, CAST(sum(amount) AS DOUBLE) AS amount FROM m_payments GROUP BY payment_method""",
         "payments appended in two parts to a table by method (S4)")(lambda t: _appended(t))


def _appended(t: Tables) -> DataFrame:
    path = replay.scratch(t.spark, "payments")
    for k in range(2):
        io.append(t.payments.filter(F.col("payment_id") % 2 == k), path, ["payment_method"])
    return t.spark.read.parquet(path).groupBy("payment_method").agg(
        F.count(F.lit(1)).alias("payments"), Fx.money(F.sum("amount")).alias("amount"))


register("s5_status_snapshot", REGISTRY["d3_status_snapshot"].sql.split(MODEL_CTES.strip() + ",\n", 1)[1],
         "D3 on a bucketed table of committed versions")(lambda t: _status_version(t))


def _status_version(t: Tables) -> DataFrame:
    store = Store(t.spark, replay.scratch(t.spark, "orders"))
    store.create("orders", t.orders, "order_id", span=max(1, t.orders.agg(F.max("order_id")).first()[0] // 16))
    updates = Rq.status_updates(t)
    store.update("orders", updates.filter(F.col("order_id") >= 0), lambda rows: D.apply_status_updates(rows, updates)["orders"])
    return store.read("orders").withColumn("total_amount", Fx.money("total_amount"))


register("t3_live_status_table", REGISTRY["t3_latest_status"].sql.split(MODEL_CTES.strip() + ",\n", 1)[1],
         "the stream's table after all updates, in four batches")(lambda t: _live_status(t))


def _live_status(t: Tables) -> DataFrame:
    updates = Rq.status_updates(t).filter(Qy.status_ok("status"))
    out = replay.scratch(t.spark, "live")
    replay.run(updates, 4, "ts", lambda s, ck: St.live_order_status(s, out, ck, delay_seconds=3600, buckets=8, trigger={"availableNow": True}))
    return St.order_status(t.spark, out)


register("t7_ingested_orders", _NEW_ORDERS_SQL, "the carts as a stream of three batches")(lambda t: _streamed_carts(t, "orders"))
register("t7_ingested_lines", _NEW_LINES_SQL, "lines of the streamed carts")(lambda t: _streamed_carts(t, "order_items"))


def _streamed_carts(t: Tables, table: str) -> DataFrame:
    paths = {name: replay.scratch(t.spark, name) for name in ("orders", "order_items", "payments", "out")}
    for name in ("orders", "order_items", "payments"):
        getattr(t, name).write.parquet(paths[name])
    replay.run(Rq.carts(t), 3, "ts", lambda s, ck: St.ingest_stream(
        s, paths["orders"], paths["out"], ck, {"availableNow": True}, paths["order_items"], paths["payments"]))
    return St.ingested(t.spark, paths["out"], table)


# ------------------------------------------------- primitives that had no key

register("a3_weekly_customers_by_sketch", """
SELECT date_trunc('week', created_at) AS week, count(DISTINCT customer_id) AS customers, count(*) AS orders, TRUE AS estimate_fits
FROM m_orders GROUP BY 1""", "a week from its daily sketches, within four standard errors of the exact count")(lambda t: _weeks(t))


def _weeks(t: Tables) -> DataFrame:
    week = F.date_trunc("week", F.col("created_at")).cast("timestamp_ntz")
    exact = t.orders.groupBy(week.alias("week")).agg(F.countDistinct("customer_id").alias("customers"))
    days = daily_sketches(t.orders.filter(F.col("customer_id").isNotNull()), Fx.to_day("created_at"), "customer_id")
    guess = distinct_over(days, F.date_trunc("week", F.col("day")).cast("timestamp_ntz").alias("week"))
    fits = F.abs(F.col("distinct_values") - F.col("customers")) <= F.greatest(F.lit(1), 4 * 0.01625 * F.col("customers"))
    return exact.join(guess, "week").select("week", "customers", F.col("n").alias("orders"), fits.alias("estimate_fits"))


register("f25_line_totals", """
SELECT order_item_id, CAST(quantity * price AS DOUBLE) AS line_total FROM m_order_items""", "what a bill shows per line")(
    lambda t: t.order_items.select("order_item_id", Fx.money(Fx.line_total("quantity", "price")).alias("line_total")))

register("j4_orders_with_online_payment", """
SELECT od.order_id, py.payment_id FROM m_orders od
LEFT JOIN m_payments py ON py.order_id = od.order_id AND py.payment_method = 'razorpay'""",
         "the predicate in ON drops partners, never orders")(
    lambda t: (lambda p: outer_with_condition(t.orders, p, (p["_order"] == t.orders["order_id"]) & (p["payment_method"] == "razorpay"))
               .select("order_id", "payment_id"))(t.payments.select("payment_id", "payment_method", F.col("order_id").alias("_order"))))

for _kind, _where in (("new", "CAST(created_at AS DATE) = DATE '1999-05-05'"), ("no_dob", "dob IS NULL")):
    register(f"p12_customers_{_kind}", f"SELECT customer_id, name, phone, dob FROM m_customers WHERE {_where}",
             "segment of the users page")(
        lambda t, kind=_kind: t.customers.filter(P.customer_segment(kind, "1999-05-05")).select("customer_id", "name", "phone", "dob"))

register("o6_orders_listing_text_parameters", _filtered_listing_sql("od.status != 'completed'", 12, 5),
         "limit and offset as request texts: the leading digits count")(
    lambda t: L.with_items_text(L.orders_listing(t, view_type="active", limit="12abc", offset=" 5x", as_of=OA)))

register("o3_deep_page", """
SELECT order_item_id, order_id, quantity FROM m_order_items
ORDER BY quantity DESC, order_item_id LIMIT 500 OFFSET (SELECT count(*) // 2 FROM m_order_items)""",
         "500 rows from the middle of all lines, by range")(lambda t: _middle(t))


def _middle(t: Tables) -> DataFrame:
    lines = t.order_items.select("order_item_id", "order_id", "quantity")
    return deep_page(lines, [pg_desc("quantity"), pg_asc("order_item_id")], 500, lines.count() // 2)


register("delete_ratings_snapshot", """
SELECT rating_id, customer_id FROM m_ratings WHERE rating_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error')""",
         "an admin deletes the ratings of error events")(
    lambda t: D.delete_ratings(t.ratings, t.raw("events").filter("event_type = 'error'").select(F.col("event_id").alias("rating_id")))["ratings"]
    .select("rating_id", "customer_id"))

register("end_sessions_snapshot", """
SELECT session_id, customer_id, admin_id FROM m_sessions WHERE id % 3 <> 0""", "every third session logs out")(
    lambda t: D.end_sessions(t.sessions, t.sessions.filter("id % 3 = 0").select("session_id"))["sessions"].select(
        "session_id", "customer_id", "admin_id"))

register("register_customers_snapshot", """
m_ask AS (SELECT s_name, s_suppkey, CAST(9000000000 + s_suppkey * 40 AS VARCHAR) AS phone FROM supplier),
m_fresh AS (SELECT phone, s_suppkey FROM m_ask WHERE phone NOT IN (SELECT phone FROM m_customers))
SELECT customer_id, phone FROM m_customers
UNION ALL SELECT (SELECT max(customer_id) FROM m_customers) + row_number() OVER (ORDER BY phone), phone FROM m_fresh""",
         "suppliers register as customers; some phones are known")(
    lambda t: D.register_customers(t.customers, t.raw("supplier").select(
        F.lit("New Guest").alias("name"), (F.lit(9000000000) + F.col("s_suppkey") * 40).cast("string").alias("phone"),
        F.lit("2001-08-01 10:00:00").cast("timestamp_ntz").alias("ts")))["customers"].select("customer_id", "phone"))
