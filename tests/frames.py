"""Tiny hand-made model frames (FIXTURES.md §4)."""

import datetime as dt
from decimal import Decimal as D

from thali.sources import schema as S
from thali.sources.model import from_frames

T0 = dt.datetime(2024, 1, 30, 9, 0)


def tables(spark, **over):
    customers = [
        (1, "Asha Rao", "9876543210", dt.datetime(2024, 1, 30, 8), dt.date(1990, 1, 30)),
        (2, "Ben", None, dt.datetime(2023, 5, 1), None),
        (3, "Chitra Devi Iyer", "12345", dt.datetime(2023, 6, 1), dt.date(2000, 2, 29)),
    ]
    categories = [(1, "Starters"), (2, "Uncategorized")]
    items = [
        (10, "Samosa", 1, D("20.00"), None, None, True),
        (11, "Lassi", None, D("40.00"), None, None, True),      # NULL category
        (12, "Dosa", 2, D("60.00"), None, None, True),          # real 'Uncategorized'
        (13, "Idli", 1, D("30.00"), None, None, True),          # never sold
        (14, "Vada", 1, D("25.00"), None, None, False),         # unavailable
    ]
    orders = [
        (100, 1, "T-1", D("80.00"), "completed", dt.datetime(2024, 1, 30, 8)),
        (101, 1, "T-2", D("40.00"), "pending", dt.datetime(2024, 1, 30, 9)),
        (102, 2, "T-3", D("60.00"), None, dt.datetime(2024, 1, 29, 9)),    # NULL status
        (103, 3, "T-1", D("20.00"), "cancelled", dt.datetime(2024, 1, 20, 9)),
    ]
    lines = [
        (1000, 100, 10, 2, D("20.00")),
        (1001, 100, 11, 1, D("40.00")),
        (1010, 101, 11, 1, D("40.00")),
        (1020, 102, 12, 1, D("60.00")),
        (1030, 103, 10, 1, D("20.00")),
    ]
    payments = [
        (1, 100, D("80.00"), "completed", "cash", None, dt.datetime(2024, 1, 30, 8)),
        (2, 100, D("80.00"), "completed", "cash", None, dt.datetime(2024, 1, 30, 8)),   # equal duplicate
        (3, 101, D("40.00"), "pending", None, None, dt.datetime(2024, 1, 30, 9)),       # NULL method
        (4, 102, D("60.00"), "completed", "razorpay", "pay_x", dt.datetime(2024, 1, 29, 9)),
        (5, 102, D("60.00"), "pending", "cash", None, dt.datetime(2024, 1, 29, 9)),     # different fields
    ]
    ratings = [
        (1, 1, 5, "great", dt.datetime(2024, 1, 30, 10), 10, None),
        (2, 1, 4, "", dt.datetime(2024, 1, 30, 11), 10, None),       # second rating of item 10
        (3, 1, 3, None, dt.datetime(2024, 1, 30, 12), None, 100),
        (4, 2, 1, "bad", dt.datetime(2024, 1, 25, 12), None, 100),   # foreign order
    ]
    sessions = [
        ("a", 1, None, None, dt.datetime(2024, 1, 29, 10), dt.datetime(2024, 1, 30, 10), None, 1, None),
        ("b", 1, None, None, dt.datetime(2024, 1, 30, 8), dt.datetime(2024, 1, 31, 8), None, 2, None),
        ("c", 2, None, None, dt.datetime(2024, 1, 20, 8), dt.datetime(2024, 1, 21, 8), None, 3, None),
    ]
    frames = dict(
        customers=spark.createDataFrame(customers, S.CUSTOMERS),
        menu_category=spark.createDataFrame(categories, S.MENU_CATEGORY),
        menu_items=spark.createDataFrame(items, S.MENU_ITEMS),
        orders=spark.createDataFrame(orders, S.ORDERS),
        order_items=spark.createDataFrame(lines, S.ORDER_ITEMS),
        payments=spark.createDataFrame(payments, S.PAYMENTS),
        ratings=spark.createDataFrame(ratings, S.RATINGS),
        sessions=spark.createDataFrame(sessions, S.SESSIONS),
        admins=spark.createDataFrame([(1, "boss", None), (2, "cook", "c@example.com")], S.ADMINS),
    )
    frames.update(over)
    return from_frames(spark, **frames)
