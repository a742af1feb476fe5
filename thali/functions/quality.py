"""V1–V8: data-quality rules as Column expressions and whole-table checks.

A rule is a boolean Column (true = passes). ``validate`` attaches the names of
the failed rules as an array column, so a table is checked in one narrow pass
and rejects keep their reasons.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thali.functions.scalars import age_years, digits_only
from thali.functions.predicates import as_date
from thali.sources.schema import ORDER_STATUSES

# The reference's validation patterns.
MOBILE_PATTERN = r"^[6-9][0-9]{9}$"
NAME_PATTERN = r"^[A-Za-z\s]+$"
ISO_DATE_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
MIN_AGE, MAX_AGE = 13, 120


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def phone_ok(phone: str | Column) -> Column:
    """V1: digits only, then a ten-digit mobile number starting 6–9."""
    return F.coalesce(digits_only(phone).rlike(MOBILE_PATTERN), F.lit(False))


def name_ok(name: str | Column) -> Column:
    """V2: letters and spaces, at least two characters after trimming."""
    t = F.trim(_c(name))
    return F.coalesce((F.length(t) >= 2) & t.rlike(NAME_PATTERN), F.lit(False))


def rating_ok(rating: str | Column) -> Column:
    """V3: present and within 1..5 (0 counts as missing)."""
    return F.coalesce(_c(rating).between(1, 5), F.lit(False))


def status_ok(status: str | Column) -> Column:
    """V5."""
    return F.coalesce(_c(status).isin(*ORDER_STATUSES), F.lit(False))


def dob_reason(text: str | Column, as_of) -> Column:
    """V4: NULL when the date-of-birth text is acceptable, else the reason."""
    s = _c(text)
    d = F.try_to_date(s, "yyyy-MM-dd")
    today = F.lit(as_date(as_of))
    age = age_years(d, as_of)
    return (F.when(s.isNull() | (s == ""), "required")
            .when(~s.rlike(ISO_DATE_PATTERN), "bad_format")
            .when(d.isNull(), "invalid_date")
            .when(d > today, "future")
            .when(age < MIN_AGE, "too_young")
            .when(age > MAX_AGE, "too_old"))


def cart_reason(items: str | Column, table_number: str | Column) -> Column:
    """V6 (static part): empty cart, missing table, a line without item, quantity or
    price (0 counts as missing, as JS truthiness does). Occupancy is checked by the
    change job."""
    arr = _c(items)
    bad_line = F.exists(arr, lambda x: x["item_id"].isNull() | (x["item_id"] == 0)
                        | x["quantity"].isNull() | (x["quantity"] == 0)
                        | x["price"].isNull() | (x["price"] == 0))
    table = F.trim(_c(table_number))
    return (F.when(arr.isNull() | (F.size(arr) == 0), "empty_cart")
            .when(table.isNull() | (table == ""), "missing_table")
            .when(bad_line, "invalid_item"))


def validate(df: DataFrame, rules: Mapping[str, Column], name: str = "violations") -> DataFrame:
    """Attach the names of failed rules (empty array = clean row)."""
    flags = [F.when(~rule, F.lit(rule_name)) for rule_name, rule in rules.items()]
    return df.withColumn(name, F.filter(F.array(*flags), lambda x: x.isNotNull()))


def validate_customers(customers: DataFrame) -> DataFrame:
    return validate(customers, {"phone": phone_ok("phone"), "name": name_ok("name")})


# The schema's foreign keys (child table, column, parent table, column).
FOREIGN_KEYS = (
    ("menu_items", "category_id", "menu_category", "category_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "item_id", "menu_items", "item_id"),
    ("orders", "customer_id", "customers", "customer_id"),
    ("payments", "order_id", "orders", "order_id"),
    ("ratings", "customer_id", "customers", "customer_id"),
    ("ratings", "item_id", "menu_items", "item_id"),
    ("ratings", "order_id", "orders", "order_id"),
    ("sessions", "customer_id", "customers", "customer_id"),
    ("sessions", "admin_id", "admins", "admin_id"),
)


def fk_orphans(tables, fks=FOREIGN_KEYS) -> DataFrame:
    """V7: for each foreign key, the number of child rows whose non-NULL key has no parent.

    One exchange for all keys: every table is read once and gives a (key space, key, role) row per
    key column; one aggregate per (key space, key) sees whether the key has a parent and how many
    children of each foreign key hold it. Its partial step makes a hot key one row per task.
    """
    spaces: dict[tuple[str, str], int] = {}
    roles: dict[str, list[tuple[int, str, int]]] = {}
    for i, (child, ccol, parent, pcol) in enumerate(fks):
        if (parent, pcol) not in spaces:
            spaces[parent, pcol] = len(spaces)
            roles.setdefault(parent, []).append((spaces[parent, pcol], pcol, -1))
        roles.setdefault(child, []).append((spaces[parent, pcol], ccol, i))
    union = None
    for name, own in roles.items():
        tagged = F.explode(F.array(*(F.struct(F.lit(space).alias("space"), F.col(col).cast("long").alias("k"), F.lit(fk).alias("fk"))
                                     for space, col, fk in own)))
        rows = getattr(tables, name).select(tagged.alias("x")).select("x.*").filter(F.col("k").isNotNull())
        union = rows if union is None else union.unionByName(rows)
    keys = union.groupBy("space", "k").agg(
        F.max(F.col("fk") == -1).alias("known"),
        *(F.count(F.when(F.col("fk") == i, 1)).alias(f"c{i}") for i in range(len(fks))))
    total = keys.filter(~F.col("known")).agg(*(F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"c{i}") for i in range(len(fks))))
    per_key = F.explode(F.array(*(F.struct(F.lit(f"{c}.{cc}").alias("fk"), F.lit(f"{p}.{pc}").alias("parent"),
                                           F.col(f"c{i}").alias("orphans")) for i, (c, cc, p, pc) in enumerate(fks))))
    return total.select(per_key.alias("x")).select("x.*")


def duplicate_keys(df: DataFrame, keys: list[str], skip_null: bool = True) -> DataFrame:
    """Key values held by more than one row, with their count (partial aggregation, skew-safe)."""
    d = df.select(*keys)
    if skip_null:
        for k in keys:
            d = d.filter(F.col(k).isNotNull())
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def not_null_violations(df: DataFrame, columns: list[str]) -> DataFrame:
    """V8: count of NULLs per NOT NULL column, one pass."""
    return df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])

