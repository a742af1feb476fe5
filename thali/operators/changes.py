"""The reference's change handlers as batch jobs over tables of requests.

Each job is a pure function ``(snapshots, requests) → Change(new snapshots,
rejects)``; nothing is mutated in place. A snapshot is written to a new
folder by ``thali.sources.io.write_snapshot``.

"Latest / first per key" is an aggregate (``max_by``/``min`` of a struct),
not a window: partial aggregation keeps a hot key to one row per map
partition. New rows get serial ids, as the
source's serial columns give them: dense, from one above the greatest, in the order of
the requests (``scans.with_serial``: prefix sums over ranges, at any partitioning), so no
two can meet. Numbering needs the accepted requests once, so it writes them to the
checkpoint folder; the rest of a job stays lazy.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thali.functions import quality as Q
from thali.functions.predicates import day_range, ts_literal, unexpired
from thali.functions.scalars import coerce_bool, parse_float_prefix
from thali.operators.joins import taken_by_other
from thali.operators.scans import next_id, with_prefix_sums, with_serial
from thali.sources.io import cut_lineage
from thali.sources.schema import MONEY, OPEN_STATUSES, PRICE

def optional(df: DataFrame, name: str, type_: str) -> DataFrame:
    """`df` with the column, NULL where requests do not carry it."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(type_))


def _now(as_of) -> Column:
    return ts_literal(as_of)


@dataclass
class Change:
    """New snapshots by table name, and rejected requests with a `reason`."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    rejects: DataFrame | None = None
    #: The next id of each serial column, for the batch after this one.
    next_ids: dict[str, int] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def _first_per_key(df: DataFrame, keys: list[str], order: list[str], id_col: str) -> DataFrame:
    """Ids of the first row per key by `order` (NULL keys excluded)."""
    d = df
    for k in keys:
        d = d.filter(F.col(k).isNotNull())
    best = F.min(F.struct(*[F.col(c) for c in order], F.col(id_col).alias("_id")))
    return d.groupBy(*keys).agg(best.alias("_w")).select(F.col("_w._id").alias(id_col))


# ---------------------------------------------------------------- D1, D2

def order_ids(t) -> dict[str, int]:
    """The next ids of the three tables that an order adds to."""
    return {"order_id": next_id(t.orders, "order_id"), "order_item_id": next_id(t.order_items, "order_item_id"),
            "payment_id": next_id(t.payments, "payment_id")}


def ingest_orders(orders: DataFrame, carts: DataFrame, ids: dict[str, int] | None = None) -> Change:
    """D1 + D2: carts → new orders, order_items, payments; rejects with reasons.

    Order of checks as in the reference: empty cart, missing table, table
    occupied (an open order on that table that day, in the snapshot or placed
    earlier in this batch), invalid line. Total = Σ price·quantity, trusting
    client prices (Q8). A cart with `pay_ref` is paid online (completed
    razorpay payment), else a pending cash payment. A repeated cart id keeps its first copy, and a
    cart whose order exists already (same customer, table, time and total) is skipped, so
    re-sent carts add nothing. Carts without an id, among them corrupt lines, are
    rejected one by one (with ``_corrupt_record`` where the reader kept it).

    New ids are serial in order of (time, cart id), lines in cart order, from `ids` on (``order_ids``;
    default: one above the greatest order, and 1 for the tables not given).
    """
    ids = ids or {"order_id": next_id(orders, "order_id"), "order_item_id": 1, "payment_id": 1}
    raw = optional(carts, "_corrupt_record", "string")
    c = raw.select("cart_id", "customer_id", F.trim("table_number").alias("table_number"),
                   F.col("ts").cast("timestamp_ntz").alias("ts"), "items", "pay_ref", "_corrupt_record")
    unnamed = c.filter(F.col("cart_id").isNull()).withColumn("reason", F.lit("missing_cart_id"))
    c = c.filter(F.col("cart_id").isNotNull())
    # A repeated cart id keeps its earliest copy (one aggregate, no window).
    cols = [x for x in c.columns if x != "cart_id"]
    c = c.groupBy("cart_id").agg(F.min_by(F.struct(*cols), F.struct("ts", "table_number")).alias("_c")) \
        .select("cart_id", "_c.*")
    total = F.aggregate("items", F.lit(0).cast(MONEY),
                        lambda acc, x: (acc + x["price"] * x["quantity"]).cast(MONEY))
    c = c.withColumn("day", F.to_date("ts")).withColumn("total", total)
    sent = orders.select(F.col("customer_id").alias("_who"), F.col("table_number").alias("_table"),
                         F.col("created_at").alias("_at"), F.col("total_amount").alias("_sum"))
    c = c.join(sent, (F.col("ts") == F.col("_at")) & F.col("table_number").eqNullSafe(F.col("_table"))
               & F.col("customer_id").eqNullSafe(F.col("_who")) & F.col("total").eqNullSafe(F.col("_sum")), "left_anti")
    c = c.withColumn("_static", Q.cart_reason("items", "table_number"))
    open_existing = orders.filter(F.col("status").isin(*OPEN_STATUSES)).select(
        "table_number", F.to_date("created_at").alias("day")).distinct().withColumn("_occ", F.lit(True))
    c = c.join(open_existing, ["table_number", "day"], "left")
    candidates = c.filter(F.col("_static").isNull() & F.col("_occ").isNull())
    winners = candidates.groupBy("table_number", "day").agg(
        F.min(F.struct("ts", "cart_id")).alias("_win"))
    c = c.join(winners, ["table_number", "day"], "left")
    beaten = F.col("_win").isNotNull() & (F.struct("ts", "cart_id") > F.col("_win"))
    reason = (F.when(F.col("_static").isin("empty_cart", "missing_table"), F.col("_static"))
              .when(F.col("_occ") | beaten, F.lit("table_occupied"))
              .when(F.col("_static").isNotNull(), F.col("_static")))
    # decided once: the accepted carts are numbered, the rejected ones reported
    c = cut_lineage(c.withColumn("reason", reason).drop("_occ", "_win", "_static"))
    ok = with_prefix_sums(c.filter(F.col("reason").isNull()), ["ts", "cart_id"], {"_n": F.lit(1), "_lines": F.size("items")})
    ok = ok.withColumn("order_id", F.col("_n") + F.lit(ids["order_id"]).cast("long"))
    new_orders = ok.select("order_id", "customer_id", "table_number", F.col("total").alias("total_amount"),
                           F.lit("pending").alias("status"), F.col("ts").alias("created_at"))
    lines = ok.select("order_id", "_lines", F.posexplode("items").alias("pos", "line")).select(
        (F.col("_lines") + F.col("pos") + F.lit(ids["order_item_id"]).cast("long")).alias("order_item_id"), "order_id",
        F.col("line.item_id").alias("item_id"), F.col("line.quantity").alias("quantity"),
        F.col("line.price").cast(MONEY).alias("price"))
    online = F.col("pay_ref").isNotNull()
    payments = ok.select(
        (F.col("_n") + F.lit(ids["payment_id"]).cast("long")).alias("payment_id"), "order_id",
        F.col("total").alias("amount"),
        F.when(online, "completed").otherwise("pending").alias("payment_status"),
        F.when(online, "razorpay").otherwise("cash").alias("payment_method"),
        F.col("pay_ref").alias("razorpay_payment_id"), F.col("ts").alias("created_at"))
    made = c.filter(F.col("reason").isNull()).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("items")), F.lit(0))).first()
    then = {"order_id": ids["order_id"] + made[0], "order_item_id": ids["order_item_id"] + made[1],
            "payment_id": ids["payment_id"] + made[0]}
    shown = ["cart_id", "customer_id", "table_number", "ts", "reason"]
    if "_corrupt_record" in carts.columns:
        shown.append("_corrupt_record")
    rejects = c.filter(F.col("reason").isNotNull()).select(*shown).unionByName(unnamed.select(*shown))
    return Change({"orders": new_orders, "order_items": lines, "payments": payments}, rejects, then)


def price_mismatches(carts: DataFrame, menu_items: DataFrame) -> DataFrame:
    """Q8 corrected: cart lines whose client price differs from the menu price
    (or whose item is unknown). Faithful ingestion trusts client prices."""
    lines = carts.select("cart_id", F.posexplode("items").alias("pos", "line")).select(
        "cart_id", "pos", F.col("line.item_id").alias("item_id"), F.col("line.price").alias("cart_price"))
    j = lines.join(menu_items.select("item_id", F.col("price").alias("menu_price")), "item_id", "left")
    return j.filter(F.col("menu_price").isNull() | (F.col("cart_price") != F.col("menu_price"))) \
        .select("cart_id", "pos", "item_id", "cart_price", "menu_price")


def occupied_tables(orders: DataFrame, as_of) -> DataFrame:
    """D2 probe for one day: tables with an open order on as_of."""
    return orders.filter(F.col("status").isin(*OPEN_STATUSES) & day_range("created_at", as_of)) \
        .select("table_number").distinct()


# ---------------------------------------------------------------- D3, D4

def apply_status_updates(orders: DataFrame, updates: DataFrame) -> Change:
    """D3: the latest valid update per order wins; any transition is allowed.

    Rejects: status outside the domain (V5), unknown order.
    """
    u = updates.select("order_id", "status", "ts")
    bad = u.filter(~Q.status_ok("status")).withColumn("reason", F.lit("invalid_status"))
    good = u.filter(Q.status_ok("status"))
    unknown = good.join(orders.select("order_id"), "order_id", "left_anti").withColumn("reason", F.lit("unknown_order"))
    latest = good.groupBy("order_id").agg(F.max_by("status", F.struct("ts", "status")).alias("_new"))
    snap = orders.join(latest, "order_id", "left").withColumn(
        "status", F.coalesce("_new", "status")).drop("_new").select(*orders.columns)
    return Change({"orders": snap}, bad.unionByName(unknown))


def mark_paid(orders: DataFrame, payments: DataFrame, order_ids: DataFrame, as_of, first_id: int | None = None) -> Change:
    """Every payment of a marked order becomes completed/cash; an order without
    payment gets a new completed cash payment of the order total. Unknown order → reject.
    Applying it twice gives the same snapshot. New payment ids are serial by order id, from
    `first_id` on (default: one above the greatest of `payments`)."""
    marks = order_ids.select("order_id").filter(F.col("order_id").isNotNull()).distinct()
    known = marks.join(orders.select("order_id"), "order_id", "left_semi")
    unknown = marks.join(orders.select("order_id"), "order_id", "left_anti").withColumn("reason", F.lit("unknown_order"))
    flagged = known.withColumn("_m", F.lit(True))
    p = payments.join(flagged, "order_id", "left")
    updated = p.withColumn("payment_status", F.when(F.col("_m"), "completed").otherwise(F.col("payment_status"))) \
        .withColumn("payment_method", F.when(F.col("_m"), "cash").otherwise(F.col("payment_method"))) \
        .select(*payments.columns)
    missing = known.join(payments.select("order_id"), "order_id", "left_anti") \
        .join(orders.select("order_id", "total_amount"), "order_id")
    missing = with_serial(missing, "payment_id", ["order_id"], first_id or next_id(payments, "payment_id"))
    inserted = missing.select(
        "payment_id", "order_id", F.col("total_amount").alias("amount"),
        F.lit("completed").alias("payment_status"), F.lit("cash").alias("payment_method"),
        F.lit(None).cast("string").alias("razorpay_payment_id"), _now(as_of).alias("created_at"))
    return Change({"payments": updated.unionByName(inserted)}, unknown)


# ---------------------------------------------------------------- D5, D6, D10

def delete_orders(t, order_ids: DataFrame) -> Change:
    """Remove orders with their lines and payments, and ratings of them (FK cascade)."""
    ids = order_ids.select("order_id").filter(F.col("order_id").isNotNull()).distinct()
    unknown = ids.join(t.orders.select("order_id"), "order_id", "left_anti").withColumn("reason", F.lit("not_found"))
    keep = lambda df: df.join(ids, "order_id", "left_anti")
    ratings = t.ratings.join(ids.withColumn("_d", F.lit(True)), "order_id", "left") \
        .filter(F.col("_d").isNull()).drop("_d")
    return Change({"orders": keep(t.orders), "order_items": keep(t.order_items),
                   "payments": keep(t.payments), "ratings": ratings.select(*t.ratings.columns)}, unknown)


def guarded_delete_items(menu_items: DataFrame, order_items: DataFrame, item_ids: DataFrame) -> Change:
    """Items that occur in any order are refused ('in_orders'); the rest are removed."""
    ids = item_ids.select("item_id").filter(F.col("item_id").isNotNull()).distinct()
    unknown = ids.join(menu_items.select("item_id"), "item_id", "left_anti").withColumn("reason", F.lit("not_found"))
    known = ids.join(menu_items.select("item_id"), "item_id", "left_semi")
    used = known.join(order_items.select("item_id"), "item_id", "left_semi").withColumn("reason", F.lit("in_orders"))
    gone = known.join(order_items.select("item_id"), "item_id", "left_anti")
    return Change({"menu_items": menu_items.join(gone, "item_id", "left_anti")}, unknown.unionByName(used))


def guarded_delete_categories(menu_category: DataFrame, menu_items: DataFrame, category_ids: DataFrame) -> Change:
    """Categories that still have items are refused ('has_items'); the rest are removed."""
    ids = category_ids.select("category_id").filter(F.col("category_id").isNotNull()).distinct()
    unknown = ids.join(menu_category.select("category_id"), "category_id", "left_anti") \
        .withColumn("reason", F.lit("not_found"))
    known = ids.join(menu_category.select("category_id"), "category_id", "left_semi")
    used = known.join(menu_items.select("category_id"), "category_id", "left_semi") \
        .withColumn("reason", F.lit("has_items"))
    gone = known.join(menu_items.select("category_id"), "category_id", "left_anti")
    return Change({"menu_category": menu_category.join(gone, "category_id", "left_anti")},
                  unknown.unionByName(used))


def first_payment_status(payments: DataFrame) -> DataFrame:
    """Status of each order's first payment (earliest, then lowest payment_id)."""
    return payments.groupBy("order_id").agg(
        F.min_by("payment_status", F.struct("created_at", "payment_id")).alias("first_payment_status"))


def cancel_orders(t, requests: DataFrame) -> Change:
    """A customer cancels an order: it must be theirs, pending, and its payment not
    completed; accepted orders are then deleted as in D5."""
    r = requests.select("order_id", "customer_id").distinct()
    o = t.orders.select("order_id", F.col("customer_id").alias("_owner"), "status")
    j = r.join(o, "order_id", "left").join(first_payment_status(t.payments), "order_id", "left")
    reason = (F.when(F.col("_owner").isNull() | (F.col("_owner") != F.col("customer_id")), "not_found")
              .when(~F.col("status").eqNullSafe(F.lit("pending")), "not_pending")
              .when(F.col("first_payment_status") == "completed", "paid"))
    j = j.withColumn("reason", reason)
    # used for four tables: decided once
    accepted = cut_lineage(j.filter(F.col("reason").isNull()).select("order_id"))
    out = delete_orders(t, accepted)
    return Change(out.tables, j.filter(F.col("reason").isNotNull()).select("order_id", "customer_id", "reason"))


# ---------------------------------------------------------------- D7, D8

def dedupe_ratings(ratings: DataFrame) -> Change:
    """One rating per (customer, item) and per (customer, order); the first
    (created_at, rating_id) wins; NULL keys never collide."""
    order = ["created_at"]
    by_item = _first_per_key(ratings, ["customer_id", "item_id"], order, "rating_id").withColumn("_ik", F.lit(True))
    by_order = _first_per_key(ratings, ["customer_id", "order_id"], order, "rating_id").withColumn("_ok", F.lit(True))
    j = ratings.join(by_item, "rating_id", "left").join(by_order, "rating_id", "left")
    keep = (F.col("item_id").isNull() | F.col("_ik").isNotNull()) & \
           (F.col("order_id").isNull() | F.col("_ok").isNotNull())
    kept = j.filter(keep).select(*ratings.columns)
    dropped = j.filter(~keep).select("rating_id", "customer_id", "item_id", "order_id",
                                     F.lit("duplicate").alias("reason"))
    return Change({"ratings": kept}, dropped)


def rating_reasons(t, submissions: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Why a rating submission would be refused (NULL reason = eligible).

    Item rating: the item exists and the customer has a completed order
    containing it. Order rating: the order is the customer's and completed.
    Either: not rated before (against `existing`, default the ratings snapshot).
    """
    existing = t.ratings if existing is None else existing
    s = submissions
    done = t.orders.filter(F.col("status") == "completed").select("order_id", "customer_id")
    bought = t.order_items.select("order_id", "item_id").join(done, "order_id") \
        .select("customer_id", "item_id").distinct().withColumn("_bought", F.lit(True))
    items = t.menu_items.select("item_id").withColumn("_item", F.lit(True))
    o = t.orders.select("order_id", F.col("customer_id").alias("_owner"), F.col("status").alias("_ostatus"))
    rated_i = existing.filter(F.col("item_id").isNotNull()).select("customer_id", "item_id").distinct() \
        .withColumn("_rated_i", F.lit(True))
    rated_o = existing.filter(F.col("order_id").isNotNull()).select("customer_id", "order_id").distinct() \
        .withColumn("_rated_o", F.lit(True))
    # Joins on the same key are adjacent, so each key costs one shuffle of the submissions.
    j = (s.join(items, "item_id", "left")
         .join(bought, ["customer_id", "item_id"], "left").join(rated_i, ["customer_id", "item_id"], "left")
         .join(rated_o, ["customer_id", "order_id"], "left").join(o, "order_id", "left"))
    is_item = F.col("item_id").isNotNull()
    is_order = F.col("order_id").isNotNull()
    reason = (F.when(~Q.rating_ok("rating"), "bad_rating")
              .when(is_item & F.col("_item").isNull(), "unknown_item")
              .when(is_item & F.col("_bought").isNull(), "not_ordered")
              .when(is_item & F.col("_rated_i").isNotNull(), "already_rated")
              .when(is_item, F.lit(None))
              .when(~is_order, "missing_target")
              .when(F.col("_owner").isNull() | (F.col("_owner") != F.col("customer_id")), "order_not_found")
              .when(~F.col("_ostatus").eqNullSafe(F.lit("completed")), "order_not_completed")
              .when(F.col("_rated_o").isNotNull(), "already_rated"))
    return j.withColumn("reason", reason).drop("_item", "_bought", "_owner", "_ostatus", "_rated_i", "_rated_o")


def eligible_ratings(t, submissions: DataFrame, as_of=None) -> Change:
    """D8 + D7: accepted submissions become new ratings (first per key within the batch), with serial ids in
    order of time, customer and target."""
    checked = rating_reasons(t, submissions)
    ok = checked.filter(F.col("reason").isNull())
    said = F.struct(F.col("rating").cast("int").alias("rating_value"),
                    F.when(F.col("review_text") == "", None).otherwise(F.col("review_text")).alias("review_text"))
    # equal submissions are one row with a count: the first stays, the others are duplicates like any other
    new = ok.groupBy("customer_id", "item_id", "order_id", F.col("ts").cast("timestamp_ntz").alias("created_at")).agg(
        F.min(said).alias("_said"), F.count(F.lit(1)).alias("_n"))
    new = with_serial(new, "rating_id", ["created_at", "customer_id", "item_id", "order_id"], 1)
    repeated = new.filter("_n > 1").select("customer_id", "item_id", "order_id", F.explode(
        F.array_repeat(F.lit("duplicate"), (F.col("_n") - 1).cast("int"))).alias("reason"))
    deduped = dedupe_ratings(new.select("rating_id", "customer_id", "_said.*", "created_at", "item_id", "order_id"))
    kept = with_serial(deduped["ratings"].withColumnRenamed("rating_id", "_asked"), "rating_id", ["_asked"],
                       next_id(t.ratings, "rating_id")).select(*t.ratings.columns)
    rejects = checked.filter(F.col("reason").isNotNull()).select("customer_id", "item_id", "order_id", "reason") \
        .unionByName(deduped.rejects.select("customer_id", "item_id", "order_id", "reason")).unionByName(repeated)
    return Change({"ratings": t.ratings.unionByName(kept)}, rejects)


# ---------------------------------------------------------------- D11

def purge_sessions(sessions: DataFrame, now) -> Change:
    """Drop expired sessions (expires_at <= now), then keep each owner's newest. Owners are
    customers or admins; a session without either stays."""
    live = optional(sessions, "admin_id", "long").filter(unexpired("expires_at", now))
    owner = (F.when(F.col("customer_id").isNotNull(), F.struct(F.lit("customer").alias("kind"), F.col("customer_id").alias("id")))
             .when(F.col("admin_id").isNotNull(), F.struct(F.lit("admin").alias("kind"), F.col("admin_id").alias("id"))))
    newest = _first_per_key(live.withColumn("_neg", -F.unix_micros(F.col("created_at").cast("timestamp")))
                            .withColumn("_owner", owner), ["_owner"], ["_neg"], "id")
    kept = live.filter(owner.isNull()).unionByName(live.join(newest, "id", "left_semi"))
    return Change({"sessions": kept.select(*sessions.columns)}, None)


# ---------------------------------------------------------------- D12–D15

def upsert_menu_items(menu_items: DataFrame, requests: DataFrame) -> Change:
    """Coerce and check item requests; insert (no id) or replace (known id).

    Required: name, category, price (absent or '' → 'missing_field'). Price is
    read like JS parseFloat (longest numeric prefix); text without one is
    refused ('bad_price') rather than stored as NaN. Availability NULL → true,
    else text = 'true' (F14). A replace sets every field, as the source's
    UPDATE does: description and image come from the request (optional
    columns; absent or '' → NULL). Of several replaces of one item the last (by
    `ts`, then by content) wins; inserts are items of their own, equal ones too.
    """
    r = requests
    for opt in ("description", "image_url"):
        r = optional(r, opt, "string")
    r = optional(r, "ts", "timestamp_ntz")
    price = parse_float_prefix("price", "decimal(10,2)")
    name = F.trim("item_name")
    reason = (F.when(name.isNull() | (name == "") | F.col("category_id").isNull() | (F.col("category_id") == 0)
                     | F.col("price").isNull() | (F.trim("price") == ""), "missing_field")
              .when(price.isNull(), "bad_price"))
    r = r.withColumn("reason", reason)
    ok = r.filter(F.col("reason").isNull()).select(
        "item_id", "ts",
        name.alias("item_name"), F.col("category_id").cast("int").alias("category_id"),
        price.cast(PRICE).alias("price"),
        F.when(F.col("image_url") != "", F.col("image_url")).alias("image_url"),
        F.when(F.col("description") != "", F.col("description")).alias("description"),
        coerce_bool("is_available").alias("is_available"))
    changed, unknown = _upserted(menu_items, ok, "item_id")
    snap = menu_items.join(changed.select("item_id"), "item_id", "left_anti").unionByName(changed)
    rejects = r.filter(F.col("reason").isNotNull()).select("item_id", "item_name", "reason") \
        .unionByName(unknown.select("item_id", "item_name", F.lit("not_found").alias("reason")))
    return Change({"menu_items": snap}, rejects)


def _upserted(table: DataFrame, ok: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Changed rows and replaces of unknown ids, from checked requests. The last replace per id wins (by `ts`,
    then by content); inserts get serial ids by content and time. Equal inserts are numbered as one row with a count."""
    content = [c for c in table.columns if c != key]
    replaces = ok.filter(F.col(key).isNotNull())
    last = replaces.groupBy(key).agg(F.max_by(F.struct(*content), F.struct("ts", *content)).alias("_last")).select(
        key, "_last.*")
    unknown = replaces.join(table.select(key), key, "left_anti")
    last = last.join(table.select(key), key, "left_semi").select(*table.columns)
    inserts = ok.filter(F.col(key).isNull()).groupBy(*content, "ts").agg(F.count(F.lit(1)).alias("_n"))
    inserts = with_prefix_sums(inserts, [*content, "ts"], {"_at": F.col("_n")}).withColumn(
        "_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    kind = table.schema[key].dataType
    inserts = inserts.withColumn(key, (F.col("_at") + F.col("_k") + F.lit(next_id(table, key))).cast(kind))
    return last.unionByName(inserts.select(*table.columns)), unknown


def upsert_categories(menu_category: DataFrame, requests: DataFrame) -> Change:
    """Trimmed non-empty names; insert (no id) or rename (known id). The last rename of a
    category (by `ts`, then by name) wins."""
    name = F.trim("category_name")
    r = optional(requests, "ts", "timestamp_ntz").withColumn(
        "reason", F.when(name.isNull() | (name == ""), "missing_name"))
    ok = r.filter(F.col("reason").isNull()).select("category_id", "ts", name.alias("category_name"))
    changed, unknown = _upserted(menu_category.select("category_id", "category_name"), ok, "category_id")
    snap = menu_category.join(changed.select("category_id"), "category_id", "left_anti").unionByName(changed)
    rejects = r.filter(F.col("reason").isNotNull()).select("category_id", "category_name", "reason") \
        .unionByName(unknown.select("category_id", "category_name", F.lit("not_found").alias("reason")))
    return Change({"menu_category": snap}, rejects)


def set_birth_dates(customers: DataFrame, requests: DataFrame, as_of) -> Change:
    """Apply valid dates of birth (V4); the last request per customer (by `ts`, then by date) wins."""
    r = optional(requests, "ts", "timestamp_ntz").select("customer_id", "dob", "ts").withColumn(
        "reason", Q.dob_reason("dob", as_of))
    ok = r.filter(F.col("reason").isNull()).groupBy("customer_id").agg(
        F.max_by(F.to_date("dob"), F.struct("ts", "dob")).alias("_dob"))
    r = r.drop("ts")
    known = ok.join(customers.select("customer_id"), "customer_id", "left_semi")
    unknown = ok.join(customers.select("customer_id"), "customer_id", "left_anti") \
        .select("customer_id", F.col("_dob").cast("string").alias("dob"), F.lit("not_found").alias("reason"))
    snap = customers.join(known, "customer_id", "left").withColumn("dob", F.coalesce("_dob", "dob")) \
        .select(*customers.columns)
    return Change({"customers": snap}, r.filter(F.col("reason").isNotNull()).unionByName(unknown))


def record_payments(orders: DataFrame, payments: DataFrame, verified: DataFrame) -> Change:
    """Append verified online payments for orders owned by the payer; amount is
    the order's total. Refusals: 'missing_field', 'not_found' (no such order),
    'unauthorized' (someone else's order), 'already_recorded' (the order has a payment with
    this reference, or the batch an earlier one). The gateway signature check is outside the data."""
    v = verified.select("order_id", "customer_id", "razorpay_payment_id", "ts")
    o = orders.select("order_id", F.col("customer_id").alias("_owner"), "total_amount")
    j = v.join(o, "order_id", "left")
    reason = (F.when(F.col("order_id").isNull() | F.col("razorpay_payment_id").isNull()
                     | (F.col("razorpay_payment_id") == ""), "missing_field")
              .when(F.col("total_amount").isNull() & F.col("_owner").isNull(), "not_found")
              .when(F.col("_owner").isNull() | (F.col("_owner") != F.col("customer_id")), "unauthorized"))
    j = j.withColumn("reason", reason)
    keys = ["order_id", "razorpay_payment_id"]
    known = payments.select(*keys).filter(F.col("razorpay_payment_id").isNotNull()).distinct().withColumn("_known", F.lit(True))
    fine = j.filter(F.col("reason").isNull()).join(known, keys, "left")
    # equal requests are one row with a count, so a reference sent very often is no hot key
    fine = fine.groupBy(*keys, "customer_id", "total_amount", "ts", "_known").agg(F.count(F.lit(1)).alias("_n"))
    first = fine.groupBy(*keys).agg(F.min("ts").alias("_first"))
    fine = fine.join(first, keys).withColumn("_new", F.col("_known").isNull() & F.col("ts").eqNullSafe(F.col("_first")))
    again = fine.withColumn("_n", F.col("_n") - F.col("_new").cast("int")).filter("_n > 0").select(
        "order_id", "customer_id", F.explode(F.array_repeat(F.lit("already_recorded"), F.col("_n").cast("int"))).alias("reason"))
    ok = with_serial(fine.filter("_new"), "payment_id", ["ts", *keys], next_id(payments, "payment_id"))
    new = ok.select("payment_id", "order_id",
                    F.col("total_amount").alias("amount"), F.lit("completed").alias("payment_status"),
                    F.lit("razorpay").alias("payment_method"), "razorpay_payment_id",
                    F.col("ts").cast("timestamp_ntz").alias("created_at"))
    return Change({"payments": payments.unionByName(new)},
                  j.filter(F.col("reason").isNotNull()).select("order_id", "customer_id", "reason").unionByName(again))


# ---------------------------------------------------------------- accounts and ratings

def admin_profile_reasons(admins: DataFrame, requests: DataFrame) -> DataFrame:
    """Why an admin's new profile (admin_id, username, email) would be refused (NULL: it
    would not): no user name, or a user name or e-mail that another admin holds."""
    r = requests.select("admin_id", "username", "email")
    r = taken_by_other(r, admins, "username", "admin_id", "_name")
    r = taken_by_other(r, admins, "email", "admin_id", "_mail")
    reason = (F.when(F.col("username").isNull() | (F.col("username") == ""), "missing_username")
              .when(F.col("_name"), "username_taken").when(F.col("_mail") & (F.col("email") != ""), "email_taken"))
    return r.select("admin_id", "username", "email", reason.alias("reason"))



def delete_ratings(ratings: DataFrame, rating_ids: DataFrame) -> Change:
    """Admin deletes ratings by id; unknown ids are rejected ('not_found')."""
    ids = rating_ids.select("rating_id").filter(F.col("rating_id").isNotNull()).distinct()
    unknown = ids.join(ratings.select("rating_id"), "rating_id", "left_anti").withColumn("reason", F.lit("not_found"))
    return Change({"ratings": ratings.join(ids, "rating_id", "left_anti")}, unknown)


def end_sessions(sessions: DataFrame, session_ids: DataFrame) -> Change:
    """Logout: the named sessions are removed (unknown ids are a no-op, as in the source)."""
    ids = session_ids.select("session_id").filter(F.col("session_id").isNotNull()).distinct()
    return Change({"sessions": sessions.join(ids, "session_id", "left_anti")}, None)


def register_customers(customers: DataFrame, requests: DataFrame) -> Change:
    """Registrations (name, phone, ts): phone normalised to digits (V1), name checked (V2),
    refused when the phone already belongs to a customer ('exists') or to an earlier
    registration of the batch ('duplicate'). New ids are serial by time and phone."""
    from thali.functions.scalars import digits_only

    r = requests.select("name", "phone", F.col("ts").cast("timestamp_ntz").alias("ts")) \
        .withColumn("phone_norm", digits_only("phone"))
    r = r.withColumn("reason", F.when(~Q.phone_ok("phone"), "bad_phone").when(~Q.name_ok("name"), "bad_name"))
    known = customers.select(F.col("phone").alias("phone_norm")).filter(F.col("phone_norm").isNotNull()) \
        .distinct().withColumn("_exists", F.lit(True))
    r = r.join(known, "phone_norm", "left").withColumn(
        "reason", F.coalesce("reason", F.when(F.col("_exists"), F.lit("exists"))))
    ok = r.filter(F.col("reason").isNull())
    first = ok.groupBy("phone_norm").agg(F.min(F.struct("ts", "name")).alias("_w"))
    ok = ok.join(first, "phone_norm").withColumn("_first", F.struct("ts", "name") == F.col("_w"))
    dup = ok.filter(~F.col("_first")).withColumn("reason", F.lit("duplicate"))
    new = with_serial(ok.filter(F.col("_first")).dropDuplicates(["phone_norm"]), "customer_id", ["ts", "phone_norm"],
                      next_id(customers, "customer_id")).select(
        "customer_id", F.trim("name").alias("name"),
        F.col("phone_norm").alias("phone"), F.col("ts").alias("created_at"), F.lit(None).cast("date").alias("dob"))
    rejects = r.filter(F.col("reason").isNotNull()).select("name", "phone", "ts", "reason") \
        .unionByName(dup.select("name", "phone", "ts", "reason"))
    return Change({"customers": customers.unionByName(new.select(*customers.columns))}, rejects)
