"""Sources and sinks S2–S5, and the FK-trusting fast paths against the full joins."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from thali.plans import listings as L
from thali.plans import sales as S
from thali.sources import io
from thali.sources.model import ORDERS_AS_OF, load


def test_nested_listing_round_trips_as_json(spark):
    t = load(spark, SF_SMALL)
    listing = L.orders_listing(t, view_type="old", limit=5, as_of=ORDERS_AS_OF)
    path = os.path.join(tempfile.mkdtemp(prefix="thali-json-"), "orders")
    io.write_json(listing, path)
    back = spark.read.json(path)
    assert back.count() == 5
    first = json.loads(io.as_json_column(listing).orderBy(F.col("json")).first().json)
    assert isinstance(first["items"], list) and {"order_item_id", "quantity", "price", "item_name"} <= set(first["items"][0])


def test_snapshot_versions_and_lineage_cut(spark):
    t = load(spark, SF_SMALL)
    base = tempfile.mkdtemp(prefix="thali-snap-")
    p1 = io.write_snapshot(t.orders, "orders", 1, base)
    p2 = io.write_snapshot(t.orders.filter(F.col("status") != "cancelled"), "orders", 2, base)
    assert p1 != p2
    v1, v2 = io.read_snapshot(spark, "orders", 1, base), io.read_snapshot(spark, "orders", 2, base)
    assert v1.count() > v2.count()
    cut = io.cut_lineage(v2.withColumn("x", F.lit(1)))
    assert cut.count() == v2.count()
    io.append(v2.limit(3), os.path.join(base, "appended"))
    io.append(v2.limit(2), os.path.join(base, "appended"))
    assert spark.read.parquet(os.path.join(base, "appended")).count() == 5


def test_read_carts_keeps_bad_lines(spark):
    d = tempfile.mkdtemp(prefix="thali-carts-")
    with open(os.path.join(d, "c.json"), "w") as f:
        f.write('{"cart_id": "a", "customer_id": 1, "table_number": "T-1", "ts": "2024-01-30T10:00:00",'
                ' "items": [{"item_id": 1, "quantity": 2, "price": 3.5}], "pay_ref": null}\n{oops\n')
    df = io.read_carts(spark, d)
    rows = df.collect()
    assert len(rows) == 2 and sum(r["_corrupt_record"] is not None for r in rows) == 1
    good = [r for r in rows if r["_corrupt_record"] is None][0]
    assert good["items"][0]["quantity"] == 2


def test_fk_fast_paths_equal_full_joins(spark):
    t = load(spark, SF_SMALL)
    pairs = [
        (S.best_sellers(t, "all", ORDERS_AS_OF, 10), S.best_sellers(t, "all", ORDERS_AS_OF, 10, check_fk=False)),
        (S.best_sellers(t, "month", ORDERS_AS_OF, 10), S.best_sellers(t, "month", ORDERS_AS_OF, 10, check_fk=False)),
        (S.top_customers(t, "all", ORDERS_AS_OF), S.top_customers(t, "all", ORDERS_AS_OF, check_fk=False)),
    ]
    for fast, full in pairs:
        assert fast.exceptAll(full).count() == 0 and full.exceptAll(fast).count() == 0


def test_newest_complete_snapshot(spark, tmp_path):
    base = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        io.newest_snapshot(spark, "t", base)
    for v in (1, 2, 10):
        io.write_snapshot(spark.range(v), "t", v, base)
    os.remove(f"{base}/t/v={10:010d}/_SUCCESS")           # as if its writer had died
    assert io.newest_snapshot(spark, "t", base).count() == 2


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    from thali import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Session())


def test_jdbc_options_for_parallel_reads():
    from thali.sources.driver import jdbc_options
    o = jdbc_options("jdbc:postgresql://db/shop", "orders", "order_id", 1, 1_000_000, 64, user="ro")
    assert o["partitionColumn"] == "order_id" and o["numPartitions"] == "64" and o["user"] == "ro"
    with pytest.raises(ValueError):
        jdbc_options("u", "t", "k", 10, 1, 4)
