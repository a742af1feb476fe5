"""Hot keys: one item, one order, one customer and one user each hold a third of their
table's rows. Every query with a SQL twin must still agree with it exactly."""

import tempfile

import duckdb
import pytest

from conftest import SF_SMALL
from test_oracle import _key, _norm
from thali import catalog
from thali.sources.driver import DRIVER_TABLES, table_path

HEAVY = ["best_sellers", "worst_sellers", "sales_by_category", "payment_method_mix", "top_customers",
         "customers_with_stats", "customer_orders_nested", "orders_listing", "order_history",
         "ordered_items", "customer_report_stats", "j9_valid_session_activity", "t4_attempt_limits",
         "d7_dedupe_ratings", "d8_rating_reasons", "d3_status_snapshot", "menu_with_ratings"]


@pytest.fixture(scope="module")
def skew_dir():
    d = tempfile.mkdtemp(prefix="thali-skew-")
    con = duckdb.connect()
    src = SF_SMALL
    for t in DRIVER_TABLES:
        if t in ("lineitem", "orders", "events"):
            continue
        con.execute(f"COPY (SELECT * FROM '{src}/{t}.parquet') TO '{d}/{t}.parquet' (FORMAT parquet)")
    con.execute(f"""COPY (SELECT CASE WHEN hash(l_orderkey, l_linenumber) % 3 = 0 THEN 1 ELSE l_orderkey END AS l_orderkey,
      CASE WHEN hash(l_linenumber, l_orderkey, 1) % 3 = 0 THEN 7 ELSE l_partkey END AS l_partkey,
      l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
      FROM '{src}/lineitem.parquet') TO '{d}/lineitem.parquet' (FORMAT parquet)""")
    con.execute(f"""COPY (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE o_custkey END AS o_custkey,
      o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM '{src}/orders.parquet')
      TO '{d}/orders.parquet' (FORMAT parquet)""")
    con.execute(f"""COPY (SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 5 ELSE user_id END AS user_id,
      event_type, value, props FROM '{src}/events.parquet' ORDER BY event_id) TO '{d}/events.parquet' (FORMAT parquet)""")
    return d


@pytest.fixture(scope="module")
def skew_con(skew_dir):
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(skew_dir, t)}')")
    return c


@pytest.mark.parametrize("name", HEAVY)
def test_hot_keys_keep_results_exact(spark, skew_dir, skew_con, name):
    df = catalog.run(name, spark, skew_dir)
    srows = [tuple(_norm(x) for x in r) for r in df.collect()]
    res = skew_con.execute(catalog.REGISTRY[name].sql)
    ocols = [d[0] for d in res.description]
    idx = [ocols.index(c) for c in df.columns]
    orows = [tuple(_norm(r[i]) for i in idx) for r in res.fetchall()]
    assert sorted(srows, key=_key) == sorted(orows, key=_key)
