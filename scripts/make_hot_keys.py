"""Copy a driver folder with hot keys: one item (7) and one order (1) each take a third of the
lines, one customer (3) a third of the orders, one user (5) a third of the events.

Usage: python scripts/make_hot_keys.py SRC_DIR OUT_DIR
then:  python scripts/check_oracle.py OUT_DIR
"""

from __future__ import annotations

import sys

import duckdb

sys.path.insert(0, ".")

from thali.sources.driver import DRIVER_TABLES  # noqa: E402


def main() -> None:
    src, out = sys.argv[1], sys.argv[2]
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        if t in ("lineitem", "orders", "events"):
            continue
        con.execute(f"COPY (SELECT * FROM '{src}/{t}.parquet') TO '{out}/{t}.parquet' (FORMAT parquet)")
    con.execute(f"""COPY (SELECT CASE WHEN hash(l_orderkey, l_linenumber) % 3 = 0 THEN 1 ELSE l_orderkey END AS l_orderkey,
      CASE WHEN hash(l_linenumber, l_orderkey, 1) % 3 = 0 THEN 7 ELSE l_partkey END AS l_partkey,
      l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
      FROM '{src}/lineitem.parquet') TO '{out}/lineitem.parquet' (FORMAT parquet)""")
    con.execute(f"""COPY (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 3 ELSE o_custkey END AS o_custkey,
      o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM '{src}/orders.parquet')
      TO '{out}/orders.parquet' (FORMAT parquet)""")
    con.execute(f"""COPY (SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 5 ELSE user_id END AS user_id,
      event_type, value, props FROM '{src}/events.parquet' ORDER BY event_id) TO '{out}/events.parquet' (FORMAT parquet)""")
    print(out)


if __name__ == "__main__":
    main()
