"""Every registered query against its SQL twin in DuckDB (sf0.001)."""

import math

import duckdb
import pytest

from conftest import SF_SMALL
from thali import catalog
from thali.sources.driver import DRIVER_TABLES, table_path


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_SMALL, t)}')")
    return c


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _key(row):
    return tuple((x is None, type(x).__name__ if x is not None else "", x if x is not None else 0) for x in row)


# Spark type name → DuckDB type name for the types the reports return.
TYPE_NAMES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
              "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


@pytest.mark.parametrize("name", sorted(n for n, q in catalog.REGISTRY.items() if q.sql))
def test_matches_sql_twin(spark, con, name):
    df = catalog.run(name, spark, SF_SMALL)
    srows = [tuple(_norm(x) for x in r) for r in df.collect()]
    rel = con.sql(catalog.REGISTRY[name].sql)
    types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for f in df.schema.fields:
        spark_t = f.dataType.simpleString()
        assert TYPE_NAMES.get(spark_t, spark_t.upper()) == types.get(f.name), (name, f.name, spark_t, types.get(f.name))
    res = con.execute(catalog.REGISTRY[name].sql)
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    idx = [ocols.index(c) for c in df.columns]
    orows = [tuple(_norm(r[i]) for i in idx) for r in res.fetchall()]
    assert sorted(srows, key=_key) == sorted(orows, key=_key)
