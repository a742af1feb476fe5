"""T1 over tables: chained windows by pointer doubling, against a sequential limiter."""

import datetime as dt
import random

import pytest

from thali.operators import limiter
from thali.operators.scans import prefix_scan, with_serial
from thali.sources.io import cut_lineage

T0 = dt.datetime(2024, 1, 30, 9)


def sequential(rows, window, most):
    out, open_ = [], {}
    for client, t in sorted(r for r in rows if None not in r):
        start, hits = open_.get(client, (None, 0))
        if start is None or t >= start + window:
            start, hits = t, 0
        open_[client] = start, hits + 1
        if hits + 1 > most:
            out.append((client, t, start, hits + 1))
    return sorted(out)


@pytest.mark.parametrize("seed,window,most", [(0, 900, 5), (1, 60, 1), (2, 100_000, 3)])
def test_refusals_equal_the_sequential_limiter(spark, seed, window, most):
    rng = random.Random(seed)
    rows = [(rng.choice("abcdef") if rng.random() < 0.6 else "hot", T0 + dt.timedelta(seconds=rng.randrange(0, 40_000) * rng.choice([1, 60])))
            for _ in range(700)]
    rows += [("hot", T0)] * 40 + [("one", T0), (None, T0), ("a", None)]
    rows += [("chain", T0 + dt.timedelta(seconds=window * k)) for k in range(70)]           # every request opens a window
    df = spark.createDataFrame(rows, "client string, ts timestamp_ntz").repartition(5)
    got = sorted(map(tuple, limiter.rate_limit(df, window, most, parts=6).collect()))
    assert got == sequential(rows, dt.timedelta(seconds=window), most) and got


def test_microseconds_and_empty_tables(spark):
    rows = [("a", T0 + dt.timedelta(microseconds=m)) for m in (0, 1, 999_999, 1_000_000, 1_000_001)]
    df = spark.createDataFrame(rows, "client string, ts timestamp_ntz")
    got = sorted(map(tuple, limiter.rate_limit(df, 1, 1).collect()))
    assert got == sequential(rows, dt.timedelta(seconds=1), 1) and len(got) == 3
    assert limiter.rate_limit(df.limit(0)).count() == 0


def test_a_hot_key_is_scanned_in_ranges(spark):
    rows = [("hot", i, i % 7 or None, 1) for i in range(3000)] + [("cold", i, None, 2) for i in range(9)]
    df = spark.createDataFrame(rows, "k string, i long, v long, n long").repartition(4)
    got = prefix_scan(df, ["k"], ["i"], last={"seen": "v"}, total={"sum": "n"}, parts=16)
    by = {(r.k, r.i): (r.seen, r.sum) for r in got.collect()}
    for k, i, _, n in rows:
        newest = next((j % 7 for j in range(i, -1, -1) if j % 7), None) if k == "hot" else None
        assert by[k, i] == (newest, n * (i + 1))
    from thali.operators.scans import dealt
    sizes = [r["count"] for r in dealt(df, ["k", "i"], 16).groupBy("k", "_sub").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 800


@pytest.mark.parametrize("parts", [1, 3, 13])
def test_serials_are_dense_at_any_partitioning(spark, parts):
    df = spark.range(1000, numPartitions=parts).selectExpr("(id * 7919) % 1000 AS k")
    got = cut_lineage(with_serial(df, "serial", ["k"], 501, parts=parts)).orderBy("k").collect()
    assert [r.serial for r in got] == list(range(501, 1501))
    assert with_serial(df.limit(0), "serial", ["k"], 1).count() == 0
