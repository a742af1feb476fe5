import numpy as np
import pytest
from pyspark.sql import functions as F

from thali.llm import ann


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def brute(rows, is_query, k):
    ok = {i: np.array(v, np.float64) for i, v in rows if v and not any(x is None or not np.isfinite(x) for x in v) and any(v)}
    ok = {i: np.array(np.float32(v), np.float64) for i, v in ok.items()}
    out = {}
    for q in filter(is_query, ok):
        near = sorted((-float(v @ ok[q] / np.linalg.norm(v) / np.linalg.norm(ok[q])), i)
                      for i, v in ok.items() if i != q and len(v) == len(ok[q]))
        out[q] = [(i, -s) for s, i in near[:k]]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1500, 64)))]
    found = ann.nearest(frame(spark, rows), F.col("id") % 50 == 0, block=300).collect()
    want = brute(rows, lambda i: i % 50 == 0, 5)
    got = {}
    for r in found:
        got.setdefault(r.query_id, {})[r.rank] = (r.id, r.score)
    assert set(got) == set(want) and all(sorted(v) == [1, 2, 3, 4, 5] for v in got.values())
    hit = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q].values()}) for q in want)
    assert hit >= 0.9 * 5 * len(want)
    scores = {(q, i): s for q, v in brute(rows, lambda i: i % 50 == 0, 2000).items() for i, s in v}
    assert all(scores[q, i] == pytest.approx(s, abs=1e-12) for q, v in got.items() for i, s in v.values())


def test_odd_vectors_ties_and_small_tables(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]),
            (6, [1.0, None, 0.0]), (7, [float("nan"), 1.0, 0.0]), (8, [float("inf"), 1.0, 0.0]), (9, [0.0, 1.0, 0.0]),
            (10, [1.0, 1.0]), (50, [0.0, 0.0, 2.0]), (50, [0.0, 0.0, 2.0]), (100, [3.0])]
    found = ann.nearest(frame(spark, rows).withColumn("bucket", F.lit(1)).withColumn("v", F.lit(2)),
                        F.col("id") % 50 == 0).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {0: [1, 2, 9, 50], 50: [0, 1, 2, 9]}


def test_hot_vector(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [1.0] * 8) for i in range(400)] + [(400 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))]
    found = {}
    for r in ann.nearest(frame(spark, rows), F.col("id") % 50 == 0, block=64).collect():
        found.setdefault(r.query_id, {})[r.rank] = r.id
    assert [found[50][k] for k in range(1, 6)] == [0, 1, 2, 3, 4]
    assert [found[0][k] for k in range(1, 6)] == [1, 2, 3, 4, 5]


def test_pseudo_rotation_keeps_lengths():
    x = np.random.default_rng(2).normal(size=(10, 50))
    assert np.allclose(np.linalg.norm(ann.rotated(x, 3), axis=1), np.linalg.norm(x, axis=1))


def test_empty_table(spark):
    assert ann.nearest(frame(spark, []), F.col("id") % 50 == 0).count() == 0
