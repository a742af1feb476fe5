import hashlib
import math
import random

import numpy as np
import pytest

from thali.llm import vector_codes as V


def vectors(n=300, d=16, seed=0, kind="float"):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.1) for _ in range(d)], rng.choice([0, 1, 2, None])) for i in range(n)]
    rows += [(n + i, list(rows[7][1]), 1) for i in range(40)]                     # copies
    rows += [(2000, None, 1), (2001, [None] + [0.1] * (d - 1), 1), (2002, [math.nan] * d, 2), (2003, [math.inf] * d, 2),
             (2004, [], 1), (2005, [0.5] * (d - 1), 1), (-5, [0.25] * d, 1), (-4, [0.0] * d, None), (3, list(rows[3][1]), 0),
             (None, [0.1] * d, 0)]
    return rows, f"vec_id long, embedding array<{kind}>, label int, error string, id string, codes string"


def frame(spark, rows, schema):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema).repartition(5)


def brute(rows, parts=8, entries=16, rounds=6):
    d = len(next(v for i, v, _ in sorted((r for r in rows if r[0] is not None and ok(r[1])), key=lambda r: r[0])))
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if ok(v) and len(v) == d]
    w = d // parts
    ids = sorted({i for i, _, _ in kept if i is not None})[:entries]
    firsts = [min(v for j, v, _ in kept if j == i) for i in ids]
    books = [[v[p * w:(p + 1) * w] for v in firsts] for p in range(parts)]

    def near(y, book):
        return min((sum((a - b) ** 2 for a, b in zip(y, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            got = {}
            for _, v, _ in kept:
                y = v[p * w:(p + 1) * w]
                got.setdefault(near(y, books[p])[1], []).append(y)
            books[p] = [[sum(c) // len(got[e]) for c in zip(*got[e])] if e in got else c for e, c in enumerate(books[p])]
    out = []
    for i, v, lab in kept:
        best = [near(v[p * w:(p + 1) * w], books[p]) for p in range(parts)]
        out.append((i, lab, [e for _, e in best], sum(x for x, _ in best)))
    return out, books


def ok(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize("seed", [0, 1])
def test_codes_as_brute_force(spark, seed):
    rows, schema = vectors(seed=seed)
    coded, books = V.encode(frame(spark, rows, schema))
    want, want_books = brute(rows)
    assert books.tolist() == want_books
    found = V.with_label_errors(coded).collect()
    assert sorted(repr((r.id, r.label, list(r.codes), r.error)) for r in found) == sorted(map(repr, want))
    for r in found:
        assert r.label_error == sum(e for _, lab, _, e in want if lab == r.label)
    flat = ",".join(str(x) for b in want_books for c in b for x in c)
    assert V.codebooks_digest(books) == hashlib.sha256(flat.encode()).hexdigest()


def test_labels_are_joined_by_shuffle_alike(spark, monkeypatch):
    rows, schema = vectors(n=50)
    coded, _ = V.encode(frame(spark, rows, schema), rounds=1)
    a = sorted(map(repr, V.with_label_errors(coded).collect()))
    monkeypatch.setattr(V, "SMALL_LABELS", 0)
    assert sorted(map(repr, V.with_label_errors(coded).collect())) == a


@pytest.mark.parametrize("shift", [0, 3, 7, 12])
def test_no_nearest_entry_is_dominated_and_ties_go_low(shift):
    rng = np.random.default_rng(shift)
    entries = rng.integers(-40, 40, (16, 3))
    entries[9] = entries[2]
    parts = rng.integers(-50, 50, (4000, 3))
    cells = V.Cells(entries, memo_cells=500, shift=shift)
    distance = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    for at in range(0, 4000, 400):                       # the memo overflows and starts anew
        code, error = cells.assign(parts[at:at + 400])
        assert (code == distance[at:at + 400].argmin(axis=1)).all() and (error == distance[at:at + 400].min(axis=1)).all()
    assert len(cells.memo) == len(cells.kept) <= 900
    known = len(cells.memo)
    cells.assign(parts[-400:])
    assert len(cells.memo) == known or shift == 0        # all remembered


def test_hash_collisions_of_cells_do_not_matter():
    cells = V.Cells(np.array([[0, 0], [50, 50], [100, 0]]), shift=2)
    cells.multipliers = np.zeros(2, dtype=np.int64)
    parts = np.random.default_rng(0).integers(-20, 120, (500, 2))
    assert (cells.assign(parts)[0] == ((parts[:, None] - cells.entries[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_few_rows_empty_tables_and_bad_shapes(spark):
    schema = "vec_id long, embedding array<double>, label string"
    some = spark.createDataFrame([(5, [1.0] * 8, "a"), (2, [0.5] * 8, "a"), (5, [0.25] * 8, None)], schema)
    coded, books = V.encode(some)
    assert books.shape == (8, 2, 1) and sorted(r.id for r in coded.collect()) == [2, 5, 5]
    for rows in ([], [(1, None, "a")], [(None, [1.0] * 8, "a")]):
        coded, books = V.encode(spark.createDataFrame(rows, schema))
        assert V.with_label_errors(coded).count() == 0 and V.codebooks_digest(books) == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError):
        V.encode(spark.createDataFrame([(1, [1.0] * 9, "a")], schema))
    with pytest.raises(ValueError):
        V.encode(spark.createDataFrame([(1, [1e30] * 8, "a")], schema))


def test_ids_and_labels_of_other_types(spark):
    some = spark.createDataFrame([(f"v{i:02}", [float(i)] * 8, 1.5) for i in range(30)], "vec_id string, embedding array<double>, label double")
    coded, books = V.encode(some, rounds=0)
    assert books[0].ravel().tolist() == [4096 * i for i in range(16)]
    assert {r.id: r.error for r in coded.collect()}["v16"] == 8 * 4096 ** 2
