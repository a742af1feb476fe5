import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import ROWS, documents, same, with_clashes, words

from thali.llm import periodic as P
from thali.llm import queries


def brute(w, min_length=6, min_exponent=4):
    """Every maximal stretch, by definition: for each period, longest first starts; smallest period only."""
    n, found = len(w), []
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(min_length, min_exponent * q):
                part = w[i:i + length]
                if not any(all(part[k] == part[k + p] for k in range(length - p)) for p in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def texts():
    rng = random.Random(12)
    out = [[rng.choice("ab") for _ in range(rng.randrange(0, 60))] for _ in range(150)]
    out += [[rng.choice("abcdefgh") for _ in range(40)] for _ in range(30)]
    for _ in range(150):
        w = []
        while len(w) < 80:
            root = [rng.choice("abc") for _ in range(rng.randrange(1, 9))]
            w += (root * rng.randrange(1, 7))[:rng.randrange(1, 40)]
        out.append(w)
    out += [list("ab" * 20 + "c" + "ab" * 20), ["x"] * 100, [], ["x"], list("aaaaaa"), list("aaaaa"), list("abababab"), list("aab" * 9)]
    return out


def found_in(docs, **limits):
    of, start, length, period = P.find_runs([[w.encode() for w in d] for d in docs], **limits)
    out = [[] for _ in docs]
    for d, *r in zip(of.tolist(), start.tolist(), length.tolist(), period.tolist()):
        out[d].append(tuple(r))
    return [sorted((s, m, q) for s, m, q in x) for x in out]


@pytest.mark.parametrize("limits", [{}, {"min_length": 1, "min_exponent": 3}, {"min_length": 20, "min_exponent": 5}])
def test_runs_as_brute_force(limits):
    docs = texts()
    assert found_in(docs, **limits) == [sorted(brute(d, **{"min_length": 6, "min_exponent": 4} | limits)) for d in docs]
    assert found_in(docs[:1], **limits) == found_in(docs, **limits)[:1]


def test_long_periods_and_long_documents():
    rng = random.Random(1)
    root = [f"w{rng.randrange(50)}" for _ in range(5000)]
    doc = ["head"] + root * 4 + root[:77]
    assert found_in([doc, root, doc[1:]]) == [[(1, 20077, 5000)], [], [(0, 20077, 5000)]]
    assert found_in([["w"] * 300_000]) == [[(0, 300_000, 1)]]


def test_two_periods_are_no_runs():
    with pytest.raises(ValueError):
        P.find_runs([[b"a"]], min_exponent=2)


def test_rows_with_nulls_repeats_and_clashes(spark):
    rows = [*ROWS, (None, "a b " * 9, "en", "a", 0), (30, " x y\tx y\nx  y x y z\n", "en", "a", 3)]
    found = P.runs(with_clashes(documents(spark, rows))).collect()
    assert len(found) == len(rows)
    by = {r[0]: r[1] for r in rows}
    for r in found:
        w = words(by[r.doc_id])
        runs = brute(w) if len(w) < 200 else [(0, 3000, 1)]
        assert [tuple(x) for x in r.runs] == runs and r.n_words == len(w)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        assert r.collapsed == " ".join(x for i, x in enumerate(w) if i not in gone)
    assert P.runs(documents(spark, [])).count() == 0


def test_documents_keep_rows_and_columns(spark):
    docs = with_clashes(documents(spark, [*ROWS, (30, " x y\tx y\nx  y x y z\n", "en", "a", 3)]))
    out = P.without_runs(docs)
    assert out.columns == docs.columns
    by = {r.doc_id: r for r in out.collect()}
    assert by[30].text == " x y z\n" and by[30].n_chars == 7 and by[6].text == "word " and by[2].text is None
    assert same(out.filter("doc_id not in (6, 30)"), docs.filter("doc_id not in (6, 30)"))
    assert P.without_runs(documents(spark, [])).count() == 0
    assert P.without_runs(out).filter("doc_id = 30").first().text == " x y z\n"


def test_query_as_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("pqrstuvw") for _ in range(rng.randrange(0, 90))), "en", "a", 0) for i in range(200)]
    rows += [(None, "a " * 20, "en", "a", 0), (500, None, "en", "a", 0), (501, "", "en", "a", 0)]
    documents(spark, rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in queries.op12_basic_factor_runs(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    planted = 0
    for i, text, *_ in rows:
        w = words(text)
        n, h = len(w), 1 if i is None else zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            planted += 1
        runs = brute(w)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        r = found[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
    assert planted > 10


def test_names_and_steps():
    names, twice = P._names(np.array([5, 7, 5, 9]))
    assert names[0] == names[2] and twice.tolist() == [True, False, True, False]
    assert P._steps(np.array([0, 2, 3, 9]), np.array([4, 4, 1, 4]), 3).tolist() == [2, 0, 0, 0]
