import hashlib
import random
import re

import numpy as np
import pytest
from helpers import LOWER, ROWS, documents, same, with_clashes

from thali.llm import decontaminate as D
from thali.llm import queries


def fold(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def brute(text, items, n=10):
    """(words, hit places, items) by comparing every window with every window."""
    w, hit, met = fold(text), set(), set()
    for item, t in items:
        v = fold(t)
        k = min(n, len(v))
        windows = {tuple(v[i:i + k]) for i in range(len(v) - k + 1)} if v else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i:i + k]) in windows:
                hit |= set(range(i, i + k))
                if item is not None:
                    met.add(str(item))
    return len(w), hit, sorted(met)


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, "other") for i, t in items], "item_id long, text string, key string")


def corpus(seed=0, words=12):
    """Texts over few words, so that windows are met by chance as well as by copying."""
    rng = random.Random(seed)
    one = lambda k: " ".join(rng.choice(["Alpha", "beta", "GAMMA", "d3", "é", "日本"][:words]) for _ in range(k))
    items = [(i, one(rng.randrange(1, 16))) for i in range(12)] + [(2, one(30)), (None, "unnamed item here"), (50, None), (51, " .,! "),
                                                                   (52, "single"), (9, "a repeated item"), (9, "a repeated item")]
    rows = list(ROWS)
    for i in range(100, 160):
        t = one(rng.randrange(0, 40))
        if i % 3 == 0:
            t += " -- " + rng.choice([x for _, x in items if x]).upper() + "! " + one(5)
        rows.append((i, t, "en", "a", len(t)))
    rows += [(None, "x unnamed ITEM, here y", "en", "a", 0), (200, "single", "en", "a", 0), rows[-1]]
    return rows, items


@pytest.mark.parametrize("n,index_bytes", [(10, 8 << 20), (3, 8 << 20), (10, 60), (4, 100)])
def test_hits_as_brute_force(spark, n, index_bytes):
    rows, items = corpus(n)
    found = D.contamination(with_clashes(documents(spark, rows)), benchmark(spark, items), n, index_bytes)
    found = found.withColumn("n_hit", D.hit_words(found.spans)).collect()
    assert len(found) == len(rows)
    by, hits = {r[0]: r[1] for r in rows}, 0
    for r in found:
        size, hit, met = brute(by[r.doc_id], items, n)
        assert (r.n_words, r.n_hit, list(r.items)) == (size, len(hit), met)
        places = [i for s in r.spans for i in range(s["start"], s["end"])]
        assert places == sorted(hit) and all(a["end"] < b["start"] for a, b in zip(r.spans, r.spans[1:]))
        hits += bool(hit)
    assert hits > 20


def test_long_items_are_cut_without_losing_windows(spark, monkeypatch):
    monkeypatch.setattr(D, "PIECE_WORDS", 7)
    text = " ".join(f"w{i}" for i in range(500))
    docs = documents(spark, [(1, "lead " + text + " tail", "en", "a", 0), (2, " ".join(text.split()[490:]), "en", "a", 0)])
    for size in (8 << 20, 200):
        got = {r.doc_id: r for r in D.contamination(docs, benchmark(spark, [(1, text)]), index_bytes=size).collect()}
        assert [tuple(s) for s in got[1].spans] == [(1, 501)] and [tuple(s) for s in got[2].spans] == [(0, 10)]


def test_very_long_text():
    grams = D.NgramIndex([("1", b"one two three four five six seven eight nine ten eleven")])
    words = [b"filler"] * 1_000_000
    words[500_000:500_011] = b"one two three four five six seven eight nine ten eleven".split()
    of, start, end, who, item = grams.scan([[], words, [b"one"]])
    assert (of.tolist(), start.tolist(), end.tolist(), who.tolist()) == ([1], [500_000], [500_011], [1])


def test_equal_hashes_are_verified():
    grams = D.NgramIndex([("1", b"a b c"), ("2", b"b c a")], 2)
    grams.hashed = lambda ids, at, length: np.full(len(at), grams.sets[2][0][0])
    of, start, end, _, _ = grams.scan([[b"a", b"c", b"b", b"b"]])
    assert len(of) == 0


def test_documents_and_passages_are_removed(spark):
    rows, items = corpus(1)
    docs = with_clashes(documents(spark, rows))
    for size in (8 << 20, 80):
        clean = D.without_documents(docs, benchmark(spark, items), index_bytes=size)
        assert clean.columns == docs.columns
        want = sorted(repr(r[0]) for r in rows if not brute(r[1], items)[1])
        assert sorted(repr(r.doc_id) for r in clean.collect()) == want
        cut = D.without_passages(docs, benchmark(spark, items), index_bytes=size)
        assert cut.columns == docs.columns and cut.count() == len(rows)
        by = {r[0]: r[1] for r in rows}
        for r in cut.collect():
            w, (_, hit, _) = fold(by[r.doc_id]), brute(by[r.doc_id], items)
            assert fold(r.text) == [x for i, x in enumerate(w) if i not in hit]
            if not hit:
                assert r.text == by[r.doc_id]
            elif r.text is not None:
                assert r.n_chars == len(r.text)
    half = D.without_documents(docs, benchmark(spark, items), max_share=1.0)
    assert same(half, docs)


def test_passages_are_cut_from_first_to_last_word():
    assert D.cut("He said: Uno, DOS!! é... end.".encode(), [(2, 5)]).decode() == "He said: ... end."
    assert D.cut(b"", []) == b""


def test_empty_tables(spark):
    rows, items = corpus()
    assert D.contamination(documents(spark, []), benchmark(spark, items)).count() == 0
    none = D.contamination(documents(spark, rows), benchmark(spark, [])).collect()
    assert len(none) == len(rows) and not any(r.spans or r["items"] for r in none)
    docs = documents(spark, rows)
    assert same(D.without_passages(docs, benchmark(spark, [])), docs) and same(D.without_documents(docs, benchmark(spark, [(1, None)])), docs)


def test_query(spark):
    rows = queries.op11_broadcast_ngram_decontamination(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(r.contaminated == (r.n_hit > 0) == (r.n_items > 0) for r in rows)
    assert {r.items_sha256 for r in rows if not r.contaminated} == {hashlib.sha256(b"").hexdigest()}
    assert any(r.contaminated for r in rows)
