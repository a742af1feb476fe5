import inspect
import math
import resource
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import ROWS, documents, with_clashes

from thali.llm import gru_lm as G

SMALL = dict(train_docs=50, tasks=2, rounds=1, tokens=2000)


def model(seed=0, classes=4, hidden=5):
    rng = np.random.default_rng(seed)
    lm = G.GatedLM.start(rng.integers(1, 50, classes * classes), hidden, classes)
    for k in lm.w:
        lm.w[k] = (lm.w[k] + rng.normal(0, 0.3, lm.w[k].shape)).astype(np.float64)
    return lm


def test_gradient_against_differences():
    lm, rng = model(), np.random.default_rng(1)
    x, y = rng.integers(0, 16, (6, 3)), rng.integers(0, 16, (6, 3))
    fresh = rng.random((6, 3)) < 0.2
    h = rng.normal(size=(3, 5))
    lm.steps_dtype = np.float64
    loss, g, _ = lm.gradient(x, y, h, fresh)
    for name in lm.w:
        flat = lm.w[name].reshape(-1)
        for i in rng.integers(0, flat.size, 4):
            old = flat[i]
            values = []
            for d in (1e-3, -1e-3):
                flat[i] = old + d
                values.append(lm.gradient(x, y, h, fresh)[0])
            flat[i] = old
            assert (values[0] - values[1]) / 2e-3 == pytest.approx(g[name].reshape(-1)[i], abs=2e-3), name


def test_probabilities_sum_to_one():
    lm = model()
    state = np.random.default_rng(2).normal(size=(1, 5)).repeat(16, axis=0)
    assert np.exp(lm.log_probabilities(state, np.arange(16))).sum() == pytest.approx(1)


def test_windows_carry_the_state_through_whole_documents():
    lm, rng = model(), np.random.default_rng(3)
    docs = [rng.integers(0, 16, n) for n in (1, 7, 150, 33, 64)]
    docs = [np.append(d, 1) for d in docs]
    whole, cut = lm.score(docs, window=1000), lm.score(docs, lanes=2, window=8)
    assert np.allclose(whole, cut, rtol=1e-4)
    alone = lm.score([docs[2]])
    assert alone[0] == pytest.approx(whole[2], rel=1e-4)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(4)
    docs = [np.append(np.tile([2, 3, 4, 5], 20), 1) for _ in range(20)] + [np.append(rng.integers(6, 9, 30), 1) for _ in range(5)]
    lm = G.GatedLM.start(np.bincount(np.concatenate(docs), minlength=16), 16, 4)
    before = lm.score(docs).sum()
    lm.train(docs, 20_000)
    assert lm.score(docs).sum() > 0.6 * before


@pytest.mark.parametrize("sizes", [(900, 700, 3), (1, 5, 40, 2000, 1, 60)])
def test_every_word_is_a_target_and_nothing_else(monkeypatch, sizes):
    rng, seen, step = np.random.default_rng(5), [], G.GatedLM.gradient
    docs = [np.append(rng.integers(2, 16, n), 1) for n in sizes]

    def spy(self, x, y, h, fresh, *mask):
        real = mask[0] if mask else np.ones(y.shape, bool)
        seen.extend(zip(x[real].tolist(), y[real].tolist()))
        return step(self, x, y, h, fresh, *mask)

    monkeypatch.setattr(G.GatedLM, "gradient", spy)
    model().train(docs, 100)
    assert Counter(seen) == Counter((int(a), int(b)) for d in docs for a, b in zip([1, *d[:-1]], d))


def test_places_without_a_word_have_no_gradient():
    lm, rng = model(), np.random.default_rng(6)
    x, y = rng.integers(0, 16, (2, 6, 3))
    fresh, real = np.zeros((6, 3), bool), np.ones((6, 3), bool)
    real[2:, 1] = real[:, 2] = False
    a = lm.gradient(x, y, np.zeros((3, 5)), fresh, real)
    x[~real], y[~real] = 7, 9
    b = lm.gradient(x, y, np.zeros((3, 5)), fresh, real)
    assert a[0] == b[0] and all(np.allclose(a[1][k], b[1][k]) for k in a[1])


def expected(rows):
    own = {}
    counts = Counter()
    for k, (i, t, *_) in enumerate(rows):
        own[k] = [*(w.lower() for w in (t or "").encode().split()), b""]
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(own[k])
    n, v = sum(counts.values()), len(counts)
    return sorted((rows[k][0], len(w), sum(counts[x] > 0 for x in w), n,
                   round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for k, w in own.items())


@pytest.mark.parametrize("top", [3, 100_000])
def test_base_scores_as_brute_force(spark, top):
    rows = [*ROWS, *((50 + k, f"held out or not, doc{k} word shared{k % 3}", "en", "a", 0) for k in range(20))]
    got = G.score_documents(with_clashes(documents(spark, rows)), top=top, **SMALL).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected(rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_better_than_counts_on_held_out_documents(spark):
    from thali.llm.common import table

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = [r for r in G.score_documents(docs).collect() if zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_empty_tables_and_no_training_rows(spark):
    assert G.score_documents(documents(spark, []), **SMALL).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = G.score_documents(documents(spark, [(held, "a b", "en", "a", 3)]), **SMALL).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and math.isfinite(r.score)


def test_every_training_document_reaches_the_model(spark):
    train = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 7 != 2][:2_000]
    docs = documents(spark, [(i, f"own{i} and more", "en", "a", 0) for i in train])
    symbols = {w.encode(): k for k, w in enumerate(["", "and", "more", *(f"own{i}" for i in train)], 1)}
    counts = np.array([1, 2_000, 2_000, 2_000, *[1] * 2_000])
    sample = inspect.signature(G.score_documents).parameters["train_docs"].default
    before, after = G.GatedLM.start(counts), G.fit(docs, symbols, counts, sample, 2, 3, 20_000)
    moved = (before.w["emb"] != after.w["emb"]).any(axis=1)          # what is never read stays as it starts
    assert moved[1:len(symbols) + 1].all() and not moved[len(symbols) + 1:].any()


@pytest.mark.parametrize("words", [1, 500, 100_000])
def test_dealing_keeps_every_document_and_starts_long_ones_early(words):
    rng = np.random.default_rng(7)
    docs = [rng.integers(0, 16, n) for n in [*rng.integers(1, 40, 300), 900, 2_000, 700, *rng.integers(1, 40, 300)]]
    got = list(G.dealt(iter(docs), 8, words))
    assert sorted(map(id, got)) == sorted(map(id, docs))
    if words == 100_000:
        assert [len(d) for d in got[:3]] == [2_000, 900, 700]
    assert list(G.dealt([], 8, words)) == []


def test_softmax_of_large_log_odds():
    logit = np.array([[0, 200, 100], [-300, -300, -301], [1, 2, 3]], np.float32)
    want = np.exp(logit.astype(float) - logit.max(axis=1, keepdims=True))
    assert np.allclose(G.GatedLM.softmax(logit.copy()), want / want.sum(axis=1, keepdims=True), atol=1e-6)


@pytest.mark.parametrize("scale", [1, 30, 1000])
def test_weights_bound_the_logits_that_need_no_shift(scale):
    lm, rng = model(3), np.random.default_rng(3)
    lm.w["Uw"] *= scale
    states = rng.uniform(-1, 1, (50, 5))
    largest = max(np.abs(states @ u + b).max() for u, b in ((lm.w["Uc"], lm.w["bc"]), *zip(lm.w["Uw"], lm.w["bw"])))
    assert lm.small_logits(states) == (scale < 1000) and (largest < 60 or not lm.small_logits(states))
    y = rng.integers(0, 16, 50)
    cls, word = states @ lm.w["Uc"] + lm.w["bc"], np.einsum("nk,nkj->nj", states, lm.w["Uw"][y // 4]) + lm.w["bw"][y // 4]
    at, lse = np.arange(50), lambda v: np.log(np.exp(v - v.max(axis=1, keepdims=True)).sum(axis=1)) + v.max(axis=1)
    want = cls[at, y // 4] - lse(cls) + word[at, y % 4] - lse(word)
    assert np.allclose(lm.log_probabilities(states, y), want, atol=1e-6)


def test_scores_and_unlisted_words_come_from_one_pass(spark):
    rows = [(k, f"a b b w{k} w{k} v{k % 3}", "en", "a", 3) for k in range(40)]
    scored = G.score_documents(with_clashes(documents(spark, rows)), top=2, **SMALL)
    assert "MapInArrow" not in scored._jdf.queryExecution().executedPlan().toString()      # texts are not read again
    assert {r.n_tokens for r in scored.collect()} == {7}


def test_windows_ask_for_little_new_memory():
    rng = np.random.default_rng(8)
    lm = G.GatedLM.start(rng.integers(1, 50, G.VOCABULARY))
    x, y = rng.integers(0, G.VOCABULARY, (2, G.WINDOW, G.LANES))
    fresh, real, h = np.zeros(x.shape, bool), np.ones(x.shape, bool), np.zeros((G.LANES, G.HIDDEN), np.float32)
    for k in range(20):
        lm.gradient(x, y, h, fresh, real)
        if k == 4:
            before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    assert resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before < 15 * 600       # pages: 1,400 a window before


def test_gradient_of_the_rows_read_is_that_of_all():
    lm, rng = model(), np.random.default_rng(9)
    x, y = rng.integers(0, 12, (2, 40, 3))
    fresh, real, h = rng.random(x.shape) < 0.2, np.ones(x.shape, bool), rng.normal(size=(3, 5))
    loss, g, _ = lm.gradient(x, y, h, fresh, real)
    same, own, _ = lm.gradient(x, y, h, fresh, real, False)
    assert loss == same and np.array_equal(g["emb"][np.unique(x)], own["emb"])
    assert not np.delete(g["emb"], np.unique(x), axis=0).any()


@pytest.mark.parametrize("sizes", [(1,), (1, 2, 8, 9, 300, 1, 8, 7)])
def test_sums_of_stretches(sizes):
    rows = np.random.default_rng(10).normal(size=(sum(sizes), 6))
    ends = np.cumsum(sizes)
    want = [rows[e - n:e].sum(axis=0) for e, n in zip(ends, sizes)]
    assert np.allclose(G.GatedLM.sums_of_equal(rows, ends - sizes), want)


def test_words_are_those_of_bytes():
    texts = ["", " ", "a", "  A\t\x0bb B \n", "x\x0c\ry\x1cz\x85\xa0w", "\u00c4\u2003q \u0130 I", "\n", "end "] * 2
    want = [t.encode().lower().split() for t in texts]
    words, sizes = G.words_of(pa.array(["cut off", *texts])[1:])
    assert words.to_pylist() == [w for d in want for w in d] and sizes.tolist() == [len(d) for d in want]
    place = G.numbered(words, pa.array([b"", b"a", b"b"], pa.binary()))
    ids, ends = G.with_ends(place, sizes, 1)
    known = {b"a": 2, b"b": 3}
    assert [d.tolist() for d in np.split(ids, ends[:-1])] == [[*(known.get(w, 0) for w in d), 1] for d in want]


@pytest.mark.parametrize("held", [1, 200_000])
def test_counts_of_words_that_leave_a_task_in_parts(spark, monkeypatch, held):
    monkeypatch.setattr(G, "COUNT_WORDS", held)
    rows = [(None, f"a A b{k % 7} c{k}", "en", "a", 3) for k in range(40)]
    want = Counter({"": 40, **Counter(w for r in rows for w in r[1].lower().split())})
    assert Counter({r.word: r.n for r in G.word_counts(documents(spark, rows)).collect()}) == want
