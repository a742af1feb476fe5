import random
import time
import zlib

import numpy as np
import pytest
from helpers import ROWS, documents, with_clashes

from thali.llm import toxicity as T

BAD = ["idiot", "moron", "loser"]


def corpus(n=600, seed=0):
    rng = random.Random(seed)
    vocabulary = ["river", "mountain", "the", "of", "garden", "window", "story", "light", "and", "water", "people", "winter"]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(vocabulary) + rng.choice(["", "", "s", "ing"]) for _ in range(rng.randint(20, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(BAD))
        rows.append((i, f"Doc {i * 7919}. " + " ".join(text), "en", "s", 0))
        labels.append((i, int(toxic)))
    return rows, labels


def frames(spark, rows, labels):
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.fixture(scope="module")
def restorer():
    text = " ".join(t for _, t, *_ in corpus()[0]) + " stupid pathetic" * 50
    counts = T.four_grams([text]).reshape((T.SYMBOLS,) * 4)
    return T.Restorer(T.interpolate(counts).ravel())


def test_the_model_is_a_distribution():
    counts = T.four_grams(["some text, with words"]).reshape((T.SYMBOLS,) * 4)
    assert np.allclose((10 ** T.interpolate(counts)).sum(axis=-1), 1)


@pytest.mark.parametrize("noisy,plain", [("1d10t", "idiot"), ("m0r0n", "moron"), ("l0ser", "loser"), ("mooooron", "moron"),
                                         ("i.d.i.o.t", "idiot"), ("$tup1d", "stupid"), ("idiot!!", "idiot"),
                                         ("l-o-s-e-r", "loser"), ("garden", "garden"), ("p4th3tic", "pathetic")])
def test_decoding(restorer, noisy, plain):
    assert restorer.word(noisy) == [plain]


@pytest.mark.parametrize("noisy,plain", [("!diot", "idiot"), ("|oser", "loser"), ("iddiott", "idiot"), ("stuupiid", "stupid"),
                                         ("st.up.id", "stupid"), ("i..d..i..o..t", "idiot"), ("id-iot", "idiot"),
                                         ("(!diot,", "idiot"), ("garden!", "garden"), ("(garden)", "garden")])
def test_decoding_of_common_disguises(restorer, noisy, plain):
    assert plain in restorer.word(noisy)


@pytest.mark.parametrize("text", ["i. d. i. o. t.", "i - d - i - o - t", "i .. d .. i .. o .. t"])
def test_spaced_words_with_separators(restorer, text):
    assert "idiot" in restorer.spaced(f"you {text} there".split())


def test_long_tokens_of_digits_take_no_time(restorer):
    assert restorer.word("a" + "1234567890" * 20 + "-?b")


@pytest.mark.parametrize("token", ["a" * 1_000_000 + ".b1", "a" * 1_000_000, "ab" * 500_000 + "1", "abcdefg" * 140_000 + "00t",
                                   "1" * 1_000_000 + "x", "x" + "." * 1_000_000 + "y", "hello" * 200_000])
def test_very_long_tokens_take_time_in_proportion(restorer, token):
    began = time.process_time()
    restorer.word(token)
    assert time.process_time() - began < 5


def exhaustive(restorer, span):
    """The best score over every path through the lattice, and the spellings that reach it."""
    paths = [(0, 0.0, "")]
    for i, c in enumerate(span):
        here = []
        if c in T.LOOKALIKES:
            here += [(x, 1.0) for x in T.LOOKALIKES[c]] + [(" ", 3.0)]
        elif c in T._SEPARATORS:
            here += [(" ", 1.0), ("", 0.3)]
        else:
            here.append((c, 0.0))
        if i and c == span[i - 1] and c not in T._SEPARATORS:
            here.append(("", 0.3))
        paths = [(k if not x else (k * T.SYMBOLS + T.symbol(x)) % T.CONTEXTS,
                  v - cost + (restorer.model[k * T.SYMBOLS + T.symbol(x)] if x else 0.0), text + x)
                 for k, v, text in paths for x, cost in here]
    return max(v + restorer.model[k * T.SYMBOLS] for k, v, _ in paths), paths


@pytest.mark.parametrize("short", [0, 40])
@pytest.mark.parametrize("alphabet", ["ab1", "aio0!l", "st.u-", "aaab", "o0 .", "xx1"])
def test_decoding_is_the_best_path_of_the_lattice(restorer, alphabet, monkeypatch, short):
    monkeypatch.setattr(T, "SHORT", short)
    rng = random.Random(alphabet)
    for _ in range(60):
        span = "".join(rng.choice(alphabet) * rng.choice([1, 1, 1, 2, 3]) for _ in range(rng.randint(1, 6)))[:8]
        best, paths = exhaustive(restorer, span)
        found = restorer.decode(span)
        assert max(v + restorer.model[k * T.SYMBOLS] for k, v, text in paths if text == found) == pytest.approx(best, abs=1e-6), span


@pytest.mark.parametrize("span", ["a" * 14 + "b", "s" + "o" * 13 + "n", "b" + "1" * 5 + "d", "a." + "." * 12 + "b", "idio" + "t" * 14])
def test_long_repeats_decode_to_the_best_path(restorer, span, monkeypatch):
    monkeypatch.setattr(T, "SHORT", 0)
    best, paths = exhaustive(restorer, span)
    found = restorer.decode(span)
    assert max(v + restorer.model[k * T.SYMBOLS] for k, v, text in paths if text == found) == pytest.approx(best, abs=1e-6)


def test_copies_in_the_sample_prefer_no_class(spark):
    rows, labels = corpus(300)
    # each toxic text once more under another id with a clean label: both count, neither displaces the other
    rows += [(5000 + i, rows[i][1], "en", "s", 0) for i in range(0, 300, 5)]
    docs, marks = frames(spark, rows, labels + [(5000 + i, 0) for i in range(0, 300, 5)])
    scores = {r.doc_id: r.score for r in T.score_documents(docs, marks).collect()}
    toxic = [scores[i] for i, y in labels if y]
    clean = [scores[i] for i, y in labels if not y]
    assert min(toxic) > np.median(clean)


def test_spaced_words(restorer):
    assert "idiot" in restorer.spaced("you i d i o t there".split())
    assert restorer.spaced("a big b tree".split()) == []
    assert restorer.word("") == [] and restorer.word("...") == [] and restorer.word("173.33.203.46") == []


def test_held_out_accuracy_and_disguised_words(spark):
    rows, labels = corpus()
    hidden = {"idiot": "1d10t", "moron": "m 0 r o n", "loser": "l.o.s.e.r"}
    rows += [(10_000 + k, f"Some river garden {hidden[w]} water and people {hidden[w]} of light", "en", "s", 0) for k, w in enumerate(BAD)]
    docs, marks = frames(spark, rows, labels)
    got = {r.doc_id: r.score for r in T.score_documents(docs, marks).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= T.THRESHOLD) == y for i, y in held]) > 0.97
    assert all(got[10_000 + k] >= T.THRESHOLD for k in range(3))
    kept = T.without_toxic(with_clashes(docs), marks)
    assert kept.columns == with_clashes(docs).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < T.THRESHOLD}


def test_scores_never_see_held_out_labels(spark):
    rows, labels = corpus(200)
    docs, marks = frames(spark, rows, labels)
    _, wrong = frames(spark, rows, [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels])
    a, b = (sorted(map(tuple, T.score_documents(docs, m).collect())) for m in (marks, wrong))
    assert a == b


def test_odd_rows_and_missing_labels(spark):
    docs, _ = frames(spark, ROWS, [(1, 1)])
    for labels in ([], [(1, None), (None, 1)], [(1, 1), (5, 1)], [(9, 0)], [(1, 1), (1, 0), (9, 0), (10, 0)]):
        _, marks = frames(spark, ROWS, labels)
        got = T.score_documents(docs, marks).collect()
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (2, 3)}) == 1
    assert T.score_documents(documents(spark, []), marks).count() == 0
