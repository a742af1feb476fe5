import hashlib
from collections import Counter

import numpy as np
import pytest
from helpers import ROWS, documents, with_clashes

from thali.llm import suffix_dedup
from thali.llm.induced_sort import sort_suffixes


def brute_sort(text, depth):
    order = sorted(range(len(text)), key=lambda i: text[i:].tolist())
    prefix = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while k < min(depth, len(text) - max(a, b)) and text[a + k] == text[b + k]:
            k += 1
        prefix.append(k)
    return order, prefix


@pytest.mark.parametrize("base,queue", [(1 << 20, 1 << 20), (2, 5)])
def test_induced_sorting_with_recursion_and_queues_on_disk(base, queue):
    rng = np.random.default_rng(0)
    for trial in range(120):
        text = rng.integers(97, 97 + int(rng.integers(1, 5)), int(rng.integers(1, 120))).astype(np.uint8)
        if trial % 3 == 0 and len(text) > 30:
            text = np.concatenate([text, text[5:25], text])
        depth = int(rng.choice([1000, 8, 5, 20]))
        order, prefix = sort_suffixes(text, depth, base, queue)
        want, common = brute_sort(text, depth)
        assert sorted(order.tolist()) == list(range(len(text)))
        assert [text[i:i + depth].tolist() for i in order] == [text[i:i + depth].tolist() for i in want]
        assert prefix.tolist() == common


def test_nothing_is_left_on_disk(tmp_path, monkeypatch):
    monkeypatch.setattr("tempfile.tempdir", str(tmp_path))
    sort_suffixes(np.frombuffer(b"abracadabra" * 50, np.uint8), 50, base_items=2, queue_items=3)
    assert not list(tmp_path.iterdir())


def brute(rows, length):
    texts = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(b[k:k + length] for b in texts for k in range(len(b) - length + 1))
    out = []
    for (i, *_), b in zip(rows, texts):
        cover = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                cover[k:k + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], cover.astype(int), [0]])))
        kept = np.frombuffer(b, np.uint8)[~cover].tobytes()
        out.append((i, len(b), int(cover.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdeé"), int(rng.integers(1, 8))))
    passage = " ".join(word() for _ in range(60))
    text = " ".join(word() for _ in range(400))
    rows = [*ROWS, (30, passage, "en", "a", 0), (31, "Start. " + passage + " End " + passage, "en", "a", 0),
            (32, text, "en", "a", 0), (33, text[:900] + "X" + text[900:], "en", "a", 0), (34, "ab" * 400, "en", "a", 0),
            (35, passage[:199], "en", "a", 0), (36, passage[20:230] + "é" + passage[230:], "en", "a", 0)]
    return rows + [(40 + k, " ".join(word() for _ in range(30)) + " " + passage[:260], "en", "a", 0) for k in range(6)]


@pytest.mark.parametrize("limits", [{}, {"shard_bytes": 2000}, {"hot_segments": 2}, {"hot_segments": 0}])
def test_removed_bytes_as_brute_force(spark, limits):
    rows = corpus()
    found = suffix_dedup.remove_repeats(with_clashes(documents(spark, rows)), **limits).collect()
    assert sorted(map(tuple, found)) == brute(rows, 200)


def test_documents_keep_their_columns(spark):
    docs = with_clashes(documents(spark, corpus()))
    left = suffix_dedup.without_repeats(docs)
    assert left.columns == docs.columns and left.count() == docs.count()
    by = {r.doc_id: r for r in left.collect()}
    assert by[30].text == "" and by[30].n_chars == 0 and by[9].text == "one two" and by[9].n_chars == 7
    assert by[2].text == "" and by[2].n_chars is None and by[9].key == "other"


def test_empty_table(spark):
    assert suffix_dedup.remove_repeats(documents(spark, [])).count() == 0
