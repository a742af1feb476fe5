import numpy as np
import pandas as pd
import pytest
import xxhash
from helpers import LOWER, ROWS, documents, with_clashes, words

from thali.llm import simhash
from thali.llm.components import components


def brute(text):
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def reach(ids, fps, bits=3):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i, a in zip(ids, fps):
            for j, b in zip(ids, fps):
                if (a ^ b).bit_count() <= bits and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprints_and_components_as_brute_force(spark):
    rows = [r for r in ROWS] + [(20 + k, "alpha beta gamma delta " * 20 + f"w{k}", "en", "a", 0) for k in range(8)]
    found = simhash.near_duplicates(with_clashes(documents(spark, rows))).collect()
    assert len(found) == len(rows)
    fps = {i: brute(t) for i, t, *_ in rows}
    label = reach(list(fps), list(fps.values()))
    for r in found:
        assert r.fp % 2**64 == fps[r.doc_id] and r.component_id == label[r.doc_id]


def test_long_documents_count_beyond_255_shingles():
    text = " ".join(f"w{i % 700}" for i in range(3000))
    assert int(simhash.fingerprint_of([simhash.shingle_hashes(text)])[0]) == brute(text)


def test_manhattan_distance_is_a_lower_bound():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2**63, 5000, dtype=np.uint64), rng.integers(0, 2**63, 5000, dtype=np.uint64)
    for width in (2, 4, 8):
        bound = np.bitwise_count(simhash.embed(a, width) ^ simhash.embed(b, width))
        assert (bound <= np.bitwise_count(a ^ b)).all()


@pytest.mark.parametrize("bits,block", [(3, 4096), (3, 8), (1, 8), (5, 4096)])
def test_links_lose_no_component(spark, bits, block):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64)
    near = [base]
    for _ in range(12):
        x = base[rng.integers(0, 30, 80)].copy()
        for _ in range(int(rng.integers(1, 5))):
            x ^= np.uint64(1) << rng.integers(0, 64, len(x), dtype=np.uint64)
        near.append(x)
    fps = np.unique(np.concatenate(near)).view(np.int64)
    found = simhash.links(spark.createDataFrame(pd.DataFrame({"fp": fps})).repartition(3), bits, cell_block=block)
    close = np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None, :]) <= bits
    i, j = np.nonzero(np.triu(close, 1))
    want = dict(zip(*(x.tolist() for x in simhash.forest(fps[i], fps[j]))))
    got = {r.node: r.root for r in components(found).collect() if r.node != r.root}
    assert got == want


def test_components_ignore_loops_nulls_and_repeats(spark):
    links = spark.createDataFrame([(1, 1), (2, 3), (3, 2), (2, 3), (None, 4), (5, None), (3, 9), (7, 8)], "a long, b long")
    assert sorted(map(tuple, components(links).collect())) == [(2, 2), (3, 2), (7, 7), (8, 7), (9, 2)]
    assert components(links.filter("a > 100")).count() == 0
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.root for r in components(path).collect()} == {0}


def test_one_document_of_each_group_stays(spark):
    left = simhash.one_per_group(with_clashes(documents(spark)))
    assert left.columns == with_clashes(documents(spark)).columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 5, 6, 7, 9, 10]
    assert simhash.one_per_group(documents(spark, [])).count() == 0
    unnamed = documents(spark, [(None, "some text", "en", "a", 9), (None, "some text", "en", "a", 9)])
    assert simhash.one_per_group(unnamed).count() == 2
