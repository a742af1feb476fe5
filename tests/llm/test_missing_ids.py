"""Rows without an id keep their results, and ids beyond 2^53 stay exact beside them."""

from helpers import documents

from thali.llm import bpe, cotrain, gru_lm, packing, quality_rules, simhash, suffix_dedup, toxicity
from thali.llm.queries import vocabulary

BIG = 2**53 + 1
TEXT = " ".join(f"word{i} of some text" for i in range(60))
ROWS = [(None, TEXT, "en", "a", 0), (None, "another text", "en", "a", 0), (BIG, TEXT, "en", "a", 0), (0, "short", "en", None, 0),
        (None, None, None, None, None), (BIG + 2, TEXT[100:], "en", "a", 0)]
IDS = sorted([r[0] for r in ROWS], key=str)


def ids(df):
    return sorted([r.doc_id for r in df.collect()], key=str)


def test_every_row_has_its_result(spark):
    docs = documents(spark, ROWS)
    marks = spark.createDataFrame([(BIG, 1, 0), (0, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert ids(packing.pack(docs, vocabulary())) == IDS
    assert ids(bpe.encoding_digests(docs, vocabulary())) == IDS
    assert ids(simhash.near_duplicates(docs)) == IDS
    assert ids(quality_rules.verdicts(docs)) == IDS
    assert ids(toxicity.score_documents(docs, marks)) == IDS
    assert ids(cotrain.score_documents(docs, marks)) == IDS
    assert ids(gru_lm.score_documents(docs, train_docs=5, tasks=1, rounds=1, tokens=200)) == IDS


def test_repeats_are_found_without_ids(spark):
    found = suffix_dedup.remove_repeats(documents(spark, ROWS)).collect()
    assert sorted([r.doc_id for r in found], key=str) == IDS
    assert sorted(r.n_removed for r in found) == sorted([len(TEXT)] * 2 + [len(TEXT) - 100, 0, 0, 0])
