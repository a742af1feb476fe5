import numpy as np
from helpers import ROWS, documents, with_clashes
from pyspark.sql import functions as F

from thali.llm import cotrain as C
from thali.llm.common import table


def views(n=600, seed=0):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.5).astype(float)
    return y, [rng.normal(size=(n, 4)) + y[:, None] * 1.5, rng.normal(size=(n, 3)) + y[:, None] * 1.5]


def in_memory(free):
    """The rows of arrays as a corpus: what ``co_train`` asks of Spark."""

    def sample(history, part):
        said = C.handed_over(history, free)
        return [(free[1 - v][said[v] >= 0], said[v][said[v] >= 0].astype(float)) for v in range(2)]

    return lambda history, models: C.histograms(history, models, free), sample


def test_views_teach_each_other():
    gains = []
    for seed in range(8):
        y, x = views(900, seed)
        few, free, test = np.arange(10), np.arange(10, 600), np.arange(600, 900)
        if not 2 <= y[few].sum() <= 8:
            continue
        corpus = in_memory([v[free] for v in x])
        alone = C.co_train([v[few] for v in x], y[few], *corpus, rounds=0)
        taught = C.co_train([v[few] for v in x], y[few], *corpus, share=0.1)
        right = [np.mean([((m.logit(v[test]) > 0) == y[test]).mean() for m, v in zip(models, x)]) for models in (alone, taught)]
        gains.append(right[1] - right[0])
    assert np.mean(gains) > 0


def test_a_round_hands_over_the_surest_rows():
    """Against sorting: in the classes' proportion, none less sure than the bound, nobody twice."""
    y, x = views(3000, 3)
    models = [C.View().fit(v[:200], y[:200]) for v in x]
    free, history = [v[200:] for v in x], []
    before = [np.zeros(2800, dtype=bool)] * 2
    for _ in range(3):
        counts = C.histograms(history, models, free)
        found = [C.surest(c, 0.05, 0.4, 0.9) for c in counts]
        history = [*history, (models, [f[:2] for f in found])]
        said = C.handed_over(history, free)
        for v in range(2):
            z = models[v].logit(free[v])
            new = (said[v] >= 0) & ~before[v]
            assert new.sum() == found[v][2]
            rest = np.sort(C.steps_of(z[~before[v]]))
            k = 0.05 * len(rest)
            best = rest >= max(rest[-int(np.ceil(k * 0.4))], C.steps_of(np.array([np.log(9)]))[0] + 1)
            worst = rest <= min(rest[int(np.ceil(k * 0.6)) - 1], C.steps_of(np.array([-np.log(9)]))[0] - 1)
            assert (new & (said[v] == 1)).sum() == best.sum() and (new & (said[v] == 0)).sum() == worst.sum()
            before[v] = before[v] | new


def test_what_is_handed_over_grows_with_the_corpus():
    y, x = views(40_000, 5)
    sizes = []
    for n in (4_000, 40_000):
        seen = []
        count, sample = in_memory([v[200:n] for v in x])

        def spy(history, part, sample=sample, seen=seen):
            out = sample(history, part)
            seen.append(len(out[0][1]))
            return out

        C.co_train([v[:200] for v in x], y[:200], count, spy)
        sizes.append(seen[-1])
    assert 8 < sizes[1] / sizes[0] < 12


def test_calibration_silences_a_view_that_knows_nothing():
    y, x = views()
    noise = np.random.default_rng(9).normal(size=(len(y), 30))
    view = C.View().fit(noise[:100], y[:100]).calibrate(noise[100:], y[100:])
    assert np.abs(view.logit(noise[100:])).mean() < 0.4


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    got = C.score_documents(with_clashes(docs), labels).join(labels, "doc_id").filter(
        F.crc32(F.col("doc_id").cast("string")) % 3 == 1).collect()
    assert np.mean([(r.score >= 0.5) == r.quality for r in got]) > 0.95


def test_odd_rows_and_missing_labels(spark):
    docs = documents(spark)
    for labels in ([], [(1, None), (None, 1)], [(1, 1), (9, 1)], [(i, i % 2) for i in range(12)], [(1, 1), (1, 0), (9, 0)]):
        marks = spark.createDataFrame(labels, "doc_id long, quality int")
        got = C.score_documents(docs, marks).collect()
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in C.score_documents(docs, none).collect()} == {0.5}
    assert C.score_documents(documents(spark, []), marks).count() == 0


def test_held_out_labels_are_never_trained_on(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    wrong = labels.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, C.score_documents(docs, x).collect())) for x in (labels, wrong))
    assert a == b


def test_repeated_rows_and_ids_are_settled_in_spark(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    one = labels.filter("quality = 1").first().doc_id
    copies = docs.filter(F.col("doc_id") == one).crossJoin(spark.range(3000)).drop("id")
    got = C.score_documents(docs.unionByName(copies), labels).collect()
    assert len(got) == 3200 and len({r.score for r in got if r.doc_id == one}) == 1
    assert len({r.score for r in C.score_documents(documents(spark, [*ROWS, (1, "other text", "en", "a", 3)]),
                                                   spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")).collect()}) > 1
