"""Operator 9: quality classification by co-training two views of a document.

One classifier sees only the text's content (character and word statistics), the other only
the page's metadata (host, language, size and layout). Both start from the same labelled
rows. In each round every classifier labels the unlabelled documents it is surest of, in the
classes' proportion, and hands them to the other one as training rows. At the end each view
is calibrated on labelled rows that neither trained on, and a document's score adds up the
views' calibrated log-odds over the base rate, which is right where the views are
independent given the class; a view that knows nothing is calibrated to add nothing.

Scale: the texts are read once to measure them; the measures (some 70 bytes a document) are written
to the shared checkpoint folder, and every round reads those. All unlabelled documents take part: a round
counts each view's log-odds over them in a histogram, takes from it the bounds beyond which the surest
``SHARE`` of the documents lie, and hands over all documents beyond them, so what is handed over grows with
the corpus. Which documents those are follows from the rounds' weights and bounds alone, so no list of
them is kept. Only the fit is bounded: it sees at most ``LABELLED`` labelled rows and a random sample of
about ``FIT_ROWS`` of the handed ones per view, a few numbers each, on the driver. Scoring is a map with
the weights in a broadcast; nothing is shuffled but histograms. Rows whose crc32(doc_id) mod 3 is 1 are
never trained on with their labels.

Defined results: null and empty texts have the features of zero words; a null host or
language is a value of its own; without usable labels every score is 0.5, with one class only
it is the smoothed share of good labels; null labels are ignored, contradicting ones of a
document decided by majority (ties: good); of labelled rows with one id the least by its measures is
trained on; repeated rows get equal scores; an empty table gives no rows; very long texts are
measured whole; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thali.llm.bpe import slices
from thali.llm.common import cut_lineage, hash_sample, prepare

LABELLED, FIT_ROWS = 20_000, 10_000
#: A round hands over the surest ``SHARE`` of the documents not handed over yet, no less sure than ``CONFIDENT``.
ROUNDS, SHARE, CONFIDENT = 5, 0.02, 0.9
#: Steps of a log-odds histogram from -32 to 32.
STEPS = 4096
HOSTS, LANGS = 64, 16

_UPPER = np.arange(65, 91)
_SYMBOLS = np.array([c for c in b"#*$%&|<>@^~_=+{}[]\\/"])
_MARKS = np.array([c for c in b".,;:!?\"'()-"])
_DIGITS = np.arange(48, 58)
_SPACE = np.array([32, 9, 10, 11, 12, 13])


def content_features(text: str) -> list[float]:
    """Statistics of the text alone."""
    raw = text.encode()
    if not raw.split():
        return [0.0] * 11
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words = raw.split()
    n, chars = len(words), len(raw) - int(counts[_SPACE].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = lambda which: float(counts[which].sum()) / chars
    return [share(_UPPER), share(_SYMBOLS), share(_MARKS), share(_DIGITS), float(counts[33]) / n, float(counts[124]) / n,
            chars / n / 10, len(set(words)) / n, 1 - len(set(lines)) / len(lines),
            sum(len(w) <= 3 for w in words) / n, sum(not w[:1].isalpha() and w[0] < 128 for w in words) / n]


def metadata_features(host: str | None, lang: str | None, text: str) -> list[float]:
    """Where the page is from, its language, its size and layout: (bucket of the host, of the language, sizes)."""
    size, lines = len(text), text.count("\n") + 1
    return [zlib.crc32(b"" if host is None else b"=" + host.encode()) % HOSTS,
            zlib.crc32(b"" if lang is None else b"=" + lang.encode()) % LANGS,
            math.log1p(size), math.log(lines), math.log1p(size / lines)]


def metadata_matrix(rows: np.ndarray) -> np.ndarray:
    """Metadata rows with one column per bucket."""
    rows = rows.reshape(-1, 5)
    one = np.zeros((len(rows), HOSTS + LANGS))
    at = np.arange(len(rows))
    one[at, rows[:, 0].astype(np.int64)] = one[at, HOSTS + rows[:, 1].astype(np.int64)] = 1.0
    return np.concatenate([rows[:, 2:], one], axis=1)


class View:
    """Ridge logistic regression over standardised features, with a calibration on top."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> View:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.w = self._newton((x - self.mean) / self.scale, y, 1.0)
        self.a, self.b = 1.0, 0.0
        return self

    @staticmethod
    def _newton(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
        x = np.column_stack([np.ones(len(x)), x])
        w = np.zeros(x.shape[1])
        ridge = np.eye(len(w)) * penalty
        ridge[0, 0] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + ridge, x.T @ (y - p) - ridge @ w)
            w += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-6:
                break
        return w

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(((x - self.mean) / self.scale) @ self.w[1:] + self.w[0], -30, 30)
        return self.a * z + self.b

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> View:
        """Platt scaling on rows that were not trained on."""
        if 0 < y.sum() < len(y):
            self.b, self.a = self._newton(self.logit(x)[:, None], y, 0.1)
        return self


#: One round: both views' models and, per view, the log-odds from which on (good) and down to which (bad) it is sure.
Round = tuple[list[View], list[tuple[float, float]]]


def handed_over(history: list[Round], x: list[np.ndarray]) -> list[np.ndarray]:
    """Per view what it has told the other of each row so far: 1 good, 0 bad, -1 nothing."""
    said = [np.full(len(x[0]), -1) for _ in x]
    for models, bounds in history:
        for v, (good, bad) in enumerate(bounds):
            z, new = models[v].logit(x[v]), said[v] < 0
            said[v][new & (z >= good)] = 1
            said[v][new & (z <= bad)] = 0
    return said


def steps_of(z: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((z + 32) * (STEPS / 64)), 0, STEPS - 1).astype(np.int64)


def histograms(history: list[Round], models: list[View], x: list[np.ndarray]) -> np.ndarray:
    """(view, step): the log-odds of the rows that the view has not handed over yet."""
    said = handed_over(history, x)
    return np.stack([np.bincount(steps_of(models[v].logit(x[v])[said[v] < 0]), minlength=STEPS) for v in range(2)])


def surest(counts: np.ndarray, share: float, good_share: float, confident: float = CONFIDENT) -> tuple[float, float, int]:
    """The bounds (good, bad) beyond which the surest rows of a histogram lie, in the classes' proportion, and how
    many there are. Bounds are whole steps: all rows that are equally sure go together."""
    total, least = counts.sum(), math.log(confident / (1 - confident))
    edges = np.arange(STEPS + 1) * (64 / STEPS) - 32
    above = np.cumsum(counts[::-1])[::-1]                       # rows from each step on
    below = np.cumsum(counts)
    want = max(1.0, share * total * good_share), max(1.0, share * total * (1 - good_share))
    good = edges[np.flatnonzero(above >= want[0])[-1]] if total >= want[0] else edges[0]
    bad = edges[np.flatnonzero(below >= want[1])[0] + 1] if total >= want[1] else edges[-1]
    good, bad = max(good, least), min(bad, -least)
    first, last = int(np.ceil((good + 32) * (STEPS / 64))), int(np.floor((bad + 32) * (STEPS / 64)))
    # bounds inside a step move to its far end
    good, bad = edges[first], np.nextafter(edges[last], -np.inf)
    return float(good), float(bad), int(counts[first:].sum() + counts[:last].sum())


def co_train(labelled: list[np.ndarray], y: np.ndarray, count: Callable[[list[Round], list[View]], np.ndarray],
             sample: Callable[[list[Round], list[float]], list[tuple[np.ndarray, np.ndarray]]], rounds: int = ROUNDS,
             share: float = SHARE, fit_rows: int = FIT_ROWS, confident: float = CONFIDENT) -> list[View]:
    """Both views' classifiers. ``count`` gives the histograms of the unlabelled rows under a history and new
    models; ``sample`` gives, per view, a part of the rows handed to it: their features and labels."""
    models, history, handed = [View().fit(x, y) for x in labelled], [], [0, 0]
    for _ in range(rounds):
        found = [surest(c, share, y.mean(), confident) for c in count(history, models)]
        if not any(n for _, _, n in found):
            break
        history.append((models, [(good, bad) for good, bad, _ in found]))
        handed = [a + n for a, (_, _, n) in zip(handed, found)]
        # what view v is sure of trains the other
        taught = sample(history, [min(1.0, fit_rows / max(1, n)) for n in handed])
        models = [View().fit(np.concatenate([labelled[v], taught[1 - v][0]]), np.concatenate([y, taught[1 - v][1]]))
                  for v in range(2)]
    return models


def features(docs: DataFrame, host_col: str, lang_col: str) -> DataFrame:
    """(id, content array<float>, metadata array<float>) of every row."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col(host_col).cast("string").alias("host"),
                       F.col(lang_col).cast("string").alias("lang"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hosts, langs, texts = (part.column(c).to_pylist() for c in (1, 2, 3))
                yield pa.record_batch(
                    [part.column(0), pa.array([content_features(t) for t in texts], pa.list_(pa.float32())),
                     pa.array([metadata_features(h, x, t) for h, x, t in zip(hosts, langs, texts)],
                              pa.list_(pa.float32()))], names=["id", "content", "metadata"])

    return rows.mapInArrow(run, "id long, content array<float>, metadata array<float>")


def matrices(content: pa.Array, metadata: pa.Array) -> list[np.ndarray]:
    """Both views' features of a batch."""
    flat = [c.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in (content, metadata)]
    return [flat[0].reshape(len(content), -1) if len(content) else np.zeros((0, 11)), metadata_matrix(flat[1])]


def fit(measured: DataFrame, labels: DataFrame, label_col: str, labelled: int, fit_rows: int) -> dict:
    """``measured``: (id, content, metadata, pick) of every document; pick is a random number of the row."""
    known = cut_lineage(labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull())
                        .groupBy(F.col("doc_id").cast("long").alias("id"))
                        .agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("y")))
    train = known.filter(F.crc32(F.col("id").cast("string")) % 3 != 1)
    train = hash_sample(train, labelled, train.count())                             # bounded by ``labelled``
    rows = (measured.select("id", "content", "metadata").join(F.broadcast(train), "id").groupBy("id", "y")
            .agg(F.min(F.struct("content", "metadata")).alias("m")).select("id", "y", "m.*").toArrow())
    order = np.argsort(rows["id"].to_numpy())
    ids, y = rows["id"].to_numpy()[order], rows["y"].to_numpy()[order].astype(float)
    if not len(y):
        return {"views": None, "base": 0.0}
    share = (y.sum() + 1) / (len(y) + 2)
    base = math.log(share / (1 - share))
    if not 2 <= y.sum() <= len(y) - 2:
        return {"views": None, "base": base}
    x = [v[order] for v in matrices(rows["content"].combine_chunks(), rows["metadata"].combine_chunks())]
    hold = np.array([zlib.crc32(f"calibrate {i}".encode()) % 4 == 0 for i in ids])
    use = ~hold if 0 < y[~hold].sum() < (~hold).sum() else np.ones(len(y), dtype=bool)
    free = measured.join(known.select("id"), "id", "left_anti").select("content", "metadata", "pick")

    def count(history: list[Round], models: list[View]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, STEPS), dtype=np.int64)
            for batch in batches:
                if batch.num_rows:
                    total += histograms(history, models, matrices(batch.column(0), batch.column(1)))
            v, step = np.nonzero(total)
            yield pa.record_batch([pa.array(v), pa.array(step), pa.array(total[v, step])], names=["v", "step", "n"])

        out = np.zeros((2, STEPS), dtype=np.int64)
        for r in free.mapInArrow(run, "v long, step long, n long").groupBy("v", "step").agg(F.sum("n").alias("n")).collect():
            out[r.v, r.step] = r.n                                                   # at most 2 x STEPS rows
        return out

    def sample(history: list[Round], part: list[float]) -> list[tuple[np.ndarray, np.ndarray]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    said = handed_over(history, matrices(batch.column(0), batch.column(1)))
                    pick = batch.column(2).to_numpy()
                    for v in range(2):
                        at = np.flatnonzero((said[v] >= 0) & (pick < part[v]))
                        yield pa.record_batch(
                            [pa.array(np.full(len(at), v)), pa.array(said[v][at]), pa.array(pick[at]),
                             batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))],
                            names=["v", "y", "pick", "content", "metadata"])

        got = free.mapInArrow(run, "v long, y long, pick double, content array<float>, metadata array<float>").toArrow()
        out = []
        own = matrices(got["content"].combine_chunks(), got["metadata"].combine_chunks())
        of, label, pick = (got[c].to_numpy() for c in ("v", "y", "pick"))
        for v in range(2):                       # the rows that view v handed over, as the other view sees them
            at = np.flatnonzero(of == v)
            at = at[np.argsort(pick[at], kind="stable")]
            out.append((own[1 - v][at], label[at].astype(float)))
        return out

    models = co_train([v[use] for v in x], y[use], count, sample, fit_rows=fit_rows)
    for m, v in zip(models, x):
        m.calibrate(v[hold], y[hold])
    return {"views": models, "base": base}


def score_documents(docs: DataFrame, labels: DataFrame, label_col: str = "quality", host_col: str = "source",
                    lang_col: str = "lang", labelled: int = LABELLED, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, content_score, metadata_score, score) of every row; score is the chance that it is good."""
    # a row's random number is that of its place in the scan, so repeated rows are drawn one by one
    measured = cut_lineage(features(docs, host_col, lang_col).withColumn(
        "pick", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 52)) / F.lit(1 << 52)))
    fitted = docs.sparkSession.sparkContext.broadcast(fit(measured, labels, label_col, labelled, fit_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, base = fitted.value["views"], fitted.value["base"]
        chance = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        for batch in batches:
            for part in slices(batch, 2000):
                z = [np.full(part.num_rows, base)] * 2
                if views:
                    z = [m.logit(v) for m, v in zip(views, matrices(part.column(1), part.column(2)))]
                yield pa.record_batch([part.column(0), *(pa.array(chance(v)) for v in (z[0], z[1], z[0] + z[1] - base))],
                                      names=["doc_id", "content_score", "metadata_score", "score"])

    return measured.select("id", "content", "metadata").mapInArrow(
        run, "doc_id long, content_score double, metadata_score double, score double")
