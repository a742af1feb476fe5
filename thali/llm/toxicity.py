"""Operator 6: toxicity scores over texts restored by a noisy-channel decoder.

Writers hide words by leetspeak (``1d10t``), spacing (``s t u p i d``, ``s.t.u.p.i.d``) and
repetition (``looooser``, ``iddiott``). Spans that show such signs become a lattice: a look-alike may
stand for each letter it resembles, a separator or a repeated character may be dropped or
kept, each at a cost in the channel; Viterbi decoding under a character 4-gram model picks
the likeliest spelling. Signs that plain text shows too (a doubled letter, a look-alike at a
word's end, pieces of several letters) leave the plain reading beside the decoded one. Everywhere else the lattice has a single path, the text itself.
Restored texts are scored.

The character model counts every text of the corpus. The scorer learns from a bounded
sample of labelled rows (``TRAIN_ROWS``, taken in the order of a hash of the id; copies
among them count once per label): which words and word beginnings speak for toxic documents, and a
logistic regression over a document's evidence. The evidence of each half of the sample is
measured with the words of the other half, so the regression sees it as on new documents.

Scale: every pass over the texts is a map over the scan's partitions. What is shuffled is
4-gram counts and, for the sample only, word counts; what is broadcast is the 4-gram table
(28^4 floats), the sample's ids and its words, all bounded whatever the corpus holds.

Defined results: null and empty texts have no evidence and get the regression's base score;
without usable labels (none, or one class only) every score is the smoothed share of toxic
labels; labels that are null are ignored, of contradicting labels of one document the
majority counts (ties: toxic); repeated rows get equal scores; an empty table gives no rows. Very long
texts and tokens are read whole, in time in proportion to their length. Extra columns, whatever their names,
are ignored by ``score_documents`` and kept by ``without_toxic``.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thali.llm.bpe import _Memo, slices
from thali.llm.common import cut_lineage, hash_sample, id_and_text

TRAIN_ROWS = 20_000
THRESHOLD = 0.7
MIN_SUPPORT = 3
PREFIXES = (4, 5, 6)
SYMBOLS = 28                      # space, a to z, any other letter
CONTEXTS = SYMBOLS ** 3
#: Spans of so many characters are decoded place by place; longer ones skip what has one reading, to the same result.
SHORT = 40

# Letters that look-alikes stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
              "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
_SEPARATORS = ".-_*~'/·,:;=^ "
# channel costs, in powers of ten
_LOOKALIKE, _NOT_ONE, _DROP_SEPARATOR, _KEEP_SEPARATOR, _DROP_REPEAT = 1.0, 3.0, 0.3, 1.0, 0.3

_LOOKS = "".join(map(re.escape, LOOKALIKES))
_MIXED = re.compile(rf"(?:[^\W\d_]|[{_LOOKS}])+")       # letters and look-alikes together
_LOOK = re.compile(f"[{_LOOKS}]")
_CHAIN = re.compile(rf"(?:[^\W_{_LOOKS}]|[{_LOOKS}])(?:[{re.escape(_SEPARATORS)}](?:[^\W_]|[{_LOOKS}])){{2,}}")
_PIECES = re.compile(rf"(?:[^\W_{_LOOKS}]|[{_LOOKS}])+(?:[{re.escape(_SEPARATORS)}]+(?:[^\W_{_LOOKS}]|[{_LOOKS}])+)+")
_RUN = re.compile(rf"[{re.escape(_SEPARATORS)}]+")
_OTHER = re.compile(rf"(?:(?![{_LOOKS}])[\W_])+")
_TRIPLE = re.compile(r"(.)\1\1")
_DOUBLE = re.compile(r"(.)\1")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "@$") + "«»“”‘’…¡¿–—"


def spaced_sign(token: str) -> int:
    """1 for a token that holds one character beside separators, 2 for separators alone, 0 for any other."""
    if len(token) > 1 and token.isalnum():
        return 0
    core = token.strip(_SEPARATORS)
    return 2 if not core else int(len(core) == 1 and (core.isalpha() or core in LOOKALIKES))


def symbol(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    return SYMBOLS - 1 if c.isalpha() else 0


_ASCII = np.array([symbol(chr(c).lower()) for c in range(128)], dtype=np.int64)


def four_grams(texts: list[str]) -> np.ndarray:
    """Counts of all character 4-grams of the texts, over the alphabet of 28 symbols."""
    points = np.frombuffer(" ".join(["  ", *texts]).lower().encode("utf-32-le", "replace"), dtype="<u4")
    s = np.where(points < 128, _ASCII[np.minimum(points, 127)], np.where(points >= 0xC0, SYMBOLS - 1, 0))
    if len(s) < 4:
        return np.zeros(SYMBOLS ** 4, dtype=np.int64)
    code = ((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:]
    return np.bincount(code, minlength=SYMBOLS ** 4)


def character_model(docs: DataFrame) -> np.ndarray:
    """log10 probability of a symbol after three others, from every text; flat, 28^4 entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS ** 4, dtype=np.int64)
        for batch in batches:
            for rows in slices(batch, 200):
                total += four_grams(rows.column(1).to_pylist())
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["code", "n"])

    counts = id_and_text(docs).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    table = np.zeros(SYMBOLS ** 4)
    for code, n in counts.collect():          # at most 28^4 rows, whatever the corpus
        table[code] = n
    return interpolate(table.reshape((SYMBOLS,) * 4)).ravel().astype(np.float32)


def interpolate(counts: np.ndarray, weight: float = 5.0) -> np.ndarray:
    """log10 of 4-gram probabilities, each order smoothed towards the next shorter one."""
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in (1, 2, 3, 4):
        c = counts.sum(axis=tuple(range(4 - order)))
        p = (c + weight * p) / (c.sum(axis=-1, keepdims=True) + weight)
    return np.log10(p)


class Restorer:
    """Viterbi decoder of noisy spans under the character model."""

    def __init__(self, model: np.ndarray):
        self.model = array("f", np.asarray(model, dtype=np.float32).tobytes())

    def decode(self, span: str, edges: bool = False) -> str:
        """The likeliest spelling; with ``edges``, punctuation at the span's ends may also be just that."""
        first = len(span) - len(span.lstrip(_EDGE)) if edges else 0
        last = len(span.rstrip(_EDGE)) if edges else len(span)
        n = len(span)

        def options(i: int) -> list[tuple[int, str, float]]:
            c, here = span[i], []
            if c in LOOKALIKES:
                here += [(symbol(x), x, _LOOKALIKE) for x in LOOKALIKES[c]] + [(0, " ", _NOT_ONE)]
            elif c in _SEPARATORS:
                here += [(0, " ", _KEEP_SEPARATOR), (-1, "", _DROP_SEPARATOR)]
            else:
                here.append((symbol(c), c, 0.0))
            if i and c == span[i - 1] and c not in _SEPARATORS:
                here.append((-1, "", _DROP_REPEAT))
            if not first <= i < last:
                here.append((-1, "", 0.0))
            return here

        states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
        i, forced = 0, 0
        while n <= SHORT and i < n:         # nothing to shorten: place by place
            here, new = options(i), {}
            for context, (score, path) in states.items():
                for s, c, cost in here:
                    if s < 0:
                        to, value, way = context, score - cost, path
                    else:
                        code = context * SYMBOLS + s
                        to, value, way = code % CONTEXTS, score - cost + self.model[code], (c, path)
                    if to not in new or value > new[to][0]:
                        new[to] = (value, way)
            states = new
            i += 1
        while i < n:
            here = options(i)
            if len(here) == 1:
                forced += 1
                if forced > 3:
                    # three symbols without a choice: one context is left, and further ones only follow it
                    j = i
                    while j < n and len(options(j)) == 1:
                        j += 1
                    (_, (score, path)), = states.items()
                    a, b, c = map(symbol, span[j - 3:j])
                    states = {(a * SYMBOLS + b) * SYMBOLS + c: (score, (span[i:j], path))}
                    i = j
                    continue
            else:
                forced = 0
            new, source = self._step(states, here)
            i += 1
            if i < n and span[i] == span[i - 1] and options(i) == here and all(k == f for k, f in source.items()):
                # a repeat that every state outlives by itself goes on so to the repeat's end
                gain = {k: new[k][0] - states[k][0] for k in new}
                if all(gain[k] <= gain[to] + 1e-9 for k in new for to in self._followers(k, here)):
                    j = i
                    while j < n and span[j] == span[i] and (first <= j < last) == (first <= i < last):
                        j += 1
                    for k, (score, path) in new.items():
                        kept = path[0] * (j - i) if path is not states[k][1] else ""
                        new[k] = score + (j - i) * gain[k], (kept, path) if kept else path
                    i = j
            states = new
        path = max(((v + self.model[k * SYMBOLS], w) for k, (v, w) in states.items()), key=lambda x: x[0])[1]
        out = []
        while path:
            out.append(path[0])
            path = path[1]
        return "".join(reversed(out))

    def _step(self, states: dict, here: list[tuple[int, str, float]]) -> tuple[dict, dict[int, int]]:
        """Best (score, path) per context after one more place, and the context each came from."""
        new: dict[int, tuple[float, tuple | None]] = {}
        source: dict[int, int] = {}
        for context, (score, path) in states.items():
            for s, c, cost in here:
                if s < 0:
                    to, value, way = context, score - cost, path
                else:
                    code = context * SYMBOLS + s
                    to, value, way = code % CONTEXTS, score - cost + self.model[code], (c, path)
                if to not in new or value > new[to][0]:
                    new[to], source[to] = (value, way), context
        return new, source

    @staticmethod
    def _followers(context: int, here: list[tuple[int, str, float]]) -> list[int]:
        return [context if s < 0 else (context * SYMBOLS + s) % CONTEXTS for s, _, _ in here]

    def word(self, word: str) -> list[str]:
        """The words that one (lower-cased) token stands for."""
        if word.isalpha():
            core = word
        else:
            core = word.strip(_EDGE)
            if not core:
                return []
        if core.isalpha():
            if _TRIPLE.search(core) or len(_DOUBLE.findall(core)) >= 3:
                found = self.decode(core).split()
            else:                                       # a double may be plain spelling: both readings count
                found = [core, *(self.decode(core).split() if _DOUBLE.search(core) else [])]
        elif _CHAIN.fullmatch(core):
            found = self.decode(core).split()
        else:
            plain = _MIXED.sub(lambda m: self.decode(m[0]) if _LOOK.search(m[0]) and any(map(str.isalpha, m[0])) else m[0], core)
            found = [x for x in re.split(r"[\W\d_]+", plain) if x]
            if found and _PIECES.fullmatch(core):       # pieces of one word, or words
                found += self.decode(_RUN.sub(" ", core)).split()
        if core != word:
            for x in _OTHER.split(word):                # look-alikes at the ends: letters, or punctuation
                inner = x.strip(_EDGE)
                if inner != x and any(map(str.isalpha, inner)):
                    found += self.decode(x, edges=True).split()
        return list(dict.fromkeys(found))

    def spaced(self, tokens: list[str]) -> list[str]:
        """Words of tokens among which runs of single characters, with or without separators, may be
        spaced-out words."""
        kind = np.fromiter(map(spaced_sign, tokens), dtype=np.int8, count=len(tokens))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], kind > 0, [0]])))
        out = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if (kind[a:b] == 1).sum() >= 3:
                out += self.decode(_RUN.sub(" ", " ".join(tokens[a:b])).strip()).split()
        return out


def signs(word: str) -> list[str]:
    """What a restored word may speak by: itself and its beginnings."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


def tokens_of(text: str) -> list[str]:
    return unicodedata.normalize("NFKC", text).lower().split() if not text.isascii() else text.lower().split()


def evidence(words: dict[str, float], tokens: list[str], extra: list[str], lexicon: dict[str, float]) -> list[float]:
    """(strongest sign, log of 1 + distinct toxic words): words remembers tokens' evidence."""
    found = {t: v for t in set(tokens) if (v := words[t])}
    for w in extra:
        if v := max((lexicon.get(s, 0.0) for s in signs(w)), default=0.0):
            found[w] = v
    return [max(found.values(), default=0.0), math.log1p(len(found))]


def lexicon_of(rows: list[tuple[str, int, int]], base: float) -> dict[str, float]:
    """Signs that speak for toxic documents: (sign, toxic documents, others) to log-odds."""
    out = {}
    for sign, t, c in rows:
        if t >= MIN_SUPPORT and (p := (t + base) / (t + c + 1)) >= 0.5:
            out[sign] = min(6.0, math.log(p / (1 - p)) + 1.0)
    return out


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05) -> np.ndarray:
    """Weights (intercept first) of a ridge logistic regression, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w)) * penalty
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_rows(labels: DataFrame, train_rows: int, label_col: str = "toxic") -> DataFrame:
    """(id, y, half): a bounded sample of the labelled rows outside the held-out third."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & (fold != 1))
             .groupBy(F.col("doc_id").cast("long").alias("id"))
             .agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("y")))
    return hash_sample(known, train_rows, known.count()).withColumn(
        "half", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)).cast("int"))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    """Character model, lexicon and regression weights."""
    model = character_model(docs)
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    train = F.broadcast(training_rows(labels, train_rows))          # bounded by train_rows
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(train, "id").select(
        (F.col("y") * 2 + F.col("half")).alias("doc_id"), "text")

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Restored words of each document, with the least and greatest hash of its 3-word windows."""
        restorer = Restorer(sent.value)
        memo = _Memo(restorer.word)
        for batch in batches:
            for part in slices(batch):
                words, low, high = [], [], []
                for text in part.column(1).to_pylist():
                    tokens = tokens_of(text)
                    h = [zlib.crc32(" ".join(x).encode()) for x in zip(tokens, tokens[1:], tokens[2:])] or [
                        zlib.crc32(text.encode())]
                    low.append(min(h))
                    high.append(max(h))
                    words.append(sorted({w for t in set(tokens) for w in memo[t]} | set(restorer.spaced(tokens))))
                yield pa.record_batch([part.column(0), pa.array(low, pa.int64()), pa.array(high, pa.int64()),
                                       pa.array(words, pa.list_(pa.string()))],
                                      names=["kind", "low", "high", "words"])

    # near copies among the sample count once per label: they share the least and the greatest window. Copies are
    # in one half, whatever their labels
    half = F.pmod(F.xxhash64("low", "high"), F.lit(2))
    sample = cut_lineage(
        id_and_text(rows).mapInArrow(sketch, "kind long, low long, high long, words array<string>")
        .groupBy("low", "high", F.floor(F.col("kind") / 2).alias("y")).agg(F.min("words").alias("words"))
        .select((2 * F.col("y") + half).alias("kind"), "words"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter() for _ in range(4)]
        for batch in batches:
            for kind, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[kind].update({s for w in words for s in signs(w)})
        keys = sorted(set().union(*seen))
        yield pa.record_batch([pa.array(keys, pa.string()),
                               *(pa.array([s[k] for k in keys], pa.int64()) for s in seen)],
                              names=["sign", "c0", "c1", "t0", "t1"])

    counts = (sample.mapInArrow(count, "sign string, c0 long, c1 long, t0 long, t1 long").groupBy("sign")
              .agg(*(F.sum(c).cast("long").alias(c) for c in ("c0", "c1", "t0", "t1")))
              .filter(F.col("t0") + F.col("t1") >= MIN_SUPPORT)
              .filter(F.col("t0") + F.col("t1") >= 0.5 * (F.col("c0") + F.col("c1")))).collect()  # within the sample
    by_kind = dict(sample.groupBy("kind").count().collect())
    n, toxic = sum(by_kind.values()), by_kind.get(2, 0) + by_kind.get(3, 0)
    base = (toxic + 1) / (n + 10)
    if toxic == 0 or toxic == n:
        return {"model": model, "lexicon": {}, "weights": [math.log(base / (1 - base)), 0.0, 0.0]}
    halves = [lexicon_of([(r.sign, r.t0, r.c0) for r in counts], base),
              lexicon_of([(r.sign, r.t1, r.c1) for r in counts], base)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memos = [_Memo(lambda w, lex=lex: max((lex.get(s, 0.0) for s in signs(w)), default=0.0)) for lex in halves]
        for batch in batches:
            kinds = batch.column(0).to_pylist()
            x = [evidence(memos[1 - k % 2], words, [], {}) for k, words in zip(kinds, batch.column(1).to_pylist())]
            yield pa.record_batch([pa.array([k // 2 for k in kinds], pa.int64()),
                                   pa.array([a for a, _ in x], pa.float64()),
                                   pa.array([b for _, b in x], pa.float64())], names=["y", "a", "b"])

    seen = sample.mapInArrow(measure, "y long, a double, b double").toPandas()     # within the sample
    weights = logistic(seen[["a", "b"]].to_numpy(), seen["y"].to_numpy())
    both = lexicon_of([(r.sign, r.t0 + r.t1, r.c0 + r.c1) for r in counts], base)
    return {"model": model, "lexicon": both, "weights": weights.tolist()}


def scorer(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS):
    """A function from a column of texts to a column of scores, fitted on ``docs`` and ``labels``."""
    fitted = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, train_rows))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = fitted.value
        restorer, lexicon, weights = Restorer(own["model"]), own["lexicon"], own["weights"]
        memo = _Memo(lambda t: max((lexicon.get(s, 0.0) for w in restorer.word(t) for s in signs(w)), default=0.0))
        for texts in parts:
            out = []
            for text in texts:
                tokens = tokens_of(text)
                a, b = evidence(memo, tokens, restorer.spaced(tokens), lexicon)
                z = weights[0] + weights[1] * a + weights[2] * b
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pd.Series(out, dtype="float64")

    return lambda text: score(F.coalesce(text.cast("string"), F.lit("")))


def score_documents(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, score) of every whole text."""
    score = scorer(docs, labels, train_rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text")).alias("score"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
                  train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    score = scorer(docs, labels, train_rows)
    return docs.withColumn("_toxicity", score(F.col("text"))).filter(F.col("_toxicity") < threshold).select(*docs.columns)
