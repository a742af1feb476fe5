"""Operator 12: periodic runs of words, by a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that is
long enough and that no neighbouring word extends. For each length L = 1, 2, 4, ... every stretch of L
words gets a name, made of the names of its two halves; stretches of one document have one name where
they are equal. A name's next occurrence at most L words on, so that both lie within twice the length,
is an arithmetic progression's step and proposes that step as a period. Neighbouring words with the
same step extend the proposal: by the periodicity lemma the steps of a run with period q <= L are all
q and stop with the run, so a maximal stretch of equal steps is the whole run and q its smallest
period. Longer lengths propose the same run again; it is kept once.

A name that occurs once in its document cannot take part in a run at any longer length and is
dropped, so ordinary text costs a few lengths, not all of them. Every run of at least three periods
is found: with q <= L < 2 q some stretch of L words and its next occurrence fit into it.

Scale: documents are independent, so there is no shuffle and no hot key; a task holds a few hundred
texts at a time and works on all their words at once, with memory in proportion to the words. A very
long document takes O(n log n) time and O(n) memory in one task.

Defined results: a null or empty text, or one without a word, has no runs and an empty collapsed text;
documents without an id are like any other; repeated rows give repeated results; an empty table gives
no rows; ``runs`` ignores extra columns, ``without_runs`` keeps them, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thali.llm.bpe import slices
from thali.llm.common import prepare

MIN_LENGTH, MIN_EXPONENT = 6, 4

_PIECE = re.compile(rb"[ \t-\r]*[^ \t-\r]+")
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _names(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names 0, 1, ... of equal keys, and whether each key occurs more than once."""
    names = pd.factorize(keys)[0].astype(np.int64, copy=False)
    return names, np.bincount(names)[names] > 1


def _steps(at: np.ndarray, names: np.ndarray, length: int) -> np.ndarray:
    """Words from each place (ascending) to the next one of its name; 0 beyond ``length`` words."""
    order = np.argsort(names, kind="stable")
    step = np.diff(at[order])
    step[(np.diff(names[order]) != 0) | (step > length)] = 0
    out = np.zeros(len(at), dtype=np.int64)
    out[order[:-1]] = step
    return out


def find_runs(words: list[list[bytes]], min_length: int = MIN_LENGTH,
              min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of all runs, in that order but for the length."""
    if min_exponent < 3:
        raise ValueError("runs of fewer than three periods are not searched for")
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    first = np.concatenate([[0], np.cumsum(n)])
    found = []
    if n.sum() > 1:
        doc = np.repeat(np.arange(len(words)), n)
        flat = np.empty(int(n.sum()), dtype=object)
        flat[:] = [w for d in words for w in d]
        names, twice = _names(pd.factorize(flat)[0].astype(np.int64) * len(words) + doc)
        at, names = np.flatnonzero(twice), names[twice]
        longest, length = int(n.max()) // min_exponent, 1
        while len(at):
            step = _steps(at, names, length)
            edge = np.flatnonzero((np.diff(at) != 1) | (np.diff(step) != 0)) + 1
            begin, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(at)]])
            q = step[begin]
            whole = at[end - 1] - at[begin] + length + q
            keep = (q > 0) & (whole >= np.maximum(min_length, min_exponent * q))
            found.append(np.stack([at[begin][keep], q[keep], whole[keep]]))
            if length >= longest:
                break
            # a stretch of twice the length is named by its halves, both of which occur again
            half = np.full(int(first[-1]), -1, dtype=np.int64)
            half[at] = names
            fits = at + length < len(half)
            at, names = at[fits], names[fits]
            right = half[at + length]
            both = (right >= 0) & (doc[at] == doc[at + length])
            at, names = at[both], names[both] * (len(half) + 1) + right[both]
            if len(at):
                names, twice = _names(names)
                at, names = at[twice], names[twice]
            length *= 2
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 4
    place, period, whole = np.unique(np.concatenate(found, axis=1), axis=1)
    of = np.searchsorted(first, place, side="right") - 1
    return of, place - first[of], whole, period


def dropped_words(n: np.ndarray, runs: tuple[np.ndarray, ...]) -> np.ndarray:
    """Over the words of all documents one after another: whether a run holds the word after its first period."""
    of, start, length, period = runs
    first = np.concatenate([[0], np.cumsum(n)])
    edge = np.zeros(int(first[-1]) + 1, dtype=np.int64)
    np.add.at(edge, first[of] + start + period, 1)
    np.add.at(edge, first[of] + start + length, -1)
    return np.cumsum(edge)[:-1] > 0


def runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>> by start and period, collapsed): one row
    per row of ``docs``; collapsed is the words that no run repeats, one space apart."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = [t.split() for t in part.column(1).to_pylist()]
                n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
                found = find_runs(words, min_length, min_exponent)
                of, start, length, period = found
                if len(of):
                    keep, first = ~dropped_words(n, found), np.concatenate([[0], np.cumsum(n)])
                    for d in np.unique(of).tolist():
                        words[d] = [w for w, k in zip(words[d], keep[first[d]:first[d + 1]].tolist()) if k]
                ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(words)))]).astype(np.int32)
                listed = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(
                    [pa.array(start), pa.array(length), pa.array(period)], fields=list(_RUN)))
                yield pa.record_batch(
                    [part.column(0), pa.array(n), listed, pa.array([b" ".join(w) for w in words], pa.binary())],
                    names=["doc_id", "n_words", "runs", "collapsed"])

    out = rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, "
                               "collapsed binary")
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def without_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """All rows and columns of ``docs``, each run cut down to its first period together with the white space
    before the words that go; ``n_chars``, where there is one, follows the text."""
    prepare(docs.sparkSession)
    column = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    rows = docs.withColumn("text", F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = [t if t is None else t.encode() for t in part.column(column).to_pylist()]
                words = [(t or b"").split() for t in texts]
                n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
                found = find_runs(words, min_length, min_exponent)
                if not len(found[0]):
                    yield part
                    continue
                keep, first = ~dropped_words(n, found), np.concatenate([[0], np.cumsum(n)])
                chars = part.column(size).to_pylist() if size is not None else None
                for d in np.unique(found[0]).tolist():
                    kept = zip(_PIECE.finditer(texts[d]), keep[first[d]:first[d + 1]].tolist())
                    tail = texts[d][len(texts[d].rstrip(b" \t\n\r\x0b\x0c")):]
                    texts[d] = b"".join(m.group() for m, k in kept if k) + tail
                    if chars is not None:
                        chars[d] = len(texts[d].decode())
                columns = list(part.columns)
                columns[column] = pa.array([t if t is None else t.decode() for t in texts], part.column(column).type)
                if chars is not None:
                    columns[size] = pa.array(chars, part.column(size).type)
                yield pa.record_batch(columns, schema=part.schema)

    return rows.mapInArrow(run, rows.schema)


def oracle_sql(min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> str:
    """The query over ``runs`` (with its planted runs) in DuckDB SQL: equal words by distance, gaps and islands.
    The checksum is worked out bit by bit: a byte is taken in, then eight shifts follow."""
    return f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
h AS (SELECT *, len(ws) AS n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten([
        [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS h FROM w),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM h),
b AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
d AS MATERIALIZED (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN ws ELSE
      [ws[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1] FOR i IN range(n)] END AS ws FROM b),
t AS MATERIALIZED (SELECT r, n, unnest(ws) AS w, unnest(range(n)) AS i FROM d),
e AS (SELECT x.r, x.i, y.i - x.i AS q FROM t x JOIN t y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND (y.i - x.i) * {min_exponent} <= x.n),
g AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM e),
c AS MATERIALIZED (SELECT r, q, min(i) AS s, count(*) + q AS m FROM g GROUP BY r, q, island
      HAVING count(*) + q >= greatest({min_length}, {min_exponent} * q)),
runs AS MATERIALIZED (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c o
      WHERE o.r = c.r AND o.q < c.q AND o.s <= c.s AND o.s + o.m >= c.s + c.m)),
f AS (SELECT r, count(*) AS n_runs, max(struct_pack(m := m, s := -s, q := -q)) AS best,
             string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + m)) AS i FROM runs),
left_over AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS text FROM t SEMI JOIN runs USING (r) ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, -best.s AS start, best.m AS length, -best.q AS period,
       1000 * best.m // -best.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(CASE WHEN n_runs IS NULL THEN array_to_string(ws, ' ') ELSE left_over.text END) AS collapsed_sha256
FROM d LEFT JOIN f USING (r) LEFT JOIN left_over USING (r)"""
