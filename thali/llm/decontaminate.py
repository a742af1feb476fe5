"""Operator 11: benchmark decontamination by a broadcast hash set of test n-grams.

Texts are normalised to words (A-Z lower-cased, all other ASCII but digits and letters separates). Every
n consecutive words of a benchmark item are a window; an item of fewer words is one window. The windows
are hashed (a polynomial over word numbers, in 64 bits) into a broadcast set with the items that hold
each. One scan over the corpus hashes the windows of each text, looks them up, verifies each hit word by
word, and reports the words covered and the items met. Passages or whole documents can then be removed.

Scale: the corpus is read once and not shuffled. A broadcast index is made of at most ``index_bytes``
of benchmark text, which is counted first. A larger benchmark is cut into such parts, by pieces of items that
overlap by n - 1 words, so that no window is lost; each part is one more scan, its hits (only
documents that have some) are written to the shared folder, and they are put together per document. The
driver holds one part at a time, never anything of the documents. Words that no item holds are told
apart by one look-up, so most windows are never hashed.

Defined results: a null text, or one without a word, has no words, no hits and no items; items without
a word have no windows; windows of items without an id mark words, but such items are not named or
counted; repeated items are one item; repeated documents each get the same result; an empty benchmark
marks nothing and an empty table gives no rows. Very long texts and items are handled whole.
``contamination`` ignores extra columns, the others keep them, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thali.llm.bpe import slices
from thali.llm.common import cut_lineage, prepare, written

WINDOW_WORDS = 10
#: Benchmark text of one broadcast index; the index takes some ten times as much.
INDEX_BYTES = 8 << 20
#: Words of an item that are indexed together.
PIECE_WORDS = 4096

_WORD_BYTES = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Normalised words of UTF-8 bytes."""
    return text.translate(_FOLD).split()


class NgramIndex:
    """Hash set of windows with their items."""

    def __init__(self, pieces: list[tuple[str | None, bytes]], n: int = WINDOW_WORDS):
        words = [words_of(t) for _, t in pieces]
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        self.flat = np.array([number(w, len(self.vocabulary)) for p in words for w in p], dtype=np.int32)
        self.items = sorted({i for i, _ in pieces if i is not None})
        place = {item: k for k, item in enumerate(self.items)}
        size = np.array([len(p) for p in words], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(size) else size
        item = np.array([-1 if i is None else place[i] for i, _ in pieces], dtype=np.int64)
        #: By window length: sorted hashes, a place of each window in ``flat``, and its items as (ends, numbers).
        self.sets: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.seed = 0
        while not self._hashed(n, size, first, item):
            self.seed += 1                       # two different windows share a hash: other word values

    def _hashed(self, n: int, size: np.ndarray, first: np.ndarray, item: np.ndarray) -> bool:
        self.values = np.random.default_rng([11, self.seed]).integers(
            0, 1 << 63, len(self.vocabulary) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for length in sorted(set(np.minimum(size, n).tolist()) - {0}):
            of = np.flatnonzero(size >= n if length == n else size == length)
            count = size[of] - length + 1
            begins = np.concatenate([[0], np.cumsum(count)[:-1]])
            at = np.repeat(first[of] - begins, count) + np.arange(int(count.sum()))
            hashes, some, which = np.unique(self.hashed(self.flat, at, length), return_index=True, return_inverse=True)
            if not self.equal(self.flat, at, at[some][which], length).all():
                return False
            held = np.unique(np.stack([which, np.repeat(item[of], count)]), axis=1)
            held = held[:, held[1] >= 0]
            ends = np.concatenate([[0], np.cumsum(np.bincount(held[0], minlength=len(hashes)))])
            self.sets[length] = hashes, at[some], ends, held[1]
        return True

    def hashed(self, ids: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        out = np.zeros(len(at), dtype=np.uint64)
        for k in range(length):
            out = out * np.uint64(0x9E3779B97F4A7C15) + self.values[ids[at + k]]
        return out

    def equal(self, ids: np.ndarray, at: np.ndarray, to: np.ndarray, length: int) -> np.ndarray:
        """Whether the windows of ``ids`` are, word by word, those of the index at ``to``."""
        out = np.ones(len(at), dtype=bool)
        for k in range(length):
            out &= ids[at + k] == self.flat[to + k]
        return out

    def scan(self, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hit passages as (document, first word, word after the last) and met items as (document, number)."""
        n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        first = np.concatenate([[0], np.cumsum(n)])
        total, number = int(first[-1]), self.vocabulary.get
        ids = np.fromiter((k for d in words for k in map(number, d, repeat(-1))), dtype=np.int32, count=total)
        # words from each place on that items hold, up to the document's end
        stop = np.unique(np.concatenate([first[1:], np.flatnonzero(ids < 0)]))
        edge, met = np.zeros(total + 1, dtype=np.int64), []
        known = np.flatnonzero(ids >= 0)
        room = stop[np.searchsorted(stop, known, side="right")] - known if len(known) else known
        for length, (hashes, place, ends, items) in self.sets.items():
            at = known[room >= length]
            if not len(at):
                continue
            found = self.hashed(ids, at, length)
            near = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
            same = hashes[near] == found
            at, near = at[same], near[same]
            sure = self.equal(ids, at, place[near], length)
            at, near = at[sure], near[sure]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + length, -1)
            pairs = np.unique(np.stack([np.searchsorted(first, at, side="right") - 1, near]), axis=1)
            many = ends[pairs[1] + 1] - ends[pairs[1]]
            begins = np.concatenate([[0], np.cumsum(many)[:-1]]) if len(many) else many
            held = items[np.repeat(ends[pairs[1]] - begins, many) + np.arange(int(many.sum()))]
            met.append(np.stack([np.repeat(pairs[0], many), held]))
        hit = np.cumsum(edge)[:-1] > 0
        doc = np.repeat(np.arange(len(words)), n)
        opens = hit & np.concatenate([[True], ~hit[:-1] | (doc[1:] != doc[:-1])])[:total]
        closes = hit & np.concatenate([~hit[1:] | (doc[1:] != doc[:-1]), [True]])[:total]
        begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        of = doc[begin]
        met = np.unique(np.concatenate(met, axis=1), axis=1) if met else np.zeros((2, 0), dtype=np.int64)
        return of, begin - first[of], end - first[of], met[0], met[1]


def _pieces(benchmark: DataFrame, n: int) -> DataFrame:
    """(item, piece): items cut into pieces that overlap by n - 1 words, each once."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"),
                            F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                item, piece = [], []
                for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = words_of(text)
                    for at in range(0, max(1, len(words) - n + 1) if words else 0, PIECE_WORDS):
                        item.append(name)
                        piece.append(b" ".join(words[at:at + PIECE_WORDS + n - 1]))
                yield pa.record_batch([pa.array(item, pa.string()), pa.array(piece, pa.binary())], names=["item", "piece"])

    return rows.mapInArrow(run, "item string, piece binary").distinct()


def _scanned(docs: DataFrame, index, only_hits: bool) -> DataFrame:
    """(doc_id, key, n_words, spans, items) against one broadcast index."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(
        "doc_id", F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = index.value
        names = pa.array(grams.items, pa.string())
        for batch in batches:
            for part in slices(batch):
                words = [words_of(t) for t in part.column(2).to_pylist()]
                of, begin, end, who, item = grams.scan(words)
                ends = [np.concatenate([[0], np.cumsum(np.bincount(x, minlength=len(words)))]).astype(np.int32) for x in (of, who)]
                spans = pa.ListArray.from_arrays(ends[0], pa.StructArray.from_arrays([pa.array(begin), pa.array(end)], ["start", "end"]))
                out = pa.record_batch(
                    [part.column(0), part.column(1), pa.array(list(map(len, words)), pa.int64()), spans,
                     pa.ListArray.from_arrays(ends[1], names.take(pa.array(item)))],
                    names=["doc_id", "key", "n_words", "spans", "items"])
                yield out.filter(pa.array(np.diff(ends[0]) > 0)) if only_hits else out

    return rows.mapInArrow(run, "doc_id long, key long, n_words long, spans array<struct<start: long, end: long>>, items array<string>")


def merged_spans(spans: list[dict]) -> list[dict]:
    """Spans in order, joined where they meet or overlap."""
    out: list[dict] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    return out


def _put_together(hits: DataFrame) -> DataFrame:
    """The hits of several indices, one row per document."""
    rows = hits.groupBy("doc_id", "key", "n_words").agg(
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = [merged_spans(s) for s in batch.column(3).to_pylist()]
            columns = [*batch.columns[:3], pa.array(merged, batch.column(3).type), batch.column(4)]
            yield pa.record_batch(columns, names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def _found(docs: DataFrame, benchmark: DataFrame, n: int, index_bytes: int, only_hits: bool) -> DataFrame:
    spark = docs.sparkSession
    prepare(spark)
    pieces = cut_lineage(_pieces(benchmark, n))
    total = pieces.agg(F.sum(F.length("piece"))).first()[0] or 0
    parts = -(-total // index_bytes) or 1
    part = F.pmod(F.xxhash64("item", "piece"), F.lit(parts))

    def index(k: int):
        rows = pieces.filter(part == k).toArrow()
        return spark.sparkContext.broadcast(NgramIndex(list(zip(rows["item"].to_pylist(), rows["piece"].to_pylist())), n))

    if parts == 1:
        return _scanned(docs, index(0), only_hits)
    hits = None
    for k in range(parts):
        held = index(k)
        # a document that many rows repeat is one hit
        rows, _ = written(_scanned(docs, held, True).groupBy("doc_id", "key", "n_words").agg(
            F.first("spans").alias("spans"), F.first("items").alias("items")))
        hits = rows if hits is None else hits.unionByName(rows)
        held.destroy()
    hits = _put_together(hits)
    if only_hits:
        return hits
    every = _scanned(docs, spark.sparkContext.broadcast(NgramIndex([], n)), False).select("doc_id", "key", "n_words")
    hit = hits.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "spans", "items")
    none = {c: F.array().cast(hits.schema[c].dataType) for c in ("spans", "items")}
    return every.join(hit, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left").select(
        "doc_id", "key", "n_words", *(F.coalesce(c, none[c]).alias(c) for c in none))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS,
                  index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(doc_id, key, n_words, spans array<struct<start, end>>, items array<string>): per row of ``docs`` the
    spans of words (numbered from 0) that windows of the benchmark cover, and the items that hold those
    windows, as sorted strings; key is a hash of the text."""
    return _found(docs, benchmark, n, index_bytes, False)


def hit_words(spans: Column) -> Column:
    """Number of words in an array of spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def _joined(docs: DataFrame, hits: DataFrame) -> DataFrame:
    hits = hits.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("n_words").alias("_n_words"),
                       F.col("spans").alias("_spans")).dropDuplicates(["_id", "_key"])
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.withColumn("_text_key", key).join(
        hits, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left")


def without_documents(docs: DataFrame, benchmark: DataFrame, max_share: float = 0.0, n: int = WINDOW_WORDS,
                      index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of ``docs`` of whose words no more than ``max_share`` are hit."""
    hits = _found(docs, benchmark, n, index_bytes, True)
    bad = hits.filter(hit_words(F.col("spans")) > max_share * F.col("n_words"))
    return _joined(docs, bad).filter(F.col("_id").isNull() & F.col("_key").isNull()).select(*docs.columns)


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the bytes from the first to the last word of each (start, end)."""
    word = np.frombuffer(text.translate(_FOLD), dtype=np.uint8) != 0x20
    begin = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
    end = np.flatnonzero(word & ~np.concatenate([word[1:], [False]])) + 1
    out, at = [], 0
    for start, stop in spans:
        out.append(text[at:begin[start]])
        at = int(end[stop - 1])
    return b"".join([*out, text[at:]])


def without_passages(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW_WORDS,
                     index_bytes: int = INDEX_BYTES) -> DataFrame:
    """All rows and columns of ``docs``, the texts without their hit passages (judged on the input, not on what
    is left); ``n_chars``, where there is one, follows the text."""
    joined = _joined(docs, _found(docs, benchmark, n, index_bytes, True))

    @F.pandas_udf("string")
    def cut_texts(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else cut(t.encode(), s).decode() for t, s in zip(texts, spans)], dtype=object)

    # texts without a hit are not sent to Python
    pairs = F.transform("_spans", lambda s: F.array(s["start"], s["end"]))
    less = cut_texts(F.when(F.col("_spans").isNotNull(), F.col("text").cast("string")), pairs)
    out = joined.withColumn("_less", less).withColumn("text", F.coalesce("_less", F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_less").isNotNull(), F.char_length("_less")).otherwise(
            F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def oracle_sql(n: int = WINDOW_WORDS) -> str:
    """The query over ``contamination`` in DuckDB SQL."""
    words = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS ws FROM benchmark),
g AS MATERIALIZED (SELECT DISTINCT item, least(len(ws), {n}) AS k, ws[p:p + least(len(ws), {n}) - 1] AS w
      FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - {n}, 0) + 2)) AS p FROM i WHERE len(ws) > 0)),
l AS (SELECT DISTINCT k FROM g),
places AS (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, l WHERE len(ws) >= k),
hit AS MATERIALIZED (SELECT r, p, a.k, item FROM (SELECT r, p, k, ws[p:p + k - 1] AS w FROM places) a JOIN g USING (w)),
n AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + k)) AS q FROM hit) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)"""
