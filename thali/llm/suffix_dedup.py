"""Operator 8: exact removal of repeated 200-byte strings by external induced suffix sorting.

Every byte is removed that a string of ``length`` bytes covers which also starts elsewhere,
in the same document or another. Which strings repeat is read off suffix arrays: in suffix
order they are neighbours with a common prefix of ``length`` or more (``induced_sort``).

One array over the corpus is not needed. A window of ``length`` bytes is keyed by the least
hash among its 32-byte grams; equal windows have equal keys. A document falls into segments,
maximal runs of windows with one key, each with the bytes its windows cover. Only segments
whose key occurs with different bytes elsewhere, or at several places in their own run, have
to be sorted; they are dealt by key
into shards of about ``shard_bytes``, and each shard is sorted by itself. Segments that are
equal byte for byte are one text with a count: all their windows repeat, and one of them
stands for all in the shards, so large groups of copies and passages that very many
documents share are pre-aggregated before any text moves.

A key that still has more than ``hot_segments`` different segments would make a shard of its
own size. Its windows are counted by a 128-bit hash instead, pre-aggregated in Spark.

Defined results: texts are UTF-8 bytes (null: none), which may be cut inside a character;
texts shorter than ``length`` bytes are kept; equal rows are documents of their own and so
lose whatever is long enough; rows that share an id but not the text are kept apart by a
32-bit hash of the text, rows without an id by a 64-bit one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thali.llm.bpe import slices
from thali.llm.common import cut_lineage, id_and_text, written
from thali.llm.induced_sort import sort_suffixes

LENGTH = 200
GRAM = 32
SHARD_BYTES = 2 << 20
HOT_SEGMENTS = 20_000
#: Bytes of a document that are hashed at a time.
CHUNK_BYTES = 4 << 20
#: Stands between the texts of a shard; occurs in no UTF-8 text.
SEPARATOR = 0xFF

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(8).integers(0, 2**64, 256, dtype=np.uint64)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of every ``gram`` (a power of two) bytes."""
    h, width, power = _BYTES[data], 1, np.array([_MULTIPLY])
    while width < gram:
        h = h[:-width] * power + h[width:]
        power = power * power
        width *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def sliding(values: np.ndarray, width: int, pick: np.ufunc = np.minimum) -> np.ndarray:
    """The least (or greatest) of every ``width`` neighbouring values."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, pick is np.minimum and np.iinfo(np.uint64).max or 0, dtype=np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    behind = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[:n - width + 1], ahead[width - 1:n])


def segments(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(key, first window, windows, again) of every maximal run of windows with one key; ``again`` is true
    where the gram behind the key occurs at several places, so that the run may hold equal windows itself."""
    if len(data) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    if len(data) > CHUNK_BYTES + length:           # a run cut at a chunk's end is two runs of one key
        parts = [(at, segments(data[at:at + CHUNK_BYTES + length - 1], length, gram))
                 for at in range(0, len(data) - length + 1, CHUNK_BYTES)]
        key, _, windows, again = (np.concatenate([p[i] for _, p in parts]) for i in range(4))
        start = np.concatenate([p[1] + at for at, p in parts])
        return key, start, windows, again
    width = length - gram + 1
    hashes = gram_hashes(data, gram)
    least = sliding(hashes, width)
    start = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    around = np.zeros(width - 1, dtype=np.uint64)
    behind_keys = np.sort(hashes[hashes == sliding(np.concatenate([around, least, around]), width, np.maximum)])
    twice = behind_keys[1:][behind_keys[1:] == behind_keys[:-1]]
    key = least[start]
    return key, start, np.diff(np.append(start, len(least))), np.isin(key, twice)


def all_segments(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, content, doc_id, text_key, start, windows, again) of all documents; content is a hash of the bytes,
    text_key one of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, 200):
                out: list[list[np.ndarray]] = [[], [], [], [], [], [], []]
                for i, text, text_key in zip(*(rows.column(c).to_pylist() for c in range(3))):
                    raw = text.encode()
                    key, start, windows, again = segments(np.frombuffer(raw, dtype=np.uint8), length)
                    ends = (start + windows + length - 1).tolist()
                    content = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start.tolist(), ends)),
                                          dtype=np.uint64, count=len(key))
                    for column, x in zip(out, (key.view(np.int64), content.view(np.int64), np.full(len(key), i),
                                               np.full(len(key), text_key), start, windows, again)):
                        column.append(x)
                kinds = (np.int64, np.int64, np.int64, np.int32, np.int32, np.int32, bool)
                yield pa.record_batch([pa.array(np.concatenate(x).astype(kind)) for x, kind in zip(out, kinds)],
                                      names=["key", "content", "doc_id", "text_key", "start", "windows", "again"])

    return with_text_key(docs).mapInArrow(
        run, "key long, content long, doc_id long, text_key int, start int, windows int, again boolean")


def reference(doc_id: Column, text: Column) -> Column:
    """What names a document in the joins: its id, or a hash of the text where it has none."""
    return F.coalesce(doc_id.cast("long"), F.xxhash64(text))


def with_text_key(docs: DataFrame) -> DataFrame:
    return id_and_text(docs).select(reference(F.col("doc_id"), F.col("text")).alias("doc_id"), "text",
                                    F.hash("text").alias("text_key"))


def extract(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(shard, doc_id, text_key, start, data) for the wanted segments; those of one document that meet in one
    shard and overlap become one text, so a shard holds no place twice. Hot segments come with shard -1, one
    row per window, with the window's 128-bit hash for data."""
    per_doc = wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("shard", "start", "windows")).alias("at"))
    per_doc = per_doc.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "at")
    # equal rows are one text here: every window of theirs is marked as a repeat by its equal segments
    joined = texts.join(per_doc.hint("shuffle_hash"), (F.col("doc_id") == F.col("_id"))
                        & (F.col("text_key") == F.col("_key"))).select("doc_id", "text_key", "text", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, 100):
                out: tuple[list, ...] = ([], [], [], [], [])
                for i, text_key, text, at in zip(*(rows.column(c).to_pylist() for c in range(4))):
                    raw = text.encode()
                    spans: list[list[int]] = []
                    for x in sorted(((x["shard"], x["start"], x["windows"]) for x in at)):
                        shard, a, b = x[0], x[1], x[1] + x[2] + length - 1
                        if shard < 0:
                            for p in range(a, b - length + 1):
                                for column, v in zip(out, (shard, i, text_key, p,
                                                           xxhash.xxh3_128_digest(raw[p:p + length]))):
                                    column.append(v)
                        elif spans and spans[-1][0] == shard and a <= spans[-1][2]:
                            spans[-1][2] = max(spans[-1][2], b)
                        else:
                            spans.append([shard, a, b])
                    for shard, a, b in spans:
                        for column, v in zip(out, (shard, i, text_key, a, raw[a:b])):
                            column.append(v)
                yield pa.record_batch([pa.array(x, kind) for x, kind in zip(
                    out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                    names=["shard", "doc_id", "text_key", "start", "data"])

    return joined.mapInArrow(run, "shard long, doc_id long, text_key int, start int, data binary")


def runs_of(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - edge[::2]


def repeated_windows(parts: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(part, first window, windows) of the windows that start at two or more places of the parts."""
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    text = np.frombuffer(b"\xff".join(parts), dtype=np.uint8)
    order, prefix = sort_suffixes(text, length)
    repeats = np.zeros(len(text) + 1, dtype=bool)
    long = np.flatnonzero(prefix >= length)
    repeats[order[long]] = True
    repeats[order[long - 1]] = True
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    first, count = runs_of(repeats[:-1])
    part = np.searchsorted(starts, first, side="right") - 1
    out = []
    for p, a, n in zip(part.tolist(), first.tolist(), count.tolist()):
        end = a + n                                    # a run may go on into the next part: cut it there
        while a < end:
            inside = int(starts[p] + sizes[p]) - length + 1        # windows that do not leave the part
            if a < inside:
                out.append((p, a - int(starts[p]), min(end, inside) - a))
            p += 1
            a = max(a, int(starts[p])) if p < len(parts) else end
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES,
                   hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(doc_id, text_key, start, windows): runs of windows that occur twice or more."""
    every, delete = written(all_segments(docs, length))
    # what there is to look at: keys of two or more segments, and runs that may repeat in themselves
    keys = every.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again")).filter(
        "n > 1 or again").select("key")
    found = cut_lineage(every.join(keys, "key", "left_semi"))
    delete()
    place = F.struct("doc_id", "text_key", "start", "windows")
    distinct = found.groupBy("key", "content").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place"),
                                                   F.max("again").alias("again"))
    equal = distinct.filter("n > 1").select("key", "content")
    copies = found.join(equal, ["key", "content"], "left_semi").select("doc_id", "text_key", "start", "windows")
    # what has to be sorted: keys with different bytes, and such runs of which there is one
    several = distinct.groupBy("key").agg(
        F.count(F.lit(1)).alias("kinds"), F.max(F.col("again") & (F.col("n") == 1)).alias("alone")).filter("kinds > 1 or alone")
    total = found.agg(F.sum(F.col("windows") + length)).first()[0] or 0       # an upper bound of what is sorted
    shards = max(1, -(-int(total) // shard_bytes))
    wanted = distinct.join(several, "key").select(
        "place.*", F.when(F.col("kinds") > hot_segments, F.lit(-1)).otherwise(
            F.pmod(F.xxhash64("key"), F.lit(shards))).cast("long").alias("shard"))
    texts = with_text_key(docs)

    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["doc_id", "text_key", "start"])          # repeated rows
        ids, keys, starts = (pdf[c].tolist() for c in ("doc_id", "text_key", "start"))
        rows = [(ids[p], keys[p], starts[p] + a, n) for p, a, n in repeated_windows(pdf["data"].tolist(), length)]
        return pd.DataFrame(rows, columns=["doc_id", "text_key", "start", "windows"])

    sorted_ = extract(texts, wanted.filter("shard >= 0"), length).groupBy("shard").applyInPandas(
        sort, "doc_id long, text_key int, start int, windows int")
    hot = extract(texts, wanted.filter("shard < 0"), length)
    here = F.struct("doc_id", "text_key", "start")
    twice = hot.groupBy("data").agg(F.min(here).alias("a"), F.max(here).alias("b")).filter("a < b").select("data")
    windows = hot.join(twice, "data", "left_semi").select("doc_id", "text_key", "start", F.lit(1).alias("windows"))
    return copies.unionByName(sorted_).unionByName(windows)


def cut_out(raw: bytes, spans: list[dict], length: int) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of ``raw`` and the maximal removed runs (start, length)."""
    step = np.zeros(len(raw) + 1, dtype=np.int64)
    for x in spans:
        step[x["start"]] += 1
        step[x["start"] + x["windows"] + length - 1] -= 1
    removed = np.cumsum(step[:-1]) > 0
    start, size = runs_of(removed)
    return np.frombuffer(raw, dtype=np.uint8)[~removed].tobytes(), list(zip(start.tolist(), size.tolist()))


def _cut(docs: DataFrame, keep: list[str], with_text: bool, length: int = LENGTH, shard_bytes: int = SHARD_BYTES,
         hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, _keep struct of further columns, kept binary)."""
    spans = repeated_spans(docs, length, shard_bytes, hot_segments).groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("start", "windows")).alias("spans")).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "spans")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("_doc"), text.alias("_text"), F.hash(text).alias("_tk"),
                       reference(F.col("doc_id"), text).alias("_ref"), F.struct(F.lit(0).alias("_"), *keep).alias("_keep"))
    joined = rows.join(spans.hint("shuffle_hash"), (F.col("_ref") == F.col("_id"))
                       & (F.col("_tk") == F.col("_key")), "left").select("_doc", "_text", "spans", "_keep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 200):
                out: tuple[list, ...] = ([], [], [], [], [])
                for t, s in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    raw = t.encode()
                    left, removed = cut_out(raw, s, length) if s else (raw, [])
                    for column, x in zip(out, (len(raw), len(raw) - len(left), len(removed),
                                               hashlib.sha256(left).hexdigest(), left if with_text else None)):
                        column.append(x)
                yield pa.record_batch([part.column(0), *(pa.array(x, pa.int64()) for x in out[:3]),
                                       pa.array(out[3], pa.string()), part.column(3), pa.array(out[4], pa.binary())],
                                      names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "_keep", "kept"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
                                  f"_keep {joined.schema['_keep'].dataType.simpleString()}, kept binary")


def remove_repeats(docs: DataFrame, with_text: bool = False, **limits: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]) of every row of ``docs``."""
    return _cut(docs, [], with_text, **limits).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []))


def decoded(kept: pd.Series) -> pd.Series:
    return kept.map(lambda b: b.decode("utf-8", errors="ignore"))


def without_repeats(docs: DataFrame, **limits: int) -> DataFrame:
    """All documents and columns, their texts without repeated bytes; of a character that was cut, the rest
    goes too. ``n_chars``, where there is one, follows the text."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    text = F.pandas_udf(decoded, "string")
    done = _cut(docs, rest, True, **limits).withColumn("_text", text("kept"))
    out = {c: F.col(f"_keep.`{c}`") for c in rest} | {
        "doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("_text")}
    if "n_chars" in rest:
        out["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("_text")).otherwise(out["n_chars"]).cast(
            docs.schema["n_chars"].dataType)
    return done.select(*(out[c].alias(c) for c in docs.columns))
