"""Operator 2: SimHash near-dedup by a segment-popcount embedding and a grid range-join.

A fingerprint is embedded as the bit counts of its segments. The Manhattan distance of two
such vectors never exceeds the fingerprints' bit distance, so it is a lower bound: pairs
beyond the limit by Manhattan distance are not looked at. The range-join runs on a grid:
the segments fall into bands, and if the whole distance is at most d, then some band's part
is at most d // bands, which is 0 or 1 for the bands used here. Each distinct fingerprint
lies in one cell per band (the band's vector) and probes the cells one count above it;
whoever is one below finds it by its own probe. Pairs that meet in a cell are held against
the bound, then verified exactly by their bit distance.

Counts are kept in unary ("thermometer") code, c of a segment's bits set for a count of c,
so a band is a plain integer and Manhattan distance is the bit count of an exclusive or.

Scale: equal fingerprints are one row before anything is compared (a group of copies is a
single node). A cell is a hash key of one shuffle, dealt evenly; cells with more than
``cell_block`` residents are split into blocks that meet block by block in separate tasks,
so no pair is lost and no task holds a whole hot cell. Links leave a task as a spanning
forest, never as all pairs of a group. Components come from star contraction over the
links, checkpointed each round.

Defined results: null and empty texts, and texts without a word, have fingerprint zero,
linked like any other; texts with fewer words than a shingle are one shingle; repeated
rows give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thali.llm.bpe import slices
from thali.llm.common import cut_lineage, id_and_text, prepare
from thali.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEGMENT_BITS = 2
SEED = 42
CELL_BLOCK = 4096
#: Pairs held against the bound at a time in a task.
PAIRS_AT_ONCE = 1 << 20

#: Eight 8-bit counters in one integer, one per bit of a byte.
_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=np.uint64)


def shingle_hashes(text: str, words: int = SHINGLE_WORDS) -> list[int]:
    """Unsigned XXH64 of every shingle of lower-cased (A-Z) words, repeats included."""
    w = text.encode().lower().split()
    if not w:
        return []
    joined = b" ".join(w)
    if len(w) <= words:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[words - 1:].tolist())]


def fingerprint_of(hashes: list[list[int]]) -> np.ndarray:
    """Per document the 64 bits that are set in over half of its hashes."""
    n = np.fromiter(map(len, hashes), dtype=np.int64, count=len(hashes))
    out = np.zeros(len(hashes), dtype=np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    flat = np.fromiter((h for x in hashes for h in x), dtype=np.uint64, count=int(n.sum()))
    first = np.concatenate([[0], np.cumsum(n[full])[:-1]])
    # 8-bit counters hold 255 rows, so sums start anew at each document and every 255 rows
    runs = -(-n[full] // 255)
    at = np.concatenate([[0], np.cumsum(runs)[:-1]])
    cuts = np.repeat(first, runs) + 255 * (np.arange(runs.sum()) - np.repeat(at, runs))
    part = np.add.reduceat(_SPREAD[flat.view(np.uint8).reshape(-1, 8)], cuts, axis=0)
    counts = np.add.reduceat(part.view(np.uint8).reshape(len(cuts), 64).astype(np.int64), at, axis=0)
    bits = (2 * counts > n[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, key, fp long): a hash of the text, and the 64 bits as a signed integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                fp = fingerprint_of([shingle_hashes(t, words) for t in rows.column(1).to_pylist()])
                yield pa.record_batch([rows.column(0), rows.column(2), pa.array(fp.view(np.int64))],
                                      names=["doc_id", "key", "fp"])

    return id_and_text(docs).withColumn("key", F.xxhash64("text")).mapInArrow(run, "doc_id long, key long, fp long")


def embed(fp: np.ndarray, segment_bits: int = SEGMENT_BITS) -> np.ndarray:
    """Bit counts of the segments in unary code, packed like the fingerprint itself."""
    out = np.zeros_like(fp)
    mask = np.uint64((1 << segment_bits) - 1)
    for at in range(0, 64, segment_bits):
        count = np.bitwise_count((fp >> np.uint64(at)) & mask).astype(np.uint64)
        out |= ((np.uint64(1) << count) - np.uint64(1)) << np.uint64(at)
    return out


def bands(max_bits: int) -> int:
    """Fewest bands of equal width so that one of them differs by at most one count."""
    b = 2
    while max_bits // b > 1:
        b *= 2
    return b


def grid(fps: DataFrame, max_bits: int = MAX_BITS, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """(cell long, fp, resident boolean): each fingerprint in its own cells and in those one count above."""
    prepare(fps.sparkSession)
    n_bands = bands(max_bits)
    width = 64 // n_bands
    up = max_bits // n_bands >= 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.uint64((1 << width) - 1)
        for batch in batches:
            for rows in slices(batch, 5000):
                signed = rows.column(0).to_numpy()
                vector = embed(signed.view(np.uint64), segment_bits)
                for band in range(n_bands):
                    here = (vector >> np.uint64(band * width)) & low
                    cells, who, resident = [here], [signed], [np.ones(len(here), dtype=bool)]
                    if up:
                        for at in range(0, width, segment_bits):
                            count = here >> np.uint64(at) & np.uint64((1 << segment_bits) - 1)
                            more = count < np.uint64((1 << segment_bits) - 1)
                            step = ((count << np.uint64(1) | np.uint64(1)) ^ count) << np.uint64(at)
                            cells.append((here ^ step)[more])
                            who.append(signed[more])
                            resident.append(np.zeros(int(more.sum()), dtype=bool))
                    # several bands leave room above the cell's bits; the hash key tells bands apart
                    cell = np.concatenate(cells) | np.uint64(band << width if n_bands > 1 else 0)
                    yield pa.record_batch([pa.array(cell.view(np.int64)), pa.array(np.concatenate(who)),
                                           pa.array(np.concatenate(resident))], names=["cell", "fp", "resident"])

    return fps.select("fp").mapInArrow(run, "cell long, fp long, resident boolean")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links to a star per connected component: (node, least node), as many as nodes at most."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[:len(a)], place[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _pairs(fp: np.ndarray, resident: np.ndarray, side: np.ndarray, cross: np.ndarray, group: np.ndarray,
           max_bits: int, segment_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified links of whole groups. Rows are sorted by group, residents first."""
    unsigned = fp.view(np.uint64)
    vector = embed(unsigned, segment_bits)
    starts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]])
    residents = np.add.reduceat(resident.astype(np.int64), starts[:-1])
    of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    meets = residents[of]
    rows = np.flatnonzero(meets)
    total = np.cumsum(meets[rows])
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE)))
        some = rows[at:to]
        at = to
        m = meets[some]
        left = np.repeat(some, m)
        begin = np.concatenate([[0], np.cumsum(m)[:-1]])
        right = np.repeat(starts[of[some]] - begin, m) + np.arange(len(left))
        keep = np.bitwise_count(vector[left] ^ vector[right]) <= max_bits           # the lower bound
        keep &= ~resident[left] | (fp[left] < fp[right])                            # each pair once
        keep &= ~cross[left] | (side[left] != side[right])                          # two blocks: across only
        left, right = left[keep], right[keep]
        keep = np.bitwise_count(unsigned[left] ^ unsigned[right]) <= max_bits       # exactly
        keep &= left != right
        yield fp[left[keep]], fp[right[keep]]


def links(fps: DataFrame, max_bits: int = MAX_BITS, segment_bits: int = SEGMENT_BITS,
          cell_block: int = CELL_BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints that differ in at most ``max_bits`` bits, thinned
    within each task to a spanning forest (the components are those of all links)."""
    cells = grid(fps, max_bits, segment_bits)
    hot = cells.filter("resident").groupBy("cell").count().filter(F.col("count") > cell_block).select(
        "cell", F.ceil(F.col("count") / cell_block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int")
    dealt = (cells.join(hot, "cell", "left").withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
             .select("cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
                     "own", "fp", "resident"))
    met = dealt.repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high", F.desc("resident"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        rest: list[pa.RecordBatch] = []

        def take(columns: list[np.ndarray]) -> None:
            nonlocal kept
            cell, low, high, side, fp, resident = columns
            group = np.concatenate([[0], np.cumsum((cell[1:] != cell[:-1]) | (low[1:] != low[:-1])
                                                   | (high[1:] != high[:-1]))])
            for a, b in _pairs(fp, resident, side, low != high, group, max_bits, segment_bits):
                kept = np.concatenate([kept[0], a]), np.concatenate([kept[1], b])
                if len(kept[0]) > PAIRS_AT_ONCE:
                    kept = forest(*kept)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            rest.append(batch)
            columns = [c.to_numpy(zero_copy_only=False) for c in pa.Table.from_batches(rest).columns]
            cell, low, high = columns[:3]
            new = np.flatnonzero((cell != cell[-1]) | (low != low[-1]) | (high != high[-1]))
            end = int(new[-1]) + 1 if len(new) else 0      # the last group may go on in the next batch
            if end:
                take([c[:end] for c in columns])
                rest = [pa.Table.from_batches(rest).slice(end).combine_chunks().to_batches()[0]]
        if rest:
            take([c.to_numpy(zero_copy_only=False) for c in pa.Table.from_batches(rest).columns])
        if len(kept[0]):
            a, b = forest(*kept)
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                    segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """(doc_id, key, fp long, component_id): key is a hash of the text, component_id the smallest doc_id
    reachable over links."""
    found = cut_lineage(fingerprints(docs, words))
    distinct = cut_lineage(found.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    roots = components(links(distinct, max_bits, segment_bits))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return found.join(classes, "fp").select("doc_id", "key", "fp", "component_id")


def one_per_group(docs: DataFrame, **limits: int) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id, with all columns. Rows
    that repeat a document are one document; rows without an id cannot be named and stay."""
    copies = near_duplicates(docs, **limits).filter(F.col("doc_id") != F.col("component_id")).select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    left = docs.withColumn("_text_key", text).withColumn("_doc", F.col("doc_id").cast("long")).join(
        copies, (F.col("_doc") == F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left_anti")
    # the join above has dealt and sorted the rows by these columns
    again = F.row_number().over(Window.partitionBy("_doc", "_text_key").orderBy("_doc"))
    return left.withColumn("_again", again).filter((F.col("_again") == 1) | F.col("_doc").isNull()).select(*docs.columns)
