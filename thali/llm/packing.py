"""Operator 1: packing documents into training sequences, balanced by attention cost.

A document is its tokens plus an end token. Documents are cut into pieces of at most
``capacity`` tokens: full pieces are sequences by themselves, the rest of each document is
packed. A piece of n tokens costs ``linear * n + quadratic * n * n`` (attention does not
cross documents), and pieces are taken in descending order, each into the sequence of
lowest cost so far among those that still have room (longest-processing-time order under
a capacity). Pieces that fit nowhere whole are cut over the room that is left, so only the
last sequence of a block holds padding.

Scale: tokenizing is a map over the scan's partitions that emits numbers only, one row per
piece. Pieces are dealt to blocks by a hash of (document, start, place in the scan), so neither a hot
source, nor a very long document, nor a row that is repeated very often meets in one task; a block holds about ``block_pieces`` pieces and
is packed by itself in bounded memory. The number of blocks follows the number of pieces,
the padding is at most one sequence per block (about 1/400 of the tokens).

Defined results: a null or empty text is one piece that holds only the end token; ties in
length go by (doc_id, start); a row that repeats another (same id and text) is packed again
with the same keys; rows without an id are packed like any other; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thali.llm.bpe import byte_letters, slices
from thali.llm.common import broadcast_bytes, id_and_text

CAPACITY = 2048
END_ID = 1
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
BLOCK_PIECES = 2000


def fast_encoder(raw: bytes) -> Callable[[str], np.ndarray]:
    """The vocabulary file (byte-level BPE, JSON) as a compiled encoder: text to uint32 ids."""
    import json

    import regex
    import tiktoken
    from public_tokenizers import PATTERN

    spec = json.loads(raw)
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ordinary = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")")

    def encode(text: str) -> np.ndarray:
        if not any(s in text for s in special):
            return np.array(ordinary.encode_ordinary(text), dtype="<u4")
        ids: list[int] = []
        for part in split.split(text):
            ids += [special[part]] if part in special else ordinary.encode_ordinary(part)
        return np.array(ids, dtype="<u4")

    return encode


_ENCODERS: dict[int, Callable[[str], np.ndarray]] = {}


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID,
           with_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``capacity`` tokens: (doc_id, start, length, doc_tokens, ids_crc32, ids).
    Full pieces are never cut again, so their ids are left out unless asked for."""
    raw = broadcast_bytes(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(raw.value)
        if key not in _ENCODERS:
            _ENCODERS[key] = fast_encoder(raw.value)
        encode, end = _ENCODERS[key], np.array([end_id], dtype="<u4")
        for batch in batches:
            for rows in slices(batch):
                out: tuple[list, ...] = ([], [], [], [], [], [])
                for i, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                    ids = np.concatenate([encode(text), end])
                    for at in range(0, len(ids), capacity):
                        part = ids[at:at + capacity].tobytes()
                        keep = with_ids or len(part) < 4 * capacity
                        for column, x in zip(out, (i, at, len(part) // 4, len(ids), zlib.crc32(part),
                                                   part if keep else None)):
                            column.append(x)
                yield pa.record_batch([*(pa.array(x, pa.int64()) for x in out[:5]), pa.array(out[5], pa.binary())],
                                      names=["doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids"])

    return id_and_text(docs).mapInArrow(
        run, "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary")


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY, linear: float = LINEAR,
                 quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (in descending order) to (piece, start in it, length, sequence, offset there).

    The lowest-cost sequence with room is found in a heap per amount of free room, indexed
    by the room: pieces descend, so a sequence that is too full now may still take later,
    shorter ones and is put aside until then.
    """
    total = int(lengths.sum())
    n_sequences = -(-total // capacity)
    room = np.full(n_sequences, capacity, dtype=np.int64)
    cost = [0.0] * n_sequences
    heap = [(0.0, s) for s in range(n_sequences)]  # a heap as it stands: all costs are equal
    aside: list[tuple[int, int]] = []              # (-room, sequence): too full for the last piece
    left, out = [], []
    for p, n in enumerate(lengths.tolist()):
        while aside and -aside[0][0] >= n:         # shorter pieces: there is room again
            s = heapq.heappop(aside)[1]
            heapq.heappush(heap, (cost[s], s))
        while heap and room[heap[0][1]] < n:
            s = heapq.heappop(heap)[1]
            if room[s]:
                heapq.heappush(aside, (-int(room[s]), s))
        if not heap:
            left.append(p)
            continue
        s = heapq.heappop(heap)[1]
        out.append((p, 0, n, s, capacity - int(room[s])))
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n
        if room[s]:
            heapq.heappush(heap, (cost[s], s))
    free = [(cost[s], s) for s in range(n_sequences) if room[s]]
    heapq.heapify(free)
    for p in left:                                 # cut what fits nowhere whole, over the cheapest sequences with room
        at, n = 0, int(lengths[p])
        while n:
            s = heapq.heappop(free)[1]
            m = min(n, int(room[s]))
            out.append((p, at, m, s, capacity - int(room[s])))
            room[s] -= m
            cost[s] += linear * m + quadratic * m * m
            at, n = at + m, n - m
            if room[s]:
                heapq.heappush(free, (cost[s], s))
    return out


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID,
         linear: float = LINEAR, quadratic: float = QUADRATIC, block_pieces: int = BLOCK_PIECES,
         with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) per piece in a sequence."""
    size = id_and_text(docs).agg(F.count(F.lit(1)).alias("n"),
                                 F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, -(-(size["n"] + (size["bytes"] or 0) // (2 * capacity)) // block_pieces))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    columns = ", ".join(f"{c} long" for c in names) + ", named boolean" + (", ids binary" if with_ids else "")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0]) << 32
        full = pdf[pdf["length"] == capacity].sort_values(["doc_id", "start", "ids_crc32"])
        pdf = pdf[pdf["length"] < capacity].sort_values(["length", "doc_id", "start", "ids_crc32"],
                                                        ascending=[False, True, True, True])
        doc, start, total, ids, named = (pdf[c].tolist() for c in ("doc_id", "start", "doc_tokens", "ids", "named"))
        rows, sequences = [], 0
        for p, at, n, s, offset in pack_lengths(pdf["length"].to_numpy(), capacity, linear, quadratic):
            part = ids[p][4 * at:4 * (at + n)]
            rows.append((doc[p], start[p] + at, n, zlib.crc32(part), total[p], block + s, offset, named[p], part))
            sequences = max(sequences, s + 1)
        packed = pd.DataFrame(rows, columns=[*names, "named", "ids"])
        full = full.assign(sequence_id=block + sequences + np.arange(len(full)), offset=0)[[*names, "named", "ids"]]
        out = pd.concat([packed, full]) if len(packed) and len(full) else (packed if len(packed) else full)
        return out if with_ids else out.drop(columns="ids")

    # pandas has no missing integers: a missing id travels as 0 and a flag. Rows that repeat each other differ in
    # their place in the scan, so they do not meet in one block
    dealt = pieces(docs, vocabulary, capacity, end_id, with_ids).withColumns(
        {"block": F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(blocks)), "named": F.col("doc_id").isNotNull(),
         "doc_id": F.coalesce("doc_id", F.lit(0))})
    return dealt.groupBy("block").applyInPandas(run, columns).select(
        F.when(F.col("named"), F.col("doc_id")).alias("doc_id"), *names[1:], *(["ids"] if with_ids else []))
