"""Operator 7: byte-level BPE encoding and decoding by forced-boundary splitting.

A merge can only ever build a vocabulary token. So a pair of neighbouring bytes that
occurs inside no token is never joined, whatever surrounds it: the text may be cut there
for certain, its fragments encoded independently and the results concatenated. The cuts
are found from the vocabulary alone (a 256 x 256 table). Fragments are short and repeat,
so their encodings are remembered (in a table of bounded size) and most of a text is
looked up instead of merged.

The vocabulary file is a parameter; its bytes travel to the executors as a broadcast
(a few MB, whatever the data's size). Every document is a row of a narrow map over the
scan's partitions: no shuffle, so hot sources, copies and long documents need no care.

Defined results: a null or empty text has no ids and decodes to the empty text; a special
token's string inside a text is encoded as that token, as the tokenizers library does;
repeated rows give repeated results; further columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from thali.llm.common import broadcast_bytes, id_and_text

# The pre-tokenizer's pattern of the public byte-level vocabulary, with the
# Unicode white space that its engine takes for \s.
_SPACE = r"\t-\r \x85\xa0  -     　"
_WORDS = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _SPACE + r"\p{L}\p{N}]+|["
          + _SPACE + r"]+(?![^" + _SPACE + r"])|[" + _SPACE + r"]+")

LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
#: Fragments and words remembered per Python worker and generation (about 200 bytes each).
MEMO_ENTRIES = 250_000
#: Fragments up to this many bytes are merged by scanning, longer ones with a heap.
SCAN_BYTES = 48


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1
    characters stand for themselves, the rest for 256, 257, ... in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Memo(dict):
    """A dictionary that computes and remembers missing values. Of more than the bound, those
    not asked for since the last time it was full are forgotten."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.older = compute, {}

    def __missing__(self, key):
        if len(self) >= MEMO_ENTRIES:
            self.older = dict(self)
            self.clear()
        value = self.older.pop(key, None)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value


class ForcedBoundaryBPE:
    """Encoder and decoder for one vocabulary file (JSON, byte-level BPE)."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        letters = byte_letters()
        to_bytes = lambda token: bytes(letters[c] for c in token)
        vocab = {to_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ranks: dict[tuple[int, int], int] = {}
        self.joined: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (to_bytes(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            self.ranks[vocab[a], vocab[b]] = rank
            self.joined.append(vocab[a + b])
        self.single = [vocab[bytes([b])] for b in range(256)]
        #: True where two neighbouring bytes occur inside no token: a certain cut.
        self.cut = np.ones((256, 256), dtype=bool)
        for token in vocab:
            for a, b in zip(token, token[1:]):
                self.cut[a, b] = False
        self.cut_rows = self.cut.tolist()
        size = 1 + max([*vocab.values(), *self.special.values()])
        table = [b""] * size
        for token, i in vocab.items():
            table[i] = token
        for text, i in self.special.items():
            table[i] = text.encode()
        self.lengths = np.array([len(t) for t in table], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(table), dtype=np.uint8)
        self.fragments = _Memo(self._merge)
        self.words = _Memo(self._word)
        self.pattern = regex.compile(_WORDS)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def fragments_of(self, data: bytes) -> list[bytes]:
        """``data`` cut at every pair of bytes that no token holds."""
        if len(data) > 200:
            b = np.frombuffer(data, dtype=np.uint8)
            at = (np.flatnonzero(self.cut[b[:-1], b[1:]]) + 1).tolist()
        else:
            rows = self.cut_rows
            at = [i for i, (x, y) in enumerate(zip(data, data[1:]), 1) if rows[x][y]]
        if not at:
            return [data] if data else []
        return [data[i:j] for i, j in zip([0, *at], [*at, len(data)])]

    def _word(self, word: str) -> bytes:
        parts = self.fragments_of(word.encode())
        if len(parts) == 1:
            return self._merge(parts[0])
        return b"".join([self.fragments[f] for f in parts])

    def _merge(self, fragment: bytes) -> bytes:
        ids = [self.single[b] for b in fragment]
        ids = self._scan(ids) if len(ids) <= SCAN_BYTES else self._heap(ids)
        return array("I", ids).tobytes() if LITTLE else np.array(ids, dtype="<u4").tobytes()

    def _scan(self, ids: list[int]) -> list[int]:
        """Join the leftmost pair of the lowest rank until no pair is left that the vocabulary holds."""
        rank_of, none = self.ranks.get, len(self.ranks)
        found = [rank_of(pair, none) for pair in zip(ids, ids[1:])]
        while found and (best := min(found)) < none:
            i = found.index(best)
            ids[i] = self.joined[best]
            del ids[i + 1], found[i]
            if i < len(found):
                found[i] = rank_of((ids[i], ids[i + 1]), none)
            if i:
                found[i - 1] = rank_of((ids[i - 1], ids[i]), none)
        return ids

    def _heap(self, ids: list[int]) -> list[int]:
        """Long fragments: a heap of (rank, place) over a linked list, n log n."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, r in enumerate(map(self.ranks.get, zip(ids, ids[1:]))) if r is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or self.ranks.get((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j], after[i] = self.joined[rank], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := self.ranks.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (r, a))
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        if self.split is None or not any(s in text for s in self.special):
            return b"".join([self.words[w] for w in self.pattern.findall(text)])
        out = []
        for part in self.split.split(text):
            if part in self.special:
                out.append(np.array([self.special[part]], dtype="<u4").tobytes())
            else:
                out += [self.words[w] for w in self.pattern.findall(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ``ids``; bytes that form no UTF-8 become U+FFFD."""
        i = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        n = self.lengths[i]
        ends = np.cumsum(n)
        place = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64)
        place += np.repeat(self.starts[i] - (ends - n), n)
        return self.blob[place].tobytes().decode("utf-8", errors="replace")


_LOADED: dict[int, ForcedBoundaryBPE] = {}


def loaded(raw: bytes) -> ForcedBoundaryBPE:
    """One encoder per Python worker and vocabulary."""
    key = hash(raw)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ForcedBoundaryBPE(raw)
    return _LOADED[key]


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids binary, decoded string): every whole text encoded, and decoded again from its ids."""
    raw = broadcast_bytes(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(raw.value)
        for batch in batches:
            for rows in slices(batch):
                ids = [bpe.encode(t) for t in rows.column(1).to_pylist()]
                yield pa.record_batch([rows.column(0), pa.array(ids, pa.binary()),
                                       pa.array([bpe.decode(x) for x in ids], pa.string())],
                                      names=["doc_id", "ids", "decoded"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids binary, decoded string")


def slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """A batch in pieces, so that a task holds few texts at a time."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def encoding_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    raw = broadcast_bytes(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(raw.value)
        for batch in batches:
            for rows in slices(batch):
                n, a, b = [], [], []
                for text in rows.column(1).to_pylist():
                    ids = bpe.encode(text)
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
                yield pa.record_batch([rows.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()),
                                       pa.array(b, pa.string())],
                                      names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
