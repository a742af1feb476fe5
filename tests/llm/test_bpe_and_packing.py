import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import ROWS, documents, same, with_clashes

from thali.llm import bpe, packing
from thali.llm.queries import vocabulary

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def own():
    with open(vocabulary(), "rb") as f:
        return bpe.ForcedBoundaryBPE(f.read())


def odd_texts():
    rng = random.Random(1)
    points = [*range(1, 0x300), *range(0x4E00, 0x4E50), 0x1F600, 0x300, 0x2003, 0x85, 0x1C]
    yield from ["", "a", "<|endoftext|>x<|endoftext|>", "a  b\x85\x1c c  \n\n d", "x" * 3000, "ab" * 5000, "1" * 700,
                "don't I'll 'S 's''t", " \n  a", "日本語" * 30, "²½Ⅷ三", "\x00\x01"]
    for _ in range(20):
        yield "".join(chr(rng.choice(points)) for _ in range(400))


def test_same_ids_and_text_as_the_library(library, own):
    for text in odd_texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids
        assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_fast_encoder_agrees(own):
    with open(vocabulary(), "rb") as f:
        fast = packing.fast_encoder(f.read())
    for text in odd_texts():
        assert fast(text).tobytes() == own.encode(text)


def test_cuts_are_certain(own):
    tokens = {bytes(own.blob[s:s + n]) for s, n in zip(own.starts, own.lengths)}
    joined = {t[i:i + 2] for t in tokens for i in range(len(t) - 1)}
    for a, b in [(0, 0), (32, 32), (101, 32), (116, 104), (200, 10)]:
        assert own.cut[a, b] == (bytes([a, b]) not in joined) or bytes([a, b]) in b"<|endoftext|>"
    data = "Some words, 12 of them\x00\x01".encode()
    assert b"".join(own.fragments_of(data)) == data


def test_undecodable_bytes_become_replacement_characters(own):
    half = np.frombuffer(own.encode("é"), "<u4")
    one = np.array([own.single[0xC3]], "<u4")
    assert own.decode(one.tobytes()) == "�" and own.decode(half.tobytes()) == "é"


def test_digests(spark, library):
    found = bpe.encoding_digests(with_clashes(documents(spark)), vocabulary()).collect()
    assert len(found) == len(ROWS)
    by = {r.doc_id: r for r in found}
    for i, text, *_ in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert by[i].n_tokens == len(ids)
        assert by[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert by[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_encoded_documents_decode_to_themselves(spark):
    found = {r.doc_id: r.decoded for r in bpe.encode_documents(documents(spark), vocabulary()).collect()}
    assert found == {i: t or "" for i, t, *_ in ROWS}


def test_empty_tables(spark):
    none = documents(spark, [])
    assert bpe.encoding_digests(none, vocabulary()).count() == 0
    assert packing.pack(none, vocabulary()).count() == 0


@pytest.mark.parametrize("block", [2, 2000])
def test_packing_holds_every_token_once(spark, library, block):
    rows = [(i, t, *r) for i, t, *r in ROWS if i != 8] + [(100 + k, "word " * (37 * k % 900), "en", "a", 0) for k in range(60)]
    found = packing.pack(with_clashes(documents(spark, rows)), vocabulary(), block_pieces=block).collect()
    ids = {i: np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t, *_ in rows}
    covered, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert r.length == len(part) > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(part.tobytes())
        covered[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, parts in covered.items():
        assert [s for s, _ in sorted(parts)] == list(np.cumsum([0, *(n for _, n in sorted(parts))])[:-1])
        assert sum(n for _, n in parts) == len(ids[i])
    assert set(covered) == set(ids)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    if block > 100:
        assert len(sequences) <= sum(map(len, ids.values())) // 2048 + 2


def test_repeated_rows_are_packed_again(spark):
    found = packing.pack(documents(spark, [r for r in ROWS if r[0] == 8]), vocabulary()).collect()
    assert len(found) == 2 and len({(r.sequence_id, r.offset) for r in found}) == 2


def test_lengths_are_balanced_by_cost():
    lengths = np.sort(np.random.default_rng(0).integers(1, 2048, 3000))[::-1]
    placed = packing.pack_lengths(lengths)
    cost, used = defaultdict(float), defaultdict(int)
    for _, _, n, s, _ in placed:
        cost[s] += n + n * n / 1024
        used[s] += n
    assert sum(used.values()) == lengths.sum() and max(used.values()) <= 2048
    assert len(used) == -(-int(lengths.sum()) // 2048)
    first = packing.pack_lengths(np.array([1000, 900, 600, 500, 400]), capacity=1700)
    assert first[:4] == [(0, 0, 1000, 0, 0), (1, 0, 900, 1, 0), (2, 0, 600, 1, 900), (3, 0, 500, 0, 1000)]


def test_ids_are_returned(spark):
    found = packing.pack(documents(spark), vocabulary(), with_ids=True)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in found.collect())
    assert same(found.drop("ids"), packing.pack(documents(spark), vocabulary()))


def test_repeated_rows_spread_over_the_blocks(spark):
    docs = documents(spark, [(7, "the same text again", "en", "a", 0)] * 3000
                     + [(100 + i, f"text number {i} of many", "en", "a", 0) for i in range(3000)]).repartition(6)
    packed = packing.pack(docs, vocabulary(), block_pieces=500).collect()
    blocks = Counter(r.sequence_id >> 32 for r in packed if r.start == 0 and r.doc_id == 7)
    assert len(packed) >= 6000 and len(blocks) >= 12 and max(blocks.values()) < 400


def test_leftover_goes_to_the_cheapest_sequences():
    lengths = np.array([60] * 5)                       # three sequences of 100; two pieces fit nowhere whole
    out = packing.pack_lengths(lengths, 100, 1.0, 1.0)
    cut = [(p, s) for p, _, n, s, _ in out if n < 60]
    assert sum(n for _, _, n, _, _ in out) == 300 and {p for p, _ in cut} == {3, 4}
    assert cut == [(3, 0), (3, 1), (4, 2), (4, 1)]
