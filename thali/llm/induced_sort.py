"""External induced sorting of the suffixes of one shard, with common-prefix values.

The suffixes that begin an ascending run right after a descending step ("S*") are sorted
first, by naming the pieces between them and recursing into the string of names; then two
scans induce the order of all others. A scan pops suffix tuples in ascending (descending)
order from priority queues and pushes the suffix that starts one character earlier. Its
priority is its first character and then the order of pushing, so a queue per character,
first in first out, is a priority queue; queues beyond the memory budget go to disk. Tuples
carry the common prefix with the tuple before: a pushed one has 1 + the least of all values
popped since the last push to the same queue. Work is done on whole runs of a queue at once.

Values are capped at ``depth`` and kept for strings of bytes only (names need just the order); suffixes that agree in ``depth`` characters may be in any order.
"""

from __future__ import annotations

import os
import shutil
import tempfile

import numpy as np

#: Reduced strings up to this length are sorted by prefix doubling in memory.
BASE_ITEMS = 1 << 21
#: Tuples that the queues hold in memory altogether.
QUEUE_ITEMS = 1 << 22


class Queues:
    """A first-in-first-out queue of (position, common prefix) per character; whatever exceeds the
    budget is written to files of a scratch folder, which ``close`` removes."""

    def __init__(self, budget: int):
        self.budget, self.held, self.folder, self.files = budget, 0, None, 0
        self.queues: dict[int, list] = {}

    def push(self, char: int, positions: np.ndarray, prefixes: np.ndarray) -> None:
        queue = self.queues.setdefault(char, [])
        if self.held + len(positions) > self.budget:
            self.folder = self.folder or tempfile.mkdtemp(prefix="induced-")
            path = os.path.join(self.folder, f"{self.files}.npz")
            self.files += 1
            np.savez(path, positions=positions, prefixes=prefixes)
            queue.append(path)
        else:
            self.held += len(positions)
            queue.append((positions, prefixes))

    def pop(self, char: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The next run of the queue, or None."""
        queue = self.queues.get(char)
        if not queue:
            return None
        run = queue.pop(0)
        if isinstance(run, str):
            with np.load(run) as f:
                out = f["positions"], f["prefixes"]
            os.remove(run)
            return out
        self.held -= len(run[0])
        return run

    def close(self) -> None:
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it (S), False where it is greater (L)."""
    n = len(text)
    ends = np.flatnonzero(np.append(text[1:] != text[:-1], True))           # last place of each run
    ascending = np.zeros(len(ends), dtype=bool)
    inner = ends[:-1]
    ascending[:-1] = text[inner] < text[inner + 1]                          # the end of the text is smallest
    return np.repeat(ascending, np.diff(np.concatenate([[-1], ends])))[:n]


def run_lengths(text: np.ndarray) -> np.ndarray:
    """How often the character at each place repeats from there on."""
    ends = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    return (np.repeat(ends, np.diff(np.concatenate([[-1], ends]))) - np.arange(len(text)) + 1).astype(np.int32)


def names(text: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """Ranks of the pieces from each S* place through the next one; equal pieces share a rank."""
    n, m = len(text), len(stars)
    length = np.append(stars[1:], n) - stars + 1        # through the next S* character, or the end of the text
    bits = int(int(text.max()) + 2).bit_length()        # text + 1, 0 for its end, the greatest for "no more"
    beyond = (1 << bits) - 1
    step = max(1, (62 - m.bit_length()) // bits)        # characters that fit behind a rank
    padded = np.concatenate([text.astype(np.int32) + 1, np.zeros(1, np.int32)])
    rank = np.zeros(m, dtype=np.int64)
    open_ = np.arange(m)
    at = 0
    while len(open_):
        p, left = stars[open_] + at, length[open_] - at
        old = rank[open_]
        key = old.copy()
        for k in range(step):
            key = key << bits | np.where(left > k, padded[np.minimum(p + k, n)], beyond)
        order = np.argsort(key, kind="stable")
        key, old = key[order], old[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(first, len(key)))
        # ranks are places in the whole order: a group starts where its old group does, plus those before it
        start = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
        begin = np.repeat(start, np.diff(np.append(start, len(key))))
        rank[open_[order]] = np.repeat(old[first] + first - begin[first], size)
        at += step
        more = np.logical_or.reduceat(left[order] > step, first) & (size > 1)
        open_ = open_[order][np.repeat(more, size)]
    return np.unique(rank, return_inverse=True)[1]


def doubled(symbols: np.ndarray, enough: int) -> np.ndarray:
    """Suffix order of a string of small numbers by prefix doubling, to ``enough`` symbols at least."""
    n = len(symbols)
    rank, width = symbols.astype(np.int64), 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[:max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        width *= 2
        if width >= enough or new[-1] == n - 1:
            return order


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the one before it, up to ``depth``."""
    out = np.zeros(len(order), dtype=np.int32)
    padded = np.concatenate([text, np.zeros(8, text.dtype)]).astype(np.uint8)
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    a, b, at = order[:-1].copy(), order[1:].copy(), 0
    live = np.arange(1, len(order))
    n = len(text)
    while len(live) and at < depth:
        x = words[np.minimum(a, n)].copy().view(">u8").ravel()
        y = words[np.minimum(b, n)].copy().view(">u8").ravel()
        same = (x == y)
        if not same.all():
            off = np.flatnonzero(~same)
            diff = (x[off] ^ y[off]).astype(np.uint64)
            lead = 7 - np.minimum(np.floor(np.log2(diff.astype(np.float64))).astype(np.int64), 63) // 8
            out[live[off]] = at + lead
        live, a, b = live[same], a[same] + 8, b[same] + 8
        at += 8
        out[live] = at
    limit = n - np.maximum(order[:-1], order[1:])       # a suffix ends where the text does
    out[1:] = np.minimum(np.minimum(out[1:], limit), depth)
    return out


def _scan(text, types, runs, seeds, chars, budget, depth, ascending, with_prefixes):
    """One inducing scan. seeds: per character the sorted tuples that are given (S* in the first scan, L in
    the second); returns per character the induced tuples in the order of popping, with common prefixes."""
    queues = Queues(budget)
    # per character: whether anything was pushed, and the least value popped since the last push
    size = 256 if with_prefixes else 0
    pushed, carry = np.zeros(size, dtype=bool), np.full(size, depth, dtype=np.int32)
    out: dict[int, list] = {}

    def induce(positions: np.ndarray, prefixes: np.ndarray) -> None:
        before = positions - 1
        safe = np.maximum(before, 0)
        ok = (~types[safe] if ascending else types[safe]) & (before >= 0)
        idx = np.flatnonzero(ok)
        least = np.full(size, prefixes.min(), dtype=np.int32) if with_prefixes else None
        old = np.minimum(carry, least) if with_prefixes else carry
        if len(idx):
            target = text[safe[idx]]
            by = np.argsort(target, kind="stable")
            target = target[by]
            cut = [0, *(np.flatnonzero(target[1:] != target[:-1]) + 1).tolist(), len(by)]
            for lo, hi in zip(cut, cut[1:]):
                c, at = int(target[lo]), idx[by[lo:hi]]
                if not with_prefixes:
                    queues.push(c, before[at], prefixes[at])
                    continue
                # the least value between consecutive pushes: over (at[k - 1], at[k]]
                value = np.minimum.reduceat(prefixes[:at[-1] + 1], np.concatenate([[0], at[:-1] + 1]))
                value[0] = min(value[0], carry[c])
                value = np.minimum(value + 1, depth)
                if not pushed[c]:
                    value[0], pushed[c] = 0, True
                rest = prefixes[at[-1] + 1:]
                old[c] = rest.min() if len(rest) else depth
                queues.push(c, before[at], value)
        carry[:] = old

    try:
        if ascending and len(text):                      # the end of the text, smallest of all, comes first
            last = len(text) - 1
            if not types[last]:
                queues.push(int(text[last]), np.array([last], dtype=next(iter(seeds.values()))[0].dtype if seeds else np.int64), np.array([0], dtype=np.int32))
                if with_prefixes:
                    pushed[text[last]], carry[text[last]] = True, 0
        for c in chars if ascending else reversed(chars):
            parts = []
            while (run := queues.pop(c)) is not None:    # runs of its own character are pushed meanwhile
                positions, prefixes = run
                if not parts:
                    prefixes = prefixes.copy()
                    prefixes[0] = 0
                parts.append((positions, prefixes))
                induce(positions, prefixes)
            if parts:
                out[c] = (np.concatenate([p for p, _ in parts]), np.concatenate([x for _, x in parts]))
            if c in seeds:
                positions, prefixes = seeds[c]
                prefixes = prefixes.copy()
                # an L and an S suffix of one character agree in the shorter of their runs of it
                prefixes[0] = min(int(runs[parts[-1][0][-1]]), int(runs[positions[0]]), depth) if parts else 0
                induce(positions, prefixes)
    finally:
        queues.close()
    return out


def sort_suffixes(text: np.ndarray, depth: int, base_items: int = BASE_ITEMS, queue_items: int = QUEUE_ITEMS,
                  with_prefixes: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(places of the suffixes in order, common prefix of each with the one before, up to ``depth``)."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    assert not with_prefixes or text.dtype == np.uint8, "prefixes are carried over bytes"
    place = np.int32 if n < 2**31 - 8 else np.int64
    types = suffix_types(text)
    runs = run_lengths(text)
    stars = (np.flatnonzero(types[1:] & ~types[:-1]) + 1).astype(place)
    chars = np.unique(text).tolist()
    seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    if len(stars):
        reduced = names(text, stars)
        if len(stars) <= base_items:
            order = doubled(reduced, depth // 2 + 2)
        elif reduced.max() == len(stars) - 1:            # all names differ
            order = np.argsort(reduced)
        else:
            order, _ = sort_suffixes(reduced, depth // 2 + 2, base_items, queue_items, with_prefixes=False)
        star_order = stars[order]
        prefixes = (common_prefixes(text, star_order, depth) if with_prefixes
                    else np.zeros(len(stars), dtype=np.int32))
        seeds = _by_character(text, star_order, prefixes)
    lower = _scan(text, types, runs, seeds, chars, queue_items, depth, True, with_prefixes)
    # the second scan runs downwards: reversed order, values between the same neighbours
    upper = _scan(text, types, runs, {c: _reversed(*x) for c, x in lower.items()}, chars, queue_items, depth, False,
                  with_prefixes)
    order, prefix = [], []
    for c in chars:
        below = lower.get(c)
        above = _reversed(*upper[c]) if c in upper else None
        if below is not None:
            order.append(below[0])
            prefix.append(below[1])
        if above is not None:
            value = above[1].copy()
            if below is not None:
                value[0] = min(int(runs[below[0][-1]]), int(runs[above[0][0]]), depth)
            order.append(above[0])
            prefix.append(value)
    return np.concatenate(order), np.concatenate(prefix)


def _by_character(text, positions, prefixes):
    c = text[positions]
    cut = np.concatenate([[0], np.flatnonzero(c[1:] != c[:-1]) + 1, [len(c)]])
    out = {}
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        value = prefixes[a:b].copy()
        value[0] = 0
        out[int(c[a])] = (positions[a:b], value)
    return out


def _reversed(positions, prefixes):
    """The same tuples in the opposite order: each value moves to the later of its two neighbours."""
    value = np.zeros_like(prefixes)
    value[1:] = prefixes[:0:-1]
    return positions[::-1].copy(), value
