"""Operator 4: log-likelihood of whole documents under a gated recurrent language model.

The model is a GRU over words, written in numpy and trained by truncated backpropagation: a
window's gradient stops at its first word, the state goes on into the next window. Its output
softmax is factored: the probability of a word's class times that of the word in its class,
so a step costs about two square roots of the vocabulary. Scoring carries the state across
windows through each whole document.

The corpus gives it its statistics: every word of every training document is counted in
Spark. The most frequent ones (``VOCABULARY``) are the model's own words; all others are one
symbol for it, and their share is spread over the words by their counts, add-one smoothed,
so every text has a probability. Weights start from the counted frequencies and are fitted in
rounds over successive parts of the corpus: each partition of the scan trains on its whole
stream of the round's documents (``DEAL_WORDS`` of them at a time are dealt to lanes, long ones
early), and the results are averaged by the words they are from. Every word of every training
document is trained on; a small corpus is read several times.

Scale: words are counted per task before they are shuffled. Training holds ``DEAL_WORDS`` words;
its weights (0.5 MB a partition and round) are added up by ``TRAIN_TASKS`` tasks, so the driver
gets as many rows for any input. Counts of the ``TOP`` most frequent
words are broadcast (a fixed number of rows); the rest are looked up by a join of (document,
word, times) rows, many to one. Texts are not shuffled.

Defined results: a null or empty text is the end token alone; repeated rows count as documents
of their own and get equal scores; a document's own id decides whether it is held out (a null
id trains); without training documents every count is zero; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thali.llm.bpe import slices
from thali.llm.common import cut_lineage, hash_sample, id_and_text, written

CLASSES = 48
VOCABULARY = CLASSES * CLASSES
HIDDEN = 24
TOP = 131_072
#: ``TRAIN_TOKENS`` is the least number of words that a round trains on, ``TRAIN_TASKS`` add up the weights.
TRAIN_TASKS, TRAIN_ROUNDS, TRAIN_TOKENS = 6, 3, 60_000
#: Lanes trained side by side, and the rate that suits so many; a task with few words has fewer lanes, for as many
#: steps (``STEPS``) as it can, at a rate that follows their root.
LANES, WINDOW, RATE, STEPS = 128, 50, 0.03, 60
#: Words that a task holds while it orders their documents.
DEAL_WORDS = 2_000_000
SCORE_LANES, SCORE_WINDOW, SCORE_TOKENS = 512, 32, 2_000_000
#: Rows of a softmax at a time, so that it stays in a core's own memory.
SOFTMAX_ROWS = 1024
#: Rows that are added up side by side, not one stretch after the other.
SHORT = 8
#: Distinct words that a task counts before it hands the counts on.
COUNT_WORDS = 200_000
#: Bytes of texts whose words a task holds at a time.
TEXT_BYTES = 4_000_000
END = ""           # the end token: no word is empty


def trains():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(True))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of the texts, one text after the other, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = split.flatten().cast(pa.binary())
    real = pc.greater(pc.binary_length(words), 0)          # a text that begins or ends with a space: also an empty piece
    ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
    so_far = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return words.filter(real), np.diff(so_far[ends], prepend=0)


def numbered(words: pa.Array, listed: pa.Array) -> np.ndarray:
    """Each word's place in the list, from 1 on; 0 for what is not listed."""
    return pc.fill_null(pc.index_in(words, value_set=listed), -1).to_numpy(zero_copy_only=False) + 1


def by_size(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of texts (its column 1) in pieces of about ``TEXT_BYTES``, as equal ones have as many rows."""
    return slices(batch, max(1, batch.num_rows * TEXT_BYTES // max(1, batch.column(1).nbytes)))


def with_ends(symbols: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of documents of these sizes with an end after each, and where each document now ends."""
    ends = np.cumsum(sizes + 1)
    out, word = np.full(len(symbols) + len(sizes), end, np.int32), np.ones(len(symbols) + len(sizes), bool)
    word[ends - 1] = False
    out[word] = symbols
    return out, ends


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            for rows in by_size(batch):
                words, _ = words_of(rows.column(1))
                counted = words.value_counts()
                held.append(pa.table([pa.concat_arrays([counted.field(0), pa.array([b""], pa.binary())]),
                                      pa.concat_arrays([counted.field(1), pa.array([rows.num_rows], pa.int64())])], names=["word", "n"]))
                if sum(t.num_rows for t in held) > 2 * COUNT_WORDS:
                    held[:] = [merged()]
                    if held[0].num_rows > COUNT_WORDS:
                        yield from held.pop().to_batches()
        if held:
            yield from merged().to_batches()

    return (id_and_text(docs.filter(trains())).mapInArrow(run, "word binary, n long")
            .groupBy(F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n")))


def repeated(documents: Iterable[np.ndarray], tokens: int) -> Iterator[np.ndarray]:
    """The documents; when they have fewer than ``tokens`` words, again until there were so many."""
    held, have = [], 0
    for d in documents:
        yield d
        have += len(d)
        if have < tokens:
            held.append(d)
    while 0 < have < tokens:
        for d in held:
            yield d
            have += len(d)
            if have >= tokens:
                break


def dealt(documents: Iterable[np.ndarray], lanes: int, words: int) -> Iterator[np.ndarray]:
    """The documents, so many words of them at a time in another order: those that are long for a lane's share of the
    words start early, longest first, spread over the first half of the others. Otherwise the last ones would
    keep a few lanes busy alone."""
    rest = iter(documents)
    while True:
        held, have = [], 0
        for d in rest:
            held.append(d)
            have += len(d)
            if have >= words:
                break
        if not held:
            return
        long = sorted((d for d in held if len(d) * lanes > have / 4), key=len, reverse=True)
        others = [d for d in held if len(d) * lanes <= have / 4]
        ahead, share = 0.0, 2 * len(long) / max(1, len(others))
        each = iter(long)
        yield from islice(each, lanes // 2)
        for d in others:
            ahead += share
            if ahead >= 1:
                yield from islice(each, int(ahead))
                ahead %= 1
            yield d
        yield from each


def lane_windows(documents: Iterable[np.ndarray], lanes: int, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(inputs, targets, fresh, real, busy) until every word was a target; the first four are (time, busy lane). A
    document stays in its lane to its end; the lane then takes the next one. Places without a word are not
    ``real``, lanes without one are not ``busy``."""
    rest = iter(documents)
    own: list[tuple[np.ndarray, int] | None] = [None] * lanes
    while True:
        y, begins = np.zeros((lanes, window), dtype=np.int64), []
        filled = np.zeros(lanes, dtype=np.int64)
        for lane in range(lanes):
            at = 0
            while at < window:
                if own[lane] is None:
                    d = next(rest, None)
                    if d is None:
                        break
                    own[lane] = d, 0
                d, p = own[lane]
                m = min(len(d) - p, window - at)
                y[lane, at:at + m] = d[p:p + m]
                begins.append((lane, at, d[p - 1], p == 0))      # before its first word: an end token
                own[lane] = (d, p + m) if p + m < len(d) else None
                at += m
            filled[lane] = at
        busy = np.flatnonzero(filled)
        if not len(busy):
            return
        x, fresh = np.zeros_like(y), np.zeros(y.shape, dtype=bool)
        x[:, 1:] = y[:, :-1]
        lane, at, word, new = map(np.array, zip(*begins))
        x[lane, at], fresh[lane, at] = word, new
        real = np.arange(window) < filled[:, None]
        x[~real] = 0
        yield (*(np.ascontiguousarray(v[busy].T) for v in (x, y, fresh, real)), busy)


class GatedLM:
    """GRU with a class-factored softmax over ``classes * classes`` symbols; symbol 0 stands for all
    words that the model does not know."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights
        self.hidden = weights["Wh"].shape[0]
        self.classes, self.size = weights["bw"].shape
        self.rooms: dict[str, np.ndarray] = {}

    def room(self, name: str, *shape: int) -> np.ndarray:
        """An array for values that the next call may overwrite: memory that every window asked for anew would cost
        as much as the sums in it."""
        size, have = math.prod(shape), self.rooms.get(name)
        if have is None or have.size < size or have.dtype != self.w["Wh"].dtype:
            have = self.rooms[name] = np.empty(size, self.w["Wh"].dtype)
        return have[:size].reshape(shape)

    @staticmethod
    def start(counts: np.ndarray, hidden: int = HIDDEN, classes: int = CLASSES) -> GatedLM:
        """Weights that give each symbol its counted share."""
        rng = np.random.default_rng(4)
        n = classes * classes
        share = np.full(n, 0.5)
        share[:len(counts)] += counts
        share = (share / share.sum()).reshape(classes, classes)
        small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        mass = share.sum(axis=1)
        return GatedLM({
            "emb": small(n, 3 * hidden), "Wh": small(hidden, 3 * hidden),
            "b": np.zeros(3 * hidden, np.float32), "Uc": small(hidden, classes) * 0.1,
            "bc": np.log(mass).astype(np.float32), "Uw": small(classes, hidden, classes) * 0.1,
            "bw": np.log(share / mass[:, None]).astype(np.float32)})

    def steps(self, inputs: np.ndarray, h: np.ndarray, fresh: np.ndarray | None = None, keep: bool = False):
        """States (time, hidden, lane) after each of the inputs (time, lane), the last state (lane, hidden) and what
        the way back needs; ``fresh`` marks where a document starts. A symbol's embedding is its input to the three
        gates. Lanes are the last axis, so that each gate of a step is one contiguous block. All but the last state
        lies in ``room``."""
        w, k, (times, lanes) = self.w, self.hidden, inputs.shape
        sign = np.ones(3 * k, w["Wh"].dtype)
        sign[:2 * k] = -1                                    # exp(-a) is what a sigmoid takes
        emb = np.add(w["emb"], w["b"], out=self.room("emb", *w["emb"].shape))
        emb *= sign
        rows, x = self.room("rows", times, lanes, 3 * k), self.room("x", times, 3 * k, lanes)
        np.take(emb, inputs, axis=0, out=rows, mode="clip")
        np.copyto(x, rows.transpose(0, 2, 1))
        to_gates = np.ascontiguousarray((w["Wh"] * sign).T)
        starts = [False] * len(inputs) if fresh is None else fresh.any(axis=1).tolist()
        states = self.room("states", times, k, lanes)
        before = self.room("before", times, k, lanes) if keep else None
        g = self.room("gates", times if keep else 1, 3 * k, lanes)
        h, spare = np.ascontiguousarray(h.T, x.dtype), self.room("spare", k, lanes)
        for t in range(len(inputs)):
            if starts[t]:
                h = h * ~fresh[t]
            if keep:
                before[t] = h
            own = g[t if keep else 0]
            np.matmul(to_gates, h, out=own)
            gates, n = x[t, :2 * k], x[t, 2 * k:]
            gates += own[:2 * k]
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            np.multiply(gates[k:], own[2 * k:], out=spare)
            n += spare
            np.tanh(n, out=n)
            new = states[t]
            np.subtract(h, n, out=new)
            new *= gates[:k]
            new += n
            h = new
        return states, np.ascontiguousarray(h.T), (before, x, g[:, 2 * k:]) if keep else None

    def with_ones(self, states: np.ndarray, live: np.ndarray) -> np.ndarray:
        """The states (time, hidden, lane) of the ``live`` places as rows, with a one for the biases behind, in ``room``."""
        times, k, lanes = states.shape
        each = self.room("each", times, lanes, k + 1)
        each[..., :k] = states.transpose(0, 2, 1)
        each[..., k] = 1
        return np.take(each.reshape(-1, k + 1), live, axis=0, out=self.room("flat", len(live), k + 1), mode="clip")

    def outputs(self) -> tuple[np.ndarray, np.ndarray]:
        """The softmaxes' weights, a column for each of their outputs, with the biases as the last row."""
        w = self.w
        return np.vstack([w["Uc"], w["bc"]]), np.concatenate([w["Uw"], w["bw"][:, None]], axis=1)

    def by_class(self, y: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order of the targets by class, and each class's (class, begin, end) in it."""
        cls = y // self.size
        order = np.argsort(cls.astype(np.int16), kind="stable")
        cut = np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=self.classes))]).tolist()
        return order, [(c, cut[c], cut[c + 1]) for c in range(self.classes) if cut[c] < cut[c + 1]]

    @staticmethod
    def shifted(logit: np.ndarray, small: bool = False) -> np.ndarray:
        """Logits for ``exp``, in place: shifted by their rows' largest only where single precision could not hold
        their powers. ``small`` ones are known to need no shift."""
        if not small and logit.size and not -60 < logit.min() <= logit.max() < 60:
            logit -= logit.max(axis=1, keepdims=True)
        return logit

    def small_logits(self, states: np.ndarray) -> bool:
        """Whether the weights bound all logits of such states below what ``shifted`` looks for."""
        if not states.size:
            return True
        w, top = self.w, max(float(states.max()), -float(states.min()))
        return all(bool((np.abs(w[u]).sum(axis=-2) * top + np.abs(w[b])).max() < 59) for u, b in (("Uc", "bc"), ("Uw", "bw")))

    @classmethod
    def softmax(cls, logit: np.ndarray, small: bool = False) -> np.ndarray:
        """Softmax of the rows, in place."""
        np.exp(cls.shifted(logit, small), out=logit)
        logit *= (1 / (logit @ np.ones(logit.shape[1], logit.dtype)))[:, None]
        return logit

    def log_probabilities(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log of each target's probability; states (n, hidden), targets (n)."""
        order, parts = self.by_class(targets)
        flat = np.ones((len(order), self.hidden + 1), states.dtype)
        np.take(states, order, axis=0, out=flat[:, :-1])
        out = np.empty(len(order), states.dtype)
        out[order] = self.sorted_log_probabilities(flat, targets[order], parts)
        return out

    def sorted_log_probabilities(self, flat: np.ndarray, targets: np.ndarray, parts: list[tuple[int, int, int]]) -> np.ndarray:
        """Of states with a one behind and targets in the order of ``by_class``."""
        to_class, to_word = self.outputs()
        cls, word = targets // self.size, targets % self.size
        at, small = np.arange(SOFTMAX_ROWS), self.small_logits(flat)
        found, sums = np.empty((2, len(flat)), flat.dtype)

        def logs(weights: np.ndarray, of: np.ndarray, begin: int, end: int) -> None:
            ones = np.ones(weights.shape[1], flat.dtype)
            for a in range(begin, end, SOFTMAX_ROWS):
                b = min(end, a + SOFTMAX_ROWS)
                logit = np.matmul(flat[a:b], weights, out=self.room("logit", b - a, weights.shape[1]))
                found[a:b] += self.shifted(logit, small)[at[:b - a], of[a:b]]
                np.exp(logit, out=logit)
                sums[a:b] *= logit @ ones

        found[:], sums[:] = 0, 1
        logs(to_class, cls, 0, len(flat))
        found -= np.log(sums)
        sums[:] = 1
        for c, a, b in parts:
            logs(to_word[c], word, a, b)
        found -= np.log(sums)
        return found

    def softmax_gradient(self, flat: np.ndarray, y: np.ndarray, parts: list[tuple[int, int, int]]):
        """(sum of the losses, gradients at the states, gradients at the weights and biases of both softmaxes) for
        states with a one behind and targets in the order of ``by_class``. Powers of the logits are not divided by
        their sums: the product that takes them back to the states gives these too, and fewer numbers take them."""
        w, k, n = self.w, self.hidden, len(y)
        to_class, to_word = self.outputs()
        small, at = self.small_logits(flat), np.arange(n)
        power, back = self.room("power", n, self.size), self.room("back", n, k)
        ahead, scaled = self.room("ahead", n, k + 1), self.room("scaled", n, k + 1)
        likely, back[:] = np.ones(n, flat.dtype), 0
        ones = np.ones((self.size, 1), flat.dtype)

        def forth(weights: np.ndarray, a: int, b: int) -> None:
            to_states = np.concatenate([weights[:-1].T, ones], axis=1)
            for a in range(a, b, SOFTMAX_ROWS):
                to = min(b, a + SOFTMAX_ROWS)
                some = np.matmul(flat[a:to], weights, out=power[a:to])
                np.exp(self.shifted(some, small), out=some)
                np.matmul(some, to_states, out=ahead[a:to])

        def settle(of: np.ndarray, rows: np.ndarray) -> None:
            chosen, sums = power[at, of], ahead[:, k]
            power[at, of] = chosen - sums
            np.multiply(likely, chosen / sums, out=likely)
            share = (1 / (sums * n))[:, None]
            np.multiply(flat, share, out=scaled)
            np.multiply(ahead, share, out=ahead)
            np.add(back, ahead[:, :k], out=back)
            np.take(rows, y if of is word else cls, axis=0, out=scaled_rows, mode="clip")
            np.subtract(back, scaled_rows, out=back)

        cls, word, scaled_rows = y // self.size, y % self.size, self.room("own", n, k)
        forth(to_class, 0, n)
        settle(cls, np.ascontiguousarray(w["Uc"].T) / n)
        of_class = scaled.T @ power
        for c, a, b in parts:
            forth(to_word[c], a, b)
        settle(word, np.ascontiguousarray(w["Uw"].transpose(0, 2, 1)).reshape(-1, k) / n)
        of_word = np.zeros_like(to_word)
        for c, a, b in parts:
            np.matmul(scaled[a:b].T, power[a:b], out=of_word[c])
        return -np.log(likely + 1e-20).sum(), back, {
            "Uc": of_class[:k], "bc": of_class[k], "Uw": np.ascontiguousarray(of_word[:, :k]), "bw": np.ascontiguousarray(of_word[:, k])}

    @staticmethod
    def sums_of_equal(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Sums of the stretches of ``rows`` that begin at ``first``; short ones are added up side by side."""
        size = np.diff(np.append(first, len(rows)))
        sums = rows[first]
        few = np.flatnonzero((size > 1) & (size <= SHORT))
        for j in range(1, SHORT):
            few = few[size[few] > j]
            sums[few] += rows[first[few] + j]
        ones = np.ones(len(rows), rows.dtype)
        for i in np.flatnonzero(size > SHORT).tolist():
            a, b = first[i], first[i] + size[i]
            np.matmul(ones[a:b], rows[a:b], out=sums[i])
        return sums

    def gradient(self, inputs, targets, h, fresh, real=None, whole=True):
        """(loss, gradients, last state) of one window: truncated backpropagation. Places that are not
        ``real`` hold no word and count for nothing. Not ``whole``: that of the embeddings has rows for the
        distinct inputs only, in their order."""
        w, k, (times, lanes) = self.w, self.hidden, inputs.shape
        states, last, (before, x, gn) = self.steps(inputs, h, fresh, keep=True)
        live = np.arange(inputs.size) if real is None else np.flatnonzero(real)
        y = targets.ravel()[live]
        order, parts = self.by_class(y)
        live, y = live[order], y[order]
        loss, back, g = self.softmax_gradient(self.with_ones(states, live), y, parts)
        places = self.room("places", inputs.size, k)
        if len(live) < len(places):
            places[:] = 0
        places[live] = back
        d = self.room("d", times, k, lanes)
        np.copyto(d, places.reshape(times, lanes, k).transpose(0, 2, 1))
        rows = self.room("rows", times, lanes, 3 * k)
        starts = fresh.any(axis=1).tolist()
        # of a step: gradients at its gates z, r and n, through the input, where r does not count, and through the state
        f, to_n, rest = self.room("f", 3, k, lanes), self.room("to_n", k, lanes), self.room("rest", k, lanes)
        of_gates, carry, g["Wh"] = f.reshape(3 * k, lanes), self.room("carry", k, lanes), np.zeros_like(w["Wh"])
        carry[:] = 0
        for t in range(times - 1, -1, -1):
            own, z, r, m = d[t], x[t, :k], x[t, k:2 * k], x[t, 2 * k:]
            own += carry
            np.subtract(1, z, out=rest)
            rest *= own
            np.subtract(before[t], m, out=f[0])
            f[0] *= z
            f[0] *= rest
            np.multiply(m, m, out=to_n)
            np.subtract(1, to_n, out=to_n)
            to_n *= rest
            np.multiply(to_n, r, out=f[2])
            np.subtract(1, r, out=f[1])
            f[1] *= gn[t]
            f[1] *= f[2]
            np.matmul(w["Wh"], of_gates, out=carry)
            own *= z
            carry += own
            if starts[t]:
                carry *= ~fresh[t]
            g["Wh"] += before[t] @ of_gates.T
            f[2] = to_n
            rows[t] = of_gates.T
        symbols = inputs.ravel()
        order = np.argsort(symbols.astype(np.int16) if len(w["emb"]) < 1 << 15 else symbols, kind="stable")
        sorted_rows = np.take(rows.reshape(-1, 3 * k), order, axis=0, out=self.room("sorted", len(order), 3 * k), mode="clip")
        first = np.flatnonzero(np.concatenate([[True], np.diff(symbols[order]) != 0]))
        sums = self.sums_of_equal(sorted_rows, first)
        g["b"] = sums.sum(axis=0)
        if whole:
            g["emb"] = np.zeros_like(w["emb"])
            g["emb"][symbols[order[first]]] = sums
        else:
            g["emb"] = sums
        return loss / len(y), g, last

    def train(self, documents: Iterable[np.ndarray], tokens: int, lanes: int = LANES, window: int = WINDOW,
              rate: float = RATE) -> float:
        """Adam over all words of the documents, which are read again until there were at least ``tokens``
        words; the mean loss. A window that is short of words moves the weights by that much less. Embeddings
        are updated in the rows that a window holds (their moments rest between)."""
        if tokens:
            few = min(lanes, max(8, tokens // (window * STEPS)))
            lanes, rate = few, rate * math.sqrt(few / lanes)
        stream = dealt(repeated(documents, tokens), lanes, DEAL_WORDS)
        head = list(islice(stream, lanes))                       # fewer documents than lanes: as many lanes
        lanes = max(1, len(head))
        h = np.zeros((lanes, self.hidden), np.float32)
        first = {n: np.zeros_like(v) for n, v in self.w.items()}
        second = {n: np.zeros_like(v) for n, v in self.w.items()}
        losses = []
        for step, (x, y, fresh, real, busy) in enumerate(lane_windows(chain(head, stream), lanes, window), 1):
            loss, g, h[busy] = self.gradient(x, y, h[busy], fresh, real, False)
            losses.append(loss)
            pace = rate * real.sum() / (window * lanes)
            rows = np.flatnonzero(np.bincount(x.ravel()))
            scale = min(1.0, 1.0 / (math.sqrt(sum(float(np.vdot(v, v)) for v in g.values())) + 1e-9))
            root = math.sqrt(1 - 0.99 ** step)
            for n, v in g.items():
                one, two = (first[n], second[n]) if n != "emb" else (first[n][rows], second[n][rows])
                change = self.room("change", *v.shape)
                one *= 0.9
                one += np.multiply(v, 0.1 * scale, out=change)
                two *= 0.99
                change *= change                                 # 0.01 of the square
                two += change
                np.sqrt(two, out=change)
                change += 1e-8 * root
                np.divide(one, change, out=change)
                change *= pace * root / (1 - 0.9 ** step)
                if n == "emb":
                    first[n][rows], second[n][rows] = one, two
                    self.w[n][rows] -= change
                else:
                    self.w[n] -= change
        return float(np.mean(losses)) if losses else 0.0

    def score(self, documents: list[np.ndarray], lanes: int = SCORE_LANES, window: int = SCORE_WINDOW) -> np.ndarray:
        """log10 probability of each whole document; the state goes on from window to window."""
        out = np.zeros(len(documents))
        order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
        for at in range(0, len(order), lanes):
            some = order[at:at + lanes]
            sizes = np.array([len(documents[i]) for i in some])
            h = np.zeros((len(some), self.hidden), np.float32)
            total = np.zeros(len(some))
            last = np.zeros(len(some), dtype=np.int64)
            for p, i in enumerate(some):
                last[p] = documents[i][-1]                        # before its first word: an end token
            for t in range(0, int(sizes[0]), window):
                live = int((sizes > t).sum())                     # longest first: a prefix is still going on
                width = min(window, int(sizes[0]) - t)
                y = np.zeros((live, width), dtype=np.int64)
                mask = np.arange(t, t + width)[None, :] < sizes[:live, None]
                for p in range(live):
                    part = documents[some[p]][t:t + width]
                    y[p, :len(part)] = part
                x = np.concatenate([last[:live, None], y[:, :-1]], axis=1)
                states, new, _ = self.steps(x.T, h[:live])
                h[:live], last[:live] = new, y[:, -1]
                keep = np.flatnonzero(mask.T)
                targets = y.T.ravel()[keep]
                sort, parts = self.by_class(targets)
                keep = keep[sort]
                logs = np.zeros(mask.size)
                logs[keep] = self.sorted_log_probabilities(self.with_ones(states, keep), targets[sort], parts)
                total[:live] += logs.reshape(width, live).sum(axis=0)
            out[some] = total / math.log(10)
        return out


def most_frequent(counts: DataFrame, top: int) -> DataFrame:
    """The words counted at least so often that no more than ``top`` words are. The bound comes from a
    histogram of a few thousand steps (exact below 4096), so nothing is sorted."""
    step = F.when(F.col("n") < 4096, F.col("n")).otherwise(4096 + F.floor(64 * F.log2("n"))).cast("long")
    rows = sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True)
    least, have = None, 0
    for at, words in rows:
        have += words
        if have > top:
            break
        least = at
    return counts.filter(step >= least) if least is not None else counts.limit(0)


def fit(docs: DataFrame, symbols: dict[bytes, int], counts: np.ndarray, train_docs: int | None, tasks: int, rounds: int,
        tokens: int) -> GatedLM:
    """The model, from every training document (``train_docs``: from so many, for trials), in rounds of
    averaged local training over successive parts of them."""
    sc = docs.sparkSession.sparkContext
    model = GatedLM.start(counts)
    rows = id_and_text(docs.filter(trains()))
    if train_docs is not None:
        ids = rows.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id")).distinct()
        ids = hash_sample(ids, train_docs, ids.count())
        rows = cut_lineage(rows.join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("doc_id", "text"))
    part = F.pmod(F.xxhash64("doc_id", "text", F.lit(4)), F.lit(rounds))
    # how often a round reads its part: in a corpus of at least rounds x tokens words, once
    passes = math.ceil(tokens * rounds / max(1, int(counts.sum())))
    for k in range(rounds):
        sent = sc.broadcast((model.w, symbols))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            weights, known = sent.value
            listed = pa.array(sorted(known, key=known.get), pa.binary())
            own = GatedLM({n: v.copy() for n, v in weights.items()})
            words = 0

            def stream() -> Iterator[np.ndarray]:
                nonlocal words
                for batch in batches:
                    for some in by_size(batch):
                        found, sizes = words_of(some.column(1))
                        read, ends = with_ends(numbered(found, listed), sizes, known[b""])
                        words += len(read)
                        yield from np.split(read, ends[:-1])

            if passes > 1:                     # few words altogether
                held = list(stream())
                own.train(held, passes * words)
            else:
                own.train(stream(), 0)
            if words:
                at = TaskContext.get().partitionId()
                for name, v in own.w.items():
                    yield pa.record_batch([pa.array([at], pa.int64()), pa.array([name]), pa.array([float(words)]),
                                           pa.array([(v * np.float64(words)).astype(np.float64).tobytes()], pa.binary())],
                                          names=["at", "name", "words", "value"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first, total = 0, {}
            for batch in batches:
                for at, name, words, value in zip(*(batch.column(c).to_pylist() for c in range(4))):
                    first = first if total else at
                    n, v = total.get(name, (0.0, 0.0))
                    total[name] = n + words, v + np.frombuffer(value, np.float64)
            for name, (n, v) in total.items():
                yield pa.record_batch([pa.array([first], pa.int64()), pa.array([name]), pa.array([n]),
                                       pa.array([v.tobytes()], pa.binary())], names=["at", "name", "words", "value"])

        schema = "at long, name string, words double, value binary"
        # sorted, so that the sums are the same in every run
        sums = (rows.filter(part == k).mapInArrow(run, schema).repartition(tasks, F.pmod("at", F.lit(tasks)))
                .sortWithinPartitions("at", "name").mapInArrow(add, schema)).collect()      # tasks x weights
        if sums:
            total: dict[str, list] = {}
            for r in sorted(sums, key=lambda r: (r["at"], r["name"])):
                n, v = total.get(r["name"], (0.0, 0.0))
                total[r["name"]] = n + r["words"], v + np.frombuffer(r["value"], np.float64)
            model = GatedLM({name: (v / n).astype(np.float32).reshape(model.w[name].shape) for name, (n, v) in total.items()})
    return model


def score_documents(docs: DataFrame, top: int = TOP, train_docs: int | None = None, tasks: int = TRAIN_TASKS,
                    rounds: int = TRAIN_ROUNDS, tokens: int = TRAIN_TOKENS) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``."""
    spark = docs.sparkSession
    counts = cut_lineage(word_counts(docs))
    n_all, n_words = (int(x or 0) for x in counts.agg(F.sum("n"), F.count(F.lit(1))).first())
    frequent = sorted(most_frequent(counts, top).collect(), key=lambda r: (-r.n, r.word))      # at most ``top`` rows
    own = [(END, 0), *((r.word, r.n) for r in frequent if r.word != END)][:VOCABULARY - 1]
    end_count = next((r.n for r in frequent if r.word == END), 0) or int(
        (counts.filter(F.col("word") == END).agg(F.sum("n")).first()[0]) or 0)
    own[0] = (END, end_count)
    symbols = {w.encode(): i for i, (w, _) in enumerate(own, 1)}
    known_tokens = sum(n for _, n in own)
    other_tokens, other_words = n_all - known_tokens, max(0, n_words - sum(1 for _, n in own if n))
    model = fit(docs, symbols, np.array([other_tokens, *(n for _, n in own)]), train_docs, tasks, rounds, tokens)
    # every listed word's place: the model's own words first, then the other frequent ones
    places = dict(symbols)
    logs = [0.0, *(math.log10(n + 1) for _, n in own)]
    for r in frequent:
        if places.setdefault(r.word.encode(), len(logs)) == len(logs):
            logs.append(math.log10(r.n + 1))
    sent = spark.sparkContext.broadcast((model.w, pa.array(places, pa.binary()), np.array(logs), len(symbols), end_count > 0))
    rows = id_and_text(docs).withColumn("row", F.xxhash64("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, listed, logs, n_own, end_known = sent.value
        lm = GatedLM(weights)
        names = ["doc_id", "row", "n_tokens", "n_listed", "listed", "n_other", "spread", "rare", "model"]
        held: list[tuple[pa.Array, ...]] = []
        ids: list[np.ndarray] = []
        size = 0

        def scored() -> pa.RecordBatch:
            columns = [*map(pa.concat_arrays, zip(*held)), pa.array(lm.score(ids))]
            held.clear()
            ids.clear()
            return pa.record_batch(columns, names=names)

        for batch in batches:
            for part in by_size(batch):
                words, sizes = words_of(part.column(1))
                place = numbered(words, listed)
                unlisted = np.flatnonzero(place == 0)
                rare = words.take(pa.array(unlisted)).dictionary_encode()
                place, ends = with_ends(place, sizes, 1)         # the end is the first one listed
                begins, log, other = ends - sizes - 1, logs[place], place > n_own
                own = np.where(other, 0, place)
                sums = lambda v, kind: pa.array(np.add.reduceat(v, begins, dtype=kind))
                # unlisted words once a document
                kinds = max(1, len(rare.dictionary))
                pair, times = np.unique(np.repeat(np.arange(len(sizes)), sizes)[unlisted] * kinds + rare.indices.to_numpy(),
                                        return_counts=True)
                of, word = np.divmod(pair, kinds)
                rare = pa.StructArray.from_arrays([rare.dictionary.take(pa.array(word)), pa.array(times, pa.int32())],
                                                  names=["word", "times"])
                upto = np.searchsorted(of, np.arange(len(sizes) + 1))
                held.append((part.column(0), part.column(2), pa.array(sizes + 1),
                             pa.array(np.add.reduceat(place > 0, begins, dtype=np.int64) - (not end_known)), sums(log, np.float64),
                             sums(own == 0, np.int64), sums(np.where(other, log, 0.0), np.float64),
                             pa.ListArray.from_arrays(pa.array(upto, pa.int32()), rare)))
                ids += np.split(own, ends[:-1])
                size += len(own)
                if size >= SCORE_TOKENS:           # many documents at once: their lanes stay full for longer
                    yield scored()
                    size = 0
        if held:
            yield scored()

    # written, as it is read twice: texts are cut into words once for the scores and the unlisted words
    scored, _ = written(rows.mapInArrow(
        run, "doc_id long, row long, n_tokens long, n_listed long, listed double, n_other long, spread double, "
             "rare array<struct<word: binary, times: int>>, model double"))
    unlisted = scored.select("row", F.explode("rare").alias("x")).select(
        "row", F.col("x.word").cast("string").alias("word"), F.col("x.times").alias("times"))
    looked = unlisted.join(counts, "word").groupBy("row").agg(
        F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare"))
    # repeated rows have one key, so their sums hold each of them
    copies = F.count(F.lit(1)).over(Window.partitionBy("row"))
    rare_sum = F.coalesce(F.col("rare") / F.col("copies"), F.lit(0.0))
    base = F.lit(math.log10(n_all + n_words + 1))
    other = F.lit(math.log10(other_tokens + other_words + 1))
    return scored.drop("rare").withColumn("copies", copies).join(looked, "row", "left").select(
        "doc_id", "n_tokens",
        (F.col("n_listed") + F.coalesce(F.col("n_rare") / F.col("copies"), F.lit(0.0)).cast("long")).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("listed") + rare_sum - F.col("n_tokens") * base).alias("base_score"),
        (F.col("model") + F.col("spread") + rare_sum - F.col("n_other") * other).alias("score"))
