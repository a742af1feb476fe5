"""Operator 13: vector code compression with memoised grid cells.

Vectors become integers, floor(scale * x), and are cut into equal consecutive parts. Each part position
has a codebook; a part's code is its nearest entry (squared Euclidean distance, ties to the lower index).
Codebooks start from the vectors of the smallest ids and are fitted in rounds: assign, then replace each
entry by its parts' componentwise floor(sum / count); an unused entry stays. All of it is exact integer
arithmetic, so the result does not depend on how the rows are dealt.

Nearest entries are found by grid cells: a part's coarse cell (its components shifted right) is hashed and
looked up in a memo. An entry is dominated in a cell when its least distance to the cell's box is more
than the least of all entries' greatest distances; the memo keeps the others, and only those are evaluated
exactly. An entry that may tie is never dominated. The cell's width follows the codebook (about a quarter
of the distance between neighbouring entries); it changes the work, never the result.

Scale: a round is one scan with one row per part, entry and component leaving each task; the driver gets one
codebook (parts x entries x width numbers). Rows are not shuffled to be assigned. Memo and batches are
bounded. The errors per label are summed with partial aggregation and joined back; the sums are broadcast
when there are at most ``SMALL_LABELS`` labels, else joined by shuffle, where the skew join splits a hot label
(one sum on the other side).

Defined results: rows whose vector is null, empty, holds a null or non-finite component, or has another
length than the vector of the smallest id take no part; rows without an id are coded but start no codebook;
of rows with one id the least vector starts it; fewer ids than entries give smaller codebooks; repeated rows
count each time; null labels are one label; an empty table gives no rows; extra columns are ignored. A
length that the parts do not divide, or components whose squared distances exceed 64 bits, raise ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thali.llm.common import cut_lineage
from thali.session import ship_package

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
SMALL_LABELS = 100_000
#: Rows assigned at a time, and cells remembered per part position in a task.
BATCH_ROWS, MEMO_CELLS = 8192, 1 << 14


def integers(flat: np.ndarray, dimension: int, scale: int = SCALE) -> np.ndarray:
    """Rows of floor(scale * x); too large components are refused."""
    x = np.floor(scale * flat.astype(np.float64)).reshape(-1, dimension)
    limit = float(np.sqrt(2.0 ** 63 / dimension) / 2 - 1)
    if len(x) and np.abs(x).max() > limit:
        raise ValueError(f"a vector's component is beyond {limit / scale:.0f}: its squared distances exceed 64 bits")
    return x.astype(np.int64)


class Cells:
    """One part position's codebook with a memo of the entries that matter in each grid cell."""

    def __init__(self, entries: np.ndarray, memo_cells: int = MEMO_CELLS, shift: int | None = None):
        self.entries, self.limit = entries, memo_cells
        if shift is None:
            apart = ((entries[:, None] - entries[None]).astype(np.float64) ** 2).sum(axis=2)
            apart[np.arange(len(entries)), np.arange(len(entries))] = np.inf
            nearest = np.sqrt(apart.min(axis=1))
            gap = nearest[np.isfinite(nearest)].mean() / 4 if len(entries) > 1 else 1.0
            shift = max(0, int(np.floor(np.log2(max(gap, 1.0)))))
        self.shift = shift
        self.memo: dict[bytes, int] = {}
        self.kept = np.zeros((0, len(entries)), dtype=bool)
        self.multipliers = np.random.default_rng(13).integers(0, 1 << 63, entries.shape[1], dtype=np.int64) * 2 + 1

    def undominated(self, cells: np.ndarray) -> np.ndarray:
        """Per cell the entries that are nearest somewhere in its box, as far as the bounds tell."""
        low = (cells << self.shift)[:, None]
        high = low + ((1 << self.shift) - 1)
        e = self.entries[None]
        least = (np.maximum(np.maximum(low - e, e - high), 0) ** 2).sum(axis=2)
        greatest = (np.maximum(e - low, high - e) ** 2).sum(axis=2)
        return least <= greatest.min(axis=1)[:, None]

    def candidates(self, parts: np.ndarray) -> np.ndarray:
        """Entries to be evaluated for each part, from the memo where its cell is known."""
        cells = np.ascontiguousarray(parts >> self.shift)
        _, some, which = np.unique((cells * self.multipliers).sum(axis=1), return_index=True, return_inverse=True)
        if not (cells == cells[some][which]).all():          # two cells share a hash
            _, some, which = np.unique(cells, axis=0, return_index=True, return_inverse=True)
            which = which.ravel()
        distinct = cells[some]
        keys = [c.tobytes() for c in distinct]
        if len(self.memo) + len(keys) > self.limit:
            self.memo, self.kept = {}, self.kept[:0]
        at = np.array([self.memo.get(k, -1) for k in keys], dtype=np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = np.arange(len(self.kept), len(self.kept) + len(new))
            self.kept = np.concatenate([self.kept, self.undominated(distinct[new])])
            self.memo.update(zip((keys[i] for i in new.tolist()), at[new].tolist()))
        return self.kept[at[which]]

    def assign(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each part's nearest entry."""
        row, entry = np.nonzero(self.candidates(parts))
        if not len(row):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        distance = ((parts[row] - self.entries[entry]) ** 2).sum(axis=1)
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        least = np.minimum.reduceat(distance, first)
        near = np.flatnonzero(distance == least[row])                  # by row, then by entry
        near = near[np.concatenate([[True], row[near][1:] != row[near][:-1]])]
        return entry[near], least


def _valid(df: DataFrame, id_col: str, vector_col: str, extra: list[Column]) -> DataFrame:
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return df.select(F.col(id_col).alias("id"), vector.alias("vector"), *extra).filter(
        F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)


def _vectors(column: pa.Array, dimension: int, scale: int) -> np.ndarray:
    return integers(column.flatten().to_numpy(zero_copy_only=False), dimension, scale)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ``BATCH_ROWS`` rows, whatever size they come in."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            held.append(batch.slice(at, BATCH_ROWS))
            if sum(b.num_rows for b in held) >= BATCH_ROWS:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def first_vectors(rows: DataFrame, entries: int) -> list[list[float]]:
    """Vectors of the smallest ids, in order; each task passes on its smallest ids only."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            some = np.arange(len(ids)) if len(least) < entries else np.flatnonzero(ids <= max(least))
            for i in some.tolist():
                key, vector = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if key not in least or vector < least[key]:
                    least[key] = vector
                    if len(least) > entries:
                        del least[max(least)]
        ids = sorted(least)
        yield pa.record_batch([pa.array(ids, pa_type), pa.array([least[i] for i in ids], pa.list_(pa.float64()))],
                              names=["id", "vector"])

    from pyspark.sql.pandas.types import to_arrow_type

    pa_type = to_arrow_type(rows.schema["id"].dataType)
    some = rows.filter(F.col("id").isNotNull()).select("id", "vector").mapInArrow(run, f"id {kind}, vector array<double>")
    return [r.vector for r in some.groupBy("id").agg(F.min("vector").alias("vector")).orderBy("id").limit(entries).collect()]


def fitted(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
           scale: int = SCALE) -> np.ndarray | None:
    """Codebooks as an array (part, entry, component); None without rows that have an id."""
    starts = first_vectors(rows, entries)
    if not starts:
        return None
    dimension = len(starts[0])
    if dimension % parts:
        raise ValueError(f"vectors of {dimension} components cannot be cut into {parts} equal parts")
    width = dimension // parts
    starts = [s for s in starts if len(s) == dimension]
    books = integers(np.array(starts).ravel(), dimension, scale).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    same = rows.filter(F.size("vector") == dimension).select("vector")

    for _ in range(rounds):
        def run(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            cells = [Cells(b) for b in books]
            sums = np.zeros((*books.shape[:2], width + 1), dtype=np.int64)
            for batch in _gathered(batches):
                x = _vectors(batch.column(0), dimension, scale)
                for p in range(parts):
                    part = np.ascontiguousarray(x[:, p * width:(p + 1) * width])
                    code, _ = cells[p].assign(part)
                    order = np.argsort(code, kind="stable")
                    used, first = np.unique(code[order], return_index=True)
                    sums[p, used, :width] += np.add.reduceat(part[order], first, axis=0)
                    sums[p, used, width] += np.diff([*first, len(code)])
            p, e, k = np.nonzero(sums)
            yield pa.record_batch([pa.array(p), pa.array(e), pa.array(k), pa.array(sums[p, e, k])], names=["p", "e", "k", "s"])

        found = same.mapInArrow(run, "p long, e long, k long, s long").groupBy("p", "e", "k").agg(
            F.sum(F.col("s").cast("decimal(20,0)")).alias("s")).collect()
        total = {(r.p, r.e, r.k): int(r.s) for r in found}
        books = books.copy()
        for p in range(parts):
            for e in range(books.shape[1]):
                count = total.get((p, e, width), 0)
                if count:
                    books[p, e] = [total.get((p, e, k), 0) // count for k in range(width)]
    return books


def encode(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
           parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(id, label, codes array<int>, error long) per vector that takes part, and the codebooks."""
    spark = df.sparkSession
    ship_package(spark)
    rows = _valid(df, id_col, vector_col, [F.col(label_col).alias("label")])
    books = fitted(rows, parts, entries, rounds, scale)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    schema = f"id {kinds['id']}, label {kinds['label']}, codes array<int>, error long"
    if books is None:
        return spark.createDataFrame([], schema), np.zeros((parts, 0, 0), dtype=np.int64)
    width = books.shape[2]
    dimension = parts * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        for batch in _gathered(batches):
            x = _vectors(batch.column(1), dimension, scale)
            found = [cells[p].assign(np.ascontiguousarray(x[:, p * width:(p + 1) * width])) for p in range(parts)]
            codes = np.stack([c for c, _ in found], axis=1).astype(np.int32)
            ends = np.arange(0, codes.size + 1, parts, dtype=np.int32)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.ListArray.from_arrays(ends, pa.array(codes.ravel())),
                                   pa.array(sum(e for _, e in found))], names=["id", "label", "codes", "error"])

    return rows.filter(F.size("vector") == dimension).mapInArrow(run, schema), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the errors' sum over all rows with the same label (null: more than 64 bits)."""
    coded = cut_lineage(coded)
    sums = cut_lineage(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(20,0)")).alias("label_error")))
    sums = sums.select(F.col("label").alias("_label"), F.expr("try_cast(label_error AS bigint)").alias("label_error"))
    if sums.count() <= SMALL_LABELS:
        sums = F.broadcast(sums)
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and position, as decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The query over these codes in DuckDB SQL, round by round."""
    steps = f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x
      FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS MATERIALIZED (SELECT r, vec_id, p, x[p * (len(x) // {parts}) + 1:(p + 1) * (len(x) // {parts})] AS y
      FROM v, (SELECT unnest(range({parts})) AS p)),
b0 AS MATERIALIZED (SELECT p, rank() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, y AS c FROM parts QUALIFY e < {entries})"""
    for k in range(rounds + 1):
        steps += f""",
n{k} AS MATERIALIZED (SELECT r, p, min(struct_pack(d := d, e := e)) AS best FROM
      (SELECT r, a.p, e, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(y, c)]) AS d FROM parts a JOIN b{k} b ON a.p = b.p) GROUP BY r, p)"""
        if k < rounds:
            steps += f""",
s{k} AS MATERIALIZED (SELECT p, e, i, CAST(sum(y[i]) AS BIGINT) AS s, count(*) AS n FROM
      (SELECT a.p, best.e AS e, y, unnest(range(1, len(y) + 1)) AS i FROM n{k} JOIN parts a USING (r, p)) GROUP BY p, e, i),
m{k} AS MATERIALIZED (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{k} GROUP BY p, e),
b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m USING (p, e))"""
    return f"""WITH {steps},
coded AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
      FROM n{rounds} GROUP BY r),
book AS (SELECT sha256(string_agg(CAST(z AS VARCHAR), ',' ORDER BY p, e, i)) AS h FROM
      (SELECT p, e, unnest(c) AS z, unnest(range(len(c))) AS i FROM b{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT h FROM book) AS codebooks_sha256
FROM coded JOIN v USING (r)"""
