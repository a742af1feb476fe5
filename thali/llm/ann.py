"""Operator 5: approximate nearest neighbours by cross-polytope hashing.

Each table turns unit vectors by a pseudo-rotation (three rounds of random signs and a fast
Hadamard transform) and files them under the nearest signed axis. A query looks not only
under its own axis but under the ``probes`` nearest ones of each table; all vectors filed
there are candidates, and their exact cosine decides.

Scale: equal vectors are one row before anything is filed (with their smallest ids, as many as
an answer can use), so a vector that a third of all rows share is a single candidate. A bucket
with more than ``block`` candidates is split into blocks that see the same queries in separate
tasks; the number of blocks per bucket is a table of at most tables x 2 x dimension rows. Each
task holds one block and its queries and returns the few best per query, never its pairs, so
what is shuffled back is proportional to the queries. A query that found fewer candidates than
it needs looks under all axes of one table, which is every vector.

Defined results: rows whose vector is null, empty, zero or holds a null or non-finite component
take no part, nor do rows without an id; vectors of different lengths are never compared; equal
scores go to the smaller id; a row that repeats another's id and vector is one row; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thali.llm.bpe import slices
from thali.llm.common import cut_lineage, prepare

TABLES = 10
PROBES = 16
NEIGHBOURS = 5
BLOCK = 4096
SEED = 5


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (a power of two long), without scaling."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """The rows of ``x``, padded to a power of two, under the table's pseudo-rotation."""
    d = 1 << max(0, int(x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    signs = np.random.default_rng([SEED, table, d]).choice([-1.0, 1.0], size=(3, d))
    for s in signs:
        x = hadamard(x * s) / np.sqrt(d)
    return x


def axes(x: np.ndarray, table: int, probes: int) -> np.ndarray:
    """Per row the ``probes`` nearest signed axes: 2 a for axis a, 2 a + 1 for its opposite."""
    r = rotated(x / np.linalg.norm(x, axis=1, keepdims=True), table)
    both = np.stack([r, -r], axis=2).reshape(len(r), -1)
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the rows that take part; single precision stays so, as it is half the bytes to move."""
    single = rows.schema[vector_col].dataType.simpleString() == "array<float>"
    v = F.col(vector_col).cast("array<float>" if single else "array<double>")
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)).distinct()


def filed(distinct: DataFrame, tables: int, probes: int) -> DataFrame:
    """Each distinct vector under its ``probes`` nearest axes of every table."""
    prepare(distinct.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1000):
                lists = part.column(2).to_pylist()
                sizes = np.array([len(v) for v in lists])
                for dim in np.unique(sizes):
                    rows = np.flatnonzero(sizes == dim)
                    x = np.array([lists[i] for i in rows], dtype=np.float64)
                    for t in range(tables):
                        near = axes(x, t, probes)
                        whose = pa.array(np.repeat(rows, near.shape[1]))
                        n = near.size
                        yield pa.record_batch(
                            [pa.array(np.full(n, t, np.int32)), pa.array(np.full(n, dim, np.int32)),
                             pa.array(near.ravel().astype(np.int32)), *(part.column(c).take(whose) for c in range(3))],
                            names=["t", "dim", "bucket", "vid", "ids", "v"])

    kind = distinct.schema["v"].dataType.simpleString()
    return distinct.select("vid", "ids", "v").mapInArrow(
        run, f"t int, dim int, bucket int, vid long, ids array<long>, v {kind}")


def best(q: np.ndarray, c: np.ndarray, vid: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query row its ``k`` nearest candidates (places, scores), ties to the smaller id."""
    q_norm, c_norm = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    for at in range(0, len(q), 256):
        near = (q[at:at + 256] @ c.T) / q_norm[at:at + 256, None] / c_norm
        limit = np.partition(near, len(c) - k, axis=1)[:, len(c) - k] if len(c) > k else np.full(len(near), -2.0)
        for i, row in enumerate(near):
            some = np.flatnonzero(row >= limit[i] - 1e-9)          # the exact scores decide among these
            score = (c[some] * q[at + i]).sum(axis=1) / (q_norm[at + i] * c_norm[some])
            order = np.lexsort((vid[some], -score))[:k]
            yield at + i, some[order], score[order]


def search(queries: DataFrame, distinct: DataFrame, k: int, tables: int, probes: int, block: int) -> DataFrame:
    """(query vid, vid, ids, score): the k nearest distinct vectors found for each distinct query vector."""
    spark = distinct.sparkSession
    under = cut_lineage(filed(distinct, tables, 1))
    # at most one row per axis, table and vector length
    blocks = F.broadcast(under.groupBy("t", "dim", "bucket").count().select(
        "t", "dim", "bucket", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    candidates = under.join(blocks, ["t", "dim", "bucket"]).withColumn(
        "part", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int")).drop("blocks")
    asked = filed(queries, tables, probes).drop("ids").join(blocks, ["t", "dim", "bucket"]).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    schema = "qid long, vid long, ids array<long>, score double"

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            c, q = (np.stack(x["v"].to_list()).astype(np.float64) for x in (right, left))
            vid, qid, ids = right["vid"].to_numpy(), left["vid"].tolist(), right["ids"].tolist()
            rows = [(qid[i], int(vid[p]), list(ids[p]), s) for i, places, scores in best(q, c, vid, k)
                    for p, s in zip(places.tolist(), scores.tolist())]
        kinds = {"qid": "int64", "vid": "int64", "ids": "object", "score": "float64"}
        return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=kind) for i, (c, kind) in enumerate(kinds.items())})

    key = ["t", "dim", "bucket", "part"]
    found = asked.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInPandas(run, schema)
    by = Window.partitionBy("qid").orderBy(F.desc("score"), "vid")
    return found.dropDuplicates(["qid", "vid"]).withColumn("rn", F.row_number().over(by)).filter(
        F.col("rn") <= k).drop("rn")


def nearest(rows: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS,
            tables: int = TABLES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows found for every query row but itself. ``is_query``
    is a condition on the column ``id``."""
    base = cut_lineage(vectors(rows, id_col, vector_col))
    # k + 1 ids of a vector suffice: one may be the query itself
    few = base.withColumn("rn", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("rn") <= k + 1)
    distinct = cut_lineage(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(
        F.col("ids")[0].alias("vid"), "ids", "v"))
    asking = base.filter(is_query)
    query_vectors = cut_lineage(distinct.join(asking.select("v").distinct(), "v", "left_semi"))
    found = cut_lineage(search(query_vectors, distinct, k + 1, tables, probes, block))
    # whoever found too few looks at every vector: all axes of one table
    enough = found.groupBy("qid").agg(F.sum(F.size("ids")).alias("n")).filter(F.col("n") > k)
    short = cut_lineage(query_vectors.join(enough, F.col("vid") == F.col("qid"), "left_anti"))
    if not short.isEmpty():
        rest = search(short, distinct, k + 1, 1, 1 << 30, block)
        found = found.join(enough, "qid", "left_semi").unionByName(rest)
    answers = found.select("qid", "score", F.explode("ids").alias("id"))
    by = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    answers = answers.withColumn("rn", F.row_number().over(by)).filter(F.col("rn") <= k + 1).groupBy("qid").agg(
        F.sort_array(F.collect_list(F.struct("rn", "id", "score"))).alias("found"))
    asked = asking.join(distinct.select("v", F.col("vid").alias("qid")), "v").select(F.col("id").alias("query_id"), "qid")
    own = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    return asked.join(answers, "qid").select("query_id", F.posexplode(own).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("id"), F.col("x.score").alias("score"))
