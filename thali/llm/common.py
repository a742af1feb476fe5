"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thali.session import ensure_checkpoint_dir, scratch_path, ship_package
from thali.sources.driver import read_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


#: Rows per Arrow batch: texts are long, and a batch is held whole on both sides of the pipe.
BATCH_ROWS = 500
_ROWS_CONF, _ROWS_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def prepare(spark: SparkSession) -> None:
    """Ship the package to Python workers, and keep Arrow batches of texts small unless the session
    sets a size of its own."""
    ship_package(spark)
    if spark.conf.get(_ROWS_CONF, _ROWS_DEFAULT) == _ROWS_DEFAULT:
        spark.conf.set(_ROWS_CONF, str(BATCH_ROWS))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) of any document-like frame; a null text counts as empty."""
    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def hash_sample(ids: DataFrame, n: int, total: int) -> DataFrame:
    """The ``n`` ids (column ``id``) with the least hashes, of ``total`` altogether. Rows that cannot be
    among them are dropped by their hash first, so no task sorts or sends more than about 2 n rows."""
    key = F.xxhash64("id")
    if total > 2 * n:
        bound = -(1 << 63) + int((1 << 64) * (2 * n + 100) / total)
        ids = ids.filter(key < F.lit(min(bound, (1 << 63) - 1)))
    return ids.orderBy(key, "id").limit(n)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder that the cluster names."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``df`` as a Parquet table in the shared folder that the cluster names (far smaller there than a
    checkpoint), and a function that deletes the table once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, f"written-{uuid.uuid4().hex}"))
    df.write.parquet(path.toString())

    def delete() -> None:
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return spark.read.schema(df.schema).parquet(path.toString()), delete


def broadcast_bytes(spark: SparkSession, path: str):
    """A small file of the driver (a tokenizer's vocabulary) as a broadcast variable."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())

