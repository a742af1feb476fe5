"""Cart ingestion, nested JSON results, append and snapshot sinks.

Snapshots are never updated in place (plain Parquet has no MERGE): a change
job's output is written to a new version folder, and readers pick the
newest complete one. Written tables double as lineage cuts for long job
chains; the folders live under the cluster's shared ``spark.checkpoint.dir``
when no base path is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thali.session import ensure_checkpoint_dir, scratch_path
from thali.sources.schema import CART

CORRUPT = "_corrupt_record"


def read_carts(spark: SparkSession, path: str, stream: bool = False, max_files: int | None = None) -> DataFrame:
    """Carts as JSON lines with a fixed schema; malformed lines are kept in
    ``_corrupt_record`` instead of failing the job."""
    schema = T.StructType(CART.fields + [T.StructField(CORRUPT, T.StringType())])
    reader = (spark.readStream if stream else spark.read).schema(schema) \
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if stream and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def as_json_column(df: DataFrame, name: str = "json") -> DataFrame:
    """S3: one JSON document per row (nested arrays kept), e.g. an order with its items."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def write_json(df: DataFrame, path: str) -> None:
    """S3: nested result as JSON lines."""
    df.write.mode("overwrite").json(path)


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append rows to a table folder."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_snapshot(df: DataFrame, table: str, version: int, base: str | None = None) -> str:
    """Write a new snapshot version of a table; returns its folder."""
    root = base or scratch_path(df.sparkSession, "snapshots")
    path = f"{root}/{table}/v={version:010d}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_snapshot(spark: SparkSession, table: str, version: int, base: str | None = None) -> DataFrame:
    root = base or scratch_path(spark, "snapshots")
    return spark.read.parquet(f"{root}/{table}/v={version:010d}")


def newest_snapshot(spark: SparkSession, table: str, base: str | None = None) -> DataFrame:
    """The newest complete version of a table: the greatest one whose writer left its
    ``_SUCCESS`` marker. A version that is being written, or whose writer died, is passed over."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{base or scratch_path(spark, 'snapshots')}/{table}")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "v=*/_SUCCESS"))
    done = sorted(x.getPath().getParent().toString() for x in found or [])
    if not done:
        raise FileNotFoundError(f"no complete version of {table}")
    return spark.read.parquet(done[-1])


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint on the shared checkpoint folder (survives executor loss).

    The folder is the session's ``spark.checkpoint.dir``; a scratch folder is
    made only when the session names none (local runs)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
