"""A table as a stream: its rows arrive in time order, in a few batches, so that a streaming job runs over
given data from start to end (registered queries, backfills of a stream's table)."""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thali.session import scratch_path


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the session's shared checkpoint folder."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def run(rows: DataFrame, batches: int, order: str, start: Callable) -> None:
    """Feed `rows` to a streaming job in about `batches` batches of equal size by time `order` (NULL times first)
    and wait for its end. `start` takes the stream and a checkpoint folder and returns the running query, whose
    trigger must be ``availableNow``: it is started anew, from its checkpoint, whenever the next batch has arrived.
    A batch is as many files as the tasks that make it, so no task sees a whole batch."""
    spark = rows.sparkSession
    source, checkpoint = scratch(spark, "stream"), scratch(spark, "ck")
    day = F.col(order).cast("timestamp").cast("long")
    cuts = rows.agg(F.percentile_approx(day, [k / batches for k in range(1, batches)]).alias("at")).first()["at"] or []
    edges = sorted(set(cuts))
    number = sum(((day >= F.lit(c)).cast("int") for c in edges), F.lit(0))
    dealt = rows.withColumn("_batch", F.coalesce(number, F.lit(0)))
    for k in range(len(edges) + 1):
        dealt.filter(F.col("_batch") == k).drop("_batch").write.parquet(f"{source}/b{k:04d}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{source}/*")
        start(stream, checkpoint).awaitTermination()
