"""Table scans over the driver's Parquet tables.

Reads are lazy and column-pruned by Catalyst; callers select the columns they
need and the scan's ``ReadSchema`` shrinks to them.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    path = os.path.join(sf_dir, f"{name}.parquet")
    return path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one driver table. Works for a file or a directory of part files."""
    return spark.read.parquet(table_path(sf_dir, name))


def jdbc_options(url: str, table: str, key: str, lower: int, upper: int, partitions: int,
                 fetch_size: int = 10_000, **extra: str) -> dict:
    """Options for a parallel JDBC read: `partitions` range queries on the numeric `key`
    between `lower` and `upper` (rows outside still land in the first/last range)."""
    if partitions < 1 or upper < lower:
        raise ValueError("need partitions >= 1 and lower <= upper")
    opts = {"url": url, "dbtable": table, "partitionColumn": key, "lowerBound": str(lower),
            "upperBound": str(upper), "numPartitions": str(partitions), "fetchsize": str(fetch_size)}
    opts.update(extra)
    return opts


def read_jdbc_table(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int,
                    partitions: int, **extra: str) -> DataFrame:
    """S1 from the operational database itself (e.g. the restaurant's PostgreSQL tables):
    the same model tables, read in parallel ranges of their serial key. The result
    plugs into ``thali.sources.model.from_frames``."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, key, lower, upper, partitions, **extra)).load()
