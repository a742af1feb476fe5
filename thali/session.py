"""Session helpers.

The library never creates a session behind the caller's back: every operator
takes DataFrames. ``get_spark`` is for tests, the bench and local runs only.
"""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "thali", extra: dict | None = None) -> SparkSession:
    """Local session tuned like a small cluster: AQE on, UI off, UTC wall clock."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = str(shuffle_partitions or int(cpus))
    builder = SparkSession.builder
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = (
        builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder that the cluster names, by ``setCheckpointDir`` or by
    ``spark.checkpoint.dir``, and use it for checkpoints.

    Only a local session (one machine) may go without: it gets a scratch folder of its own.
    On a cluster a missing setting is an error, never a folder that only the driver sees.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get(CHECKPOINT_CONF, None)
    if not current:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError(f"name a shared folder in {CHECKPOINT_CONF}")
        current = tempfile.mkdtemp(prefix="thali-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written snapshots."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers (once per Spark application), so that
    functions defined here run there whether or not the package is installed on them."""
    sc = spark.sparkContext
    if getattr(sc, "_thali_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="thali-package-"), "thali.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("thali", os.path.relpath(path, root)))
    sc.addPyFile(archive)
    sc._thali_shipped = True
