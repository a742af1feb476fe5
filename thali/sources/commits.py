"""Tables that change by commits: files first, a manifest that names them last.

Parquet folders have no transactions. Here every write goes to a new folder nobody reads, and one small
JSON manifest, renamed into place without overwriting, makes the files of *all* tables of a change
visible at once. Readers follow manifests, never folder listings, so a writer that dies leaves nothing to
see and orders never appear without their lines. A commit carries the batch it came from: a replayed
batch finds its commit and writes nothing.

Two kinds of table live in a store. *Appended* tables are the files of all commits. *Bucketed* tables are
cut by key (a hash, or ``span`` consecutive ids, so that serial ids of one time lie together); each commit
names the files of every bucket, and a change rewrites only the buckets it touches. Older commits stay
readable (``version``) until ``vacuum``.

A manifest holds file names only: those it appends, and one short list per bucket. Nothing of the data
passes through the driver.
"""

from __future__ import annotations

import json
import re
import uuid
from typing import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "_bucket"


class CommitConflict(RuntimeError):
    """Another writer made the commit first."""


class Store:
    """The tables under one folder of a file system that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._folder = self._path("_commits")
        self._fs = self._folder.getFileSystem(self._conf)
        self._seen: dict[int, dict] = {}

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    # ------------------------------------------------------------- manifests

    def commits(self) -> list[int]:
        """Numbers of all commits, in order."""
        if not self._fs.exists(self._folder):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._folder))
        return sorted(int(m[1]) for m in (re.fullmatch(r"(\d{10})\.json", n) for n in names) if m)

    def manifest(self, number: int) -> dict:
        """A commit's manifest; it never changes, so it is read once."""
        if number not in self._seen:
            stream = self._fs.open(self._path("_commits", f"{number:010d}.json"))
            try:
                self._seen[number] = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        return self._seen[number]

    def newest(self) -> dict | None:
        numbers = self.commits()
        return self.manifest(numbers[-1]) if numbers else None

    def commit(self, append: dict[str, list[str]] | None = None, buckets: dict[str, dict] | None = None,
               schemas: dict[str, T.StructType] | None = None, batch: int | None = None, meta: dict | None = None,
               after: dict | None = None) -> int:
        """Publish the files. `buckets` gives the touched tables' new bucket files, the others are carried over
        from the commit `after` (default: the newest), which this one follows."""
        before = self.newest() if after is None else after
        number = before["commit"] + 1 if before else 0
        held = dict((before or {}).get("buckets", {}))
        held.update(buckets or {})
        said = dict((before or {}).get("schemas", {}))
        said.update({k: s.json() for k, s in (schemas or {}).items()})
        text = json.dumps({"commit": number, "batch": batch, "append": append or {}, "buckets": held, "schemas": said,
                           "meta": {**(before or {}).get("meta", {}), **(meta or {})}})
        self._fs.mkdirs(self._folder)
        draft = self._path("_commits", f"draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(draft, self._path("_commits", f"{number:010d}.json"), none)
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise CommitConflict(f"commit {number} of {self.root} was made by another writer") from e
            raise
        return number

    def has_batch(self, batch: int) -> bool:
        """Whether a stream's batch is committed already (batches are committed in order)."""
        return any((b := self.manifest(n)["batch"]) is not None and b >= batch for n in reversed(self.commits()))

    # ----------------------------------------------------------------- files

    def write(self, df: DataFrame, table: str, partition_by: Iterable[str] = ()) -> list[str]:
        """Write `df` to a folder of its own; the files, relative to the store. Nothing reads them before a commit."""
        folder = f"{table}/{uuid.uuid4().hex}"
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.root}/{folder}")
        found = self._fs.listFiles(self._path(folder), True)
        base, files = self._fs.makeQualified(self._jvm.org.apache.hadoop.fs.Path(self.root)).toString(), []
        while found.hasNext():
            path = found.next().getPath()
            if path.getName().startswith("part-"):
                files.append(path.toString()[len(base):].lstrip("/"))
        return sorted(files)

    def files(self, table: str, version: int | None = None) -> list[str]:
        """Files of a table as of a commit (default: the newest)."""
        numbers = [n for n in self.commits() if version is None or n <= version]
        if not numbers:
            return []
        newest = self.manifest(numbers[-1])
        if table in newest["buckets"]:
            return [f for files in newest["buckets"][table]["files"].values() for f in files]
        return [f for n in numbers for f in self.manifest(n)["append"].get(table, [])]

    def frame(self, table: str, files: list[str], manifest: dict | None = None) -> DataFrame:
        """The given files of a table."""
        manifest = manifest or self.newest()
        if not manifest or table not in manifest["schemas"]:
            raise FileNotFoundError(f"no commit of {table} in {self.root}")
        schema = T.StructType.fromJson(json.loads(manifest["schemas"][table]))
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{f}" for f in files))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as of a commit (default: the newest)."""
        return self.frame(table, self.files(table, version))

    # --------------------------------------------------------------- buckets

    def bucket_of(self, spec: dict) -> Column:
        key = F.col(spec["key"])
        if spec["span"]:
            return F.floor(key / spec["span"]).cast("long")
        return F.pmod(F.xxhash64(key), F.lit(spec["count"])).cast("long")

    def _bucket_files(self, df: DataFrame, table: str, spec: dict) -> dict[str, list[str]]:
        """Write `df` by bucket; adaptive execution makes small buckets few files and a hot one several."""
        files: dict[str, list[str]] = {}
        dealt = df.withColumn(BUCKET, self.bucket_of(spec)).hint("rebalance", BUCKET)
        for f in self.write(dealt, table, [BUCKET]):
            files.setdefault(re.search(rf"/{BUCKET}=([^/]+)/", f)[1], []).append(f)
        return files

    def create(self, table: str, df: DataFrame, key: str, count: int = 64, span: int | None = None) -> int:
        """First commit of a bucketed table: `count` hash buckets of `key`, or buckets of `span` consecutive ids."""
        spec = {"key": key, "count": count, "span": span}
        files = self._bucket_files(df, table, spec)
        return self.commit(buckets={table: {"spec": spec, "files": files}}, schemas={table: df.schema})

    def touched(self, table: str, keys: DataFrame, manifest: dict | None = None) -> list[str]:
        """Buckets in which the keys (a column named like the table's) lie."""
        spec = (manifest or self.newest())["buckets"][table]["spec"]
        rows = keys.select(spec["key"]).select(self.bucket_of(spec).alias("b")).distinct().collect()
        return sorted("__HIVE_DEFAULT_PARTITION__" if r.b is None else str(r.b) for r in rows)

    def rewritten(self, table: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame],
                  manifest: dict | None = None) -> dict | None:
        """New bucket files of a table in which `change` has been applied to the rows of the buckets of `keys`.
        The other buckets are neither read nor written. `change` must leave rows in their buckets."""
        manifest = manifest or self.newest()
        held = manifest["buckets"][table]
        some = self.touched(table, keys, manifest)
        if not some:
            return None
        files = dict(held["files"])
        rows = self.frame(table, [f for b in some for f in files.pop(b, [])], manifest)
        fresh = self._bucket_files(change(rows).select(*rows.columns), table, held["spec"])
        if not set(fresh) <= set(some):
            raise ValueError("a change moved rows of untouched buckets")
        return {"spec": held["spec"], "files": files | fresh}

    def update(self, table: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame],
               batch: int | None = None) -> int | None:
        """Apply a change to the buckets of `keys` and commit; None if there was nothing to touch."""
        before = self.newest()
        files = self.rewritten(table, keys, change, before)
        return None if files is None else self.commit(buckets={table: files}, batch=batch, after=before)

    def vacuum(self, keep: int = 1) -> int:
        """Delete the bucket files that none of the newest `keep` commits names (readers of older versions must be
        done), but no manifest and no appended file; the number of files deleted."""
        numbers = self.commits()
        old, new = numbers[:-keep], numbers[-keep:]

        def named(ns: list[int]) -> set[str]:
            return {f for n in ns for t in self.manifest(n)["buckets"].values() for fs in t["files"].values() for f in fs}

        gone = named(old) - named(new)
        for f in gone:
            self._fs.delete(self._path(f), False)
        return len(gone)
