"""Named tables kept as versioned parquet snapshots, in buckets where rows have a key.

A run writes new directories and then one commit record that names them. Readers follow the
newest record, so an interrupted run leaves the tables as they were.

Keyed tables are cut into buckets by the hash of their key, and a record names the directories
of each bucket. An upsert, an append or a delete reads and writes only the buckets that hold a
key of the run, so bytes follow the changed keys, not the table. Within a bucket rows are
written by as many tasks as their size asks for, a hot key included.

Several writers: `begin` pins the version that a run starts from. A commit takes the next number
by an operation that fails if the number is taken, so of two runs that started from one version
only one is published and the other raises `ConcurrentCommit`, having changed nothing.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a table that is written for the first time (hundreds for large stores), and directories of a bucket from which
#: on an append merges them.
BUCKETS, MOST_PARTS = 16, 12
BUCKET = "_bucket"


class ConcurrentCommit(RuntimeError):
    """Another run has published tables since this one began; run it again."""


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


class TableStore:
    """Tables under one root folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._pending: dict[str, str | dict] = {}
        self._base: tuple[int, dict] | None = None

    def _newest(self) -> tuple[int, dict]:
        try:
            log = self.spark.read.schema("version bigint, tables string").option(
                "recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(f"{self.root}/commits")
            last = log.agg(F.max_by("tables", "version"), F.max("version")).first()
        except AnalysisException:
            return 0, {}
        return (last[1], json.loads(last[0])) if last[1] is not None else (0, {})

    def _tables(self) -> dict:
        return (self._base or self._newest())[1]

    def _current(self) -> dict:
        """The tables with what this run has written so far."""
        return {**self._tables(), **self._pending}

    def begin(self) -> None:
        """Start a run: all reads until the commit see the tables as they are now."""
        self._pending, self._base = {}, self._newest()

    @property
    def version(self) -> int:
        """The version that a run starts from."""
        return (self._base or self._newest())[0]

    def _write_begins(self) -> None:
        if self._base is None:
            self._base = self._newest()

    def _open(self, entry: str | dict, buckets: list[int] | None = None) -> DataFrame:
        if isinstance(entry, str):
            return self.spark.read.parquet(f"{self.root}/{entry}")
        paths = [f"{self.root}/{path}/{BUCKET}={b}" for b, parts in entry["paths"].items()
                 if buckets is None or int(b) in buckets for path in parts]
        schema = StructType.fromJson(entry["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, name: str) -> DataFrame | None:
        """The committed table, or None when it was never written."""
        entry = self._tables().get(name)
        return None if entry is None else self._open(entry)

    def read_keys(self, name: str, keys: DataFrame) -> DataFrame | None:
        """The rows of a keyed table whose key is in `keys` (one column); other buckets are not read."""
        entry = self._tables().get(name)
        if entry is None:
            return None
        touched = None if isinstance(entry, str) else self._touched(keys, keys.columns[0], entry["buckets"])
        return self._open(entry, touched).join(keys.distinct(), keys.columns[0], "left_semi")

    @staticmethod
    def _touched(keys: DataFrame, key: str, buckets: int) -> list[int]:
        """Numbers of the buckets that hold a key: no more than there are buckets."""
        return [r[0] for r in keys.select(bucket_of(key, buckets)).distinct().collect()]

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        """Write a replacement without buckets that becomes visible with the next commit."""
        self._write_begins()
        path = f"tables/{name}/{uuid.uuid4().hex}"
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(f"{self.root}/{path}")
        self._pending[name] = path
        return self.spark.read.parquet(f"{self.root}/{path}")

    def _put(self, name: str, df: DataFrame, key: str, buckets: int) -> tuple[str, list[int]]:
        """Write rows by bucket; the directory and the buckets it has."""
        path = f"tables/{name}/{uuid.uuid4().hex}"
        rows = df.withColumn(BUCKET, bucket_of(key, buckets))
        rows.hint("rebalance", F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{self.root}/{path}")
        try:
            files = self.spark.read.schema(df.schema).parquet(f"{self.root}/{path}").inputFiles()
        except AnalysisException:  # no rows, no files
            return path, []
        return path, sorted({int(f.rsplit(f"/{BUCKET}=", 1)[1].split("/")[0]) for f in files if f"/{BUCKET}=" in f})

    def _entry(self, name: str, df: DataFrame, key: str) -> dict:
        old = self._current().get(name)
        fields = {f.name: f for f in (StructType.fromJson(old["schema"]).fields if isinstance(old, dict) else [])}
        fields.update({f.name: f for f in df.schema.fields})
        schema = json.loads(StructType(list(fields.values())).json())
        if isinstance(old, dict):
            return {**old, "schema": schema, "paths": dict(old["paths"])}
        return {"buckets": self.buckets, "key": key, "schema": schema, "paths": {}}

    def upsert(self, name: str, new: DataFrame, keys: list[str], replaced: DataFrame | None = None) -> None:
        """Last write wins per key; `replaced` names further keys whose old rows go."""
        self._write_begins()
        entry, key = self._entry(name, new, keys[0]), keys[0]
        gone = new.select(*keys) if replaced is None else new.select(*keys).unionByName(replaced.select(*keys))
        touched = self._touched(gone, key, entry["buckets"])
        old = self._current().get(name)
        rows = new
        if old is not None:
            kept = self._open(old, touched).join(gone.distinct(), keys, "left_anti")
            rows = kept.unionByName(new, allowMissingColumns=True)
        if isinstance(old, str):  # a table from before it had buckets: all of it moves into them
            touched = list(range(entry["buckets"]))
        self._replace(name, entry, rows, key, touched)

    def _replace(self, name: str, entry: dict, rows: DataFrame, key: str, touched: list[int]) -> None:
        path, held = self._put(name, rows, key, entry["buckets"])
        for b in touched:
            entry["paths"].pop(str(b), None)
        entry["paths"].update({str(b): [path] for b in held})
        self._pending[name] = entry

    def append(self, name: str, new: DataFrame, key: str) -> None:
        """Add rows; nothing old is read, but buckets in many pieces are merged."""
        self._write_begins()
        entry = self._entry(name, new, key)
        full = [int(b) for b, parts in entry["paths"].items() if len(parts) >= MOST_PARTS]
        if full:
            full = sorted(set(full) & set(self._touched(new, key, entry["buckets"])))
        path, held = self._put(name, new, key, entry["buckets"])
        for b in held:
            entry["paths"].setdefault(str(b), [])
            entry["paths"][str(b)] = [*entry["paths"][str(b)], path]
        if full:
            self._replace(name, entry, self._open(entry, full), key, full)
        self._pending[name] = entry

    def delete(self, name: str, keys: DataFrame) -> None:
        """Remove the rows whose key is in `keys`."""
        old = self._current().get(name)
        if old is None:
            return
        self._write_begins()
        if isinstance(old, str):
            self.write(name, self._open(old).join(keys, keys.columns, "left_anti"))
            return
        touched = self._touched(keys, keys.columns[0], old["buckets"])
        kept = self._open(old, touched).join(keys, keys.columns, "left_anti")
        self._replace(name, {**old, "paths": dict(old["paths"])}, kept, keys.columns[0], touched)

    def commit(self) -> int:
        """Publish everything written since the run began in one step, if no other run did so."""
        self._write_begins()
        version, tables = self._base
        record = json.dumps({"version": version + 1, "tables": json.dumps({**tables, **self._pending})})
        taken = not _create(self.spark, f"{self.root}/commits/{version + 1:012d}.json", record)
        self._pending, self._base = {}, None
        if taken:
            raise ConcurrentCommit(f"version {version + 1} of {self.root} was published by another run")
        return version + 1


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file whole, or return False if its name is taken."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    spare = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{uuid.uuid4().hex}")
    if fs.getUri().getScheme() == "file":  # the local rename would overwrite, a link does not
        folder = target.getParent().toUri().getPath()
        own = os.path.join(folder, spare.getName())
        with open(own, "w", encoding="utf-8") as out:
            out.write(text)
        try:
            os.link(own, target.toUri().getPath())
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
        return True
    out = fs.create(spare, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(target) or not fs.rename(spare, target):
        fs.delete(spare, False)
        return False
    return True
