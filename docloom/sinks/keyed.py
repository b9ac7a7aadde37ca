"""Keyed tables with merge on read: delta files by bucket of the key, newest wins, tombstones, compaction.

A table is a folder: ``rows/`` holds Parquet folders by bucket, ``log/`` a small JSON file for
each version with the whole state (for each bucket its base folder and its deltas, for each
writer its last batch). A version is there once its file is, and a file that exists is never
written again, so a reader sees whole versions, and of two writers one fails (where a rename doesn't replace; elsewhere let one write at a time). A batch that a writer has committed is
passed over when it comes again; what a failed attempt wrote is in no version, and ``vacuum`` deletes it.

An upsert writes its own rows only. A read takes buckets without deltas as they are; in the others the base's rows are held
against the keys of the deltas, by broadcast while those are at most BROADCAST_KEYS, else by a
shuffle of these buckets. ``compact`` rewrites the buckets that have deltas and no others.

Edge cases: null keys are a key; of rows of a batch with one key the greatest ``order`` wins, then the greatest row, where
columns can be ordered; deleting an absent key does nothing; an empty batch is committed; an empty table has its columns.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.sinks import folders

#: Keys of deltas that are broadcast.
BROADCAST_KEYS = 500_000


class KeyedTable:
    """``key`` are the columns that name a row, ``bucket_by`` those of them whose hash deals it to one of ``buckets``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        state = self.state()
        self.schema = T.StructType.fromJson(state["schema"])
        self.key, self.bucket_by, self.buckets = state["key"], state["bucket_by"], state["buckets"]

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, key: list[str], bucket_by: list[str] | None = None, buckets: int = 16) -> KeyedTable:
        state = {"version": 0, "schema": schema.jsonValue(), "key": key, "bucket_by": bucket_by or key, "buckets": buckets, "base": {}, "deltas": {}, "batches": {}}
        _commit(spark, path, state)
        return cls(spark, path)

    # State.

    def state(self) -> dict:
        fs, log = folders._of(self.spark, f"{self.path}/log")
        if not fs.exists(log):
            raise FileNotFoundError(self.path)
        last = max(x.getPath().getName() for x in fs.listStatus(log) if x.getPath().getName().endswith(".json"))
        stream = fs.open(folders._of(self.spark, f"{self.path}/log/{last}")[1])
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    @property
    def version(self) -> int:
        return self.state()["version"]

    def _rows(self, paths: list[str]) -> DataFrame:
        held = T.StructType([*self.schema.fields]).add("_gone", "boolean").add("_version", "long")
        return self.spark.read.schema(held).parquet(*[f"{self.path}/rows/{p}" for p in paths]) if paths else self.spark.createDataFrame([], held)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    # Writing.

    def upsert(self, rows: DataFrame, writer: str, batch: int, order: Column | None = None) -> bool:
        """Put rows in place of those with their keys; False if this batch of the writer is there."""
        return self.apply(rows.withColumn("_gone", F.lit(False)), writer, batch, order)

    def delete(self, keys: DataFrame, writer: str, batch: int) -> bool:
        others = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name not in self.key]
        return self.apply(keys.select(*self.key, *others).withColumn("_gone", F.lit(True)), writer, batch)

    def apply(self, rows: DataFrame, writer: str, batch: int, order: Column | None = None) -> bool:
        """Rows with ``_gone``: upserts and tombstones in one version."""
        state = self.state()
        if state["batches"].get(writer, -1) >= batch:
            return False
        version, names = state["version"] + 1, self.schema.names
        plain = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema], "_gone", (F.lit(0) if order is None else order).alias("_order"))
        comparable = [n for n in names if not isinstance(self.schema[n].dataType, (T.MapType, T.VariantType))]
        best = F.max_by(F.struct(*[n for n in names if n not in self.key], "_gone"), F.struct("_order", *comparable, ~F.col("_gone")))
        one = plain.groupBy(*self.key).agg(best.alias("_r")).select(*self.key, "_r.*")
        folder = f"v{version:08d}-{writer}-{batch}"
        out = one.select(*names, "_gone", F.lit(version).cast("long").alias("_version"), self.bucket().alias("bucket"))
        self._write(out, folder)
        touched = self._buckets_of(folder)
        for b in touched:
            state["deltas"].setdefault(b, []).append(f"{folder}/bucket={b}")
        state["batches"][writer] = batch
        state["version"] = version
        _commit(self.spark, self.path, state)
        return True

    def _write(self, rows: DataFrame, folder: str) -> None:
        rows.repartition("bucket").sortWithinPartitions("bucket", *self.key).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/{folder}")

    def _buckets_of(self, folder: str) -> list[str]:
        fs, p = folders._of(self.spark, f"{self.path}/rows/{folder}")
        return sorted(x.getPath().getName().partition("=")[2] for x in fs.listStatus(p) if x.getPath().getName().startswith("bucket="))

    # Reading.

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The newest row of each key, of all buckets or some."""
        return self._merged(self.state(), None if buckets is None else {str(b) for b in buckets}).select(*self.schema.names)

    def versions(self) -> DataFrame:
        """The same with ``_version``, the version that wrote each row."""
        return self._merged(self.state(), None).drop("_gone")

    def _merged(self, state: dict, wanted: set[str] | None) -> DataFrame:
        known = [b for b in {**state["base"], **state["deltas"]} if wanted is None or b in wanted]
        still = self._rows([state["base"][b] for b in known if not state["deltas"].get(b)])
        dirty = [b for b in known if state["deltas"].get(b)]
        if not dirty:
            return still
        deltas = self._rows([p for b in dirty for p in state["deltas"][b]])
        if any(len(state["deltas"][b]) > 1 for b in dirty):  # within one delta keys are unique
            whole = F.struct(*[c for c in deltas.columns if c not in self.key])
            deltas = deltas.groupBy(*self.key).agg(F.max_by(whole, "_version").alias("_r")).select(*self.key, "_r.*").select(*deltas.columns)
        base = self._rows([state["base"][b] for b in dirty if b in state["base"]])
        keys = deltas.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.key)])
        if keys.count() <= BROADCAST_KEYS:
            keys = F.broadcast(keys)
        same = F.lit(True)
        for i, k in enumerate(self.key):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        return still.unionByName(base.join(keys, same, "left_anti")).unionByName(deltas.where("not _gone"))

    # Upkeep.

    def compact(self, least: int = 1) -> list[str]:
        """Write a new base for buckets with ``least`` deltas or more; the buckets."""
        state = self.state()
        dirty = sorted(b for b, d in state["deltas"].items() if len(d) >= least)
        if dirty:
            version = state["version"] + 1
            folder = f"v{version:08d}-base"
            self._write(self._merged(state, set(dirty)).withColumn("bucket", self.bucket()), folder)
            there = set(self._buckets_of(folder))
            for b in dirty:
                state["deltas"].pop(b)
                state["base"].pop(b, None)
                if b in there:
                    state["base"][b] = f"{folder}/bucket={b}"
            state["version"] = version
            _commit(self.spark, self.path, state)
        return dirty

    def vacuum(self) -> None:
        """Delete folders and log files that the last version doesn't need (readers of older ones lose them)."""
        state = self.state()
        needed = {*state["base"].values(), *(p for d in state["deltas"].values() for p in d)}
        fs, rows = folders._of(self.spark, f"{self.path}/rows")
        for top in fs.listStatus(rows) if fs.exists(rows) else []:
            for b in fs.listStatus(top.getPath()):
                name = f"{top.getPath().getName()}/{b.getPath().getName()}"
                if b.isDirectory() and name not in needed:
                    fs.delete(b.getPath(), True)
        fs, log = folders._of(self.spark, f"{self.path}/log")
        for x in fs.listStatus(log):
            if x.getPath().getName() != f"{state['version']:08d}.json":
                fs.delete(x.getPath(), False)


def _commit(spark: SparkSession, path: str, state: dict) -> None:
    """Write a version's file whole, then give it its name unless that is taken."""
    name = f"{path}/log/{state['version']:08d}.json"
    if folders.exists(spark, name):
        raise RuntimeError(f"another writer has made version {state['version']} of {path}")
    fs, part = folders._of(spark, f"{path}/log/_{uuid.uuid4().hex}")
    stream = fs.create(part, False)
    try:
        stream.write(bytearray(json.dumps(state).encode()))
    finally:
        stream.close()
    if not fs.rename(part, folders._of(spark, name)[1]):
        raise RuntimeError(f"another writer has made version {state['version']} of {path}")


class FileIndex:
    """Files and the points made of them, kept up to date by change sets of content digests."""

    def __init__(self, spark: SparkSession, path: str, points: T.StructType | None = None, key: list[str] | None = None, buckets: int = 16) -> None:
        """Open, or make with the points' columns (``path`` among them) and key."""
        if points is not None and not folders.exists(spark, f"{path}/files/log"):
            KeyedTable.create(spark, f"{path}/points", points, key or ["path"], ["path"], buckets)
            KeyedTable.create(spark, f"{path}/files", T.StructType().add("path", "string").add("digest", "string"), ["path"], None, buckets)
        self.files, self.points = KeyedTable(spark, f"{path}/files"), KeyedTable(spark, f"{path}/points")

    def changes(self, files: DataFrame) -> DataFrame:
        """(path, digest, change) of (path, content): added, changed or gone; what is the same is left out."""
        now = files.select("path", F.sha2("content", 256).alias("digest"))
        old = self.files.read().select("path", F.col("digest").alias("_old"))
        change = F.when(F.col("_old").isNull(), "added").when(F.col("digest").isNull(), "gone").when(F.col("digest") != F.col("_old"), "changed")
        return now.join(old, "path", "full").select("path", "digest", change.alias("change")).where(F.col("change").isNotNull())

    def sync(self, files: DataFrame, make, batch: int, writer: str = "sync") -> dict[str, int]:
        """Bring the points up to ``files`` (path, content); ``make`` turns new files into points. Counts of changes.

        Points are committed first and the list of files after them: a run that ends between the two finds the same
        changes again, and its batch of points is there already.
        """
        found = self.changes(files)
        found = found.sparkSession.createDataFrame(found.toArrow()) if found.limit(1001).count() <= 1000 else found.checkpoint()
        counts = {r["change"]: r["n"] for r in found.groupBy("change").agg(F.count("*").alias("n")).collect()}
        if not counts:
            return counts
        fresh = make(files.join(found.where("change <> 'gone'").select("path"), "path", "left_semi"))
        new = fresh.select(*self.points.schema.names, F.lit(False).alias("_gone"))
        names = [r["b"] for r in found.where("change <> 'added'").select(F.pmod(F.xxhash64("path"), F.lit(self.points.buckets)).alias("b")).distinct().collect()]
        old = self.points.read(names).join(found.where("change <> 'added'").select("path"), "path", "left_semi").select(*self.points.schema.names)
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.points.key]
        gone = old.alias("o").join(new.select(*self.points.key).alias("n"), same, "left_anti").withColumn("_gone", F.lit(True))
        self.points.apply(new.unionByName(gone), writer, batch)
        self.files.apply(found.select("path", "digest", (F.col("change") == "gone").alias("_gone")), writer, batch)
        return counts
