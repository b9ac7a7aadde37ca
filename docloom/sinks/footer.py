"""A Spark data source that writes Parquet files with key-value pairs in their footers, each chunk once.

    register(spark)
    df.write.format("docloom_parquet").option("path", p).option("metadata", json).option("chunk", "7").mode("append").save()
    stream.writeStream.format("docloom_parquet").option("path", p).option("checkpointLocation", c).start()

Tasks write their own files and report them; the commit writes a manifest of the chunk, ``_manifest/<chunk>.json``,
under a name that is taken once: a chunk, or a micro-batch of a stream, that comes again finds it and leaves only
the first one's files. What failed tasks wrote is deleted by the abort and is in no manifest, so
``exported`` never reads it.

Edge cases: an empty chunk has a manifest without files; partitions without rows write no file; a
chunk without a name gets a new one; overwriting is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

NAME = "docloom_parquet"


def store(path: str):
    """(file system, path in it): local, or any that the path's scheme names."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class Writer:
    def __init__(self, options: dict) -> None:
        self.path, self.pairs = options["path"], json.loads(options.get("metadata", "{}"))
        self.compression = options.get("compression", "zstd")

    def put(self, batches: Iterator[pa.RecordBatch], chunk: str) -> Written:
        """A task's rows as one file."""
        from pyarrow import parquet

        fs, root = store(self.path)
        fs.create_dir(f"{root}/data", recursive=True)
        name, rows, out = f"data/{chunk}-{uuid.uuid4().hex}.parquet", 0, None
        for batch in batches:
            if batch.num_rows:
                if out is None:
                    pairs = {**(batch.schema.metadata or {}), **{k.encode(): str(v).encode() for k, v in self.pairs.items()}}
                    sink = fs.open_output_stream(f"{root}/{name}")
                    out = parquet.ParquetWriter(sink, batch.schema.with_metadata(pairs), compression=self.compression)
                out.write_batch(batch.replace_schema_metadata(out.schema.metadata))
                rows += batch.num_rows
        if out is not None:
            out.close()
            sink.close()
        return Written([(name, rows)] if rows else [])

    def publish(self, messages: list[Written | None], chunk: str) -> None:
        fs, root = store(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        name = f"{root}/_manifest/{chunk}.json"
        if fs.get_file_info(name).is_file:
            return self.remove(messages)
        fs.create_dir(f"{root}/_manifest", recursive=True)
        with fs.open_output_stream(f"{name}.part") as out:
            out.write(json.dumps({"chunk": chunk, "metadata": self.pairs, "files": [{"file": f, "rows": n} for f, n in files]}).encode())
        fs.move(f"{name}.part", name)

    def remove(self, messages: list[Written | None]) -> None:
        fs, root = store(self.path)
        for m in messages:
            for name, _ in m.files if m is not None else []:
                fs.delete_file(f"{root}/{name}")


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.to, self.chunk = Writer(options), options.get("chunk") or uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return self.to.put(iterator, self.chunk)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self.to.publish(messages, self.chunk)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self.to.remove(messages)


class StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict) -> None:
        self.to, self.prefix = Writer(options), options.get("chunk", "batch")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return self.to.put(iterator, self.prefix)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        self.to.publish(messages, f"{self.prefix}-{batchId}")

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        self.to.remove(messages)


class FooterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> BatchWriter:
        if overwrite:
            raise ValueError("chunks are only appended")
        return BatchWriter(dict(self.options))

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FooterSource)


def write_chunk(df: DataFrame, path: str, chunk: str, metadata: dict | None = None) -> None:
    """Export a table as a chunk, once."""
    register(df.sparkSession)
    df.write.format(NAME).option("path", path).option("chunk", chunk).option("metadata", json.dumps(metadata or {})).mode("append").save()


def write_stream(stream: DataFrame, path: str, checkpoint: str, metadata: dict | None = None):
    """Export what a stream has now, each micro-batch once."""
    register(stream.sparkSession)
    out = stream.writeStream.format(NAME).option("path", path).option("metadata", json.dumps(metadata or {}))
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(chunk, file, rows) of committed files; a chunk without files has one row of nulls."""
    found = spark.read.schema("chunk string, files array<struct<file:string,rows:long>>").json(f"{path}/_manifest/*.json")
    return found.select("chunk", F.explode_outer("files").alias("f")).select("chunk", "f.file", "f.rows")


def exported(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed chunks."""
    names = [r["file"] for r in manifest(spark, path).where("file IS NOT NULL").collect()]  # names of files only
    return spark.read.parquet(*[f"{path}/{n}" for n in names])


def footers(spark: SparkSession, path: str) -> DataFrame:
    """(chunk, file, key, value) of the pairs in each committed file's footer, read from the files in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import parquet

        for batch in batches:
            out = []
            for chunk, name in zip(batch.column("chunk").to_pylist(), batch.column("file").to_pylist()):
                fs, root = store(path)
                with fs.open_input_file(f"{root}/{name}") as f:
                    pairs = parquet.read_metadata(f).metadata or {}
                out += [(chunk, name, k.decode(), v.decode()) for k, v in pairs.items() if k != b"ARROW:schema"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(4)], names=["chunk", "file", "key", "value"])

    return manifest(spark, path).where("file IS NOT NULL").mapInArrow(run, "chunk string, file string, key string, value string")
