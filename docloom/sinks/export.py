"""Sinks: CSV, Parquet and JSON exports, keyed upserts, collections and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("csv", "parquet", "json")


def is_tabular(kind: T.StructType) -> bool:
    """Can the fields be rows: is every field an array (and is there one)?"""
    return bool(kind.fields) and all(isinstance(f.dataType, T.ArrayType) for f in kind.fields)


def tabular(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Rows of a struct: if all its fields are arrays of one length, a row for each element, else one row."""
    kind = df.schema[column].dataType
    names = [f.name for f in kind.fields]
    if not is_tabular(kind):
        return df.select(*keep, f"{column}.*")
    sizes = [F.size(F.col(column)[n]) for n in names]
    even = F.lit(True)
    for s in sizes[1:]:
        even = even & (s == sizes[0])
    zipped = F.arrays_zip(*[F.col(column)[n].alias(n) for n in names])
    rows = df.where(even).select(*keep, F.explode(zipped).alias("_z")).select(*keep, *[F.col("_z")[n].cast("string").alias(n) for n in names])
    single = df.where(~even).select(*keep, *[F.to_json(F.col(column)[n]).alias(n) for n in names])
    return rows.unionByName(single)


def flat_strings(df: DataFrame) -> DataFrame:
    """Nested columns as JSON, for formats that hold none."""
    nested = (T.ArrayType, T.StructType, T.MapType, T.VariantType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields])


def canonical_rows(records: DataFrame, include_metadata: bool = True) -> DataFrame:
    """Canonical records as flat rows, with ``_meta_`` columns."""
    df = records.select("processing_id", "timestamp", "schema_version", "extraction_data.*")
    names = [f.name for f in records.schema["extraction_data"].dataType.fields]
    meta = {"_meta_processing_id": "processing_id", "_meta_timestamp": "timestamp", "_meta_schema_version": "schema_version"} if include_metadata else {}
    return df.select(*names, *[F.col(c).cast("string").alias(n) for n, c in meta.items()])


def shaped_rows(df: DataFrame, include_lineage: bool = True) -> DataFrame:
    """Shaped records with their ``_meta_`` columns."""
    own = [c for c in df.columns if c not in ("processing_id", "_shaped_id", "_transformations", "_1nf_compliant")]
    meta = [
        F.col("_shaped_id").alias("_meta_processing_id"), F.col("processing_id").alias("_meta_canonical_id"),
        F.size("_transformations").alias("_meta_transformation_count"), F.col("_1nf_compliant").alias("_meta_1nf_compliant"),
    ]
    return df.select(*own, *(meta if include_lineage else []))


def with_file_metadata(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """Key-value pairs in the first column's metadata; Parquet keeps them in the file's schema."""
    first = df.columns[0]
    return df.withMetadata(first, {**df.schema[first].metadata, **values})


def write(df: DataFrame, path: str, form: str = "parquet", compression: str | None = None, mode: str = "errorifexists", partition_by: list[str] = ()) -> None:
    if form not in FORMATS:
        raise ValueError(f"unsupported format: {form}")
    writer = (flat_strings(df) if form == "csv" else df).write.mode(mode)
    if form == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if compression or form == "parquet":
        writer = writer.option("compression", compression or "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(form).save(path)


def write_batch(records: DataFrame, path: str, form: str = "parquet") -> None:
    """Many records: one folder for each day of their timestamp, not one file for each record."""
    if form not in ("csv", "parquet"):
        raise ValueError(f"unsupported format: {form}")
    df = canonical_rows(records).withColumn("day", F.to_date("_meta_timestamp"))
    write(df, path, form, partition_by=["day"])


def csv_text(df: DataFrame) -> DataFrame:
    """Rows as CSV text."""
    flat = flat_strings(df)
    return flat.select(F.to_csv(F.struct(*flat.columns)).alias("csv"))


def write_stream(stream: DataFrame, path: str, checkpoint: str, form: str = "parquet", once: bool = True):
    """Append a stream to files; the schema is the stream's. With ``once``, what is there now and then an end."""
    if form == "csv":
        stream = flat_strings(stream)
    writer = stream.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    if form == "csv":
        writer = writer.option("header", True)
    return (writer.trigger(availableNow=True) if once else writer).start()


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, key: str = "id"):
    """Append keyed micro-batches, newest wins on read: see :func:`newest`."""

    def put(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n).cast("long")).write.mode("append").parquet(path)

    assert key in stream.columns
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def newest(df: DataFrame, key: str = "id") -> DataFrame:
    """One row for each key of an upserted table: that of the last batch."""
    other = [c for c in df.columns if c not in (key,)]
    return df.groupBy(key).agg(F.max_by(F.struct(*other), "_batch").alias("_r")).select(key, "_r.*").drop("_batch")


def batch_report(df: DataFrame, ok: Column, size: int = 100) -> DataFrame:
    """(stored, failed, batches, success_rate) of a write in batches."""
    n = F.count("*")
    good = F.sum(ok.cast("long"))
    return df.agg(good.alias("stored"), (n - good).alias("failed"), F.ceil(n / size).alias("batches"), F.coalesce(F.try_divide(good.cast("double"), n), F.lit(0.0)).alias("success_rate"))


class Collection:
    """A stored table of points: created, replaced, checked, dropped; clustered by the payload keys that filters use."""

    KEYS = ("document_type", "document_id", "page_number")

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name = spark, name

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def create(self, points: DataFrame, recreate: bool = False) -> bool:
        """False if it is there and is not to be made again."""
        if self.exists():
            if not recreate:
                return False
            self.delete()
        keys = [k for k in self.KEYS if k in points.columns]
        sorted_points = points.sortWithinPartitions(*keys) if keys else points
        sorted_points.write.format("parquet").saveAsTable(self.name)
        return True

    def ensure(self, points: DataFrame) -> None:
        if not self.exists():
            self.create(points)

    def append(self, points: DataFrame) -> None:
        points.select(*self.read().columns).write.format("parquet").mode("append").saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def delete(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def info(self) -> DataFrame:
        return self.read().agg(F.count("*").alias("points_count"), F.count("vector").alias("vectors_count"), F.max(F.size("vector")).alias("vector_size"))


def response(status: Column, body: Column, request_id: Column | None = None) -> Column:
    """An HTTP envelope as a struct: status, headers, JSON body."""
    headers = F.create_map(F.lit("Content-Type"), F.lit("application/json"), F.lit("X-Request-ID"), F.coalesce(request_id, F.lit("")) if request_id is not None else F.lit(""))
    return F.struct(status.cast("int").alias("statusCode"), headers.alias("headers"), F.to_json(body).alias("body"))


def error_response(status: Column, message: Column, kind: Column) -> Column:
    return response(status, F.struct(F.struct(kind.alias("type"), message.alias("message")).alias("error")))
