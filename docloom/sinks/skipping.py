"""Data skipping for payload filters: ranges and Bloom filters of each file choose the files before the scan.

``write`` puts points in files along a space-filling curve of two columns (bits of both in turn), so a
box meets few files, and keeps beside them, for each file, least and greatest values of ranged keys
and the words of a Bloom filter for each key that is asked for by equality. All of it is made and
asked by DataFrame operations; the driver sees the names of the files that remain.

Edge cases: null values are in no range and no filter, and no condition fits them; a file whose
values of a key are all null is skipped if the key is asked for; an empty table has no files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.search import payload_filter
from docloom.sinks import folders

#: Keys of a filter by equality, and by range.
EQUAL, RANGED = ("document_id", "document_type"), ("page_number", "patch_x", "patch_y", "processing_timestamp")
#: Bits of a file's filter for a value, and hash functions.
BITS, HASHES = 10, 5
#: Bits of each coordinate that the curve uses.
DEPTH = 16


def curve(x: Column, y: Column) -> Column:
    """The place on the space-filling curve: bits of both columns in turn (values from 0 to 65535; null: 0)."""
    cut = lambda c: F.least(F.greatest(F.coalesce(c.cast("int"), F.lit(0)), F.lit(0)), F.lit((1 << DEPTH) - 1))
    a, b, out = cut(x), cut(y), F.lit(0).cast("long")
    for k in range(DEPTH):
        one = lambda c, to: F.shiftleft(F.shiftright(c, k).bitwiseAND(1).cast("long"), to)
        out = out.bitwiseOR(one(a, 2 * k)).bitwiseOR(one(b, 2 * k + 1))
    return out


def places(value: Column, bits: Column) -> Column:
    """The bits of a value in a filter of so many bits."""
    text = value.cast("string")
    return F.array(*[F.pmod(F.xxhash64(F.lit(k), text), bits) for k in range(HASHES)])


def write(points: DataFrame, path: str, rows_per_file: int = 100_000, along: tuple[str, str] = ("patch_x", "patch_y")) -> SkippingTable:
    spark = points.sparkSession
    n = points.count()
    files = -(-n // rows_per_file) or 1
    z = curve(*(F.col(c) for c in along))
    points.withColumn("_z", z).repartitionByRange(files, "_z", *points.columns[:1]).sortWithinPartitions("_z").drop("_z").write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows").withColumn("_file", F.col("_metadata.file_path"))
    ranges = [f(c).alias(f"{c}_{n}") for c in RANGED if c in points.columns for n, f in (("least", F.min), ("most", F.max))]
    per = rows.groupBy("_file").agg(F.count("*").alias("n_rows"), *ranges)
    per.write.parquet(f"{path}/ranges")
    words = None
    for c in EQUAL:
        if c in points.columns:
            values = rows.where(F.col(c).isNotNull()).select("_file", F.col(c).cast("string").alias("v")).distinct()
            sizes = values.groupBy("_file").agg((F.ceil(F.count("*") * BITS / 64) * 64).alias("bits"))
            bit = values.join(sizes, "_file").select("_file", "bits", F.explode(places(F.col("v"), F.col("bits"))).alias("p"))
            one = F.expr("bit_or(shiftleft(1L, cast(pmod(p, 64) as int)))")
            part = bit.groupBy("_file", "bits", F.floor(F.col("p") / 64).alias("word")).agg(one.alias("set")).withColumn("key", F.lit(c))
            words = part if words is None else words.unionByName(part)
    if words is not None:
        words.repartition(1 if files < 1000 else files // 1000, "_file").write.parquet(f"{path}/filters")
    return SkippingTable(spark, path)


class SkippingTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def chosen(self, conditions: dict) -> DataFrame:
        """(_file, n_rows) of the files that may hold rows that fit."""
        files = self.spark.read.parquet(f"{self.path}/ranges")
        bounds = self._bounds(conditions)
        for c, (low, high, strict) in bounds.items():
            if f"{c}_least" in files.columns:
                if low is not None:
                    files = files.where(F.col(f"{c}_most") > low if strict else F.col(f"{c}_most") >= low)
                if high is not None:
                    files = files.where(F.col(f"{c}_least") <= high)
        for c in EQUAL:
            if conditions.get(c) is not None and folders.exists(self.spark, f"{self.path}/filters"):
                held = self.spark.read.parquet(f"{self.path}/filters").where(F.col("key") == c)
                bit = held.select("_file", "bits", "word", "set").join(held.select("_file", "bits").distinct().select("_file", F.explode(places(F.lit(conditions[c]), F.col("bits"))).alias("p")), "_file")
                hit = bit.where((F.col("word") == F.floor(F.col("p") / 64)) & (F.expr("shiftright(`set`, cast(pmod(p, 64) as int)) & 1") == 1))
                fit = hit.groupBy("_file").agg(F.count_distinct("p").alias("hits"))
                asked = held.select("_file", "bits").distinct().select("_file", F.size(F.array_distinct(places(F.lit(conditions[c]), F.col("bits")))).alias("asked"))
                files = files.join(fit.join(asked, "_file").where("hits = asked").select("_file"), "_file", "left_semi")
        return files.select("_file", "n_rows")

    def _bounds(self, conditions: dict) -> dict[str, tuple]:
        out, page = {}, conditions.get("page_number")
        if isinstance(page, dict):
            out["page_number"] = (page.get("gte"), page.get("lte"), False)
        elif page is not None:
            out["page_number"] = (page, page, False)
        box = conditions.get("spatial_box")
        if box is not None and len(box) == 4:
            out |= {"patch_x": (box[0], box[2], False), "patch_y": (box[1], box[3], False)}
        after = (conditions.get("processing_timestamp") or {}).get("after")
        return out | ({} if after is None else {"processing_timestamp": (after, None, True)})

    def read(self, conditions: dict) -> DataFrame:
        """Rows that fit all conditions, from the chosen files."""
        files = [r["_file"] for r in self.chosen(conditions).select("_file").collect()]  # names of files only
        schema = self.spark.read.parquet(f"{self.path}/rows").schema
        rows = self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)
        return rows.where(payload_filter(conditions))

    def report(self, conditions: dict) -> DataFrame:
        """(n_files, n_read, n_rows, n_rows_read)."""
        chosen = self.chosen(conditions).agg(F.count("*").alias("n_read"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows_read"))
        every = self.spark.read.parquet(f"{self.path}/ranges").agg(F.count("*").alias("n_files"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))
        return every.join(chosen, F.lit(True)).select("n_files", "n_read", "n_rows", "n_rows_read")
