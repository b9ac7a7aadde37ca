"""Shared pieces of the training-data operators: folders, tables, graph components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids that may be broadcast (8 bytes each); above it the join is shuffled.
BROADCAST_IDS = 1_000_000

#: Texts and bytes of one Arrow batch.
BATCH_TEXTS = 1024
BATCH_BYTES = 1 << 22

#: Spark's setting that deletes a query's shuffle files at its end.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Words of the contract: runs of anything but ASCII white space. ``bytes.split()``
#: cuts at exactly these six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a folder of our own will do on one machine (tests); on a cluster a
    local folder would be another one on every executor, so that is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
        held = spark.sparkContext.getCheckpointDir()
    return held.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    What was shuffled for the table is deleted once the table is there: nothing reads it again,
    and otherwise it stays on the executors' disks until the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom/{name}-{uuid.uuid4().hex}"
    held = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, held)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {p.rpartition("/")[0] for p in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """At most BATCH_TEXTS texts and about BATCH_BYTES go to a Python worker at once (less if the session says so).

    Spark's own 10,000 long texts would be hundreds of megabytes in the JVM and again in Python.
    The settings stay, as plans are made after this call returns; they only bound memory.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_TEXTS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        held = spark.conf.get(key)
        held = int(held) if held.lstrip("-").isdigit() else None  # a size like 64MB is as good as unset
        if held is None or not 0 < held <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Return to the system what this worker has freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator], forget: Callable[[], None] | None = None) -> Callable[[Iterator], Iterator]:
    """``run`` for a Python worker, after which the worker gives back what it no longer needs.

    Workers stay for later tasks, of other operators too, and would keep the memory.
    """

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        if forget is not None:
            forget()
        give_back()

    return tidied


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of trusted text: labelled good and not toxic (null labels: not trusted)."""
    return (
        labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
        .select("doc_id")
        .distinct()
    )


def with_flag(docs: DataFrame, ids: DataFrame, flag: str) -> DataFrame:
    """Left join of a Boolean column: is the row's doc_id among ``ids`` (distinct)?

    The ids are broadcast only while there are at most BROADCAST_IDS of them; beyond
    that Spark shuffles both sides, and rows are put in an order that a rerun repeats.
    """
    marked = ids.withColumn(flag, F.lit(True))
    small = ids.count() <= BROADCAST_IDS
    met = docs.join(F.broadcast(marked) if small else marked, "doc_id", "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    return met if small else met.sortWithinPartitions("doc_id", F.xxhash64(*docs.columns))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (node, root), root the least node.

    ``edges`` has two columns of one orderable type. Large-star and small-star rounds
    alternate until nothing changes; every round is a written table, so nothing is
    collected and a lost executor costs one round. Nodes without an edge are not
    returned. Self-loops are ignored; an empty graph gives an empty table.
    """
    a, b = edges.columns
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    cur = written(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    seen = None
    for _ in range(max_rounds):
        # Large star: every neighbour above u is linked to the least of u and its neighbours.
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(least, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        # Small star: every lower neighbour, and u itself, is linked to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        new = written(small, "edges")
        state = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        state = (state["n"], state["h"])
        dropped(cur)
        cur = new
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components: no end after {max_rounds} rounds")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
