"""Queries over what the library stores: indexes, keyed tables, exports. Each writes below the shared folder and reads back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators import contains, lineage, metrics, search, vector_index
from docloom.queries import NORM, POINTS, SCORE, TOP, hundredth, parties, q, stored_points, t
from docloom.sinks import blobs, export, folders, footer, keyed, skipping
from docloom.sources import files

#: Rows of a range where one group holds all: small, so that there are ranges in a small table too.
HOT_ROWS = 1000

# Indexes for similarity search ----------------------------------------------


def indexed(spark: SparkSession, sf: str, page: str | None = None) -> tuple[DataFrame, vector_index.Index]:
    p = stored_points(spark, sf)
    return p, vector_index.build(p, folders.fresh(spark, "vectors"), page=page)


@q(None)
def top_index_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest of every hundredth point by the inverted-file index, rescored exactly; tested for its recall."""
    p, index = indexed(spark, sf)
    return index.search(hundredth(p), 10).select("query_id", "id", F.round("score", 5).alias("score"), "rank")


@q(TOP.replace(":where", "").replace(":k", "10"))
def top_index_exact(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the bounds of cells: equal to the full scan."""
    p, index = indexed(spark, sf)
    return index.search_exact(hundredth(p), 10).select("query_id", "id", F.round("score", 5).alias("score"))


@q(TOP.replace(":where", "AND a.document_type = 'pdf' AND a.patch_x BETWEEN 0 AND 64 AND a.patch_y BETWEEN 0 AND 64").replace(":k", "20"))
def top_index_region(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest points of a type and a box, by the index."""
    p, index = indexed(spark, sf)
    where = search.payload_filter({"document_type": "pdf", "spatial_box": [0, 0, 64, 64]})
    return index.search_exact(hundredth(p), 20, where).select("query_id", "id", F.round("score", 5).alias("score"))


@q("""SELECT CAST(count(*) AS BIGINT) AS n_queries, CAST(10 * count(*) AS BIGINT) AS n_wanted, true AS recall_reached, true AS looks_at_fewer FROM embeddings WHERE vec_id % 100 = 0""")
def top_index_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of the index against the scan (0.9 at least), and whether it looks at fewer points than the scan."""
    p, index = indexed(spark, sf)
    asked = hundredth(p)
    found = index.search(asked, 10).select("query_id", "id", F.lit(1).alias("hit"))
    hits = search.top_k(p, asked, 10).join(found, ["query_id", "id"], "left").agg(F.count("*").alias("n_wanted"), F.count("hit").alias("n_found"))
    work = index.work(asked).agg(F.count("*").alias("n_queries"), F.sum("n_codes").alias("n_codes"))
    every = p.agg(F.count("*").alias("n_points"))
    one = hits.join(work, F.lit(True)).join(every, F.lit(True))
    return one.select("n_queries", "n_wanted", (F.col("n_found") >= 0.9 * F.col("n_wanted")).alias("recall_reached"), (F.col("n_codes") < F.col("n_queries") * F.col("n_points")).alias("looks_at_fewer"))


@q(f"""WITH {POINTS}, n AS (SELECT a.*, {NORM.format('a')} AS n FROM points a),
  s AS (SELECT b.label AS query_id, a.document_id AS id, b.id AS qi, max({SCORE} / (a.n * b.n)) AS best FROM n a, n b WHERE b.id % 50 = 0 GROUP BY b.label, a.document_id, b.id),
  t AS (SELECT query_id, id, sum(best) AS score FROM s GROUP BY query_id, id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM t)
  SELECT query_id, id, round(score, 5) AS score FROM r WHERE rank <= 5""")
def top_late_index(spark: SparkSession, sf: str) -> DataFrame:
    """Late interaction by lists of cells and bounds of pages: equal to scoring every page."""
    p, index = indexed(spark, sf, page="document_id")
    asked = p.where("id % 50 = 0").select(F.col("label").alias("query_id"), F.col("id").alias("q_idx"), F.col("vector").alias("query_vector"))
    return index.late_search(asked, 5).select("query_id", "id", F.round("score", 5).alias("score"))


# Keyed tables -----------------------------------------------------------------


@q("""WITH b AS (SELECT o_orderkey AS id, o_custkey AS custkey, o_totalprice AS price, 0 AS batch FROM orders
      UNION ALL SELECT o_orderkey, o_custkey, o_totalprice * 2, 1 FROM orders WHERE o_orderkey % 5 = 1
      UNION ALL SELECT o_orderkey, o_custkey, o_totalprice * 3, 2 FROM orders WHERE o_orderkey % 15 = 1
      UNION ALL SELECT o_orderkey, o_custkey, NULL, 3 FROM orders WHERE o_orderkey % 35 = 6
      UNION ALL SELECT -o_orderkey, o_custkey, o_totalprice, 4 FROM orders WHERE o_orderkey % 50 = 7),
   r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch DESC) AS n FROM b)
   SELECT id, custkey, round(price, 2) AS price FROM r WHERE n = 1 AND batch <> 3""")
def snk_merge_on_read(spark: SparkSession, sf: str) -> DataFrame:
    """Orders upserted in batches (one sent twice), some deleted, some buckets compacted on the way."""
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("custkey"), F.col("o_totalprice").alias("price"))
    table = keyed.KeyedTable.create(spark, folders.fresh(spark, "orders"), o.schema, ["id"], buckets=8)
    table.upsert(o, "w", 0)
    table.compact()
    table.upsert(o.where("id % 5 = 1").withColumn("price", F.col("price") * 2), "w", 1)
    table.upsert(o.where("id % 15 = 1").withColumn("price", F.col("price") * 3), "w", 2)
    table.upsert(o.where("id % 15 = 1").withColumn("price", F.lit(0.0)), "w", 2)  # the batch is there: nothing changes
    table.compact(least=2)
    table.delete(o.where("id % 35 = 6"), "w", 3)
    table.upsert(o.where("id % 50 = 7").withColumn("id", -F.col("id")), "w", 4)
    return table.read().withColumn("price", F.round("price", 2))


def document_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and the file, of 25 of them, that each belongs to."""
    return t(spark, sf, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / 25).cast("long").alias("f"))


@q("""SELECT doc_id, doc_id // 25 AS f, md5(CASE WHEN doc_id // 25 % 5 = 2 THEN text || ' changed' ELSE text END) AS digest, CAST(CASE WHEN doc_id // 25 % 7 = 3 OR doc_id // 25 % 5 = 2 THEN 2 ELSE 1 END AS BIGINT) AS version
      FROM documents WHERE doc_id // 25 % 11 <> 4""")
def str_incremental_index(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as files, indexed, some files changed, added and removed, indexed again; then once more without a change."""
    d, root = document_files(spark, sf), folders.fresh(spark, "files")
    points = T.StructType().add("path", "string").add("doc_id", "long").add("digest", "string")
    index = keyed.FileIndex(spark, f"{root}/index", points, ["path", "doc_id"])

    def listed(state: str) -> DataFrame:
        found = files.read_files(spark, f"{root}/{state}", "*.json")
        return found.select(F.regexp_extract("path", "f=([0-9]+)", 1).alias("path"), "content")

    def make(new: DataFrame) -> DataFrame:
        lines = new.select("path", F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line")).where("line <> ''")
        doc = F.from_json("line", "doc_id long, text string")
        return lines.select("path", doc.alias("d")).select("path", "d.doc_id", F.md5("d.text").alias("digest"))

    def written(rows: DataFrame, state: str) -> None:
        # In order: what a shuffle brings has none, and a file whose lines change places is a changed file.
        in_order = rows.repartition("f").sortWithinPartitions("f", "doc_id", "text")
        in_order.write.partitionBy("f").option("compression", "none").json(f"{root}/{state}")

    written(d.where("f % 7 <> 3"), "first")
    text = F.when(F.col("f") % 5 == 2, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    written(d.where("f % 11 <> 4").withColumn("text", text), "second")
    index.sync(listed("first"), make, 1)
    index.sync(listed("second"), make, 2)
    index.sync(listed("second"), make, 3)
    rows = index.points.versions()
    return rows.select("doc_id", F.col("path").cast("long").alias("f"), "digest", F.col("_version").alias("version"))


# Data skipping ------------------------------------------------------------------

CONDITIONS = {"document_type": "pdf", "page_number": {"gte": 2, "lte": 4}, "spatial_box": [32, 0, 96, 64], "processing_timestamp": {"after": "2024-01-03T00:00:00Z"}}


@q(f"""WITH {POINTS} SELECT id, document_id, patch_x, patch_y FROM points
       WHERE document_type = 'pdf' AND page_number BETWEEN 2 AND 4 AND patch_x BETWEEN 32 AND 96 AND patch_y BETWEEN 0 AND 64 AND processing_timestamp > '2024-01-03T00:00:00Z'""")
def flt_skipping(spark: SparkSession, sf: str) -> DataFrame:
    table = skipping.write(stored_points(spark, sf), folders.fresh(spark, "points"), rows_per_file=64)
    return table.read(CONDITIONS).select("id", "document_id", "patch_x", "patch_y")


@q(f"""WITH {POINTS} SELECT CAST(count(*) AS BIGINT) AS n_rows, true AS box_skips, true AS document_skips, CAST(0 AS BIGINT) AS n_absent FROM points""")
def flt_skipping_report(spark: SparkSession, sf: str) -> DataFrame:
    """Do a box and a document leave out files, and is a document that isn't there sought in less than an eighth of them?"""
    p = stored_points(spark, sf)
    by_box, by_id = (skipping.write(p, folders.fresh(spark, "points"), 64, along) for along in (("patch_x", "patch_y"), ("id", "page_number")))
    box, document, absent = (
        table.report(c).select("n_rows", F.col("n_files").alias(f"{n}_files"), F.col("n_read").alias(f"{n}_read"))
        for n, table, c in (("spatial_box", by_box, {"spatial_box": [0, 0, 32, 32]}), ("document_id", by_id, {"document_id": "doc3"}), ("absent", by_id, {"document_id": "no such document"}))
    )
    one = box.join(document.drop("n_rows"), F.lit(True)).join(absent.drop("n_rows"), F.lit(True))
    # A filter is wrong for about one value in a hundred: an eighth of the files would be too many.
    return one.select("n_rows", (F.col("spatial_box_read") < F.col("spatial_box_files")).alias("box_skips"), (F.col("document_id_read") < F.col("document_id_files")).alias("document_skips"), F.floor(F.col("absent_read") * 8 / F.col("absent_files")).alias("n_absent"))


# Deep lineage and hot groups -------------------------------------------------------


@q("""WITH RECURSIVE c(start_id, node, depth) AS (SELECT o_orderkey, o_orderkey, 0 FROM orders WHERE o_orderkey % 4001 = 0
        UNION ALL SELECT c.start_id, o_orderkey, depth + 1 FROM c JOIN orders ON o_orderkey = c.node + 1 WHERE depth < 4000)
      SELECT start_id AS node_id, node AS other_id, depth FROM c WHERE depth > 0""")
def lin_deep_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as chains of 4,000 steps, each a child of the one before: all descendants of the heads."""
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("child_id"))
    links = o.where("child_id % 4001 <> 0").select((F.col("child_id") - 1).alias("parent_id"), "child_id")
    return lineage.closure(links, o.where("child_id % 4001 = 0").select(F.col("child_id").alias("node_id")))


@q("""WITH e AS (SELECT event_type = 'error' AS failed, sum((event_type <> 'error')::INT) OVER (ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS n FROM events)
      SELECT 'all' AS circuit, round(coalesce(sum(pow(0.9, n)) FILTER (WHERE failed), 0), 6) AS error_rate FROM e""")
def win_decay_hot(spark: SparkSession, sf: str) -> DataFrame:
    """Error decay of one group that holds all rows, in ranges."""
    e = t(spark, sf, "events").select(F.lit("all").alias("circuit"), "ts", "event_id", (F.col("event_type") == "error").alias("failed"))
    return metrics.decayed(e, ["circuit"], ["ts", "event_id"], "failed", rows_per_range=HOT_ROWS).withColumn("error_rate", F.round("error_rate", 6))


@q("""WITH w AS (SELECT event_id, avg(value) OVER a AS x, avg(value) OVER b AS y, count(*) OVER c AS n FROM events
        WINDOW a AS (ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING), b AS (ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), c AS (ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
      SELECT event_id, round(CASE WHEN n = 10 THEN y - x END, 6) AS increase FROM w""")
def win_leak_hot(spark: SparkSession, sf: str) -> DataFrame:
    """Moving means over one group that holds all rows, in ranges."""
    e = t(spark, sf, "events").select(F.lit("all").alias("host"), "ts", "event_id", "value")
    return metrics.leak(e, ["host"], ["ts", "event_id"], "value", rows_per_range=HOT_ROWS).select("event_id", F.round("increase", 6).alias("increase"))


# Many parts, exports -----------------------------------------------------------------


@q("""WITH parts AS (SELECT p_name || ' ' || CAST(p_partkey * 25 + i AS VARCHAR) AS part, p_partkey * 25 + i AS k FROM part, range(25) r(i)),
   texts AS (SELECT c_custkey, c_name || ' wants ' || a.part || ' and ' || b.part AS text FROM customer JOIN parts a ON a.k = c_custkey * 37 % 2500 JOIN parts b ON b.k = c_custkey * 11 % 2500 + 100)
   SELECT c_custkey, part FROM texts JOIN parts ON contains(text, part)""")
def jn_contains_many(spark: SparkSession, sf: str) -> DataFrame:
    """Names of parts (25 for each, tens of thousands) in texts of customers, by the index of q-grams."""
    k = (F.col("p_partkey") * 25 + F.col("i")).alias("k")
    parts = t(spark, sf, "part").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(24)))).select(F.concat_ws(" ", "p_name", k).alias("part"), k)
    named = lambda n: parts.select(F.col("part").alias(f"part{n}"), F.col("k").alias(f"k{n}"))
    c = t(spark, sf, "customer").withColumns({"k1": F.col("c_custkey") * 37 % 2500, "k2": F.col("c_custkey") * 11 % 2500 + 100})
    # Spark takes the 25 names of each part for one row, and would broadcast them all.
    texts = c.join(named(1).hint("merge"), "k1").join(named(2).hint("merge"), "k2").select("c_custkey", F.concat(F.col("c_name"), F.lit(" wants "), F.col("part1"), F.lit(" and "), F.col("part2")).alias("text"))
    return contains.contains_join(texts, parts, "text", "part").select("c_custkey", "part")


@q("""SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS price, 'orders' AS title, '1.0' AS version FROM orders""")
def snk_export_footers(spark: SparkSession, sf: str) -> DataFrame:
    """Orders exported in chunks, one of them sent twice, and by a stream in micro-batches; rows and footers read back."""
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    root, pairs = folders.fresh(spark, "export"), {"title": "orders", "version": "1.0"}
    for n in (0, 1, 1):
        footer.write_chunk(o.where(f"o_orderkey % 4 = {n}"), f"{root}/out", f"chunk-{n}", pairs)
    o.where("o_orderkey % 4 > 1").repartition(3).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    footer.write_stream(stream, f"{root}/out", f"{root}/checkpoint", pairs).awaitTermination()
    rows = footer.exported(spark, f"{root}/out").withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    held = footer.footers(spark, f"{root}/out").groupBy(F.element_at(F.split("file", "/"), -1).alias("file"))
    value = lambda k: F.max(F.when(F.col("key") == k, F.col("value"))).alias(k)
    return rows.join(held.agg(value("title"), value("version")), "file").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("price"), "title", "version")


# Sinks, scans and stages, read back ----------------------------------------------------


@q("""SELECT o_orderkey, o_orderstatus, f.form FROM orders, (VALUES ('csv'), ('json'), ('parquet')) f(form)""")
def snk_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written in each format, with nested values as JSON where a format has none."""
    o, out = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.struct("o_custkey").alias("nested")), None
    for form in ("csv", "json", "parquet"):
        path = folders.fresh(spark, form)
        export.write(o, path, form)
        back = spark.read.option("header", True).option("escape", '"').format(form).load(path)
        rows = back.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus", F.lit(form).alias("form"))
        out = rows if out is None else out.unionByName(rows)
    return out


@q("""SELECT c_custkey, c_name AS customer_name, DATE '2024-01-15' AS day, '1.0' AS _meta_schema_version FROM customer""")
def snk_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Many records in a folder for each day."""
    path = folders.fresh(spark, "records")
    rows = parties(spark, sf)
    export.write_batch(rows.withColumn("extraction_data", F.struct(F.col("extraction_data.customer.name").alias("customer_name"))), path)
    return spark.read.parquet(path).select(F.substring("_meta_processing_id", 2, 20).cast("long").alias("c_custkey"), "customer_name", "day", "_meta_schema_version")


@q("""SELECT o_orderkey AS id, round(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END, 2) AS price FROM orders""")
def snk_stream_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Keyed micro-batches of a stream: a third of the orders come again with a new price, newest wins."""
    o, root = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")), folders.fresh(spark, "upserts")
    for rows in (o, o.where("id % 3 = 0").withColumn("price", F.col("price") * 2)):
        rows.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(o.schema).parquet(f"{root}/in")
        export.upsert_stream(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return export.newest(spark.read.parquet(f"{root}/out")).select("id", F.round("price", 2).alias("price"))


@q("""SELECT o_orderkey, o_orderstatus FROM orders""")
def snk_stream(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of orders appended to files."""
    o, root = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), folders.fresh(spark, "stream")
    o.repartition(3).write.parquet(f"{root}/in")
    export.write_stream(spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(o.schema).parquet(f"{root}/out")


@q("""SELECT CAST(s_suppkey AS VARCHAR) AS name, octet_length(encode('<html>' || s_name)) AS n_bytes, 'html' AS format FROM supplier""")
def src_files(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as files, a folder of them read back with their formats."""
    path = folders.fresh(spark, "scan")
    s = t(spark, sf, "supplier").select(F.concat(F.col("s_suppkey").cast("string"), F.lit(".txt")).alias("name"), F.concat(F.lit("<html>"), "s_name").alias("content"))
    blobs.write_files(s, path)
    found = files.read_files(spark, path, "*.txt")
    return found.select(F.regexp_extract("filename", "^(-?[0-9]+)", 1).alias("name"), F.octet_length("content").alias("n_bytes"), F.coalesce("format", F.lit("html")).alias("format"))


@q("""SELECT 'O' || o_orderkey || '_' || stage || '_' || o_orderstatus AS node_id, kind AS node_type, round(CASE WHEN metric THEN o_totalprice / 1000 END, 6) AS seconds, round(CASE WHEN stage = 'storage' THEN 100 / (o_totalprice / 1000) END, 6) AS rate
      FROM orders, (VALUES ('storage', 'storage', true), ('retrieval', 'vector_retrieval', true), ('extraction', 'extraction', true), ('canonical', 'canonical_format', false), ('shaped', 'shaped_transform', true)) s(stage, kind, metric)""")
def lin_stages(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of the later stages with their times and rates."""
    o, out = t(spark, sf, "orders"), None
    for stage in ("storage", "retrieval", "extraction", "canonical", "shaped"):
        seconds = None if stage == "canonical" else F.col("o_totalprice") / 1000
        n = lineage.stage_nodes(o, stage, F.concat(F.lit("O"), "o_orderkey"), F.col("o_orderstatus"), F.col("o_orderdate"), None, seconds, F.lit(100) if stage == "storage" else None)
        out = n if out is None else out.unionByName(n)
    m = F.col("performance_metrics")
    clock = F.coalesce(*[F.try_element_at(m, F.lit(x[2])) for x in lineage.STAGES.values() if x[2]])
    return out.select("node_id", "node_type", F.round(clock, 6).alias("seconds"), F.round(F.try_element_at(m, F.lit("vectors_per_second")), 6).alias("rate"))


@q("""SELECT user_id AS node_id, count(*) AS n_recorded, array_to_string(['ingest', 'index'], ',') AS steps, CAST(max(ts) AS VARCHAR) IS NOT NULL AS kept, arg_max(event_id, (ts, event_id)) AS newest FROM events GROUP BY user_id""")
def lin_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes recorded many times: the newest of each, and a stage's list with one more step."""
    e = t(spark, sf, "events")
    last = lineage.latest(e.select(F.col("user_id").alias("node_id"), F.struct("ts", "event_id").alias("timestamp")))
    n = e.groupBy(F.col("user_id").alias("node_id")).agg(F.count("*").alias("n_recorded"))
    steps = F.array_join(lineage.add_step(F.array(F.lit("ingest")), F.lit("index")), ",")
    return n.join(last, "node_id").select("node_id", "n_recorded", steps.alias("steps"), F.col("timestamp.ts").isNotNull().alias("kept"), F.col("timestamp.event_id").alias("newest"))


@q("""SELECT event_id, s.strategy AS applied, s.strategy IN ('model_fallback', 'data_correction', 'partial_processing') AS success, 'lost ' || event_id AS message FROM events JOIN (VALUES (0, 'graceful_degradation'), (1, 'model_fallback'), (2, 'data_correction'), (3, 'partial_processing'), (4, 'default')) s(k, strategy) ON event_id % 5 = k""")
def str_degradation(spark: SparkSession, sf: str) -> DataFrame:
    """What stands in for a failed result, by strategy."""
    names = F.array(*[F.lit(x) for x in ("graceful_degradation", "model_fallback", "data_correction", "partial_processing", "no_retry")])
    d = metrics.degradation(F.get(names, (F.col("event_id") % 5).cast("int")), F.concat(F.lit("lost "), "event_id"))
    return t(spark, sf, "events").select("event_id", d["degradation_applied"].alias("applied"), d["success"].alias("success"), d["error_message"].alias("message"))
