"""Literal fixtures of the pure functions and small cases of the operators."""

import base64
import datetime
import json

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as fn
from docloom.operators import governance, lineage, metrics, quality, search, shape, validate
from docloom.plans import schema as plans
from docloom.sinks import export
from docloom.sources import files
from docloom.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "f, value, want",
    [
        (fn.pdf_date, "D:20240115103000Z", "2024-01-15T10:30:00"),
        (fn.pdf_date, "D:2024", None),
        (fn.pdf_date, "D:20241345000000", None),
        (fn.exif_date, "2024:01:05 10:20:30", "2024-01-05T10:20:30"),
        (fn.exif_date, "2024-01-05 10:20:30", None),
        (fn.html_date, "01/05/2024", "2024-01-05T00:00:00"),
        (fn.html_date, "25/12/2024", "2024-12-25T00:00:00"),
        (fn.html_date, "soon", None),
        (fn.html_title, "<TITLE> a b </TITLE>", "a b"),
        (fn.html_title, "<p>", None),
        (fn.html_pages, "x" * 5000, 1),
        (fn.html_pages, "x" * 5001, 1),
        (fn.html_pages, "x" * 6000, 2),
        (fn.html_pages, "x" * 9000, 3),
        (fn.html_author, '<meta charset="u"><META NAME="author" content=" Ann ">', "Ann"),
        (fn.html_created, '<meta name="date" content="2024-01-05 10:20:30">', "2024-01-05T10:20:30"),
        (lambda c: fn.html_dimensions(c)["width"], '<meta name="viewport" content="width=640, scale=1">', 640.0),
        (lambda c: fn.html_dimensions(c)["width"], "<p>", 1200.0),
        (lambda c: fn.format_by_signature(c.cast("binary")), "PK..xl/worksheets", "excel"),
        (lambda c: fn.format_by_signature(c.cast("binary")), "words", None),
        (fn.html_text, "<p>a</p><script>x</script>b<br>c", "a" + "b\nc"),
        (fn.pascal_case, "line-items", "LineItems"),
        (validate.is_placeholder, "N/A", True),
        (validate.is_placeholder, "xx", False),
        (validate.is_placeholder, "samples", False),
        (validate.is_error_text, "annulled", True),
        (validate.is_error_text, "could not extract", True),
        (fn.draft_number, "http://json-schema.org/draft-07/schema#", 7),
        (fn.mime_of_name, "/a/b.PDF", "application/pdf"),
    ],
)
def test_functions(spark, f, value, want):
    assert one(spark, f(F.lit(value))) == want


def test_error_classes(spark):
    of = lambda m: one(spark, metrics.classify(F.lit(m), F.lit("X")))["category"]
    assert [of(m) for m in ("rate limit exceeded", "HTTP 429", "connection timeout", "dns down")] == ["unknown", "rate_limit", "timeout", "transient_network"]


def test_retry_delays(spark):
    s = F.lit("exponential_backoff")
    assert [one(spark, metrics.retry_delay(s, F.lit(float(n)))) for n in (1, 2, 3, 9)] == [1, 2, 4, 60]
    assert one(spark, metrics.retry_delay(s, F.lit(1.0), recovery=F.lit(30.0))) == 15


def test_patch_grid(spark):
    cells = [one(spark, F.struct(*search.patch_grid(F.lit(5), F.lit(i)))) for i in range(5)]
    assert [tuple(c) for c in cells] == [(0, 0), (32, 0), (64, 0), (0, 32), (32, 32)]


def test_touching_rectangles_do_not_overlap(spark):
    a = spark.createDataFrame([(0, 0, 32, 32)], "ax int, ay int, aw int, ah int")
    b = spark.createDataFrame([(32, 0, 32, 32), (31, 0, 32, 32)], "bx int, by int, bw int, bh int")
    assert [r.bx for r in search.overlap_join(a, b).collect()] == [31]


def test_a_bin_of_many_pairs_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(search, "PAIRS", 100, raising=False)
    a = spark.range(90).select("id", (F.col("id") % 50).cast("int").alias("ax"), F.lit(0).alias("ay"), F.lit(20).alias("aw"), F.lit(9).alias("ah"))
    b = spark.range(80).select(F.col("id").alias("other"), (F.col("id") % 70).cast("int").alias("bx"), F.lit(5).alias("by"), F.lit(9).alias("bw"), F.lit(9).alias("bh"))
    found = search.overlap_join(a, b)
    want = sorted((i, j) for i in range(90) for j in range(80) if i % 50 < j % 70 + 9 and j % 70 < i % 50 + 20)
    assert sorted((r.id, r.other) for r in found.collect()) == want
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 10


def test_zero_vectors_have_no_score(spark):
    p = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 1.0])], "id long, vector array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, query_vector array<float>")
    assert [(r.id, round(r.score, 4)) for r in search.top_k(p, q, 2).orderBy("rank").collect()] == [(2, 1.0), (3, 0.7071)]


def test_flatten_names(spark):
    data = 'named_struct("customer", named_struct("name", "A", "address", named_struct("city", "B")), "order_items", array(named_struct("product", "p", "quantity", 1), named_struct("product", "q", "quantity", 2)))'
    df = spark.range(1).select(F.lit("p1").alias("processing_id"), F.expr(data).alias("extraction_data"))
    want = ["customer_name", "customer_address_city", "order_items_0_product", "order_items_0_quantity", "order_items_1_product", "order_items_1_quantity"]
    assert list(shape.flatten(df, "extraction_data")) == want
    assert shape.shaped(df).first()["_shaped_id"] == "p1_shaped"
    assert [r.key for r in shape.flatten_long(df, "extraction_data", []).collect()] == want


def test_compat_hash_is_python_json(spark):
    import hashlib

    df = spark.createDataFrame([("p", datetime.datetime(2024, 1, 15, 10, 30), 1.5)], "processing_id string, ts timestamp_ntz, total double")
    rec = shape.canonical(df, F.col("processing_id"), F.struct("total"), F.col("ts"))
    body = {"processing_id": "p", "extraction_data": {"total": 1.5}, "timestamp": "2024-01-15T10:30:00", "schema_version": "1.0", "confidence_scores": None}
    assert shape.compat_hash(rec).first()["integrity_hash"] == hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()


def test_rule_registry():
    rules = shape.Rules()
    with pytest.raises(ValueError):
        rules.apply(None, "none")
    rules.register(shape.Rule("a", "filter"))
    assert rules.available() == ["a"]


def test_bool_is_an_int(spark):
    assert one(spark, validate.accepts(F.lit("integer"), F.lit("bool"))) and not one(spark, validate.accepts(F.lit("float"), F.lit("int")))


def test_cycles_end(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "parent_id string, child_id string")
    found = {(r.node_id, r.other_id) for r in lineage.closure(e).collect()}
    assert found == {(x, y) for x in "abc" for y in "abc"}
    isolated = spark.createDataFrame([("z",)], "node_id string")
    assert lineage.shortest_paths(e, spark.createDataFrame([("a",)], "node_id string"), isolated).count() == 0


def test_repeated_nodes_keep_one_edge(spark):
    at = F.lit("2024-01-01")
    n = lineage.stage_nodes(spark.range(2), "conversion", F.lit("p"), F.lit("x"), at, F.lit("s"))
    assert lineage.edges(n).count() == 1 and lineage.latest(n).count() == 1


def test_registry_of_rules(spark):
    r = governance.Registry(governance.shaped_rules())
    assert r.enable("transform_001", False) and "transform_001" not in {x.rule_id for x in r.active()}
    assert r.unregister("transform_002") and not r.unregister("transform_002")
    failed = governance.results(spark.range(1), [governance.Rule("n", "integrity", "error", F.lit(None).cast("boolean"))], ["id"]).first()
    assert failed["passed"] is False


def test_grades(spark):
    of = lambda x: one(spark, quality.grade(F.lit(x)))
    assert [of(x) for x in (0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.5)] == ["A+", "A", "B+", "B", "C+", "C", "F"]


def test_precision(spark):
    rows = [(True, True)] * 80 + [(False, True)] * 10 + [(True, False)] * 5 + [(False, False)] * 5
    r = metrics.confusion(spark.createDataFrame(rows, "a boolean, p boolean"), [], F.col("a"), F.col("p")).first()
    assert (round(r.precision, 3), round(r.recall, 3), r.accuracy) == (0.889, 0.941, 0.85)


def test_index_percentiles(spark):
    df = spark.range(20).withColumn("g", F.lit(1))
    assert metrics.index_percentile(df, ["g"], "id", 0.5).first()["value"] == 10
    assert metrics.index_percentile(df, ["g"], "id", 0.95).first()["value"] == 19


def test_constant_trend_is_certain(spark):
    df = spark.createDataFrame([(1, k, 0.5) for k in range(4)], "g int, k int, s double")
    r = quality.trends(df, ["g"], ["k"], "s", 30).first()
    assert (r.direction, r.confidence, r.change_rate) == ("stable", 1.0, 0.0)


# Schemas


def test_schema_codes():
    bad = {"properties": {"a": {"type": "null"}, "b": {"type": "array"}, "class": {"type": "string"}, "123x": {"type": "string"}}}
    r = plans.validated(bad)
    assert {"MISSING_TYPE", "UNSUPPORTED_TYPE", "MISSING_ARRAY_ITEMS", "RESERVED_KEYWORD_PROPERTY", "INVALID_PROPERTY_NAME"} <= r.codes()
    assert r.migration_required and r.level == "limited_compatibility"
    good = {"type": "object", "properties": {"a": {"type": "integer"}}}
    assert plans.validated(good).level == "fully_compatible" and plans.validated(good).effort == "low"
    assert plans.validated("x").level == "incompatible"
    deep = {"type": "object", "properties": {"x": {"type": "string"}}}
    for _ in range(12):
        deep = {"type": "object", "properties": {"n": deep}}
    assert "EXCESSIVE_NESTING_DEPTH" in plans.validated(deep).codes()
    wide = {"type": "object", "properties": {"rows": {"type": "array", "items": {"type": "object", "properties": {f"p{k}": {"type": "string"} for k in range(15)}}}}}
    assert "LARGE_ARRAY_OBJECTS" in plans.validated(wide).codes()
    assert plans.migration_plan(r)[0]["step"] == 1


def test_schema_fix_leaves_the_input():
    schema = {"properties": {"a": {"type": "integer"}, "b": {"type": "array"}, "class": {"type": "string"}}}
    before = json.dumps(schema)
    out, done = plans.fixed(schema)
    assert json.dumps(schema) == before and len(done) == 4
    assert out["type"] == "object" and out["properties"]["a"]["type"] == "int" and "class_value" in out["properties"]


def test_functions_of_schemas():
    f = plans.function({"title": "shipping-manifest", "type": "object", "properties": {"total": {"type": "number"}, "rows": {"type": "array", "items": {"type": "object", "properties": {"cell": {"type": "string"}}}}}})
    assert f["name"] == "ExtractShippingManifest" and f["strategy"] in plans.HINTS
    issues, warnings, score = plans.function_issues(f)
    assert not issues and not warnings and score == 100
    assert plans.function_issues({"name": "x"})[0]
    with pytest.raises(ValueError):
        plans.function({"type": "array"})


def test_client_config():
    text = 'client<llm> Fast {\n  provider openai\n  options {\n    model "m-1"\n  }\n}\n'
    assert files.client_config(text) == [{"name": "Fast", "provider": "openai", "options": {"model": "m-1"}}]


# Files, sinks, streams


def test_files_to_pages(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"<html><body>" + b"word " * 1000 + b"</body></html>")
    (tmp_path / "b.png").write_bytes(b"\x89PNG\r\n\x1a\nxx")
    (tmp_path / "c.txt").write_bytes(b"plain")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4")
    found = files.read_files(spark, str(tmp_path))
    assert {r.filename: r.format for r in found.collect()} == {"a.html": "html", "b.png": "image", "c.txt": None, "d.pdf": "pdf"}
    adapters = files.Adapters()
    pages = {(r.filename, r.page_number) for r in adapters.pages(found).collect()}
    assert pages == {("a.html", 1), ("a.html", 2), ("b.png", None)}
    assert adapters.pages(found, 0).count() == 0

    def broken(content, most):
        raise ValueError("bad file")

    adapters.register("pdf", broken)
    assert [r.error for r in adapters.pages(found.where("format = 'pdf'")).collect()] == ["ValueError: bad file"]


def test_requests(spark):
    good = json.dumps({"document": base64.b64encode(b"abc").decode(), "schema": "{}"})
    df = spark.createDataFrame([(1, good), (2, "{}"), (3, "x"), (4, None)], "id int, body string")
    rows = {r.id: r for r in files.requests(df).collect()}
    assert bytes(rows[1].content) == b"abc" and rows[1].error is None
    assert [rows[k].error for k in (2, 3, 4)] == ["Missing required field: document", "Invalid JSON", "Invalid JSON"]


def test_exports(spark, tmp_path):
    rec = spark.createDataFrame([("p", "v", [1, 2])], "processing_id string, field string, items array<int>")
    export.write(rec, f"{tmp_path}/c", "csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").first()["items"] == "[1,2]"
    export.write(export.with_file_metadata(rec, {"schema_version": "1.0"}), f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").schema["processing_id"].metadata["schema_version"] == "1.0"
    with pytest.raises(ValueError):
        export.write(rec, f"{tmp_path}/x", "xml")


def test_uneven_arrays_stay_one_row(spark):
    df = spark.createDataFrame([(1, ([1, 2], ["a", "b"])), (2, ([1], ["a", "b"]))], "id int, r struct<x:array<int>,y:array<string>>")
    assert sorted(r.id for r in export.tabular(df, "r", ["id"]).collect()) == [1, 1, 2]


def test_collection(spark):
    c = export.Collection(spark, "points_test")
    c.delete()
    p = spark.createDataFrame([(1, [1.0], "pdf")], "id long, vector array<float>, document_type string")
    assert c.create(p) and not c.create(p) and c.exists()
    c.append(p)
    assert c.info().first()["points_count"] == 2 and c.create(p, recreate=True)
    c.delete()
    assert not c.exists()


def test_index_stream_is_incremental(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    adapters = files.Adapters()

    def run():
        stream = files.stream_files(spark, str(src))
        embed = lambda pages: pages.select(F.concat_ws("#", "filename", "page_number").alias("id"), jobs.stub_embedding(F.col("image")).alias("vector"))
        jobs.index(stream, adapters.pages, embed, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
        return sorted(r.id for r in export.newest(spark.read.parquet(f"{tmp_path}/out")).collect())

    (src / "a.html").write_bytes(b"<html>one")
    assert run() == ["a.html#1"]
    (src / "b.html").write_bytes(b"<html>two")
    assert run() == ["a.html#1", "b.html#1"]


def test_stream_windows_and_export(spark, tmp_path):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 0, m), "a", float(m)) for m in range(0, 50, 10)], "ts timestamp, g string, v double")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    export.write_stream(stream, f"{tmp_path}/csv", f"{tmp_path}/ck1", "csv").awaitTermination()
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 5
    w = jobs.tumbling(stream, "ts", "20 minutes", "1 minute", ["g"], F.count("*").alias("n"))
    q = w.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("w").collect()) == [1, 2, 2]
    assert jobs.sliding(df, "ts", "20 minutes", "10 minutes", "1 minute", ["g"], F.count("*").alias("n")).count() == 6


def test_circuit_breaker(spark):
    b = jobs.Breaker()
    seen = [b.step(float(k), False) for k in range(6)]
    assert [s for _, s in seen] == ["closed"] * 4 + ["open", "open"] and seen[5][0] is False
    assert b.step(70.0, True) == (True, "half_open") and b.step(71.0, True) == (True, "closed")
    rows = [("x", k, float(k), False) for k in range(6)] + [("y", 9, 0.0, True)]
    out = {r.event_id: (r.allowed, r.state) for r in jobs.breaker(spark.createDataFrame(rows, "circuit string, event_id long, at double, ok boolean")).collect()}
    assert out[5] == (False, "open") and out[9] == (True, "closed")


def test_breaker_stream(spark, tmp_path):
    rows = [("x", k, float(k), False) for k in range(6)]
    df = spark.createDataFrame(rows, "circuit string, event_id long, at double, ok boolean")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = jobs.breaker_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    s.writeStream.format("memory").queryName("br").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert {r.event_id: r.state for r in spark.table("br").collect()}[5] == "open"


def test_memoised_runs_only_what_is_missing(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, x string")
    run = lambda d: d.select("_key", F.upper("x").alias("result"))
    out, made = jobs.memoised(df, None, F.col("x"), run)
    assert made.count() == 2 and {r.id: r.result for r in out.collect()} == {1: "A", 2: "B", 3: "A"}
    _, more = jobs.memoised(df, made, F.col("x"), run)
    assert more.count() == 0
    _, other = jobs.memoised(df, made, F.col("x"), run, version=2)
    assert other.count() == 2


def test_degradation_and_responses(spark):
    d = one(spark, metrics.degradation(F.lit("model_fallback"), F.lit("m")))
    assert d["success"] and d["degradation_applied"] == "model_fallback"
    assert one(spark, metrics.degradation(F.lit(None).cast("string"), F.lit("m")))["degradation_applied"] == "default"
    assert json.loads(one(spark, export.error_response(F.lit(400), F.lit("bad"), F.lit("E")))["body"]) == {"error": {"type": "E", "message": "bad"}}


def test_own_validators_and_stream_metrics(spark, tmp_path):
    from docloom.streaming.monitor import Metrics, log_line

    fields = spark.createDataFrame([(1, 0, "a", "string", "x", None)], "id int, pos int, path string, tag string, str_val string, num_val double")
    own = lambda f: validate.issues(f, ["id"], "own", "info", "seen")
    assert [r.issue_type for r in validate.quality_issues(fields, ["id"], validators=[own]).collect()] == ["own"]
    m = Metrics(keep=2)
    spark.streams.addListener(m)
    try:
        spark.range(3).write.parquet(f"{tmp_path}/in")
        s = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
        s.writeStream.format("noop").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.streams.removeListener(m)
    m.put(("q", 5, None, 1, None, None, None))
    assert len(m.rows) <= 2 and 1 <= m.table(spark).count() <= 2
    assert json.loads(log_line("info", "x", n=1)) == {"level": "info", "message": "x", "n": 1}


def test_failed_models_keep_their_rows(spark):
    from docloom.operators import extract

    def broken(pages, prompt):
        raise RuntimeError("out of tokens")

    pages = spark.createDataFrame([("d", 1, b"x"), ("d", 2, b"y")], "document_id string, page_number int, image binary")
    schema = {"title": "r", "type": "object", "required": ["a"], "properties": {"a": {"type": "string"}}}
    out = extract.process(pages, schema, {"m": broken}, ["m"], F.lit("2024-01-01"))
    assert out["canonical"].first()["extraction_data"] is None and out["answers"].first()["attempts"] == 2
    assert out["scores"].first()["is_valid"] is False
    good = extract.process(pages, schema, {"m": broken, "s": extract.stub(["a"])}, ["m", "s"], F.lit("2024-01-01"))
    r = good["answers"].first()
    assert r["success"] and r["fallback_applied"] and r["client"] == "s"
    assert good["scores"].first()["is_valid"] is True and good["shaped"].first()["a"]


def test_queries_pass_whole_texts(spark, tmp_path, monkeypatch):
    from docloom import queries

    spark.createDataFrame([(k, "x" * 5000, "en") for k in range(8)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = {}

    def spy(owner, name, look):
        f = getattr(owner, name)
        monkeypatch.setattr(owner, name, lambda first, *a, **b: (seen.__setitem__(name, look(first)), f(first, *a, **b))[1])

    spy(queries.files, "requests", lambda df: df.selectExpr("max(length(body))").first()[0])
    spy(queries.extract, "process", lambda df: df.selectExpr("min(length(image))").first()[0])
    spy(queries.fn, "coerced", str)
    queries.src_requests(spark, str(tmp_path))
    queries.run_extraction(spark, str(tmp_path))
    queries.prj_model_output(spark, str(tmp_path))
    assert seen["requests"] > 6000 and seen["process"] > 5000 and "substring" not in seen["coerced"]
