"""Indexes and stored tables against scans and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom import queries, queries_storage
from docloom.operators import contains, search, validate, vector_index
from docloom.sinks import blobs, footer, keyed, skipping

SF = "/root/testdata/sf0.001"

POINTS = "id long, vector array<float>, page string, kind string"


def points_of(spark, n=3000, dim=12, seed=1, clusters=25):
    """Clusters on a sphere, a third of all points equal, and some that can't be indexed."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    rows = []
    for k in range(n):
        v = centres[0] if k % 3 == 0 else centres[rng.integers(clusters)] + rng.normal(size=dim) * 0.15
        rows.append((k, [float(x) for x in v], f"p{k // 20}", "ab"[k % 2]))
    rows += [(n, None, "p0", "a"), (n + 1, [0.0] * dim, "p0", "a"), (n + 2, [1.0, 2.0], "p0", "a"), (None, [1.0] * dim, "p0", "a"), (n + 3, [float("nan")] * dim, "p0", "a")]
    return spark.createDataFrame(rows, POINTS).repartition(5)


def good(points):
    return points.where("id < 3000")


def asked_of(points):
    return points.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))


def pairs(df):
    return {(r.query_id, r.id) for r in df.collect()}


def test_index_search(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "CHUNK", 256)
    points = points_of(spark)
    index = vector_index.build(points, str(tmp_path / "i"))
    asked = asked_of(good(points)).unionByName(spark.createDataFrame([(-1, None), (-2, [0.0] * 12), (-3, [1.0])], "query_id long, query_vector array<float>"))
    want = pairs(search.top_k(good(points), asked_of(good(points)), 10))
    found = index.search(asked, 10)
    assert len(want & pairs(found)) >= 0.9 * len(want)
    assert pairs(index.search_exact(asked, 10)) == want
    # Ties of the equal points go to the lesser ids, though they fill many parts.
    hot = sorted((r.rank, r.id) for r in found.where("query_id = 0").collect())
    assert [i for _, i in hot] == [3 * k for k in range(10)]
    assert index.table("lists").groupBy("cell").count().agg(F.max("count")).first()[0] > 1
    assert index.table("lists").agg(F.max(F.size("entries"))).first()[0] < 3 * 256
    # Only the cells that are probed are read.
    work = index.work(asked).agg(F.sum("n_codes")).first()[0]
    assert index.work(asked).count() == 30 and work < 0.7 * 30 * 3000
    assert "dynamicpruning" in found._jdf.queryExecution().toString().lower()


def test_candidates_leave_tasks_without_a_row_for_each_cell(spark, tmp_path, monkeypatch):
    """The best by codes of all cells that a query probes; what tasks give grows with queries, not with cells."""
    monkeypatch.setattr(vector_index, "BLOCK", 2)
    index = vector_index.build(points_of(spark), str(tmp_path / "i"))
    asked, given, rank = asked_of(good(points_of(spark))), [], vector_index.ranked
    monkeypatch.setattr(vector_index, "ranked", lambda df, *a: rank(given.append(df) or df, *a))
    found = {(r.query_id, r.id): r.score for r in index.candidates(asked, 3, 20, 15).collect()}
    assert given[0].count() <= 3 * 30 * 15  # before: up to 15 for each of a query's 20 cells
    rows = index.table("vectors").select("id", "cell", F.col("_code").alias("code")).collect()
    near = index.model.decode(np.array([r.cell for r in rows]), np.array([list(r.code) for r in rows], np.uint8))
    for r in asked.collect():
        q = np.array(r.query_vector, float)
        q = (q / np.linalg.norm(q)).astype(np.float32)
        probed = set(np.argsort(-(q @ index.model.centroids.T), kind="stable")[:20].tolist())
        score = {x.id: float(s) for x, s in zip(rows, near @ q) if x.cell in probed}
        mine = {i: s for (k, i), s in found.items() if k == r.query_id}
        assert len(mine) == 15 and all(abs(score[i] - s) < 1e-5 for i, s in mine.items())
        assert np.allclose(sorted(mine.values()), sorted(score.values())[-15:], atol=1e-5)


def test_index_with_a_filter(spark, tmp_path):
    points = points_of(spark)
    index = vector_index.build(points, str(tmp_path / "i"))
    where = F.col("kind") == "b"
    want = pairs(search.top_k(good(points), asked_of(good(points)), 7, where=where))
    assert pairs(index.search_exact(asked_of(good(points)), 7, where)) == want
    assert len(pairs(index.search_where(asked_of(good(points)), where, 7)) & want) >= 0.9 * len(want)


def test_exact_search_multiplies_matrices(spark, tmp_path):
    index = vector_index.build(points_of(spark, 300), str(tmp_path / "i"))
    for where in (None, F.col("kind") == "b"):
        assert "zip_with" not in index.search_exact(asked_of(good(points_of(spark, 300))), 5, where)._jdf.queryExecution().toString()


@pytest.mark.parametrize("chunk", [4096, 8])
def test_late_search(spark, tmp_path, monkeypatch, chunk):
    """Pages in one row or in several; queries of one to four vectors."""
    monkeypatch.setattr(vector_index, "CHUNK", chunk)
    monkeypatch.setattr(vector_index, "BLOCK", 4)
    points = points_of(spark, 1200)
    index = vector_index.build(points, str(tmp_path / "i"), page="page")
    usable = points.where("id < 1200")
    asked = usable.where("id % 37 = 5").select((F.col("id") % 11).alias("query_id"), F.col("id").alias("q_idx"), F.col("vector").alias("query_vector"))
    want = search.max_sim(usable.select(F.col("page").alias("id"), F.col("id").alias("vec_idx"), "vector"), asked, 5)
    key = lambda df: sorted((r.query_id, r.rank, r.id, round(r.score, 6)) for r in df.collect())
    assert key(index.late_search(asked, 5)) == key(want)
    first = index.late_candidates(asked, 5)
    beat = search.ranked(index.late_scores(first, asked), ["query_id"], 5).groupBy("query_id").agg(F.min("score").alias("beat"))
    n = index.late_survivors(asked, beat).count()
    assert n < 0.7 * 60 * asked.select("query_id").distinct().count()


def brute_max_sim(pages, asked, k):
    def cos(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return None
        n = np.sqrt(sum(x * x for x in a)) * np.sqrt(sum(x * x for x in b))
        return None if n == 0 else sum(x * y for x, y in zip(a, b)) / n

    found = {}
    for q in {r[0] for r in asked}:
        for p in {r[0] for r in pages}:
            total = 0.0
            for _, _, a in sorted((r for r in asked if r[0] == q), key=lambda r: r[1]):
                best = [c for c in (cos(a, b) for i, _, b in pages if i == p) if c is not None]
                total += (float("nan") if any(np.isnan(best)) else max(best)) if best else 0.0
            found.setdefault(q, []).append((0 if np.isnan(total) else 1, -round(total, 9), p is not None, p or 0))
    return {(q, p[3] if p[2] else None, n) for q, ps in found.items() for n, p in enumerate(sorted(ps)[:k], 1)}


def test_late_interaction_by_matrices(spark, monkeypatch):
    """chunks of pages meet blocks of queries; nulls, other dimensions, zero, tiny and odd vectors as before."""
    monkeypatch.setattr(search, "CHUNK", 32)
    monkeypatch.setattr(search, "LATE_QUERIES", 8)
    monkeypatch.setattr(search, "BLOCK", 3)
    rng = np.random.default_rng(4)
    vector = lambda d: [float(x) for x in rng.normal(size=d)]
    pages = [(k // 5, k, vector(6)) for k in range(200)] + [(k // 5 + 50, k, v) for k in range(20) for v in [vector(6)] * 2]
    pages += [(60, 0, None), (61, 0, [0.0] * 6), (62, 0, vector(3)), (62, 1, [1.0, None, 2.0]), (63, 0, []), (None, 0, vector(6)), (0, 9, vector(3)), (64, 0, [1e-180] * 6)]
    asked = [(k % 6, k, vector(6)) for k in range(40)] + [(7, 0, None), (8, 0, [0.0] * 6), (9, 0, vector(3)), (9, 1, vector(6)), (10, 0, [1e-180] * 6), (11, 0, [1.0, None, 1.0])]
    both = lambda p, q: search.max_sim(spark.createDataFrame(p, "id long, vec_idx long, vector array<double>").repartition(3), spark.createDataFrame(q, "query_id long, q_idx long, query_vector array<double>"), 4)
    df = both(pages, asked)
    assert "zip_with" not in df._jdf.queryExecution().toString()
    assert {(r.query_id, r.id, r["rank"]) for r in df.collect()} == brute_max_sim(pages, asked, 4)
    odd = [*pages, (70, 0, [float("nan")] * 6)]
    assert {(r.query_id, r.id, r["rank"]) for r in both(odd, asked).collect()} == brute_max_sim(odd, asked, 4)
    assert both([], asked).count() == 0 and both(pages, []).count() == 0


@pytest.mark.parametrize("chunk", [4096, 8])
def test_late_search_by_matrices(spark, tmp_path, monkeypatch, chunk):
    """no pair of vectors is scored by Spark's lambdas, in small chunks and blocks and with pages in several rows."""
    monkeypatch.setattr(vector_index, "CHUNK", chunk)
    for name, n in (("CHUNK", 100), ("LATE_QUERIES", 8), ("BLOCK", 3)):
        monkeypatch.setattr(search, name, n)
    points = good(points_of(spark, 1200)).where("id < 1200")
    index = vector_index.build(points, str(tmp_path / "i"), page="page")
    asked = points.where("id % 31 = 5").select((F.col("id") % 7).alias("query_id"), F.col("id").alias("q_idx"), F.col("vector").alias("query_vector"))
    found = index.late_search(asked, 4)
    assert "zip_with" not in found._jdf.queryExecution().toString()
    held = [(r.page, r.id, r.vector) for r in points.collect()]
    names = {p: n for n, p in enumerate(sorted({p for p, _, _ in held}))}
    want = brute_max_sim([(names[p], i, v) for p, i, v in held], [(r.query_id, r.q_idx, r.query_vector) for r in asked.collect()], 4)
    assert {(r.query_id, names[r.id], r["rank"]) for r in found.collect()} == want


def test_empty_index(spark, tmp_path):
    points = spark.createDataFrame([], POINTS)
    index = vector_index.build(points, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, query_vector array<float>")
    assert index.search(asked).count() == index.search_exact(asked).count() == index.late_search(asked.withColumn("q_idx", F.lit(1))).count() == 0
    few = vector_index.build(spark.createDataFrame([(1, [1.0, 0.0], "p", "a")], POINTS), str(tmp_path / "j"))
    assert [tuple(r) for r in few.search(asked.select("query_id", F.array(F.lit(1.0), F.lit(1.0)).alias("query_vector"))).select("query_id", "id", "rank").collect()] == [(1, 1, 1)]


def test_codes_are_within_their_error():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 10)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for width in (1, 2, 3):
        model = vector_index.Model.fit(x, 900, width, 1)
        cell, code, error, angle = model.encode(x)
        assert code.shape[1] == -(-10 // width) and (np.linalg.norm(x - model.decode(cell, code), axis=1) <= error).all()
        model.radii[:] = [angle[cell == c].max(initial=0) for c in range(len(model.radii))]
        bound = model.bounds(x[:50])
        assert all((x[:50] @ x[cell == c].T <= bound[:, [c]]).all() for c in set(cell.tolist()))
        again = vector_index.Model.unpacked(model.packed())
        assert (again.books == model.books).all() and again.probes == model.probes


# Keyed tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("most", [0, 500_000])
def test_merge_on_read(spark, tmp_path, monkeypatch, most):
    """Batches with repeats, nulls and deletions against a dictionary; compaction and vacuum change nothing."""
    monkeypatch.setattr(keyed, "BROADCAST_KEYS", most)
    rng, schema = random.Random(4), "a long, b string, v double"
    table = keyed.KeyedTable.create(spark, str(tmp_path / "t"), spark.createDataFrame([], schema).schema, ["a", "b"], ["a"], 4)
    assert rows(table.read()) == []
    want = {}
    for n in range(6):
        got = [(rng.choice([None, *range(12)]), rng.choice([None, "x"]), float(rng.randrange(9))) for _ in range(15)]
        df = spark.createDataFrame(got, schema)
        if n == 3:
            assert table.delete(df.select("a", "b"), "w", n)
            for a, b, _ in got:
                want.pop((a, b), None)
        else:
            assert table.upsert(df, "w", n)
            for a, b, v in sorted(got, key=lambda r: r[2]):  # of one key the greatest row
                want[a, b] = v
        assert not table.upsert(df.withColumn("v", F.lit(99.0)), "w", n)
        if n == 2:
            assert table.compact(least=3) == [b for b, d in table.state()["base"].items() if d]
        assert rows(table.read()) == sorted(((*k, v) for k, v in want.items()), key=repr)
    table.compact()
    table.vacuum()
    assert not table.state()["deltas"] and rows(keyed.KeyedTable(spark, str(tmp_path / "t")).read()) == sorted(((*k, v) for k, v in want.items()), key=repr)
    assert table.compact() == [] and len(list((tmp_path / "t" / "log").glob("0*.json"))) == 1


def test_order_of_a_batch_and_failed_attempts(spark, tmp_path):
    table = keyed.KeyedTable.create(spark, str(tmp_path / "t"), spark.createDataFrame([], "k long, v string").schema, ["k"], buckets=2)
    table.upsert(spark.createDataFrame([(1, "new", 2), (1, "old", 1)], "k long, v string, at long"), "w", 0, F.col("at"))
    state = table.state()
    with pytest.raises(RuntimeError):  # another writer took the version
        keyed._commit(spark, table.path, state)
    spark.createDataFrame([(1, "lost", False, 9, 0)], "k long, v string, _gone boolean, _version long, bucket int").write.partitionBy("bucket").parquet(f"{table.path}/rows/v00000002-w-1")
    assert rows(table.read()) == [(1, "new")]
    assert table.upsert(spark.createDataFrame([(2, "b")], "k long, v string"), "w", 1)
    assert rows(table.read()) == [(1, "new"), (2, "b")]
    table.vacuum()
    assert rows(table.read()) == [(1, "new"), (2, "b")]


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = keyed.KeyedTable.create(spark, str(tmp_path / "t"), spark.createDataFrame([], "k long").schema, ["k"], buckets=8)
    table.upsert(spark.range(400).toDF("k"), "w", 0)
    table.compact()
    before = table.state()["base"]
    table.upsert(spark.createDataFrame([(3,)], "k long"), "w", 1)
    assert len(table.compact()) == 1
    after = table.state()["base"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert rows(table.read()) == [(k,) for k in sorted(range(400), key=lambda k: repr((k,)))]


def test_file_index(spark, tmp_path):
    schema = T.StructType().add("path", "string").add("line", "long").add("text", "string")
    index = keyed.FileIndex(spark, str(tmp_path / "i"), schema, ["path", "line"], 4)
    made = []

    def make(new):
        made.append(sorted(r.path for r in new.select("path").collect()))
        return new.select("path", F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("line", "text"))

    state = lambda **files: spark.createDataFrame([(k, v.encode()) for k, v in files.items()], "path string, content binary")
    assert index.sync(state(a="1\n2\n3", b="x", c="y"), make, 1) == {"added": 3}
    assert index.sync(state(a="1\n9", c="y", d="z"), make, 2) == {"added": 1, "changed": 1, "gone": 1}
    assert index.sync(state(a="1\n9", c="y", d="z"), make, 3) == {}
    assert made == [["a", "b", "c"], ["a", "d"]]
    want = [("a", 0, "1"), ("a", 1, "9"), ("c", 0, "y"), ("d", 0, "z")]
    assert rows(index.points.read()) == want
    # A run that ended after the points and before the list of files is done again.
    again = keyed.FileIndex(spark, str(tmp_path / "i"))
    kept = again.files.apply
    again.files.apply = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        again.sync(state(a="new"), make, 4)
    again.files.apply = kept
    assert again.sync(state(a="new"), make, 4) == {"changed": 1, "gone": 2}
    assert rows(again.points.read()) == [("a", 0, "new")] and rows(again.files.read().select("path")) == [("a",)]


# Data skipping


def test_files_of_the_same_rows_are_the_same(spark, monkeypatch):
    """rows that a shuffle brings in another order each time make no changed files."""
    plain = queries_storage.document_files

    def shaken(spark, sf):
        rows = plain(spark, sf)
        return rows.mapInPandas(lambda frames: (f.sample(frac=1) for f in frames), rows.schema)

    monkeypatch.setattr(queries_storage, "document_files", shaken)
    rows = queries_storage.str_incremental_index(spark, SF).collect()
    assert len(rows) > 100
    assert {(r.f, r.version) for r in rows} == {(r.f, 2 if r.f % 7 == 3 or r.f % 5 == 2 else 1) for r in rows}


def test_skipping(spark, tmp_path):
    rng = random.Random(6)
    made = [(k, f"d{k // 40}", rng.choice(["pdf", "html", None]), rng.choice([None, 1, 2, 3, 4]), rng.randrange(0, 2000) if k % 50 else None, rng.randrange(0, 2000), f"2024-01-{k % 28 + 1:02d}") for k in range(2000)]
    df = spark.createDataFrame(made, "id long, document_id string, document_type string, page_number int, patch_x int, patch_y int, processing_timestamp string")
    for name, along in (("a", ("patch_x", "patch_y")), ("b", ("id", "page_number"))):
        table = skipping.write(df, str(tmp_path / name), 100, along)
        for c in (
            {}, {"spatial_box": [0, 0, 100, 100]}, {"document_id": "d7"}, {"document_id": "none"}, {"document_type": "pdf", "page_number": 2}, {"page_number": {"gte": 9}},
            {"processing_timestamp": {"after": "2024-01-27"}, "spatial_box": [500, 500, 700, 2000]}, {"spatial_box": [1, 2]}, {"page_number": {"gte": 2, "lte": 3}, "document_id": "d1"},
        ):
            assert rows(table.read(c)) == rows(df.where(search.payload_filter(c))), c
        r = table.report({"spatial_box": [0, 0, 100, 100]} if name == "a" else {"document_id": "d7"}).first()
        assert r.n_files >= 15 and r.n_read <= 5 and r.n_rows == 2000 and r.n_rows_read <= 700
    empty = skipping.write(df.limit(0), str(tmp_path / "c"))
    assert empty.read({"document_id": "d7"}).count() == 0


# Many parts


@pytest.mark.parametrize("most", [0, 200_000])
def test_contains_join(spark, monkeypatch, most):
    monkeypatch.setattr(contains, "BROADCAST_GRAMS", most)
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcé \U0001f600%") for _ in range(n))
    texts = [(k, word(rng.randrange(0, 30))) for k in range(150)] + [(200, None), (201, ""), (202, "ab" * 5000), (150, "abc"), (151, "abc")]
    parts = [word(rng.randrange(0, 7)) for _ in range(200)] + [None, "", "ab", "ab", "zzz", "abab"]
    df = contains.contains_join(spark.createDataFrame(texts, "k long, t string"), spark.createDataFrame([(p,) for p in parts], "p string"), "t", "p")
    want = sorted((k, t, p) for k, t in texts if t is not None for p in {p for p in parts if p is not None} if p in t)
    assert sorted(tuple(r) for r in df.collect()) == want
    assert "NestedLoop" not in df._jdf.queryExecution().toString() and "CartesianProduct" not in df._jdf.queryExecution().toString()
    none = spark.createDataFrame([], "p string")
    assert contains.contains_join(spark.createDataFrame(texts, "k long, t string"), none, "t", "p").count() == 0


def test_no_names_are_broadcast(spark, monkeypatch):
    """Spark takes the names made of a part for one row; they must be shuffled however small it thinks they are."""
    from docloom.queries_storage import jn_contains_many

    monkeypatch.setattr(contains, "BROADCAST_GRAMS", 0)
    assert "BroadcastExchange" not in jn_contains_many(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_many_rules_are_the_same_rules(spark, monkeypatch):
    fields = spark.createDataFrame([(1, 0, "Invoice_Number_2", "string", "ab", None), (1, 1, "total_x", "int", None, -5.0)], "id long, pos int, path string, tag string, str_val string, num_val double")
    rules = spark.createDataFrame([("invoice", "invoice_number", 3, None, None, None), ("invoice", "total", None, None, 0.0, 9.0), ("other", "total", None, None, 0.0, 9.0)], "document_type string, part string, min_length int, pattern string, min_value double, max_value double")
    few = rows(validate.rule_issues(fields, rules, "Invoice", ["id"]))
    monkeypatch.setattr(validate, "BROADCAST_RULES", 0)
    assert rows(validate.rule_issues(fields, rules, "Invoice", ["id"])) == few and len(few) == 2


# Exports with footers


def test_chunks_once_and_aborts(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(1000).select("id", F.array(F.lit("x")).alias("list"), F.lit(None).cast("string").alias("nothing"))
    for _ in range(2):
        footer.write_chunk(df, path, "a", {"k": "v", "é": 1})
    footer.write_chunk(df.limit(0), path, "empty")
    footer.write_chunk(df.withColumn("id", F.col("id") + 1000), path, "b")
    with pytest.raises(Exception):  # noqa: B017  a task that fails
        footer.write_chunk(df.withColumn("id", F.when(F.col("id") == 900, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id"))), path, "c")
    assert sorted(r.id for r in footer.exported(spark, path).select("id").collect()) == list(range(2000))
    held = footer.manifest(spark, path).collect()
    assert {r.chunk for r in held} == {"a", "b", "empty"} and sum(r.rows or 0 for r in held) == 2000
    pairs = {(r.chunk, r.key, r.value) for r in footer.footers(spark, path).collect() if r.key in ("k", "é")}
    assert pairs == {("a", "k", "v"), ("a", "é", "1")}
    with pytest.raises(Exception):  # noqa: B017
        df.write.format(footer.NAME).option("path", path).mode("overwrite").save()


def test_a_batch_of_a_stream_is_published_once(tmp_path):
    """A micro-batch that comes again leaves the first one's files only."""
    import pyarrow as pa

    w = footer.StreamWriter({"path": str(tmp_path), "metadata": "{}"})
    first, again = (w.write(iter([pa.RecordBatch.from_pydict({"a": [1, 2]})])) for _ in range(2))
    w.commit([first, None], 3)
    w.commit([again], 3)
    lost = w.write(iter([pa.RecordBatch.from_pydict({"a": [9]})]))
    w.abort([lost, None], 4)
    assert len(list((tmp_path / "data").iterdir())) == 1 and len(list((tmp_path / "_manifest").iterdir())) == 1
    assert w.write(iter([])).files == []


def test_scan_in_blocks(spark, monkeypatch):
    """Blocks of any size, broadcast or dealt, give what plain sums of doubles give; the scan is a product of matrices, not a loop in each row."""
    points = points_of(spark, 700).unionByName(spark.createDataFrame([(5000, [1.0, None] * 6, "p", "a"), (5001, [1e-30] * 12, "p", "a")], POINTS))
    asked = asked_of(points.where("id < 700 OR id > 4000").withColumn("id", F.when(F.col("id") > 4000, F.col("id") * 100).otherwise(F.col("id"))))
    rows, wanted = [r for r in points.collect() if r.vector], []
    for q in asked.collect():
        scored = []
        for p in rows:
            if q.query_vector is None or None in q.query_vector + p.vector or len(p.vector) != len(q.query_vector) or not any(p.vector):
                continue
            dot = n = m = 0.0
            for a, b in zip(p.vector, q.query_vector):
                dot, n, m = dot + a * b, n + a * a, m + b * b
            s = dot / (n**0.5 * m**0.5)
            if not s < 0.5:
                scored.append((-float("inf") if s != s else -s, p.id is not None, p.id or 0))
        wanted += [(q.query_id, i if known else None) for _, known, i in sorted(scored)[:7]]
    for broadcast, chunk, block in ((16_384, 2048, 512), (0, 100, 3)):
        monkeypatch.setattr(search, "BROADCAST_QUERIES", broadcast)
        monkeypatch.setattr(search, "CHUNK", chunk)
        monkeypatch.setattr(search, "BLOCK", block)
        found = search.top_k(points, asked, 7, 0.5)
        assert "zip_with" not in found._jdf.queryExecution().toString()
        assert sorted(((r.query_id, r.id) for r in found.collect()), key=str) == sorted(wanted, key=str)


def test_files_of_rows(spark, tmp_path, monkeypatch):
    """suppliers are written by many tasks, a folder for each task and not for each file."""
    monkeypatch.setattr(queries_storage.folders, "fresh", lambda spark, name: str(tmp_path / name))
    n = spark.read.parquet(f"{SF}/supplier.parquet").count()
    assert queries_storage.src_files(spark, SF).count() == n
    made = [d for d in (tmp_path / "scan").iterdir() if d.is_dir()]
    assert 1 < len(made) <= 4 < n
    assert sum(f.suffix == ".txt" for d in made for f in d.iterdir()) == n
    # A name that is there twice or isn't one is an error, and what was written stays hidden.
    for names in (["a", "a"], [None], ["b", "x/y"], ["_c"]):
        with pytest.raises(Exception, match="no name of a file"):
            blobs.write_files(spark.createDataFrame([(x, b"1") for x in names], "name string, content binary"), str(tmp_path / "bad"))
    assert not list((tmp_path / "bad").glob("part=*"))
    blobs.write_files(spark.createDataFrame([("n.txt", None), ("m.txt", b"\xff\x00")], "name string, content binary"), str(tmp_path / "odd"))
    got = {r.filename: bytes(r.content) for r in queries_storage.files.read_files(spark, str(tmp_path / "odd")).collect()}
    assert got == {"m.txt": b"\xff\x00"}  # Spark's reader passes over empty files
    assert [f.stat().st_size for f in (tmp_path / "odd").rglob("n.txt")] == [0]


def test_missing_fields_alone(spark):
    """no other check is planned; only the fields that are asked for are grouped."""
    df = queries.jn_missing_required(spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Suspicious" not in plan and "Window" not in plan and "LeftSemi" in plan
    records = spark.createDataFrame([(1,), (2,), (None,)], "id long")
    fields = spark.createDataFrame([(1, "a"), (1, "z"), (2, "z")], "id long, path string")
    required = spark.createDataFrame([("a",), ("b",), ("b",)], "field string")
    got = validate.missing_required(records, fields, required, ["id"]).collect()
    assert sorted((r.id or 0, r.field_path) for r in got) == [(0, "a"), (0, "b"), (1, "b"), (2, "a"), (2, "b")]
