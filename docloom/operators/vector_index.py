"""An inverted-file index for cosine search, and late interaction with bounds, as Parquet tables.

``build`` fits centroids (spherical k-means) and a product quantiser on a bounded sample:
the SAMPLE points whose ids hash least. Every point that has a direction is then assigned to its nearest
centroid's cell and coded, ``width`` dimensions a byte, beside the length of its coding error.
An index is a folder of tables: ``model`` (one row), ``lists`` (cell, part: ids and codes of
up to about CHUNK points in one row) and ``vectors`` (one row a point, with its payload); the last two
have a folder for each cell, so a query reads the cells that it probes and no others. A cell with a third of all
points is many parts, dealt to many tasks. Where points belong to pages there are also ``inverted`` (cell, page) and
``pages`` (the cells, codes, errors and vectors of a page in rows of about CHUNK, in folders of pages).

``search`` probes the cells nearest to each query, scores codes there (blocks of queries beside parts of the lists), and holds the best
``rerank`` of each query against their vectors exactly. How many cells it probes is measured
on the sample when the index is built (REACHED of the ten nearest). ``search_exact`` uses a cell's radius: a cell
whose best conceivable score is below the k-th score that ``search`` found can hold none of the
k nearest, all others are scored; its result is that of the full scan.

``late_search`` does the same for pages of many vectors, in chunks of whole pages: a page whose upper bound by its
cells is below the k-th score that a task has found is dropped, the others are multiplied in single precision and what
may be among the best is scored in doubles. ``late_candidates`` (by lists from cells to pages), ``late_survivors`` (by bounds of
cells and codes) and ``late_scores`` give the same for single pairs, as rows: for few queries.

Queries go to tasks in blocks of BLOCK, so neither queries nor lists are broadcast whole. Edge
cases: points without id or vector, of length zero or of another dimension than most of the sample are not indexed, as they have no
score; a query without a direction has no result; ties go to the lesser id; ids must be
unique; an empty table makes an index without cells, in which every search is empty.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from docloom.operators import search
from docloom.operators.search import cosine, norm, ranked
from docloom.sinks import folders

#: Points that centroids and codes are fitted on; most of them for the quantiser.
SAMPLE, CODED = 20_000, 8192
#: Most cells, and points of a row of the lists.
CELLS, CHUNK = 4096, 4096
#: Queries that meet a row of the lists at once.
BLOCK = 256
#: Cells that give an exact search a score to beat.
FIRST = 4
#: Share of the ten nearest neighbours within the sample that the probed cells must hold.
REACHED = 0.97
#: What exact scores may differ by from those of single precision.
SLACK = 1e-4


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, sphere: bool = False) -> np.ndarray:
    """k centres of rows; on the unit sphere if asked for. Empty centres are put on far points."""
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = x @ c.T - (0 if sphere else (c * c).sum(1) / 2)
        at = near.argmax(1)
        n = np.bincount(at, minlength=k)
        total = np.stack([np.bincount(at, weights=x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)
        c = total / np.maximum(n, 1)[:, None]
        lost = np.flatnonzero(n == 0)
        if len(lost):
            c[lost] = x[np.argsort(near.max(1))[: len(lost)]] if len(lost) <= len(x) else x[rng.choice(len(x), len(lost))]
        if sphere:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-30)
    return c.astype(np.float32)


class Model:
    """Centroids, code books of ``width`` dimensions each, radii of cells (angles) and cells to probe."""

    def __init__(self, centroids: np.ndarray, books: np.ndarray, width: int, probes: int, radii: np.ndarray) -> None:
        self.centroids, self.books, self.width, self.probes, self.radii = centroids, books, width, probes, radii

    @classmethod
    def fit(cls, x: np.ndarray, total: int, width: int, seed: int) -> Model:
        rng = np.random.default_rng(seed)
        dim = x.shape[1]
        k = int(max(1, min(CELLS, total**0.5, len(x) // 8)))
        centroids = kmeans(x, k, 12, rng, sphere=True)
        rest = (x - centroids[(x @ centroids.T).argmax(1)])[:CODED]
        books = np.zeros((-(-dim // width), 256, width), np.float32)
        padded = np.pad(rest, ((0, 0), (0, books.shape[0] * width - dim)))
        for j in range(books.shape[0]):
            part = padded[:, j * width : (j + 1) * width]
            books[j] = np.linspace(part.min(), part.max(), 256, dtype=np.float32)[:, None] if width == 1 else kmeans(part, 256, 6, rng)
        asked = x[rng.choice(len(x), min(256, len(x)), replace=False)]
        near = np.argsort(-(asked @ x.T), axis=1)[:, 1:11]
        at = (x @ centroids.T).argmax(1)
        order = np.argsort(np.argsort(-(asked @ centroids.T), axis=1), axis=1)
        places = np.sort(np.take_along_axis(order, at[near], axis=1).ravel())
        probes = int(places[min(len(places) - 1, int(REACHED * len(places)))]) + 1 if len(places) else k
        return cls(centroids, books, width, probes, np.zeros(k, np.float32))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cell, code, error's length, angle to the centroid) of unit vectors."""
        near = x @ self.centroids.T
        cell = near.argmax(1)
        rest = x - self.centroids[cell]
        m, _, w = self.books.shape
        padded = np.pad(rest, ((0, 0), (0, m * w - x.shape[1])))
        code = np.empty((len(x), m), np.uint8)
        for j in range(m):
            part, book = padded[:, j * w : (j + 1) * w], self.books[j]
            if w == 1:
                step = max((book[-1, 0] - book[0, 0]) / 255, 1e-30)
                code[:, j] = np.clip(np.rint((part[:, 0] - book[0, 0]) / step), 0, 255)
            else:
                code[:, j] = (part @ book.T - (book * book).sum(1) / 2).argmax(1)
        error = np.linalg.norm(x - self.decode(cell, code), axis=1) + 1e-6
        return cell, code, error, np.arccos(np.clip(np.take_along_axis(near, cell[:, None], 1)[:, 0], -1, 1))

    def decode(self, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
        m = self.books.shape[0]
        rest = self.books[np.arange(m), code].reshape(len(code), -1)
        return self.centroids[cell] + rest[:, : self.centroids.shape[1]]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The best cosine that a point of each cell can have with each unit query."""
        angle = np.arccos(np.clip(q @ self.centroids.T, -1, 1))
        return np.cos(np.maximum(0, angle - self.radii)) + SLACK

    def nearest(self, q: np.ndarray, most: int) -> np.ndarray:
        """The ``most`` cells nearest to each unit query."""
        return np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, :most]

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, centroids=self.centroids, books=self.books, width=self.width, probes=self.probes, radii=self.radii)
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Model:
        z = np.load(io.BytesIO(data))
        return cls(z["centroids"], z["books"], int(z["width"]), int(z["probes"]), z["radii"])


class Nearest:
    """The ``most`` best (score, then lesser id) of each of ``n`` queries among what was put in; about 4 * n * most rows are held."""

    def __init__(self, n: int, most: int) -> None:
        self.n, self.most, self.least, self.parts, self.size = n, most, np.full(n, -np.inf, np.float32), [], 0

    def put(self, queries: np.ndarray, cell: int, ids: pa.Array, score: np.ndarray) -> None:
        """Scores of points of a cell, a row for each of ``queries``."""
        row, point = np.nonzero(score >= self.least[queries][:, None])
        self.parts.append(pa.table({"query": pa.array(queries[row]), "id": ids.take(pa.array(point)), "cell": pa.array(np.full(len(row), cell), pa.int32()), "score": pa.array(score[row, point], pa.float32())}))
        self.size += len(row)
        if self.size > 4 * self.n * self.most:
            self.cut()

    def cut(self) -> None:
        held = pa.concat_tables(self.parts)
        held = held.take(pc.sort_indices(held, sort_keys=[("query", "ascending"), ("score", "descending"), ("id", "ascending")])).combine_chunks()
        query = held.column("query").to_numpy()
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = np.flatnonzero(place == self.most - 1)
        self.least[query[last]] = held.column("score").to_numpy()[last]
        held = held.filter(pa.array(place < self.most))
        self.parts, self.size = [held], held.num_rows

    def rows(self, names: pa.Array) -> pa.RecordBatch:
        """(query_id, id, cell, score) of the best."""
        self.cut()
        query, *rest = (self.parts[0].column(c).combine_chunks() for c in ("query", "id", "cell", "score"))
        return pa.RecordBatch.from_arrays([names.take(query), *rest], names=["query_id", "id", "cell", "score"])


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column (all of one length, no nulls) as unit vectors."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def usable(points: DataFrame, vector: str, *named: str) -> DataFrame:
    """Rows that have names and a direction."""
    out = points.where((norm(F.col(vector)) > 0) & (norm(F.col(vector)) < float("inf")))
    for c in named:
        out = out.where(F.col(c).isNotNull())
    return out


def build(points: DataFrame, path: str, width: int | None = None, page: str | None = None, seed: int = 1) -> Index:
    """Index ``points`` (id, vector, payload...) in a new folder. ``page`` names a column whose values are pages of many vectors.

    A byte codes two dimensions, or one where bounds are to be tight enough for late interaction.
    """
    spark, width = points.sparkSession, width or (1 if page else 2)
    rows = usable(points, "vector", "id", *([page] if page else []))
    taken = rows.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow()["vector"].combine_chunks()
    if not len(taken):
        spark.createDataFrame([(None, page)], "model binary, page string").write.parquet(f"{path}/model")
        return Index(spark, path)
    sizes = np.array([len(v) for v in taken.to_pylist()])
    dim = int(np.bincount(sizes).argmax())
    model = Model.fit(matrix(taken.filter(pa.array(sizes == dim))), rows.count(), width, seed)
    shared = spark.sparkContext.broadcast(model.packed())
    names = points.columns
    added = T.StructType([*points.schema.fields]).add("_cell", "integer").add("_code", "binary").add("_error", "float").add("_angle", "float")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Model.unpacked(shared.value)
        for batch in batches:
            if batch.num_rows:
                cell, code, error, angle = held.encode(matrix(batch.column("vector")))
                made = [pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error, pa.float32()), pa.array(angle, pa.float32())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*names, "_cell", "_code", "_error", "_angle"])

    rows.where(F.size("vector") == dim).mapInArrow(run, added).write.parquet(f"{path}/coded")
    coded = spark.read.schema(added).parquet(f"{path}/coded")
    cells = coded.groupBy("_cell").agg(F.count("*").alias("n"), F.max("_angle").alias("r")).collect()  # a row for each cell, at most CELLS
    for c in cells:
        model.radii[c["_cell"]] = c["r"] + SLACK
    parts = {c["_cell"]: -(-c["n"] // CHUNK) for c in cells}
    whole = F.create_map(*[F.lit(x) for k, n in parts.items() if n > 1 for x in (k, n)]) if any(n > 1 for n in parts.values()) else None
    n_parts = F.lit(1) if whole is None else F.coalesce(F.try_element_at(whole, F.col("_cell")), F.lit(1))
    dealt = coded.withColumn("_part", F.pmod(F.xxhash64("id"), n_parts.cast("long")).cast("int")).withColumnRenamed("_cell", "cell").drop("_angle")
    entry = F.struct("id", F.col("_code").alias("code"))
    lists = dealt.groupBy("cell", "_part").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    lists.repartitionByRange("cell", "_part").write.partitionBy("cell").parquet(f"{path}/lists")
    dealt.repartitionByRange("cell", "_part").sortWithinPartitions("cell", "id").drop("_part").write.partitionBy("cell").parquet(f"{path}/vectors")
    if page:
        held = F.struct("cell", F.col("_code").alias("code"), F.col("_error").alias("error"), "vector")
        many = dealt.groupBy(page).agg(F.count("*").alias("_n")).where(F.col("_n") > CHUNK)
        segments = F.coalesce(F.ceil(F.col("_n") / CHUNK), F.lit(1))
        bucket = F.pmod(F.xxhash64(page), F.lit(min(CELLS, 1 + sum(c["n"] for c in cells) // (4 * CHUNK))))
        dealt.select("cell", bucket.cast("int").alias("bucket"), F.col(page).alias("page")).distinct().repartitionByRange("cell", "page").write.partitionBy("cell").parquet(f"{path}/inverted")
        rows = dealt.join(many, page, "left").withColumns({"segments": segments, "_segment": F.pmod(F.xxhash64("id"), segments), "bucket": bucket.cast("int")})
        whole = rows.groupBy("bucket", F.col(page).alias("page"), "segments", "_segment").agg(F.collect_list(held).alias("e"))
        whole.select("bucket", "page", "segments", "e.cell", "e.code", "e.error", F.col("e.vector").alias("vectors")).repartitionByRange("bucket", "page").write.partitionBy("bucket").parquet(f"{path}/pages")
    spark.createDataFrame([(bytearray(model.packed()), page)], "model binary, page string").write.parquet(f"{path}/model")
    folders.delete(spark, f"{path}/coded")
    return Index(spark, path)


class Index:
    """An index that ``build`` has written."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        data, self.page = spark.read.parquet(f"{path}/model").select("model", "page").first()
        self.model = None if data is None else Model.unpacked(bytes(data))
        self._shared = spark.sparkContext.broadcast(None if data is None else bytes(data))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def asked(self, queries: DataFrame) -> DataFrame:
        """Queries that have a direction of the index's dimension."""
        return usable(queries, "query_vector", "query_id").where(F.size("query_vector") == self.model.centroids.shape[1])

    def probes(self, queries: DataFrame, probes: int | None = None, beat: str | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
        """(query_id, query_vector, ..., cell, near): the nearest cells of each query, or all that can hold a score of column ``beat``."""
        shared, most = self._shared, min(probes or self.model.probes, len(self.model.centroids))
        kept = ["query_id", "query_vector", *extra]
        rows = self.asked(queries).select(*kept, *([beat] if beat else []))
        schema = T.StructType([rows.schema[c] for c in kept]).add("cell", "integer").add("near", "float")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = Model.unpacked(shared.value)
            for whole in batches:
                for k in range(0, whole.num_rows, BLOCK):
                    batch = whole.slice(k, BLOCK)
                    q = matrix(batch.column("query_vector"))
                    near = q @ model.centroids.T
                    if beat is None:
                        cell = np.argsort(-near, axis=1, kind="stable")[:, :most]
                        row, cell = np.repeat(np.arange(len(q)), most), cell.ravel()
                    else:
                        least = np.array(batch.column(beat).to_numpy(zero_copy_only=False), float)
                        row, cell = np.nonzero(model.bounds(q) >= least[:, None])
                    out = batch.select(kept).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(cell, pa.int32()), pa.array(near[row, cell], pa.float32())], names=[*kept, "cell", "near"])

        return rows.mapInArrow(run, schema)

    def work(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """(query_id, n_codes): how many points a search of each query looks at."""
        sizes = self.table("vectors").groupBy("cell").agg(F.count("*").alias("n")).collect()  # a row for each cell, at most CELLS
        shared, most, rows = self._shared, self._probed(probes), self.asked(queries).select("query_id", "query_vector")
        points = np.zeros(len(self.model.centroids), np.int64)
        for r in sizes:
            points[r["cell"]] = r["n"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = Model.unpacked(shared.value)
            for whole in batches:
                for k in range(0, whole.num_rows, BLOCK):
                    batch = whole.slice(k, BLOCK)
                    n = points[model.nearest(matrix(batch.column("query_vector")), most)].sum(1)
                    yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array(n, pa.int64())], names=["query_id", "n_codes"])

        return rows.mapInArrow(run, T.StructType([rows.schema["query_id"]]).add("n_codes", "long"))

    def _cells(self, queries: DataFrame, probes: int | None) -> DataFrame:
        """(cell): those that any query probes, at most CELLS rows."""
        shared, most = self._shared, self._probed(probes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = Model.unpacked(shared.value)
            for whole in batches:
                for k in range(0, whole.num_rows, BLOCK):
                    cells = np.unique(model.nearest(matrix(whole.slice(k, BLOCK).column("query_vector")), most))
                    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32())], names=["cell"])

        return self.asked(queries).select("query_vector").mapInArrow(run, "cell int").distinct()

    def _probed(self, probes: int | None) -> int:
        return min(probes or self.model.probes, len(self.model.centroids))

    def candidates(self, queries: DataFrame, k: int, probes: int | None = None, rerank: int | None = None) -> DataFrame:
        """(query_id, id, cell, score): the best by their codes in the probed cells.

        Blocks of queries meet parts of the lists; a task gives ``rerank`` rows for each of its queries, however many cells these probe.
        """
        rerank, shared, most, spark = rerank or max(200, 20 * k), self._shared, self._probed(probes), self.spark
        lists = self.table("lists").select("cell", "entries.id", "entries.code")
        read = lists.join(F.broadcast(self._cells(queries, probes)), "cell", "left_semi")
        asked = self.asked(queries).select("query_id", F.transform("query_vector", lambda x: x.cast("float")).alias("query_vector"))
        blocks = search.in_chunks(asked, ["query_id", "query_vector"], BLOCK, "block").withColumnRenamed("entries", "asked")
        n_blocks = -(-asked.count() // BLOCK) or 1
        parts = max(-(-4 * spark.sparkContext.defaultParallelism // n_blocks), -(-lists.count() // CHUNK), 1)
        search.small_batches(spark)
        # Each partition of blocks beside each of lists: neither is broadcast, and a query is in as many tasks as lists have parts.
        met = blocks.join(read.repartition(parts, "cell").hint("shuffle_replicate_nl"))
        kinds = {"query_id": queries.schema["query_id"].dataType, "id": lists.schema["id"].dataType.elementType}
        schema = T.StructType([T.StructField(c, kind) for c, kind in kinds.items()]).add("cell", "integer").add("score", "float")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = Model.unpacked(shared.value)
            at = names = q = probed = held = None
            for batch in batches:
                for block, cell, ids, codes, asked in zip(*(batch.column(c) for c in ("block", "cell", "id", "code", "asked"))):
                    if block.as_py() != at:  # rows of a block stand together
                        if held is not None and held.parts:
                            yield held.rows(names)
                        at, names, q = block.as_py(), asked.values.field("query_id"), matrix(asked.values.field("query_vector"))
                        probed, held = np.zeros((len(q), len(model.centroids)), bool), Nearest(len(q), rerank)
                        np.put_along_axis(probed, model.nearest(q, most), True, axis=1)
                    cell, ids = cell.as_py(), ids.values
                    some = np.flatnonzero(probed[:, cell])
                    if len(some):
                        code = np.frombuffer(b"".join(codes.as_py()), np.uint8).reshape(len(ids), -1)
                        held.put(some, cell, ids, q[some] @ model.decode(np.full(len(ids), cell), code).T)
            if held is not None and held.parts:
                yield held.rows(names)

        return ranked(met.mapInArrow(run, schema), ["query_id"], rerank).drop("rank")

    def rescored(self, pairs: DataFrame, queries: DataFrame, k: int, threshold: float = 0.0) -> DataFrame:
        """(query_id, id, score, rank) of (query_id, id, cell) by the vectors themselves."""
        named = self.asked(queries).select("query_id", "query_vector")
        met = pairs.select("query_id", "id", "cell").join(self.table("vectors").select("cell", "id", "vector"), ["cell", "id"]).join(named, "query_id")
        scored = met.select("query_id", "id", cosine(F.col("vector"), F.col("query_vector")).alias("score"))
        return ranked(scored.where(F.col("score") >= threshold), ["query_id"], k)

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, rerank: int | None = None, threshold: float = 0.0) -> DataFrame:
        """(query_id, id, score, rank): the k nearest among the points of the probed cells."""
        if self.model is None:
            return _nothing(queries)
        return self.rescored(self.candidates(queries, k, probes, rerank), queries, k, threshold)

    def search_where(self, queries: DataFrame, where: Column, k: int = 10, probes: int | None = None, threshold: float = 0.0) -> DataFrame:
        """The same among points whose payload fits: the filter and the cells reach the scan, what is left is scored exactly."""
        if self.model is None:
            return _nothing(queries)
        most, cells = min(probes or self.model.probes, len(self.model.centroids)), self.probes(queries, probes).select("cell").distinct()
        fit = self.table("vectors").where(where).join(F.broadcast(cells), "cell", "left_semi")  # at most CELLS rows

        def least(near: np.ndarray, radii: np.ndarray, cell: int, beat: np.ndarray) -> np.ndarray:
            return np.where((near > near[:, [cell]]).sum(1) < most, -np.inf, np.inf)

        return self._scanned(fit, self.asked(queries).withColumn("beat", F.lit(threshold)), k, threshold, least)

    def search_exact(self, queries: DataFrame, k: int = 10, where: Column | None = None, threshold: float = 0.0) -> DataFrame:
        """What a scan of all points gives: every cell that can hold one of the k nearest is scored."""
        if self.model is None:
            return _nothing(queries)
        first = self.search_where(queries, F.lit(True) if where is None else where, k, FIRST, threshold)
        beat = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(threshold).alias("beat"))
        asked = self.asked(queries).join(beat, "query_id", "left").withColumn("beat", F.coalesce("beat", F.lit(threshold)).cast("double"))
        rows = self.table("vectors")

        def least(near: np.ndarray, radii: np.ndarray, cell: int, beat: np.ndarray) -> np.ndarray:
            bound = np.cos(np.maximum(0, np.arccos(np.clip(near[:, cell], -1, 1)) - radii[cell])) + SLACK
            return np.where(bound >= beat, beat, np.inf)

        return self._scanned(rows if where is None else rows.where(where), asked, k, threshold, least)

    def _scanned(self, rows: DataFrame, asked: DataFrame, k: int, threshold: float, least) -> DataFrame:
        """(query_id, id, score, rank): queries (query_id, query_vector, beat) against the cells' points, in chunks and blocks.

        ``least`` gives the score that is worth looking at in a cell, infinite where the query leaves the cell out.
        """
        shared, held = self._shared, {}

        def extra(mark: dict, block: int, entries: pa.StructArray, q: search.Vectors) -> np.ndarray:
            if "model" not in held:
                held["model"] = Model.unpacked(shared.value)
            if held.get("block") != block:
                held["block"], held["near"] = block, q.unit @ held["model"].centroids.T
            return least(held["near"], held["model"].radii, mark["cell"], entries.field("beat").to_numpy(zero_copy_only=False)[q.at])

        names = asked.select("query_id", search.numbers(asked, "query_vector").alias("query_vector"), "beat")
        blocks = search.in_chunks(names, ["query_id", "query_vector", "beat"], search.BLOCK, "block").withColumnRenamed("entries", "asked")
        points = rows.select("cell", "id", search.numbers(rows, "vector").alias("vector"))
        met = search.together(search.in_chunks(points, ["id", "vector"], search.CHUNK, "chunk", ["cell"]), blocks, names.count())
        return ranked(search.best_pairs(met, k, threshold, extra), ["query_id"], k)

    # Late interaction.

    def late_search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """(query_id, id, score, rank): the k pages with the greatest sums of best matches, exactly.

        ``queries`` is (query_id, q_idx, query_vector), some vectors for each query.
        """
        if self.model is None:
            return _nothing(queries)
        return ranked(self._late_whole(queries, k).unionByName(self._late_split(queries)), ["query_id"], k)

    def _late_blocks(self, queries: DataFrame) -> DataFrame:
        """(block, asked): about LATE_QUERIES vectors in a row, those of a query in the same."""
        asked = self.asked(queries).select("query_id", "q_idx", search.numbers(queries, "query_vector").alias("query_vector"))
        return search.kept_whole(asked, "query_id", ["query_id", "q_idx", "query_vector"], search.LATE_QUERIES, "block").withColumnRenamed("entries", "asked")

    def _late_whole(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, id, score) of the pages in one row that are among the k best of a query in their task.

        Chunks of pages meet blocks of queries. A page whose cells' bounds don't reach what the task has found goes; the
        others are multiplied in single precision, and what may be among the best then is scored in doubles. Bounds by codes
        would cost the same product.
        """
        shared, pages = self._shared, self.table("pages").where("segments = 1")
        each = pages.select(F.col("page").alias("id"), F.explode(F.arrays_zip("cell", "vectors")).alias("_p"))
        points = each.select("id", "_p.cell", F.col("_p.vectors").alias("vector"))
        points = points.withColumn("vector", search.numbers(points, "vector"))
        met = search.together(search.kept_whole(points, "id", ["id", "cell", "vector"], search.CHUNK, "chunk"), self._late_blocks(queries), queries.count())
        schema = T.StructType([queries.schema["query_id"], points.schema["id"]]).add("score", "double")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = Model.unpacked(shared.value)
            held: dict[int, search.Best] = {}
            at = chunk = None
            for batch in batches:
                for row in range(batch.num_rows):
                    mark, block = batch.column("chunk")[row].as_py(), batch.column("block")[row].as_py()
                    if mark != at:
                        at, chunk = mark, search.Groups(batch.column("entries")[row].values, "id", "vector", "cell", ("cell",))
                    one = search.Groups(batch.column("asked")[row].values, "query_id", "query_vector", "q_idx")
                    best = held.setdefault(block, search.Best(len(one.sizes), k, -np.inf))
                    least = best.top[:, 0]
                    if (least > -np.inf).all():
                        maybe = (late_bounds(model, one, chunk) >= least[:, None]).any(0)
                        if not maybe.any():
                            continue
                        near = np.full((len(one.sizes), len(chunk.sizes)), -np.inf)
                        near[:, maybe] = search.near_sums(one, chunk if maybe.all() else chunk.only(maybe))
                    else:
                        near = search.near_sums(one, chunk)
                    query, page = best.better(near, search.SLACK * one.sizes)
                    score = np.array([search.exact_sum(one, q, chunk, p) for q, p in zip(query.tolist(), page.tolist())], float)
                    kept = best.put(query, page, score)
                    if len(kept):
                        yield pa.RecordBatch.from_arrays([one.names.take(pa.array(query[kept])), chunk.names.take(pa.array(page[kept])), pa.array(score[kept])], names=["query_id", "id", "score"])

        return met.mapInArrow(run, schema)

    def _late_split(self, queries: DataFrame) -> DataFrame:
        """(query_id, id, score) of the pages in several rows: each row's best match of each vector, then their greatest."""
        rows = self.table("pages").where("segments > 1").select(F.col("page").alias("id"), "vectors")
        rows = rows.withColumn("vectors", rows["vectors"].cast("array<array<double>>"))
        met = search.together(rows, self._late_blocks(queries), queries.count()).select("id", "vectors", "asked")
        schema = T.StructType([queries.schema["query_id"], rows.schema["id"]]).add("q", "integer").add("best", "double")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    one = search.Groups(batch.column("asked")[row].values, "query_id", "query_vector", "q_idx")
                    for dim, p in search.vectors_of(batch.column("vectors")[row].values).items():
                        if dim not in one.by_dim:
                            continue
                        q = one.by_dim[dim]
                        most, tiny = np.full(len(q.at), -np.inf), q.norm.min() * p.norm.min() == 0
                        for low in range(0, len(q.at), search.BLOCK):
                            near = q.unit[low : low + search.BLOCK] @ p.unit.T
                            which, other = np.nonzero(~(near < (near.max(1) - 2 * search.SLACK)[:, None]) | tiny)
                            real = q.norm[which + low] * p.norm[other] != 0  # a quotient by zero is null
                            which, other = which[real] + low, other[real]
                            np.maximum.at(most, which, q.cosines(which, p, other))
                        some = ~(most == -np.inf)
                        at, most = q.at[some], most[some]
                        names = one.names.take(pa.array(one.of[at]))
                        ids = batch.column("id").take(pa.array([row] * len(names)))
                        yield pa.RecordBatch.from_arrays([names, ids, pa.array(at - one.starts[one.of[at]], pa.int32()), pa.array(most)], names=["query_id", "id", "q", "best"])

        best = met.mapInArrow(run, schema).groupBy("query_id", "id", "q").agg(F.max("best").alias("best"))
        return best.groupBy("query_id", "id").agg(F.sum("best").alias("score"))

    def late_candidates(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, bucket, page): 4 k pages of the lists of the probed cells, by what their centroids promise."""
        near = self.probes(queries, probes, extra=("q_idx",)).select("query_id", "q_idx", "cell", "near")
        hits = near.join(self.table("inverted"), "cell").groupBy("query_id", "bucket", "page", "q_idx").agg(F.max("near").alias("near"))
        promise = hits.groupBy("query_id", "bucket", F.col("page").alias("id")).agg(F.sum("near").alias("score"))
        return ranked(promise, ["query_id"], 4 * k).select("query_id", "bucket", F.col("id").alias("page"))

    def late_survivors(self, queries: DataFrame, beat: DataFrame) -> DataFrame:
        """(query_id, bucket, page): pages whose upper bound reaches the query's score to beat.

        A page's bound is the sum, over the query's vectors, of the best bound of its cells; where that isn't enough,
        of its best code plus that code's error. Pages in several rows add up their best.
        """
        shared = self._shared
        one = F.struct("q_idx", F.transform("query_vector", lambda x: x.cast("float")).alias("v"))
        whole = self.asked(queries).groupBy("query_id").agg(F.collect_list(one).alias("vectors")).join(beat, "query_id", "left").withColumn("beat", F.coalesce("beat", F.lit(float("-inf"))))
        n = whole.count()
        blocks = -(-n // BLOCK) or 1
        dealt = whole.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("_block")).agg(F.collect_list(F.struct("query_id", "vectors", "beat")).alias("asked"))
        pages = self.table("pages").select("bucket", "page", "segments", "cell", "code", "error")
        met = pages.join(F.broadcast(dealt), F.lit(True)) if blocks == 1 else pages.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(dealt, "_block")
        columns = ["bucket", "page", "segments", "cell", "code", "error", "asked"]
        rows = met.select(*columns)
        schema = T.StructType([queries.schema["query_id"], T.StructField("bucket", T.IntegerType()), T.StructField("page", pages.schema["page"].dataType)]).add("q", "integer").add("best", "double").add("beat", "double")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = Model.unpacked(shared.value)
            known: dict[bytes, tuple] = {}
            for batch in batches:
                out: list[tuple] = []
                for bucket, page, segments, cell, code, error, asked in zip(*(batch.column(c) for c in columns)):
                    a, at = asked.values, (bucket.as_py(), page.as_py())
                    key = repr(a.field("query_id").to_pylist()).encode()
                    if key not in known:
                        known.clear()
                        q = matrix(a.field("vectors").flatten().field("v"))
                        sizes = np.array([len(x) for x in a.field("vectors").to_pylist()])
                        known[key] = q, model.bounds(q), np.cumsum(sizes) - sizes, sizes, a.field("query_id").to_pylist(), a.field("beat").to_numpy(zero_copy_only=False)
                    q, bound, starts, sizes, names, least = known[key]
                    cell, error = cell.values.to_numpy(), error.values.to_numpy()
                    x = model.decode(cell, np.frombuffer(b"".join(code.as_py()), np.uint8).reshape(len(cell), -1))
                    if segments.as_py() > 1:  # the bound of a page in several rows is known only when they meet
                        best = (q @ x.T + error).max(1) + SLACK
                        row = np.repeat(np.arange(len(names)), sizes)
                        out += [(names[r], *at, int(i - starts[r]), float(best[i]), float(least[r])) for i, r in enumerate(row.tolist())]
                        continue
                    first = np.add.reduceat(bound[:, np.unique(cell)].max(1).astype(float), starts)
                    maybe = np.flatnonzero(first >= least)
                    if len(maybe):
                        wanted = np.concatenate([np.arange(starts[r], starts[r] + sizes[r]) for r in maybe])
                        best = (q[wanted] @ x.T + error).max(1).astype(float) + SLACK
                        ends = np.cumsum(sizes[maybe])
                        total = np.add.reduceat(best, ends - sizes[maybe])
                        out += [(names[r], *at, 0, float(s), float(least[r])) for r, s in zip(maybe.tolist(), total) if s >= least[r]]
                if out:
                    kinds = [to_arrow_type(f.dataType) for f in schema]
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=[f.name for f in schema])

        best = rows.mapInArrow(run, schema).groupBy("query_id", "bucket", "page", "q").agg(F.max("best").alias("best"), F.max("beat").alias("beat"))
        total = best.groupBy("query_id", "bucket", "page").agg(F.sum("best").alias("best"), F.max("beat").alias("beat"))
        return total.where(F.col("best") >= F.col("beat")).select("query_id", "bucket", "page")

    def late_scores(self, pairs: DataFrame, queries: DataFrame) -> DataFrame:
        """(query_id, id, score) of (query_id, bucket, page) by the vectors themselves, in the folders of these pages."""
        named = self.asked(queries).select("query_id", "q_idx", "query_vector")
        held = pairs.join(self.table("pages").select("bucket", "page", "vectors"), ["bucket", "page"])
        met = held.select("query_id", "page", F.explode("vectors").alias("vector")).join(named, "query_id")
        best = met.groupBy("query_id", "page", "q_idx").agg(F.max(cosine(F.col("vector"), F.col("query_vector"))).alias("best"))
        return best.groupBy("query_id", F.col("page").alias("id")).agg(F.sum("best").alias("score"))


def late_bounds(model: Model, asked: search.Groups, pages: search.Groups) -> np.ndarray:
    """Of each query and page the sum of the best bounds of its cells."""
    (q,), (p,) = asked.by_dim.values(), pages.by_dim.values()
    cell, at = np.unique(pages.extra["cell"].to_numpy(zero_copy_only=False)[p.at], return_inverse=True)
    of = pages.of[p.at]
    has = np.zeros((len(pages.sizes), len(cell)), bool)
    has[of, at] = True
    page, which = np.nonzero(has)
    starts = np.flatnonzero(np.r_[True, page[1:] != page[:-1]])
    total = np.zeros((len(asked.sizes), len(pages.sizes)))
    for low in range(0, len(q.at), search.BLOCK):
        bound = model.bounds(q.unit[low : low + search.BLOCK])[:, cell]
        best = np.maximum.reduceat(bound[:, which], starts, axis=1).astype(np.float64)
        groups, first = np.unique(asked.of[q.at[low : low + search.BLOCK]], return_index=True)
        total[groups] += np.add.reduceat(best, first, axis=0)
    return total


def _nothing(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank")).where(F.lit(False))
