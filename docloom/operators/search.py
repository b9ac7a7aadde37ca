"""Vector search over points: exact cosine top-k, multi-vector scores, filters and storage.

Points are a table with ``id`` and ``vector`` (any dimension) and payload columns. Queries
are a table too. Both are put in rows of many vectors, which are multiplied as matrices; the
queries are broadcast only while they are within BROADCAST_QUERIES. A top-k keeps k rows for
each query and task before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query vectors that are broadcast at once.
BROADCAST_QUERIES = 16_384
#: Query vectors of a block of late interaction.
LATE_QUERIES = 2048
#: Points and queries of a row.
CHUNK, BLOCK = 2048, 512
#: Bytes that go to a Python worker at once.
BATCH_BYTES = 1 << 24
#: Pairs of rectangles of one slice of a bin, and most tasks for them.
PAIRS, TASKS = 20_000_000, 4000
#: What scores of single precision may be wrong by.
SLACK = 1e-5
#: Pixels of a patch (fixed value).
PATCH = 32
REQUIRED_PAYLOAD = ["document_id", "page_number", "document_type", "processing_timestamp"]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def payload_filter(conditions: dict) -> Column:
    """All conditions together: equalities, an inclusive page range, an inclusive box, later than a time.

    A box that hasn't four numbers is passed over.
    """
    out = F.lit(True)
    for name in ("document_id", "document_type"):
        if conditions.get(name) is not None:
            out = out & (F.col(name) == conditions[name])
    page = conditions.get("page_number")
    if isinstance(page, dict):
        if page.get("gte") is not None:
            out = out & (F.col("page_number") >= page["gte"])
        if page.get("lte") is not None:
            out = out & (F.col("page_number") <= page["lte"])
    elif page is not None:
        out = out & (F.col("page_number") == page)
    box = conditions.get("spatial_box")
    if box is not None and len(box) == 4:
        x1, y1, x2, y2 = box
        out = out & F.col("patch_x").between(x1, x2) & F.col("patch_y").between(y1, y2)
    after = (conditions.get("processing_timestamp") or {}).get("after")
    return out & (F.col("processing_timestamp") > after) if after is not None else out


def small_batches(spark: SparkSession) -> None:
    """At most BATCH_BYTES, about, go to a Python worker at once: rows are whole chunks here. The setting stays, as plans run later."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key)
    if not held.lstrip("-").isdigit() or not 0 < int(held) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def in_chunks(rows: DataFrame, entry: list[str], size: int, name: str, by: list[str] = ()) -> DataFrame:
    """(by..., name, entries): about ``size`` rows of one group put in one row, dealt to tasks by a hash of the whole entry."""
    spark = rows.sparkSession
    if by:
        n = rows.groupBy(*by).agg(F.count("*").alias("_n")).withColumn("_n", F.ceil(F.col("_n") / size))
        total = n.agg(F.sum("_n")).first()[0] or 1
        rows, parts = rows.join(F.broadcast(n), by), F.col("_n")
    else:
        total = -(-rows.count() // size) or 1
        parts = F.lit(total)
    dealt = rows.select(*by, F.struct(*entry).alias("_e"), F.pmod(F.xxhash64(*entry), parts).alias(name))
    # A number of partitions that is asked for stays as it is: small tables, much work.
    dealt = dealt.repartition(max(1, min(total, 4 * spark.sparkContext.defaultParallelism)), *by, name)
    return dealt.groupBy(*by, name).agg(F.collect_list("_e").alias("entries"))


def numbers(df: DataFrame, column: str) -> Column:
    """A vector column as floats or doubles."""
    kind = df.schema[column].dataType.elementType.simpleString()
    return F.col(column) if kind in ("float", "double") else F.col(column).cast("array<double>")


class Vectors:
    """Vectors of one dimension that have a direction: their places in the row, doubles, norms as ``norm`` has them, and directions in single precision."""

    def __init__(self, at: np.ndarray, x: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            total = np.zeros(len(x))
            for j in range(x.shape[1]):
                total += x[:, j] * x[:, j]
            kept = ~(np.sqrt(total) <= 0)
            self.at, self.norm, self.zero = at[kept], np.sqrt(total)[kept], at[~kept]
            self.columns = np.ascontiguousarray(x[kept].T)
            # What has no finite length is never ruled out, only scored.
            self.unit = np.where(np.isfinite(self.norm)[:, None], x[kept] / self.norm[:, None], np.nan).astype(np.float32)

    def taken(self, which: np.ndarray) -> Vectors:
        out = object.__new__(Vectors)
        out.at, out.norm, out.columns, out.unit, out.zero = self.at[which], self.norm[which], np.ascontiguousarray(self.columns[:, which]), self.unit[which], self.zero
        return out

    def first_copies(self, k: int) -> Vectors:
        """Without those that k equal ones come before."""
        rows = np.ascontiguousarray(self.columns.T)
        _, same = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_inverse=True)
        order = np.argsort(same, kind="stable")
        starts = np.r_[0, np.flatnonzero(np.diff(same[order])) + 1]
        place = np.empty(len(same), np.int64)
        place[order] = np.arange(len(same)) - np.repeat(starts, np.diff(np.r_[starts, len(same)]))
        return self if (place < k).all() else self.taken(np.flatnonzero(place < k))

    def cosines(self, which: np.ndarray, other: Vectors, others: np.ndarray) -> np.ndarray:
        """Those of ``cosine``, added in its order; NaN where it is null, too."""
        total = np.zeros(len(which))
        with np.errstate(all="ignore"):
            for a, b in zip(self.columns, other.columns):
                total += a[which] * b[others]
            return total / (self.norm[which] * other.norm[others])


def vectors_of(column: pa.Array) -> dict[int, Vectors]:
    """The vectors of a list column by dimension; those with a null in them are left out."""
    flat, sizes = column.flatten(), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    x, ends, usable = flat.to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(sizes), sizes > 0
    if flat.null_count:
        usable &= ~np.isin(np.arange(len(sizes)), np.repeat(np.arange(len(sizes)), sizes)[flat.is_null().to_numpy(zero_copy_only=False)])
    out = {}
    for dim in np.unique(sizes[usable]).tolist():
        at = np.flatnonzero(usable & (sizes == dim))
        out[dim] = Vectors(at, x[(ends[at] - dim)[:, None] + np.arange(dim)])
    return out


class Best:
    """Scores of the k best of each query of a block among the points that a task has met."""

    def __init__(self, n: int, k: int, threshold: float) -> None:
        self.k, self.top, self.least, self.new = k, np.full((n, k), -np.inf), np.full(n, threshold), True

    def better(self, near: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) of those that may be among the k best, by rounded scores; NaN counts as the greatest, as in SQL."""
        bound = np.maximum(self.least, self.top[:, 0]) - slack
        if self.new and near.shape[1] > self.k:
            bound = np.fmax(bound, np.partition(near, near.shape[1] - self.k, axis=1)[:, near.shape[1] - self.k] - 2 * slack)
        self.new = False
        return np.nonzero(~(near < bound[:, None].astype(np.float32)))

    def put(self, query: np.ndarray, point: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Places of those that are among the k best now; of equal scores the first points."""
        value = np.where(np.isnan(score), np.inf, score)
        fit = np.flatnonzero(value >= np.maximum(self.least, self.top[:, 0])[query])
        order = fit[np.lexsort((point[fit], -value[fit], query[fit]))]
        of = query[order]
        starts = np.searchsorted(of, of)
        rank = np.arange(len(of)) - starts
        order, of, rank = order[rank < self.k], of[rank < self.k], rank[rank < self.k]
        some = np.full(self.top.shape, -np.inf)
        some[of, rank] = value[order]
        self.top = np.sort(np.concatenate([self.top, some], axis=1), axis=1)[:, -self.k :]
        return order[value[order] >= self.top[of, 0]]


def together(chunks: DataFrame, blocks: DataFrame, n_queries: int) -> DataFrame:
    """Every chunk of points beside every block of queries; these are broadcast if they are few, else both are dealt."""
    small_batches(chunks.sparkSession)
    return chunks.crossJoin(F.broadcast(blocks) if n_queries <= BROADCAST_QUERIES else blocks)


def top_k(points: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.0, where: Column | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k most similar points of each query, ties by id.

    ``queries`` is (query_id, query_vector). Every chunk of points meets every block of queries as a product of
    matrices in single precision; what that doesn't rule out is scored in doubles, and only what is among the best k
    of its query so far leaves a task.
    """
    if where is not None:
        points = points.where(where)
    base = points.select("id", numbers(points, "vector").alias("vector")).where("vector IS NOT NULL")
    asked = queries.select("query_id", numbers(queries, "query_vector").alias("query_vector")).where("query_vector IS NOT NULL")
    blocks = in_chunks(asked, ["query_id", "query_vector"], BLOCK, "block").withColumnRenamed("entries", "asked")
    met = together(in_chunks(base, ["id", "vector"], CHUNK, "chunk"), blocks, asked.count())
    return ranked(best_pairs(met, k, threshold), ["query_id"], k)


def best_pairs(met: DataFrame, k: int, threshold: float, extra=None) -> DataFrame:
    """(query_id, id, score) of rows (chunk, entries, block, asked): those that are among a query's best k in their task.

    ``extra(row, block, asked, queries)`` may give the least score for each query that is worth looking at, infinite where none is.
    """
    kinds = {"query_id": met.schema["asked"].dataType.elementType["query_id"].dataType, "id": met.schema["entries"].dataType.elementType["id"].dataType}
    schema = T.StructType([T.StructField(c, kind) for c, kind in kinds.items()]).add("score", "double")
    marks = [c for c in met.columns if c not in ("entries", "asked", "block")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Best] = {}
        at = ids = points = None
        for batch in batches:
            for row in range(batch.num_rows):
                mark = {c: batch.column(c)[row].as_py() for c in marks}
                if mark != at:
                    entries = batch.column("entries")[row].values
                    order = pc.array_sort_indices(entries.field("id"), null_placement="at_start")
                    at, ids = mark, entries.field("id").take(order)
                    points = {d: v.first_copies(k) for d, v in vectors_of(entries.field("vector").take(order)).items()}
                asked, block = batch.column("asked")[row].values, batch.column("block")[row].as_py()
                for dim, q in vectors_of(asked.field("query_vector")).items():
                    if dim not in points or not len(q.at) or not len(points[dim].at):
                        continue
                    p = points[dim]
                    best = held.setdefault((block, dim), Best(len(q.at), k, threshold))
                    near = q.unit @ p.unit.T
                    if extra is not None:
                        least = extra(mark, block, asked, q)
                        near[near < (least - SLACK)[:, None]] = -np.inf
                        if not (near > -np.inf).any():
                            continue
                    query, point = best.better(near, SLACK)
                    if extra is not None:
                        inside = near[query, point] != -np.inf
                        query, point = query[inside], point[inside]
                    score = p.cosines(point, q, query)
                    with np.errstate(all="ignore"):  # a quotient by zero is null
                        real = p.norm[point] * q.norm[query] != 0
                    query, point, score = query[real], point[real], score[real]
                    kept = best.put(query, point, score)
                    if len(kept):
                        names = asked.field("query_id").take(pa.array(q.at[query[kept]]))
                        yield pa.RecordBatch.from_arrays([names, ids.take(pa.array(p.at[point[kept]])), pa.array(score[kept])], names=["query_id", "id", "score"])

    return met.mapInArrow(run, schema)


def ranked(scored: DataFrame, by: list[str], k: int) -> DataFrame:
    """Best k rows of each group by score, then id. Spark keeps k of a group in each task first."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def kept_whole(rows: DataFrame, key: str, entry: list[str], size: int, name: str) -> DataFrame:
    """(name, entries): about ``size`` rows put in one row, all rows of one key in the same."""
    total = -(-rows.count() // size) or 1
    dealt = rows.select(F.struct(*entry).alias("_e"), F.pmod(F.xxhash64(key), F.lit(total)).alias(name))
    dealt = dealt.repartition(max(1, min(total, 4 * rows.sparkSession.sparkContext.defaultParallelism)), name)
    return dealt.groupBy(name).agg(F.collect_list("_e").alias("entries"))


class Groups:
    """Vectors in the order of their groups (pages or queries): where each group begins, and its vectors by dimension."""

    def __init__(self, entries: pa.Array, key: str, vector: str, within: str | None = None, extra: tuple[str, ...] = ()) -> None:
        orders = [(key, "ascending")] + ([(within, "ascending")] if within else [])
        names = entries.field(key)
        columns = {key: names} | ({within: entries.field(within)} if within else {})
        order = pc.sort_indices(pa.table(columns), sort_keys=orders, null_placement="at_start")
        names = names.take(order)
        changes = np.ones(len(names), bool)
        if len(names) > 1:
            a, b = names.slice(0, len(names) - 1), names.slice(1)
            same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False))
            changes[1:] = ~same
        self.starts = np.flatnonzero(changes)
        self.of = np.cumsum(changes) - 1
        self.sizes = np.diff(np.r_[self.starts, len(names)])
        self.names = names.take(pa.array(self.starts))
        self.by_dim = vectors_of(entries.field(vector).take(order))
        self.extra = {c: entries.field(c).take(order) for c in extra}

    def only(self, wanted: np.ndarray) -> Groups:
        """Some of the groups, numbered anew; only what :func:`near_sums` needs."""
        out, number = object.__new__(Groups), np.cumsum(wanted) - 1
        out.sizes, out.of = self.sizes[wanted], np.where(wanted[self.of], number[self.of], -1)
        out.by_dim = {d: v.taken(np.flatnonzero(wanted[self.of[v.at]])) for d, v in self.by_dim.items()}
        for v in out.by_dim.values():
            v.zero = v.zero[wanted[self.of[v.zero]]]
        return out

    def ranges(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Groups with vectors of a dimension, and where these begin among them."""
        return np.unique(self.of[self.by_dim[dim].at], return_index=True)

    def of_group(self, dim: int, group: int) -> Vectors:
        v = self.by_dim[dim]
        return v.taken(np.flatnonzero(self.of[v.at] == group))


def undefined(asked: Groups, pages: Groups) -> list[tuple[np.ndarray, np.ndarray]]:
    """Queries and pages where a vector of length zero meets one without a finite length: NaN, as in SQL."""
    out = []
    for dim in set(asked.by_dim) & set(pages.by_dim):
        q, p = asked.by_dim[dim], pages.by_dim[dim]
        endless = lambda of, v: np.unique(of[v.at[~np.isfinite(v.norm)]])
        out += [(np.unique(asked.of[q.zero]), endless(pages.of, p)), (endless(asked.of, q), np.unique(pages.of[p.zero]))]
    return [(a, b) for a, b in out if len(a) and len(b)]


def near_sums(asked: Groups, pages: Groups) -> np.ndarray:
    """Of each query and page the sum of best matches in single precision, wrong by SLACK a vector at most."""
    total = np.zeros((len(asked.sizes), len(pages.sizes)))
    for dim, q in asked.by_dim.items():
        if dim in pages.by_dim and len(q.at) and len(pages.by_dim[dim].at):
            some, starts = pages.ranges(dim)
            unit = pages.by_dim[dim].unit.T
            if q.norm.min() * pages.by_dim[dim].norm.min() == 0:  # too short to divide by: these are scored only
                total[:] = np.nan
                return total
            for low in range(0, len(q.at), BLOCK):
                best = np.maximum.reduceat(q.unit[low : low + BLOCK] @ unit, starts, axis=1).astype(np.float64)
                of, first = np.unique(asked.of[q.at[low : low + BLOCK]], return_index=True)
                total[np.ix_(of, some)] += np.add.reduceat(best, first, axis=0)
    for of, some in undefined(asked, pages):
        total[np.ix_(of, some)] = np.nan
    return total


def exact_sum(asked: Groups, query: int, pages: Groups, page: int) -> float:
    """The sum of best cosines, added in the order of the query's vectors; a vector without any counts as zero."""
    if any(query in of and page in some for of, some in undefined(asked, pages)):
        return float("nan")
    best = np.zeros(asked.sizes[query])
    for dim in asked.by_dim:
        if dim not in pages.by_dim:
            continue
        q, p = asked.of_group(dim, query), pages.of_group(dim, page)
        if not len(q.at) or not len(p.at):
            continue
        total = np.zeros((len(q.at), len(p.at)))
        with np.errstate(all="ignore"):
            for a, b in zip(q.columns, p.columns):
                total += a[:, None] * b
            length = q.norm[:, None] * p.norm
            score = np.where(length == 0, -np.inf, total / length)  # a quotient by zero is null
        most = score.max(1)  # NaN is the greatest, as in SQL
        best[q.at - asked.starts[query]] = np.where(most == -np.inf, 0.0, most)
    return float(np.cumsum(best)[-1])


def max_sim(pages: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Late interaction: for each page the sum, over the query's vectors, of the best match.

    ``pages`` is (id, vec_idx, vector), ``queries`` (query_id, q_idx, query_vector), both long. A page stays in one chunk
    and a query in one block, and these are multiplied as matrices in single precision; a page that may be among the
    best k of its query in a task is scored in doubles.
    """
    points = pages.select("id", numbers(pages, "vector").alias("vector"))
    asked = queries.select("query_id", "q_idx", numbers(queries, "query_vector").alias("query_vector"))
    blocks = kept_whole(asked, "query_id", ["query_id", "q_idx", "query_vector"], LATE_QUERIES, "block").withColumnRenamed("entries", "asked")
    met = together(kept_whole(points, "id", ["id", "vector"], CHUNK, "chunk"), blocks, queries.count())
    schema = T.StructType([queries.schema["query_id"], pages.schema["id"]]).add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Best] = {}
        at = chunk = None
        for batch in batches:
            for row in range(batch.num_rows):
                mark, block = batch.column("chunk")[row].as_py(), batch.column("block")[row].as_py()
                if mark != at:
                    at, chunk = mark, Groups(batch.column("entries")[row].values, "id", "vector")
                one = Groups(batch.column("asked")[row].values, "query_id", "query_vector", "q_idx")
                best = held.setdefault(block, Best(len(one.sizes), k, -np.inf))
                query, page = best.better(near_sums(one, chunk), SLACK * one.sizes)
                score = np.array([exact_sum(one, q, chunk, p) for q, p in zip(query.tolist(), page.tolist())], float)
                kept = best.put(query, page, score)
                if len(kept):
                    yield pa.RecordBatch.from_arrays([one.names.take(pa.array(query[kept])), chunk.names.take(pa.array(page[kept])), pa.array(score[kept])], names=["query_id", "id", "score"])

    return ranked(met.mapInArrow(run, schema), ["query_id"], k)


def first_patches(points: DataFrame) -> DataFrame:
    """One query for each page: its first patch."""
    return points.groupBy("document_id", "page_number").agg(F.min_by("vector", "patch_index").alias("query_vector")).select(
        F.concat_ws("#", "document_id", "page_number").alias("query_id"), "query_vector"
    )


def patch_grid(n: Column, i: Column) -> tuple[Column, Column]:
    """Coordinates of patch i of n on the square grid that holds them."""
    g = F.greatest(F.ceil(F.sqrt(n.cast("double"))), F.lit(1))
    return ((i % g) * PATCH).cast("int"), (F.floor(i / g) * PATCH).cast("int")


def points_of(pages: DataFrame, as_of: Column) -> DataFrame:
    """A point for each vector of a page: (document_id, page_number, document_type, processing_timestamp, vectors)."""
    flat = pages.select(*REQUIRED_PAYLOAD, F.size("vectors").alias("_n"), F.posexplode("vectors").alias("patch_index", "vector"))
    x, y = patch_grid(F.col("_n"), F.col("patch_index"))
    return flat.select(
        F.sha2(F.concat_ws("#", "document_id", "page_number", "patch_index"), 256).alias("id"), "vector", *REQUIRED_PAYLOAD, "patch_index",
        x.alias("patch_x"), y.alias("patch_y"), F.concat_ws(",", x.cast("string"), y.cast("string")).alias("patch_coordinates"),
        F.size("vector").alias("embedding_dimension"), as_of.alias("storage_timestamp"),
    )


def results(found: DataFrame, points: DataFrame) -> DataFrame:
    """Search results with metadata, spatial and document structs, best first."""
    met = found.join(points, "id")
    return met.select(
        "query_id", "id", "score", "rank",
        F.struct("patch_index", "embedding_dimension", "storage_timestamp").alias("metadata"),
        F.struct("patch_x", "patch_y", "patch_coordinates").alias("spatial"),
        F.struct("document_id", "page_number", "document_type").alias("document"),
    )


def missing_payload(columns: list[str]) -> list[str]:
    return [c for c in REQUIRED_PAYLOAD if c not in columns]


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new``, and rows of ``old`` whose key is not in it."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def batches(n: Column, size: int = 100) -> Column:
    return F.ceil(n / size)


def storage(points: DataFrame, group: list[str] = ()) -> DataFrame:
    """Counts and estimated megabytes of stored points, with advice."""
    n, dim = F.count("*"), F.max(F.size("vector"))
    indexed = F.sum(F.col("vector").isNotNull().cast("long"))
    out = points.groupBy(*group).agg(n.alias("points_count"), indexed.alias("indexed_vectors_count"), dim.alias("dimension"))
    mb = F.col("points_count") * F.col("dimension") * 4 / (1024 * 1024)
    ratio = F.try_divide(F.col("indexed_vectors_count") * 100.0, F.col("points_count"))
    return out.withColumns(
        {
            "indexing_ratio": F.coalesce(ratio, F.lit(0.0)),
            "estimated_vector_size_mb": F.round(mb, 2),
            "estimated_payload_size_mb": F.round(F.col("points_count") * 0.5, 2),
            "estimated_total_size_mb": F.round(mb + F.col("points_count") * 0.5, 2),
            "collection_health": F.when(F.coalesce(ratio, F.lit(0.0)) > 90, "healthy").otherwise("needs_attention"),
            "advice": F.array_compact(F.array(F.when(F.coalesce(ratio, F.lit(0.0)) < 95, F.lit("indexing")), F.when(F.col("points_count") > 100000, F.lit("scale")))),
        }
    )


def rating(seconds: Column) -> Column:
    return F.when(seconds < 0.01, "excellent").when(seconds < 0.05, "good").when(seconds < 0.1, "acceptable").when(seconds < 0.5, "slow").otherwise("poor")


def overlaps(a: str, b: str) -> Column:
    """Do two rectangles (x, y, w, h with a prefix) overlap? Touching edges do not."""
    x1, y1, w1, h1 = (F.col(f"{a}{c}") for c in "xywh")
    x2, y2, w2, h2 = (F.col(f"{b}{c}") for c in "xywh")
    return ~((x1 + w1 <= x2) | (x2 + w2 <= x1) | (y1 + h1 <= y2) | (y2 + h2 <= y1))


def overlap_join(left: DataFrame, right: DataFrame, bin_size: int = 64, how: list[str] = ()) -> DataFrame:
    """Pairs of overlapping rectangles of two tables, columns ``a*`` and ``b*``, keys in ``how``.

    Both sides are cut into bins along x, so it is an equi-join; a pair is reported in the
    bin where it begins only. The left rows of a bin with many pairs are dealt to as many slices
    as hold PAIRS each, about, beside which its right rows are repeated: no task has a bin of many pairs.
    """
    bins = lambda c: F.explode(F.sequence(F.floor(F.col(f"{c}x") / bin_size), F.floor((F.col(f"{c}x") + F.greatest(F.col(f"{c}w"), F.lit(1)) - 1) / bin_size)))
    a, b, keys = left.withColumn("_bin", bins("a")), right.withColumn("_bin", bins("b")), ["_bin", *how]
    n = a.groupBy(*keys).agg(F.count("*").alias("_na")).join(b.groupBy(*keys).agg(F.count("*").alias("_nb")), keys)
    n = n.select(*keys, F.ceil(F.col("_na").cast("double") * F.col("_nb") / PAIRS).alias("_n"))
    tasks = min(n.agg(F.sum("_n")).first()[0] or 1, TASKS)
    first = F.floor(F.greatest(F.col("ax"), F.col("bx")) / bin_size)
    a = a.join(n, keys).withColumn("_slice", F.pmod(F.xxhash64(*[c for c in left.columns]), F.col("_n"))).drop("_n")
    b = b.join(n, keys).withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n")
    if tasks > 1:  # a number that is asked for: the tables are small beside their pairs
        a, b = a.repartition(tasks, *keys, "_slice").hint("merge"), b.repartition(tasks, *keys, "_slice")
    return a.join(b, [*keys, "_slice"]).where(overlaps("a", "b") & (F.col("_bin") == first)).drop("_bin", "_slice")
