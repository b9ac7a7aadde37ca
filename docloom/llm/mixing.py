"""Operator 7, mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them). Words
flow from patterns to sources: each pattern gives its size once at no cost and again for
every further repetition at a rising (convex) cost, each source takes up to its quota. The
flow's cost is least, so nothing is repeated that fresh text of the source could replace.
The graph has one node per pattern and source, never one per document.

A pattern's flow is then met by documents: all of them as often as the flow covers the
whole pattern, and a seeded prefix of them once more. The prefix is found without sorting
a pattern: sums over 4096 ranges of the seeded hash name the range in which the flow ends,
and only that range is put in order. What the prefix leaves of the flow is filled by up to
EXTRA single documents, each time the largest that fits.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; a
document of size 0 takes nothing; rows with equal ids are taken or left together; an empty
table gives an empty result; columns of ``docs`` that clash with those made here (``size``,
``target`` and so on) are not read by the query, and ``mixed`` returns the input's columns.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import WORD, written

SHARE = Fraction(3, 2)
WEIGHTS = (3, 1, 2)
MAX_TIMES = 2
SEED = 7
RANGE_BITS = 12
#: Patterns that are joined by broadcast at most (there is a row for each).
BROADCAST_PATTERNS = 100_000
#: Single documents of a pattern that fill what its prefix leaves.
EXTRA = 3


def targets(sizes: dict, weights: dict, share: Fraction = SHARE, times: int = MAX_TIMES) -> dict:
    """Words each source should get: ``share`` of all words by weight, none over ``times`` its size."""
    left, active, out = share * sum(sizes.values()), set(sizes), {}
    while active:
        total = sum(weights[s] for s in active)
        over = {s for s in active if Fraction(weights[s]) * left / total > times * sizes[s]} if total else set()
        if not over:
            out |= {s: float(Fraction(weights[s]) * left / total) if total else 0.0 for s in active}
            break
        for s in over:
            out[s] = float(times * sizes[s])
            left -= times * sizes[s]
        active -= over
    return out


def min_cost_flow(sizes: dict[tuple, int], quotas: dict, times: int = MAX_TIMES) -> dict[tuple, int]:
    """Words from each pattern to each of its sources: (pattern, source) -> words.

    Successive shortest paths with potentials. The r-th time a pattern is used costs r - 1
    a word, so the cost of a pattern is convex in the words it gives.
    """
    start, end = ("start",), ("end",)
    to: list = []
    room: list[int] = []
    cost: list[int] = []
    out_of: dict = {start: [], end: []}

    def arc(a, b, capacity: int, c: int) -> int:
        for x, y, cap, price in ((a, b, capacity, c), (b, a, 0, -c)):
            out_of.setdefault(x, []).append(len(to))
            to.append(y)
            room.append(cap)
            cost.append(price)
        return len(to) - 2

    carries = {}
    for pattern, size in sizes.items():
        for r in range(times):
            arc(start, ("pattern", pattern), size, r)
        for source in pattern:
            carries[pattern, source] = arc(("pattern", pattern), ("source", source), times * size, 0)
    for source, quota in quotas.items():
        arc(("source", source), end, quota, 0)
    order = {node: k for k, node in enumerate(out_of)}
    height = dict.fromkeys(out_of, 0)
    while True:
        far, via, queue = {start: 0}, {}, [(0, order[start], start)]
        while queue:
            d, _, node = heapq.heappop(queue)
            if d > far[node]:
                continue
            for k in out_of[node]:
                if room[k] and (n := d + cost[k] + height[node] - height[to[k]]) < far.get(to[k], 1 << 62):
                    far[to[k]], via[to[k]] = n, k
                    heapq.heappush(queue, (n, order[to[k]], to[k]))
        if end not in far:
            return {key: room[k ^ 1] for key, k in carries.items()}
        for node in height:
            height[node] += min(far.get(node, far[end]), far[end])
        path, node = [], end
        while node != start:
            path.append(via[node])
            node = to[via[node] ^ 1]
        words = min(room[k] for k in path)
        for k in path:
            room[k] -= words
            room[k ^ 1] += words


def seeded(seed: int) -> Column:
    """A document's place in the seeded order: 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("_id")), 1)


def plan(sized: DataFrame, share: Fraction = SHARE, weights: tuple = WEIGHTS, times: int = MAX_TIMES, seed: int = SEED) -> tuple[DataFrame, dict, dict]:
    """How often each pattern is taken, and the sources' sizes and targets.

    ``sized`` has ``_members`` (array of sources), ``_id`` and ``_size``. The plan has a row
    for each pattern: all its documents are taken ``_whole`` times, and those up to
    (``_cut``, ``_cut_id``) in the seeded order, and those in ``_extra``, once more. What comes to the driver is a row
    for each pattern and range, whatever the number of documents.
    """
    spark = sized.sparkSession
    bits = 63 - RANGE_BITS
    sized = sized.withColumn("_at", seeded(seed))
    sums = written(sized.groupBy("_members", F.shiftright("_at", bits).alias("_range")).agg(F.sum("_size").alias("_size")), "sums")
    sizes = {tuple(r["_members"]): r["_size"] for r in sums.groupBy("_members").agg(F.sum("_size").alias("_size")).collect()}
    by_source: dict = {}
    for pattern, size in sizes.items():
        for source in pattern:
            by_source[source] = by_source.get(source, 0) + size
    ordered = sorted(by_source, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(ordered)}
    target = targets(by_source, weight, share, times)
    flow = min_cost_flow(sizes, {s: round(t) for s, t in target.items()}, times)
    rows = []
    for pattern, size in sizes.items():
        words = sum(flow[pattern, s] for s in pattern)
        whole = words // size if size else 0
        rows.append((list(pattern), whole, words - whole * size))
    wanted = spark.createDataFrame(rows, "_members array<string>, _whole long, _rest long")
    before = F.sum("_size").over(Window.partitionBy("_members").orderBy("_range")) - F.col("_size")
    reached = (
        sums.withColumn("_before", before)
        .join(wanted.where("_rest > 0"), "_members")
        .where("_before < _rest and _before + _size >= _rest")
        .select("_members", "_range", "_before", "_rest")
    )
    last = (
        sized.withColumn("_range", F.shiftright("_at", bits))
        .join(F.broadcast(reached) if len(rows) <= BROADCAST_PATTERNS else reached, ["_members", "_range"])
        .groupBy("_members", "_range", "_before", "_rest", "_at", F.col("_id").alias("_cut_id"))
        .agg(F.sum("_size").alias("_size"))
    )
    order = Window.partitionBy("_members").orderBy("_at", "_cut_id")
    up_to = F.col("_before") + F.sum("_size").over(order)
    cuts = (
        last.withColumn("_up_to", up_to)
        .groupBy("_members", "_range", "_before", "_rest")
        .agg(F.max(F.when(F.col("_up_to") <= F.col("_rest"), F.struct(F.col("_at").alias("_cut"), "_cut_id", "_up_to"))).alias("c"))
        .select(
            "_members",
            F.coalesce("c._cut", F.shiftleft(F.col("_range"), bits) - 1).alias("_cut"),
            F.coalesce("c._cut_id", F.lit(-(1 << 63)).cast("long")).alias("_cut_id"),
            (F.col("_rest") - F.coalesce("c._up_to", "_before")).alias("_gap"),
        )
        .collect()
    )
    state = {tuple(r["_members"]): [r["_cut"], r["_cut_id"], r["_gap"], []] for r in cuts}
    plan_type = "_members array<string>, _whole long, _cut long, _cut_id long, _gap long, _extra array<struct<at:long,id:long>>"
    for _ in range(EXTRA):  # what is left of a flow goes to the largest document that still fits
        open_rows = [(list(m), 0, *x) for m, x in state.items() if x[2] > 0]
        if not open_rows:
            break
        side = spark.createDataFrame(open_rows, plan_type)
        fits = (
            sized.where("_size > 0")
            .join(F.broadcast(side) if len(open_rows) <= BROADCAST_PATTERNS else side, "_members")
            .where(~early(F.col("_at"), F.col("_id")))
            .groupBy("_members", "_at", "_id", "_gap")
            .agg(F.sum("_size").alias("_size"))
            .where(F.col("_size") <= F.col("_gap"))
            .groupBy("_members")
            .agg(F.max(F.struct("_size", "_at", "_id")).alias("m"))
        )
        for r in fits.collect():
            x = state[tuple(r["_members"])]
            x[2] -= r["m"]["_size"]
            x[3].append((r["m"]["_at"], r["m"]["_id"]))
    found = spark.createDataFrame([(m, whole, *state.get(tuple(m), (-1, 0, 0, []))) for m, whole, _ in rows], plan_type)
    return found, by_source, target


def early(at: Column, doc_id: Column) -> Column:
    """Is a document within its pattern's prefix, or one of its extra ones?"""
    prefix = (at < F.col("_cut")) | ((at == F.col("_cut")) & (doc_id <= F.col("_cut_id")))
    return prefix | F.exists("_extra", lambda x: (x["at"] == at) & (x["id"] == doc_id))


def with_times(docs: DataFrame, members: Column, seed: int = SEED, **how) -> tuple[DataFrame, dict, dict]:
    """(_row, _members, _size, _times, ...): rows as structs, and how often the mix takes each."""
    sized = docs.select(
        F.struct(*docs.columns).alias("_row"),
        members.alias("_members"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("_id"),
    )
    narrow = written(sized.select("_members", "_id", "_size"), "sizes")
    found, sizes, target = plan(narrow, seed=seed, **how)
    side = F.broadcast(found) if found.count() <= BROADCAST_PATTERNS else found
    taken = sized.join(side, "_members").withColumn("_times", F.col("_whole") + early(seeded(seed), F.col("_id")).cast("long"))
    return taken, sizes, target


def mix(docs: DataFrame, members: Column | None = None, **how) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document, for one source each."""
    spark = docs.sparkSession
    taken, sizes, target = with_times(docs.select("doc_id", "text", "source"), F.array("source") if members is None else members, **how)
    sources = spark.createDataFrame(
        [(s, n, target[s]) for s, n in sizes.items()], "_source string, source_size long, target double"
    )
    side = F.broadcast(sources) if len(sizes) <= BROADCAST_PATTERNS else sources
    return taken.join(side, F.col("_members")[0].eqNullSafe(F.col("_source"))).select(
        F.col("_row.doc_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_times")).alias("taken")
    )


def mixed(docs: DataFrame, members: Column | None = None, **how) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its own columns."""
    taken, _, _ = with_times(docs, F.array("source") if members is None else members, **how)
    return taken.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_times").cast("int")))).select("_row.*")
