"""Parallel scans and lineage by doubling against plain Python."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import lineage, metrics, scan


@pytest.mark.parametrize("size", [7, 64, 100_000])
def test_running(spark, size):
    """Groups of all sizes, one with most rows and one of nulls, in ranges of any size."""
    rng = random.Random(size)
    rows = [(rng.choice(["hot"] * 12 + ["a", "b", None, "c"]), k, rng.choice([0.9, 1.0, 0.5, 0.0, None]), rng.choice([0.0, 1.0, None]), rng.choice([None, float(k % 13)])) for k in range(700)]
    df = spark.createDataFrame(rows, "g string, at long, p double, q double, v double").repartition(3)
    got = {r["at"]: (r["after"], r["tail"]) for r in scan.running(df, ["g"], ["at"], F.col("p"), F.col("q"), F.col("v"), 4, 2.0, size).collect()}
    x, tails = collections.defaultdict(lambda: 2.0), collections.defaultdict(list)
    for g, at, p, q, v in rows:
        x[g] = (1.0 if p is None else p) * x[g] + (q or 0.0)
        tails[g] = [*tails[g], v][-4:]
        assert got[at] == (pytest.approx(x[g]), tails[g])
    assert len(got) == 700
    assert scan.running(df.limit(0), ["g"], ["at"], keep=2).count() == 0


def test_ranges_bound_a_task(spark):
    """One group of all rows is cut into ranges of its size."""
    df = spark.range(5000).select(F.lit("x").alias("g"), F.col("id").alias("at"), F.lit(1.0).alias("one"))
    out = scan.running(df, ["g"], ["at"], shift=F.col("one"), rows_per_range=500)
    assert [r.after for r in out.orderBy("at").collect()] == [float(k) for k in range(1, 5001)]
    files = {f for f in out.inputFiles()}
    assert len(files) >= 8


def test_decay_and_leak_do_not_depend_on_ranges(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(rng.choice("xy"), k // 2, rng.choice([True, False, None]), rng.choice([None, rng.random()])) for k in range(400)], "g string, at long, bad boolean, v double")
    few, many = (metrics.decayed(df, ["g"], ["at"], "bad", n).orderBy("g").collect() for n in (11, 10_000))
    assert [r[0] for r in few] == [r[0] for r in many] and [r[1] for r in few] == pytest.approx([r[1] for r in many])
    order = df.withColumn("i", F.monotonically_increasing_id())
    few, many = ({r.i: r.increase for r in metrics.leak(order, ["g"], ["i"], "v", 0.1, n).collect()} for n in (11, 10_000))
    assert few == many and sum(x is None for x in few.values()) >= 18


def brute_closure(edges):
    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
    out = {}
    for s in list(near):
        depth, level, seen = 0, {s}, set()
        while level:
            depth += 1
            level = {b for a in level for b in near[a]} - seen
            seen |= level
            out |= {(s, b): depth for b in level}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_closure_of_graphs(spark, seed):
    """Graphs with cycles and self-loops; from all nodes, from some, downwards, upwards, to a depth."""
    rng = random.Random(seed)
    edges = [(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(32)] + [(f"c{k}", f"c{k + 1}") for k in range(21)] + [("l", "l")]
    links = spark.createDataFrame(edges + edges[:3], "parent_id string, child_id string")
    want = brute_closure(edges)
    key = lambda df: {(r.node_id, r.other_id): r.depth for r in df.collect()}
    assert key(lineage.closure(links)) == want
    start = spark.createDataFrame([("n1",), ("n2",), ("c0",), ("c20",), ("l",), ("none",)], "node_id string")
    names = {"n1", "n2", "c0", "c20", "l"}
    assert key(lineage.closure(links, start)) == {k: d for k, d in want.items() if k[0] in names}
    assert key(lineage.closure(links, max_depth=6)) == {k: d for k, d in want.items() if d <= 6}
    assert key(lineage.closure(links, start, max_depth=5)) == {k: d for k, d in want.items() if d <= 5 and k[0] in names}
    assert key(lineage.closure(links, down=False)) == brute_closure([(b, a) for a, b in edges])


def test_shortest_paths_are_least(spark):
    rng = random.Random(9)
    edges = sorted({(f"{rng.randrange(5)}{layer}", f"{rng.randrange(5)}{layer + 1}") for layer in range(7) for _ in range(9)})
    near = collections.defaultdict(list)
    for a, b in edges:
        near[a].append(b)
    links = spark.createDataFrame(edges, "parent_id string, child_id string")
    nodes = sorted({x for e in edges for x in e})
    df = spark.createDataFrame([(x,) for x in nodes], "node_id string")
    want = {}
    for s in nodes:
        level = {s: (s,)}
        while level:
            for at, path in level.items():
                want.setdefault((s, at), path)
            after = {}
            for at, path in level.items():
                for b in near[at]:
                    if (s, b) not in want:
                        after[b] = min(after.get(b, (*path, b)), (*path, b))
            level = after
    got = {(r.start_id, r.end_id): tuple(r.path) for r in lineage.shortest_paths(links, df, df).collect()}
    assert got == want


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, kept = 4000, []
    real = lineage._kept
    monkeypatch.setattr(lineage, "_kept", lambda df: kept.append(1) or real(df))
    links = spark.range(n).select(F.col("id").alias("parent_id"), (F.col("id") + 1).alias("child_id"))
    found = lineage.closure(links, spark.range(1).select(F.col("id").alias("node_id")))
    assert {(r.other_id, r.depth) for r in found.collect()} == {(k, k) for k in range(1, n + 1)}
    assert len(kept) <= 2 * 15


def test_a_closure_from_starts_writes_few_rows(spark, monkeypatch):
    """Nodes with a single parent have no walks of their own: chains, trees and cycles beside them, all rounds together."""
    n, sizes = 4000, []
    real = lineage._kept
    monkeypatch.setattr(lineage, "_kept", lambda df: sizes.append((kept := real(df)).count()) or kept)
    edges = [(k, k + 1) for k in range(n)] + [(10_000, 10_001), (10_001, 10_000), (10_001, 10_002), (70, 20_000), (20_000, 20_001), (None, 30_000), (5, None)]
    links = spark.createDataFrame(edges, "parent_id long, child_id long").repartition(4)
    found = {(r.other_id, r.depth) for r in lineage.closure(links, spark.range(1).select(F.col("id").alias("node_id"))).collect()}
    assert found == {(k, k) for k in range(1, n + 1)} | {(20_000, 71), (20_001, 72), (None, 6)}
    assert sum(sizes) < 8 * n
