"""Lineage of records as two tables, nodes and edges.

Neighbours are joins; closures and paths double their reach with every round of equi-joins, and each
round is a written table in the shared folder, so a long chain takes few rounds and a lost executor costs one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.sinks import folders

#: Of the nodes with a single parent one in so many stands for those below it, when a closure is made.
FOLD = 8
NODE = (
    "node_id string, node_type string, timestamp timestamp_ntz, operation string, metadata map<string,string>, "
    "performance_metrics map<string,double>, parent_nodes array<string>, schema_version string, transformation_rules array<string>"
)
#: Stage -> (node type, operation, time metric, unit counted, name of the rate) (fixed values).
STAGES = {
    "source": ("source_document", "ingest_document", None, None, None),
    "conversion": ("document_conversion", "convert_to_images", "conversion_time_seconds", "page_count", "pages_per_second"),
    "embedding": ("embedding", "generate_embeddings", "processing_time_seconds", "patch_count", "patches_per_second"),
    "storage": ("storage", "store_vectors", "storage_time_seconds", "vectors_stored", "vectors_per_second"),
    "retrieval": ("vector_retrieval", "retrieve_vectors", "retrieval_time_seconds", None, None),
    "extraction": ("extraction", "extract_structured_data", "extraction_time_seconds", None, None),
    "canonical": ("canonical_format", "format_canonical", None, None, None),
    "shaped": ("shaped_transform", "transform_to_1nf", "transform_time_seconds", None, None),
}


def stage_nodes(df: DataFrame, stage: str, processing_id: Column, name: Column, timestamp: Column, parent: Column | None = None, seconds: Column | None = None, count: Column | None = None, metadata: dict[str, Column] | None = None, rules: Column | None = None, version: Column | None = None) -> DataFrame:
    """A node for each row of a pipeline stage, ``{processing_id}_{stage}_{name}``."""
    kind, operation, clock, unit, rate = STAGES[stage]
    metrics = []
    if seconds is not None and clock:
        metrics += [F.lit(clock), seconds.cast("double")]
    if count is not None and unit:
        metrics += [F.lit(unit), count.cast("double")]
        if seconds is not None:
            metrics += [F.lit(rate), F.when(seconds > 0, count / seconds).otherwise(0.0).cast("double")]
    return df.select(
        F.concat_ws("_", processing_id, F.lit(stage), name).alias("node_id"),
        F.lit(kind).alias("node_type"),
        timestamp.cast("timestamp_ntz").alias("timestamp"),
        F.lit(operation).alias("operation"),
        (F.create_map(*[x for k, v in (metadata or {}).items() for x in (F.lit(k), v.cast("string"))]) if metadata else F.create_map()).cast("map<string,string>").alias("metadata"),
        (F.create_map(*metrics) if metrics else F.create_map()).cast("map<string,double>").alias("performance_metrics"),
        (F.array(parent) if parent is not None else F.array()).cast("array<string>").alias("parent_nodes"),
        (F.lit("1.0") if version is None else version).cast("string").alias("schema_version"),
        (F.array() if rules is None else rules).cast("array<string>").alias("transformation_rules"),
    )


def export_nodes(df: DataFrame, processing_id: Column, form: str, timestamp: Column, parent: Column, seconds: Column | None = None) -> DataFrame:
    """Nodes of exported outputs, operation ``export_to_{form}``."""
    return df.select(
        F.concat_ws("_", processing_id, F.lit("export"), F.lit(form)).alias("node_id"),
        F.lit("export_output").alias("node_type"),
        timestamp.cast("timestamp_ntz").alias("timestamp"),
        F.lit(f"export_to_{form.lower()}").alias("operation"),
        F.create_map().cast("map<string,string>").alias("metadata"),
        (F.create_map() if seconds is None else F.create_map(F.lit("export_time_seconds"), seconds)).cast("map<string,double>").alias("performance_metrics"),
        F.array(parent).cast("array<string>").alias("parent_nodes"),
        F.lit("1.0").alias("schema_version"),
        F.array().cast("array<string>").alias("transformation_rules"),
    )


def edges(nodes: DataFrame) -> DataFrame:
    """(parent_id, child_id, ord): each parent once for each child."""
    return nodes.select(F.posexplode("parent_nodes").alias("ord", "parent_id"), F.col("node_id").alias("child_id")).groupBy("parent_id", "child_id").agg(F.min("ord").alias("ord"))


def children(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, child_id) of nodes that exist."""
    return links.join(nodes.select(F.col("node_id").alias("child_id")), "child_id").select(F.col("parent_id").alias("node_id"), "child_id")


def parents(links: DataFrame, nodes: DataFrame) -> DataFrame:
    return links.join(nodes.select(F.col("node_id").alias("parent_id")), "parent_id").select(F.col("child_id").alias("node_id"), "parent_id")


def _kept(df: DataFrame) -> DataFrame:
    """Written and read again: a round's plan is no part of the next one's."""
    path = folders.fresh(df.sparkSession, "lineage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _gone(df: DataFrame) -> None:
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        folders.delete(df.sparkSession, folder)


def closure(links: DataFrame, start: DataFrame | None = None, down: bool = True, max_depth: int | None = None) -> DataFrame:
    """(node_id, other_id, depth): all descendants (or ancestors) of the start nodes, least depth.

    ``start`` is (node_id); without it every node with an edge starts. The reach doubles each round, so a chain of n
    steps takes log2(n) rounds. Pairs found are not found again, so a cycle ends. All levels are followed;
    ``max_depth`` asks for so many only.
    """
    near, far = ("parent_id", "child_id") if down else ("child_id", "parent_id")
    hop = links.select(F.col(near).alias("node_id"), F.col(far).alias("other_id")).distinct()
    if start is not None:
        hop = _kept(hop)
        if max_depth is None:
            links, below = _folded(hop, start)
            found = _reach(links, start, False, None).drop("path")
            folded = found.join(below, F.col("other_id") == F.col("_to"))
            found = found.unionByName(folded.select("node_id", F.col("_v").alias("other_id"), (F.col("depth") + F.col("_off")).alias("depth")))
        else:
            found = _reach(hop, start, False, max_depth).drop("path")
        found = found.where("depth > 0")
        # A start that lies on a cycle reaches itself too.
        back = hop.join(start.select(F.col("node_id").alias("other_id")).distinct(), "other_id").select(F.col("node_id").alias("_m"), F.col("other_id").alias("node_id"))
        rounds = found.withColumnRenamed("other_id", "_m").join(back, ["node_id", "_m"])
        own = start.join(hop, "node_id").where("node_id = other_id").select("node_id", "other_id", F.lit(1).alias("depth"))
        loops = rounds.select("node_id", F.col("node_id").alias("other_id"), (F.col("depth") + 1).alias("depth")).unionByName(own).groupBy("node_id", "other_id").agg(F.min("depth").alias("depth"))
        return found.unionByName(loops if max_depth is None else loops.where(F.col("depth") <= max_depth))
    # Everything within 2^k steps, and what is just 2^k steps away.
    reach = 1
    last = _kept(hop.withColumn("depth", F.lit(1)))
    found = last
    while (max_depth is None or reach < max_depth) and not last.isEmpty():
        near_by = found.select(F.col("node_id").alias("_m"), F.col("other_id").alias("_b"), F.col("depth").alias("_d"))
        more = last.join(near_by, F.col("other_id") == F.col("_m")).groupBy("node_id", F.col("_b").alias("other_id")).agg((F.min("_d") + reach).alias("depth"))
        more = _kept(more.join(found.select("node_id", "other_id"), ["node_id", "other_id"], "left_anti"))
        reach *= 2
        found = found.unionByName(more)
        last = more.where(F.col("depth") == reach)
    return found if max_depth is None else found.where(F.col("depth") <= max_depth)


def _folded(hop: DataFrame, start: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node_id, other_id, weight) between some of the nodes, and (_v, _to, _off): the others, each ``_off`` steps below one of those.

    A node with a single parent that is no start is reached through that parent only, so it needs no walks of its own: its depth is
    that of the first node above it that stays, and the steps between. ``FOLD`` says how many stay; the way up doubles each round.
    """
    single = hop.where("other_id IS NOT NULL").groupBy(F.col("other_id").alias("_v")).agg(F.min("node_id").alias("_to"), F.count("*").alias("_n")).where("_n = 1")
    goes = single.where(F.pmod(F.xxhash64("_v"), F.lit(FOLD)) != 0).join(start.select(F.col("node_id").alias("_v")), "_v", "left_anti")
    parts, n, most = [_kept(goes.select("_v", "_to", F.lit(1).alias("_off"), F.lit(False).alias("_top")))], None, None
    while (left := parts[-1].where("NOT _top").count()) != n and left * 50 > (most := most or left):
        known = parts[-1]
        for part in parts[:-1]:
            known = known.unionByName(part.where("_top"))
        above = known.select(F.col("_v").alias("_u"), F.col("_to").alias("_over"), F.col("_off").alias("_more"), F.col("_top").alias("_end"))
        up = parts[-1].where("NOT _top").join(above, F.col("_to") == F.col("_u"), "left")
        parts.append(_kept(up.select("_v", F.coalesce("_over", "_to").alias("_to"), (F.col("_off") + F.coalesce("_more", F.lit(0))).alias("_off"), F.coalesce("_end", F.lit(True)).alias("_top"))))
        n = left
    # The last few stay too, as a round for them reads all; so does what lies on or below a cycle without a start, of which a round settles none.
    below = parts[0].where("_top")
    for part in parts[1:]:
        below = below.unionByName(part.where("_top"))
    below = below.drop("_top")
    rest = hop.join(below.select(F.col("_v").alias("other_id")), "other_id", "left_anti").join(below, F.col("node_id") == F.col("_v"), "left")
    links = rest.select(F.coalesce("_to", "node_id").alias("node_id"), "other_id", (F.coalesce("_off", F.lit(0)) + 1).alias("weight"))
    return links, below


def _reach(hop: DataFrame, start: DataFrame, paths: bool, max_depth: int | None) -> DataFrame:
    """(node_id, other_id, depth, path) from each start to all it reaches, itself at depth 0; ``path`` without the start.

    Walks of 2^k hops between nodes of the graph are put behind what was reached: after round k all within fewer than
    2^(k + 1) hops is known. A hop counts as one step, or as its ``weight``. No node has more than its own descendants in a round, and one with a single parent (or child) has one.
    """
    arrays = lambda *c: F.array(*c) if paths else F.array().cast("array<string>")
    kind = hop.schema["other_id"].dataType.simpleString()
    empty = F.array().cast(f"array<{kind}>" if paths else "array<string>")
    found = _kept(start.select("node_id").where("node_id IS NOT NULL").distinct().select("node_id", F.col("node_id").alias("other_id"), F.lit(0).alias("depth"), empty.alias("path")))
    weight = F.col("weight") if "weight" in hop.columns else F.lit(1)
    walk = _kept(hop.select(F.col("node_id").alias("_a"), F.col("other_id").alias("_b"), weight.alias("_w"), arrays(F.col("other_id")).alias("_p")))
    size = lambda df: tuple(df.agg(F.count("*"), F.sum("depth")).first())
    steps, n = 1, size(found)
    while max_depth is None or steps <= max_depth:
        more = found.join(walk, F.col("other_id") == F.col("_a")).select("node_id", F.col("_b").alias("other_id"), (F.col("depth") + F.col("_w")).alias("depth"), F.concat("path", "_p").alias("path"))
        best = found.unionByName(more).groupBy("node_id", "other_id").agg(F.min(F.struct("depth", "path")).alias("r"))
        new = _kept(best.select("node_id", "other_id", "r.depth", "r.path"))
        grown = size(new)
        _gone(found)
        found = new
        if grown == n:
            break
        n = grown
        ahead = walk.select(F.col("_a").alias("_m"), F.col("_b").alias("_c"), F.col("_w").alias("_x"), F.col("_p").alias("_q"))
        longer = walk.join(ahead, F.col("_b") == F.col("_m")).groupBy("_a", F.col("_c").alias("_b")).agg(F.min(F.struct((F.col("_w") + F.col("_x")).alias("_w"), F.concat("_p", "_q").alias("_p"))).alias("r"))
        longer = _kept(longer.select("_a", "_b", "r._w", "r._p"))
        _gone(walk)
        walk, steps = longer, steps * 2
    _gone(walk)
    return found if max_depth is None else found.where(F.col("depth") <= max_depth)


def closure_sql(links: DataFrame, max_depth: int | None = None) -> DataFrame:
    """The same as one recursive query, for graphs that are known to have no cycle.

    Spark ends a recursion that is deeper than ``spark.sql.cteRecursionLevelLimit`` with an error.
    """
    spark = links.sparkSession
    deeper = "" if max_depth is None else f" WHERE c.depth < {max_depth}"
    links.select("parent_id", "child_id").distinct().createOrReplaceTempView("_links")
    return spark.sql(
        f"""WITH RECURSIVE c(node_id, other_id, depth) AS (
            SELECT parent_id, child_id, 1 FROM _links
            UNION ALL
            SELECT c.node_id, l.child_id, c.depth + 1 FROM c JOIN _links l ON c.other_id = l.parent_id{deeper})
        SELECT node_id, other_id, min(depth) AS depth FROM c GROUP BY node_id, other_id"""
    )


def shortest_paths(links: DataFrame, start: DataFrame, end: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(start_id, end_id, path, n_nodes): a shortest path of each pair that has one.

    Of several, the one that is least in order of its ids. The reach doubles each round, as in :func:`closure`.
    """
    hop = links.select(F.col("parent_id").alias("node_id"), F.col("child_id").alias("other_id")).distinct()
    found = _reach(hop, start, True, max_depth).join(end.select(F.col("node_id").alias("other_id")).distinct(), "other_id")
    path = F.concat(F.array("node_id"), F.col("path"))
    return found.select(F.col("node_id").alias("start_id"), F.col("other_id").alias("end_id"), path.alias("path"), F.size(path).alias("n_nodes"))


def chain(links: DataFrame, nodes: DataFrame, target: DataFrame) -> DataFrame:
    """The path to each target from its source; of several sources the least id."""
    up = closure(links, target, down=False)
    sources = nodes.where(F.size("parent_nodes") == 0).select(F.col("node_id").alias("other_id"))
    first = up.join(sources, "other_id").groupBy("node_id").agg(F.min("other_id").alias("source_id"))
    paths = shortest_paths(links, first.select(F.col("source_id").alias("node_id")), first.select("node_id"))
    return paths.join(first, (F.col("start_id") == F.col("source_id")) & (F.col("end_id") == F.col("node_id"))).select("node_id", "source_id", "path", "n_nodes")


def time_metrics(nodes: DataFrame) -> DataFrame:
    """Metrics of a node whose name contains ``time``."""
    return nodes.select("node_id", "node_type", "operation", F.explode("performance_metrics").alias("metric", "value")).where(F.col("metric").contains("time"))


def performance_summary(nodes: DataFrame) -> DataFrame:
    """Total time in all, by operation and by type: (grouping, name, total_time)."""
    t = time_metrics(nodes)
    t.createOrReplaceTempView("_times")
    return nodes.sparkSession.sql(
        """SELECT CASE grouping_id(operation, node_type) WHEN 3 THEN 'all' WHEN 1 THEN 'operation' ELSE 'type' END AS grouping,
                  coalesce(operation, node_type, '') AS name, sum(value) AS total_time
           FROM _times GROUP BY GROUPING SETS ((operation), (node_type), ())"""
    )


def path_time(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Processing time along each path."""
    steps = paths.select("start_id", "end_id", F.explode("path").alias("node_id"))
    return steps.join(time_metrics(nodes).groupBy("node_id").agg(F.sum("value").alias("t")), "node_id", "left").groupBy("start_id", "end_id").agg(F.sum(F.coalesce("t", F.lit(0.0))).alias("total_time"))


def totals(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(n_nodes, n_edges, n_sources, n_sinks)."""
    counts = nodes.agg(F.count("*").alias("n_nodes"), F.sum((F.size("parent_nodes") == 0).cast("long")).alias("n_sources"))
    sinks = nodes.join(links.select(F.col("parent_id").alias("node_id")), "node_id", "left_anti").agg(F.count("*").alias("n_sinks"))
    n_edges = links.agg(F.count("*").alias("n_edges"))
    one = F.lit(1).alias("_all")
    return counts.select("*", one).join(n_edges.select("*", one), "_all").join(sinks.select("*", one), "_all").drop("_all")


def add_step(steps: Column, step: Column) -> Column:
    """A stage's own list of steps with one more."""
    return F.array_append(steps, step)


def latest(nodes: DataFrame) -> DataFrame:
    """One row for each node id: the newest (nodes may be recorded again)."""
    w = Window.partitionBy("node_id").orderBy(F.desc("timestamp"))
    return nodes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
