"""Operator 9, SimHash near-duplicates: pigeonhole blocks, then Hamming distance.

A fingerprint has 64 bits in four blocks of 16. Two fingerprints that differ in at most
two bits agree in at least two whole blocks, so each is keyed by its six pairs of blocks
(32 bits each) and every close pair meets under one key at least. Only distinct
fingerprints are keyed: documents with equal fingerprints are one node, the least doc_id.

Under a key with few fingerprints the pairs are compared. A key that many fingerprints
share is taken apart exactly, without its pairs: every fingerprint is listed under itself
and under its one-bit neighbours (only the 32 bits outside the key can differ). Those
listed at one place differ in at most two bits from each other, and any two that differ in
at most two bits have such a place in common, so a star at each place links what pairs
would. A place lists at most 33 fingerprints.

Edge cases: a null text is an empty text; texts without words have fingerprint zero and
are linked like any other; with fewer words than a shingle, the whole sequence is the one
shingle; repeated rows keep their number; an empty table gives an empty result; only
``doc_id`` and ``text`` are read. Rows whose doc_id is null keep a null component unless
their fingerprint occurs with an id.

``similar`` groups by the resemblance of shingle sets instead (what stages on word shingles
ask for), for which fingerprints are no good: at a resemblance of 0.8 two of 64 bits differ in
ten places on average and in up to twenty, and pigeonhole blocks for twenty bits would have
three bits each. Least hashes of the sets meet in bands, of which a pair at 0.8 shares none
with a probability of 4e-6, and every pair that met is held against its whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import BROADCAST_IDS, bounded_batches, components, dropped, tidy, written

SHINGLE = 3
SEED = 42
DISTANCE = 2
BLOCKS = 4
BLOCK_BITS = 16
#: Up to so many fingerprints under one key are compared pair by pair.
FEW = 48
#: Members of a larger bucket, and their hashes, that are held against as many others in a task.
MANY, HASHES = 2048, 1 << 20
#: Shingles of one text that are worked on at a time.
CHUNK = 1 << 12
#: Bands of least hashes, and least hashes in each.
BANDS, ROWS = 24, 4


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The SimHash of a text as an unsigned 64-bit integer."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxh64_intdigest(joined, SEED)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *[e + 1 for e in ends[: len(words) - size]]]
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :])], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, fp long")


def block(fp: str, k: int) -> Column:
    return F.shiftrightunsigned(F.col(fp), k * BLOCK_BITS).bitwiseAND((1 << BLOCK_BITS) - 1)


def links(nodes: DataFrame) -> DataFrame:
    """Edges (u, v) of node ids that join all fingerprints within DISTANCE bits.

    ``nodes`` has distinct ``fp`` and their ``node``. Not every close pair is an edge, but
    the edges connect exactly what all close pairs would connect.
    """
    pairs = list(combinations(range(BLOCKS), BLOCKS - DISTANCE))
    keys = F.array(
        *[
            F.struct(F.lit(n).alias("combo"), F.shiftleft(block("fp", i), BLOCK_BITS).bitwiseOR(block("fp", j)).alias("key"))
            for n, (i, j) in enumerate(pairs)
        ]
    )
    keyed = written(nodes.select("fp", "node", F.explode(keys).alias("k")).select("fp", "node", "k.combo", "k.key"), "blocks")
    many = keyed.groupBy("combo", "key").agg(F.count("*").alias("n")).where("n > 1")
    sized = written(keyed.join(many, ["combo", "key"]), "blocks")

    few = sized.where(F.col("n") <= FEW).groupBy("combo", "key").agg(F.sort_array(F.collect_list(F.struct("node", "fp"))).alias("m"))
    near = few.select(
        F.explode(
            F.flatten(
                F.transform(
                    "m",
                    lambda a, i: F.transform(
                        F.filter(
                            F.slice("m", i + 2, FEW),
                            lambda b: F.bit_count(a["fp"].bitwiseXOR(b["fp"])) <= DISTANCE,
                        ),
                        lambda b: F.struct(b["node"].alias("u"), a["node"].alias("v")),
                    ),
                )
            )
        ).alias("e")
    ).select("e.u", "e.v")

    def masks(i: int, j: int) -> Column:
        free = [b for k in range(BLOCKS) if k not in (i, j) for b in range(k * BLOCK_BITS, (k + 1) * BLOCK_BITS)]
        return F.array(F.lit(0).cast("long"), *[F.lit((1 << b) - ((1 << 64) if b == 63 else 0)).cast("long") for b in free])

    by_combo = F.lit(None).cast("array<long>")
    for n, (i, j) in enumerate(pairs):
        by_combo = F.when(F.col("combo") == n, masks(i, j)).otherwise(by_combo)
    places = sized.where(F.col("n") > FEW).select("combo", "node", "fp", F.explode(by_combo).alias("mask"))
    stars = (
        places.groupBy("combo", F.col("fp").bitwiseXOR(F.col("mask")).alias("place"), block_key(pairs).alias("key"))
        .agg(F.min("node").alias("v"), F.collect_set("node").alias("all"))
        .where(F.size("all") > 1)
        .select(F.explode("all").alias("u"), "v")
        .where("u <> v")
    )
    return near.unionByName(stars).distinct()


def block_key(pairs: list[tuple[int, int]]) -> Column:
    """The bits of a row's key, which a place keeps as they are."""
    key = F.lit(None).cast("long")
    for n, (i, j) in enumerate(pairs):
        mask = sum(((1 << BLOCK_BITS) - 1) << (k * BLOCK_BITS) for k in (i, j))
        key = F.when(F.col("combo") == n, F.col("fp").bitwiseAND(F.lit(mask - ((1 << 64) if mask >= 1 << 63 else 0)).cast("long"))).otherwise(key)
    return key


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): the least doc_id reachable over close fingerprints."""
    prints = written(fingerprints(docs), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    roots = components(links(nodes.where("node is not null")))
    classes = written(
        nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id")), "classes"
    )
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; none without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    shingles = {b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
    return np.unique(np.fromiter((xxh64_intdigest(x, SEED) for x in shingles), np.uint64, len(shingles)))


def least_hashes(own: np.ndarray) -> np.ndarray:
    """BANDS * ROWS least hashes of a set."""
    factors = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, dtype=np.uint64)
    for at in range(0, len(own), CHUNK):
        least = np.minimum(least, np.multiply.outer(own[at : at + CHUNK], factors).min(axis=0))
    return least


def band_keys(own: np.ndarray) -> list[int]:
    """The keys of a set's bands, none for an empty set."""
    from xxhash import xxh64_intdigest

    if not len(own):
        return []
    return [xxh64_intdigest(x.tobytes(), k) - (1 << 63) for k, x in enumerate(least_hashes(own).reshape(BANDS, ROWS))]


def set_print(own: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(own.tobytes(), SEED) - (1 << 63)


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, print, hashes): the sets of ``docs`` and what tells them apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, size) for t in batch.column("text").to_pylist()]
            hashes = pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(map(set_print, sets), pa.int64()), hashes], names=["doc_id", "print", "hashes"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, print long, hashes array<long>")


def resembling(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (u, v) of prints whose whole sets have at least ``similarity`` in common."""
    met = pairs
    for c in ("u", "v"):
        met = met.join(sets.select(F.col("print").alias(c), F.col("hashes").alias(f"_{c}")), c)
    both = F.size(F.array_intersect("_u", "_v"))
    return met.where(both >= similarity * (F.size("_u") + F.size("_v") - both)).select("u", "v")


def pairs_of_few(buckets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) of prints that share a bucket and not a group, for buckets of FEW members at most.

    Sets whose sizes alone rule out ``similarity`` are no pair.
    """
    m = buckets.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("print", "root", "size"))).alias("m"))
    apart = F.transform(
        "m",
        lambda a, i: F.transform(
            F.filter(F.slice("m", i + 2, FEW), lambda b: (a["root"] != b["root"]) & (F.least(a["size"], b["size"]) >= similarity * F.greatest(a["size"], b["size"]))),
            lambda b: F.struct(a["print"].alias("u"), b["print"].alias("v")),
        ),
    )
    return m.select(F.explode(F.flatten(apart)).alias("e")).select("e.u", "e.v").distinct()


def links_of_many(buckets: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) between groups that share a bucket of any size, a chunk against a chunk in a task.

    A chunk has MANY members and HASHES hashes, about. A task counts what a set has in common
    with all sets of the other chunk at once, and gives one link for each two groups it joins.
    """

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        prints, roots, chunk = (table.column(c).to_numpy() for c in ("print", "root", "chunk"))
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        hashes = table.column("hashes").chunk(0)
        size = np.diff(hashes.offsets.to_numpy())
        values, word = np.unique(hashes.flatten().to_numpy(), return_inverse=True)
        ends = size.cumsum()
        parent = {r: r for r in roots.tolist()}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        right = np.flatnonzero(chunk == high)
        flat = np.concatenate([word[ends[k] - size[k] : ends[k]] for k in right.tolist()])
        starts = size[right].cumsum() - size[right]
        mark, u, v = np.zeros(len(values), bool), [], []
        for a in np.flatnonzero(chunk == low).tolist():
            own = word[ends[a] - size[a] : ends[a]]
            mark[own] = True
            both = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[own] = False
            for b in right[(both >= similarity * (size[a] + size[right] - both)) & (roots[right] != roots[a])].tolist():
                x, y = find(int(roots[a])), find(int(roots[b]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    u.append(prints[a])
                    v.append(prints[b])
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    # Buckets with the same members are one.
    same = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("print").cast("decimal(38,0)")).alias("s"), F.sum("size").alias("hashes"))
    once = same.groupBy("n", "s").agg(F.min("bucket").alias("bucket"), F.first("hashes").alias("total"))
    chunks = F.greatest(F.ceil(F.col("n") / MANY), F.ceil(F.col("total") / HASHES))
    dealt = buckets.drop("n").join(once.drop("s"), "bucket").withColumns({"chunk": F.pmod(F.xxhash64("print"), chunks), "chunks": chunks})
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda o: F.struct(F.least("chunk", o).alias("low"), F.greatest("chunk", o).alias("high")))
    spread = dealt.select("bucket", "print", "root", "chunk", F.explode(others).alias("o")).select("bucket", "print", "root", "chunk", "o.*")
    return spread.join(sets, "print").groupBy("bucket", "low", "high").applyInArrow(compare, "u long, v long")


def similar(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """(doc_id, component_id): the least doc_id reachable over shingle sets that resemble each other.

    Sets meet in bands. Every member of a band's bucket is held against the bucket's least
    one first, which settles large groups of near copies with a pair for each member; then
    members of one bucket that are still in different groups are held against each other.
    No task holds a bucket or a group, and no pair within a group is made.
    """

    def prints_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, size) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(map(set_print, sets), pa.int64()), pa.array(map(band_keys, sets), pa.list_(pa.int64())), pa.array(map(len, sets), pa.int64())],
                names=["doc_id", "print", "bands", "size"],
            )

    bounded_batches(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    prints = written(texts.mapInArrow(tidy(prints_of), "doc_id long, print long, bands array<long>, size long"), "prints")
    nodes = written(prints.groupBy("print").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("size").alias("size")), "nodes")
    keyed = nodes.select("print", "size", F.posexplode("bands").alias("band", "key")).select("print", "size", F.xxhash64("band", "key").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.min("print").alias("v"), F.min_by("size", "print").alias("v_size"), F.count("*").alias("n")).where("n > 1")
    met = written(keyed.join(shared, "bucket"), "met")
    asked = written(nodes.select("print", "node").join(met.select("print").distinct(), "print"), "asked")
    ids = asked.select(F.col("node").alias("_node")).distinct()
    if asked.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    own = shingle_sets(texts.join(ids, F.col("doc_id").eqNullSafe(F.col("_node")), "left_semi"), size)
    # Rows with one id may have several texts; of rows with one print any will do.
    sets = written(own.join(asked.select("print"), "print", "left_semi").groupBy("print").agg(F.first("hashes").alias("hashes")), "sets")

    alike = F.least("size", "v_size") >= similarity * F.greatest("size", "v_size")
    stars = met.where(alike & (F.col("print") != F.col("v"))).select(F.col("print").alias("u"), "v").distinct()
    links = written(resembling(stars, sets, similarity), "links")
    groups = written(components(links).select(F.col("node").alias("print"), "root"), "groups")
    rooted = met.join(groups, "print", "left").select("bucket", "print", "size", "n", F.coalesce("root", "print").alias("root"))
    open_ = rooted.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("bucket")
    mixed = written(rooted.join(open_, "bucket"), "mixed")
    rest = resembling(pairs_of_few(mixed.where(F.col("n") <= FEW), similarity), sets, similarity)
    many = mixed.where(F.col("n") > FEW)
    if not many.isEmpty():
        rest = rest.unionByName(links_of_many(many, sets, similarity))
    more = written(rest, "links")
    if not more.isEmpty():
        groups = components(links.unionByName(more)).select(F.col("node").alias("print"), "root")
    grouped = nodes.select("print", "node").join(groups, "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = grouped.groupBy("root").agg(F.min("node").alias("component_id"))
    classes = written(grouped.select("print", "root").join(least, "root").select("print", "component_id"), "classes")
    out = written(prints.select("doc_id", "print").join(classes, "print").select("doc_id", "component_id"), "similar")
    for table in (prints, nodes, met, asked, sets, links, mixed, more, classes):
        dropped(table)
    return out


def near_or_similar(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """(doc_id, component_id): the least doc_id reachable over close fingerprints and resembling sets together.

    Rows without a doc_id are grouped as by ``similar``.
    """
    near, like = written(near_duplicates(docs).select("doc_id", "component_id"), "near"), similar(docs, size, similarity)
    links = near.unionByName(like).where("doc_id <> component_id").select(F.col("doc_id").alias("u"), F.col("component_id").alias("v")).distinct()
    roots = written(components(written(links, "links")).select(F.col("node").alias("_node"), "root"), "groups")
    return like.join(roots, F.col("doc_id") == F.col("_node"), "left").select("doc_id", F.coalesce("root", "component_id").alias("component_id"))


def representatives(docs: DataFrame, size: int = SHINGLE, similarity: float | None = None, linked: bool = False) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates: that of the least doc_id.

    With ``similarity`` near duplicates are those of ``similar`` with shingles of ``size``
    words (``linked``: those of ``near_or_similar``), without it those of ``near_duplicates``. Rows with equal ids count as one
    document, of which the least row stays.
    """
    groups = near_duplicates(docs) if similarity is None else (near_or_similar if linked else similar)(docs, size, similarity)
    found = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # Names that no table is likely to have: the rows keep their own columns.
    keep = written(found.groupBy(F.col("doc_id").alias("__simhash_id")).agg(F.count("*").alias("__simhash_n")), "kept")
    once, more = keep.where("__simhash_n = 1"), keep.where("__simhash_n > 1")
    if keep.count() <= BROADCAST_IDS:
        once, more = F.broadcast(once), F.broadcast(more)
    same = F.col("doc_id").eqNullSafe(F.col("__simhash_id"))
    row = F.min(F.struct(*docs.columns)).alias("__simhash_row")
    single = docs.join(more, same, "left_semi").groupBy("doc_id").agg(row).select("__simhash_row.*")
    return docs.join(once, same, "left_semi").unionByName(single)
