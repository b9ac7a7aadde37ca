"""Operator 11, filter interaction audit: what each filter removes in every order of the filters.

One pass over the texts gives each document a mask of the filters that it fails and a digest
of its text. Documents are summed to mask cells of a part (a language), at most 32 a part
for five filters, and only cells reach the enumeration. It visits all orders by swaps of neighbours:
a swap changes two steps, which are read again from the cells, and what each filter removes
is added up along the walk, which is its Shapley sum.

``Filters`` names conditions on a text; the last filter of the query fails a document whose
text a smaller doc_id has too, anywhere in the table. The least id of a text is found over
counts of (text, part, labels), not over documents, so a text with a third of all rows is a
few rows when it is compared.

Edge cases: a null or empty text has no words (it fails A, and not B, C or D), and equals
every other empty text; a null language is the part of the empty string; a null doc_id has no
labels, has no smaller id and is no smaller id; repeated rows of one doc_id are counted each,
and none is a copy of the other; a doc_id that is labelled several times is good (toxic) if
one label says so; very long texts are taken whole; a tie (50 distinct of 100 words, 3 % capitals)
doesn't fail; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import bounded_batches, tidy

CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = b"#$%&*|"
#: Join keys that documents without an id are dealt to.
SPREAD = 256

AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)
Fails = Callable[[str, bytes, list[bytes]], bool]


def few_words(text: str, data: bytes, words: list[bytes]) -> bool:
    return len(words) < 200


def few_kinds(text: str, data: bytes, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < 50 * len(words)


def many_capitals(text: str, data: bytes, words: list[bytes]) -> bool:
    return 100 * (len(data) - len(data.translate(None, CAPITALS))) > 3 * len(text)


def any_sign(text: str, data: bytes, words: list[bytes]) -> bool:
    return len(data.translate(None, SIGNS)) < len(data)


#: Filters of a text by letter; a filter that compares documents follows as the last letter.
FILTERS: dict[str, Fails] = {"A": few_words, "B": few_kinds, "C": many_capitals, "D": any_sign}
COPY = "E"


def features(docs: DataFrame, filters: dict[str, Fails]) -> DataFrame:
    """(doc_id, part, digest, mask): a bit for each filter that the text fails, in order."""
    bounded_batches(docs.sparkSession)
    checks = list(filters.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, masks = [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                data = text.encode()
                words = data.split()
                digests.append(hashlib.blake2b(data, digest_size=16).digest())
                masks.append(sum(check(text, data, words) << k for k, check in enumerate(checks)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())],
                names=["doc_id", "part", "digest", "mask"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), "text")
    return rows.mapInArrow(tidy(run), "doc_id long, part string, digest binary, mask int")


def cells(docs: DataFrame, labels: DataFrame, filters: dict[str, Fails] | None = None) -> DataFrame:
    """(part, mask, docs, good, toxic): documents by the filters they fail; copies are the highest bit."""
    filters = FILTERS if filters is None else filters
    held = features(docs, filters).withColumn("deal", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(SPREAD))).otherwise(0))
    label = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic")
    )
    met = held.join(label.withColumn("deal", F.lit(0).cast("long")), ["doc_id", "deal"], "left").withColumns(
        {"good": F.coalesce("good", F.lit(0)), "toxic": F.coalesce("toxic", F.lit(0))}
    )
    by = ["digest", "mask", "part", "good", "toxic"]
    # Rows of one id first (they lie together after the join), so that a text's least id knows how many rows it has.
    ids = met.groupBy("doc_id", "deal", *by).agg(F.count("*").alias("n"))
    texts = ids.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least")
    )
    # At most four rows for each text and language from here on.
    first = F.min("least").over(Window.partitionBy("digest"))
    original = F.col("unnamed") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    split = texts.withColumn("first", first).withColumn("original", original)
    copied = F.col("mask").bitwiseOR(F.lit(1 << len(filters)))
    either = F.explode(F.array(F.struct(F.col("mask"), F.col("original").alias("n")), F.struct(copied.alias("mask"), (F.col("n") - F.col("original")).alias("n"))))
    rows = split.select("part", "good", "toxic", either.alias("c")).select("part", "c.mask", "c.n", "good", "toxic").where("n > 0")
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def swaps(n: int) -> Iterator[int | None]:
    """Positions k whose entries k and k + 1 are swapped, one after the other, to visit all orders of n; None begins."""
    order, toward = list(range(n)), [-1] * n
    yield None
    while True:
        at = {x: k for k, x in enumerate(order)}
        free = [x for x in order if 0 <= at[x] + toward[x] < n and order[at[x] + toward[x]] < x]
        if not free:
            return
        x = max(free)
        k, other = at[x], at[x] + toward[x]
        order[k], order[other] = order[other], order[k]
        for y in range(x + 1, n):
            toward[y] = -toward[y]
        yield min(k, other)


class Walk:
    """The steps of one part's filters, kept up to date while neighbours are swapped."""

    def __init__(self, masks: list[int], counts: list[tuple[int, int, int]], n: int) -> None:
        self.cells, self.n = list(zip(masks, counts)), n
        self.total = sum(c[0] for c in counts)
        self.fails = [sum(c[0] for m, c in self.cells if m >> f & 1) for f in range(n)]
        self.alone = [sum(c[0] for m, c in self.cells if m == 1 << f) for f in range(n)]
        self.order = list(range(n))
        self.steps: list[tuple[int, ...]] = [()] * n
        for k in range(n):
            self.read(k)

    def read(self, k: int) -> None:
        """Step k from the cells: (kept, removed, redundant, good lost, toxic lost)."""
        f, before = self.order[k], sum(1 << x for x in self.order[:k])
        lost = [c for m, c in self.cells if m >> f & 1 and not m & before]
        removed, good, toxic = (sum(c[i] for c in lost) for i in range(3))
        kept = sum(c[0] for m, c in self.cells if not m & (before | 1 << f))
        self.steps[k] = (kept, removed, self.fails[f] - removed, good, toxic)

    def swap(self, k: int) -> None:
        self.order[k], self.order[k + 1] = self.order[k + 1], self.order[k]
        self.read(k)
        self.read(k + 1)


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Fails] | None = None) -> DataFrame:
    """AUDIT: a row for each part, order and step."""
    filters = FILTERS if filters is None else filters
    names = [*filters, COPY]

    def walk(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        w = Walk(frame["mask"].tolist(), list(zip(*(frame[c].tolist() for c in ("docs", "good", "toxic")))), len(names))
        rows, shapley = [], [0] * len(names)
        for k in swaps(len(names)):
            if k is not None:
                w.swap(k)
            label = "".join(names[f] for f in w.order)
            for step, (f, (kept, removed, redundant, good, toxic)) in enumerate(zip(w.order, w.steps), 1):
                shapley[f] += removed
                rows.append([key[0], label, step, kept, removed, redundant, w.alone[f], good, toxic, f])
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in AUDIT.split(", ")])
        out["shapley"] = out["shapley"].map(shapley.__getitem__)
        return out

    return cells(docs, labels, filters).groupBy("part").applyInPandas(walk, AUDIT)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
firsts AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > least, false)::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM w JOIN firsts USING (t) LEFT JOIN l USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
x(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders5 AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
            FROM x a, x b, x c, x d, x e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps AS (SELECT filter_order, s AS step, bits[s] AS bit, coalesce(list_sum(bits[1 : s - 1]), 0)::INT AS before FROM orders5, range(1, 6) r(s)),
made AS (SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM made"""
