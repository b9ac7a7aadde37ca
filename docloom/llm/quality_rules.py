"""Operator 4, quality rules: counts of a text and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word unigrams and bigrams are counted, one over trusted
target texts and one over the whole raw corpus. A document's score is the sum of
log(target share / raw share) over its n-grams, divided by their number; the document's own
n-grams are left out of the counts, so a rare n-gram says nothing about the text that
brought it. The log ratios are integers (units of 2**-16), so sums are exact and the
verdict on every document is the same in every run and on every partitioning.

The number of buckets follows the measured number of n-grams, so an n-gram shares its bucket
as rarely in a large corpus as in a small one. No task holds all counts: texts become blocks
of numbered words (see ``blocks``), each block's distinct buckets go with their counts to
shards (ranges of buckets), which sum them and hand the sums back to the blocks that asked.

Edge cases: a null text is an empty text; a document without words has score 0 and fails
the base rules; repeated rows are judged alike; an empty table gives an empty result; of
further columns of ``docs`` only ``doc_id``, ``text`` and, if there, ``lang`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.blocks import Block, blocks, mixed, narrow, numbered, shards_of, tallied, widened
from docloom.llm.common import BROADCAST_IDS, WORD, bounded_batches, give_back, tidy, trusted_ids, with_flag, written

#: Hash buckets of n-grams where the corpus has at most a quarter as many n-grams; a larger
#: one has ROOM buckets for each of its n-grams at least.
BUCKETS = 1 << 16
ROOM = 64
#: N-grams of a shard of buckets, about.
SHARD_GRAMS = 1 << 22
#: Words of a block in a pipeline, where executors are fuller and disk is less scarce.
STAGE_WORDS = 1 << 20
#: Units of a log ratio.
UNIT = 1 << 16
#: A document goes if its mean log ratio is below what all but QUANTILE of its language's
#: trusted documents reach, and below THRESHOLD. Languages with fewer than ENOUGH trusted
#: documents take the quantile of all.
THRESHOLD = -0.02
QUANTILE = 0.01
ENOUGH = 50
#: Added to the target count of every bucket, and to what the raw share lets expect of it:
#: a bucket with few n-grams says little either way.
PSEUDO = 4.0
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 5
COUNTS = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_UNIGRAM = np.uint64(0x9E3779B97F4A7C15)

RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, score double, n_ngrams long"
)


def buckets(hashes: np.ndarray, count: int) -> np.ndarray:
    """Buckets (of ``count``, a power of two) of hashed n-grams."""
    return (hashes >> np.uint64(65 - count.bit_length())).astype(np.int64)


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words that stand in a window of WINDOW words that the text has twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    key, size = ids, distinct
    code = key[:n]
    for k in range(1, WINDOW):
        code = code * distinct + key[k : k + n]
        size *= distinct
        if size * distinct >= 1 << 62:
            values, code = np.unique(code, return_inverse=True)
            size = len(values)
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    if not twice.any():
        return 0
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    edge[:n] += twice
    edge[WINDOW : WINDOW + n] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: str, words: list[bytes], ids: np.ndarray, distinct: int) -> tuple[int, int, int, int, int]:
    """The number of words and COUNTS of a text."""
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACES):
            seen.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        dup,
        repeated_words(ids, distinct),
    )


def named(docs: DataFrame) -> Column:
    return F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")


def row_key(docs: DataFrame) -> Column:
    """A hash of all that a verdict depends on; nulls count."""
    parts = (F.col("doc_id").cast("long"), F.col("text"), named(docs))
    return F.xxhash64(*[x for p in parts for x in (p.isNull(), p)])


def sizes(flagged: DataFrame) -> tuple[int, int]:
    """N-grams of all texts and of the trusted ones."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    n = F.greatest(F.lit(0).cast("long"), 2 * words - 1)
    r = flagged.agg(F.sum(n), F.sum(F.when(F.col("trusted"), n))).first()
    return r[0] or 0, r[1] or 0


class Grams:
    """The distinct buckets ``keys`` of a block, and the places among them of its unigrams and of its bigrams."""

    def __init__(self, block: Block, count: int) -> None:
        width = max(1, len(block.hashes))
        inner = np.ones(max(0, len(block.ids) - 1), bool)
        inner[block.ends[(block.ends > 0) & (block.ends <= len(inner))] - 1] = False
        code = block.ids[:-1].astype(np.int64)
        code *= width
        code += block.ids[1:]
        pairs, at = numbered(code[inner])
        del code, inner
        one = buckets(block.hashes * _UNIGRAM, count)
        two = buckets(mixed(block.hashes[pairs // width], block.hashes[pairs % width]), count)
        self.keys, place = numbered(np.concatenate([one, two]))
        self.places = place[: len(one)][block.ids], place[len(one) :][at]
        self.sizes = block.size, np.maximum(0, block.size - 1)
        self.ends = tuple(x.cumsum() for x in self.sizes)

    def counts(self, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """N-grams of every bucket in all rows, and in those that are ``good``."""
        raw, target = (np.zeros(len(self.keys), np.int64) for _ in range(2))
        for place, size in zip(self.places, self.sizes):
            raw += np.bincount(place, minlength=len(raw))
            target += np.bincount(place[np.repeat(good > 0, size)], minlength=len(raw))
        return raw, target

    def owned(self, block: Block) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, and for each of their distinct buckets the row (from 0), the key's place and the n-grams in it."""
        width = np.int64(max(1, len(self.keys)))
        for rows, _, _ in block.slices():
            code = [
                np.repeat(np.arange(rows.stop - rows.start), size[rows]) * width + place[ends[rows.start] - size[rows.start] : ends[rows.stop - 1]]
                for place, size, ends in zip(self.places, self.sizes, self.ends)
            ]
            found, n = tallied(np.concatenate(code))
            yield rows, found // width, found % width, n


def block_counts(dealt: DataFrame, count: int, edges: list[int]) -> DataFrame:
    """Every block's distinct buckets by shard, with the n-grams in them in all texts and in trusted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                grams, good = Grams(block, count), block.column("trusted")
                found = list(shards_of(grams.keys, np.array(edges), grams.counts(good)))
                shard, size, *data = zip(*found) if found else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([row[c]] * len(found), pa.int64()) for c in ("block", "checksum")), pa.array(shard, pa.int64()), pa.array(size, pa.int64()), *(pa.array(x, pa.binary()) for x in data)],
                    names=["block", "checksum", "shard", "size", "keys", "raw", "target"],
                )

    return dealt.mapInArrow(tidy(run), "block long, checksum long, shard long, size long, keys binary, raw binary, target binary")


def shard_sums(counts: DataFrame) -> DataFrame:
    """The rows of ``block_counts`` with the counts of all other blocks in place of the block's.

    A shard's keys are numbered range by range, and one block's counts are unpacked at a time: a task's memory is about
    22 bytes for each key of a block.
    """

    def summed(table: pa.Table) -> pa.Table:
        size = table.column("size").to_pylist()
        ends = np.cumsum([0, *size]).tolist()
        spans = [slice(*x) for x in zip(ends[:-1], ends[1:])]
        keys = np.empty(ends[-1], np.int64)
        for x, span, n in zip(table.column("keys"), spans, size):
            np.cumsum(widened(x.as_py(), n), out=keys[span])
        found, at = numbered(keys)
        distinct = len(found)
        del keys, found
        out = []
        for c in ("raw", "target"):
            total, packed = np.zeros(distinct, np.int64), []
            for x, span, n in zip(table.column(c), spans, size):
                total[at[span]] += widened(x.as_py(), n)  # a block's keys are distinct
            for x, span, n in zip(table.column(c), spans, size):
                packed.append(narrow(total[at[span]] - widened(x.as_py(), n)))  # mostly 0, which is short
            out.append(pa.array(packed, pa.binary()))
        return pa.table([*(table.column(c) for c in ("block", "checksum", "shard", "size")), *out], names=["block", "checksum", "shard", "size", "raw", "target"])

    def run(table: pa.Table) -> pa.Table:
        out = summed(table)
        give_back()
        return out

    return counts.groupBy("shard").applyInArrow(run, "block long, checksum long, shard long, size long, raw binary, target binary")


GRADES = (
    "row long, doc_id long, lang string, trusted boolean, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, total long, n_ngrams long, step long"
)


def grades(docs: DataFrame, labels: DataFrame, block_words: int | None = None) -> DataFrame:
    """GRADES of every document: base counts, and the summed integer log ratios of its n-grams.

    The text itself is left out of the counts. Without any (other) trusted text all ratios are 0.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(row_key(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), named(docs).alias("lang"), "text")
    flagged = with_flag(rows, trusted_ids(labels), "trusted")
    raw_all, target_all = sizes(flagged)
    count = BUCKETS if 4 * raw_all <= BUCKETS else 1 << (ROOM * raw_all).bit_length()
    shards = max(1, raw_all // SHARD_GRAMS)
    edges = [-(-count * k // shards) for k in range(shards)]
    dealt = blocks(flagged, base_counts, ("n_words", *COUNTS), block_words)

    def graded_block(packed: pa.Table, sums: pa.Table) -> pa.Table:
        out = []
        for row in packed.to_pylist():
            block = Block(row)
            grams, good = Grams(block, count), block.column("trusted")
            if any(x != row["checksum"] for x in sums.column("checksum").to_pylist()):
                raise RuntimeError("quality rules: a block was dealt otherwise than before")
            parts = sorted(zip(*(sums.column(c).to_pylist() for c in ("shard", "size", "raw", "target"))))
            raw, target = (np.concatenate([np.zeros(0, np.int64), *(widened(p[k], p[1]) for p in parts)]) for k in (2, 3))
            if len(raw) != len(grams.keys):
                raise RuntimeError("quality rules: a block's counts are not those it asked for")
            raw, target = (x + y for x, y in zip((raw, target), grams.counts(good)))
            length = np.maximum(0, 2 * block.size - 1)
            raw_sum, target_sum = raw_all - length, target_all - length * good
            some = (raw_sum > 0) & (target_sum > 0)
            share = np.where(some, target_sum, 0) / np.where(some, raw_sum, 1)
            total = np.zeros(len(length), np.int64)
            for rows, owner, place, n in grams.owned(block):
                ratios = np.log((target[place] - n * good[rows][owner] + PSEUDO) / ((raw[place] - n) * share[rows][owner] + PSEUDO))
                units = np.where(some[rows][owner], np.rint(ratios * UNIT).astype(np.int64) * n, 0)
                # Sums of integers below 2**53 are exact in doubles.
                total[rows] = np.bincount(owner, weights=units, minlength=rows.stop - rows.start).astype(np.int64)
            n_words, repeats = block.size, block.column("n_repeat_words")
            step = [t * 1000 // (k * UNIT) if k else None for t, k in zip(total.tolist(), length.tolist())]
            out.append(
                pa.table(
                    [
                        *(block.meta.column(c) for c in ("row", "doc_id", "lang", "trusted", "n_words", *COUNTS)),
                        pa.array((n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words)),
                        pa.array(total), pa.array(length), pa.array(step, pa.int64()),
                    ],
                    names=[x.split()[0] for x in GRADES.split(", ")],
                )
            )
        return pa.concat_tables(out)

    def run(packed: pa.Table, sums: pa.Table) -> pa.Table:
        out = graded_block(packed, sums)
        give_back()
        return out

    sums = shard_sums(block_counts(dealt, count, edges))
    return written(dealt.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(run, GRADES), "grades")


def least(step: Column, threshold: float) -> Column:
    """The least integer mean that is kept, given the step of the quantile."""
    at = F.coalesce(F.floor(step * UNIT / 1000), F.lit(UNIT))
    return F.least(F.lit(int(np.floor(threshold * UNIT))).cast("long"), at.cast("long"))


def quantiles(tally: DataFrame, by: list[str], quantile: float) -> DataFrame:
    """The least step that more than ``quantile`` of a group's documents stand at or below."""
    w = Window.partitionBy(*by)
    ranked = tally.withColumns({"up": F.sum("n").over(w.orderBy("step")), "all": F.sum("n").over(w)})
    return ranked.where(F.col("up") > F.col("all") * quantile).groupBy(*by).agg(F.min("step").alias("at"), F.first("all").alias("all"))


def graded(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, quantile: float = QUANTILE, block_words: int | None = None) -> DataFrame:
    """GRADES and ``kept`` of every document."""
    found = grades(docs, labels, block_words)
    tally = written(found.where("trusted and step is not null").groupBy("lang", "step").agg(F.count("*").alias("n")), "steps")
    every = tally.groupBy("step").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1))
    overall = quantiles(every, ["one"], quantile).first()
    limits = quantiles(tally, ["lang"], quantile).where(F.col("all") >= ENOUGH).select(F.col("lang").alias("_lang"), "at")
    step = F.coalesce("at", F.lit(overall["at"] if overall else None).cast("long"))
    joined = found.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    kept = ~F.col("base_failed") & (F.col("total") >= least(step, threshold) * F.col("n_ngrams"))
    return joined.withColumn("kept", kept).drop("_lang", "at")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, score and verdict of every document; see RESULT."""
    score = F.when(F.col("n_ngrams") > 0, F.col("total") / (F.col("n_ngrams") * UNIT)).otherwise(0.0)
    return graded(docs, labels, threshold).withColumn("score", score).select(*[x.split()[0] for x in RESULT.split(", ")])


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    # A name that no table is likely to have: the rows keep their own columns.
    keep = written(graded(docs, labels, threshold, block_words=STAGE_WORDS).where("kept").select(F.col("row").alias("__quality_row")).distinct(), "kept")
    if keep.count() <= BROADCAST_IDS:
        keep = F.broadcast(keep)
    return docs.join(keep, row_key(docs) == F.col("__quality_row"), "left_semi")
