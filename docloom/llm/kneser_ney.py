"""Operator 1, quality classifier: perplexity under an interpolated modified Kneser-Ney model.

The model counts word n-grams up to ORDER in all trusted texts of a language, with three
discounts per order and continuation counts below the highest order; n-grams that begin a
text keep their raw counts there. What it holds grows with the text, so no task holds it:
n-grams are keys of a space cut into shards, and texts are blocks of numbered words (see
``blocks``). Training goes down order by order. Every block of trusted text sends the counts
of its distinct n-grams to their shards; a shard sums them and tells one block for each
n-gram, its owner, the sum. Owners, which know the words, credit the n-gram to its context and
to the n-gram without its first word, and these credits are the next order's counts. Blocks of
all texts then ask the shards for the sums of their distinct n-grams, and add up.

Only distinct n-grams of a block travel, as sorted keys in compressed byte planes. The key
space of an order has 2**ROOM_BITS keys for each word of the trusted text, 2**LEAST_BITS at
least: an n-gram that was never seen takes another's counts with a probability of 2**-ROOM_BITS.

Log probabilities are integers (units of 2**-20), so sums do not depend on how rows are
dealt. Means are drawn towards the trusted mean of the language with the weight of PRIOR
words, as a few words say little.

Edge cases: a null text or one without words has no perplexity and is not kept; a null
language is a language of its own; a language without trusted text has no model: its documents
have no perplexity and are kept; a perplexity equal to the threshold is kept; a text longer than
a block is a block of its own; repeated rows are scored alike; an empty table gives an empty
result; only ``doc_id``, ``text`` and ``lang`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.blocks import Block, blocks, mixed, narrow, numbered, restored, shards_of, widened
from docloom.llm.common import BROADCAST_IDS, bounded_batches, dropped, tidy, trusted_ids, with_flag, written

ORDER = 3
UNIT = 1 << 20
QUANTILE = 0.98
#: One trusted document in so many is not trained on; thresholds are measured on these.
HELD_OUT = 5
#: Nats by which a threshold is raised where it rests on ENOUGH documents or fewer; less on more.
SLACK = 0.1
ENOUGH = 50
PRIOR = 20
#: Least discount, so that unseen n-grams keep a share where counts of counts give none.
LEAST = 0.1
ROOM_BITS = 12
LEAST_BITS = 32
STATS_BITS = 40
BLOCK_WORDS = 2 << 20
#: N-grams of all texts that a shard is asked for, about.
SHARD_GRAMS = 1 << 21
#: Documents are scored in so many portions, one after the other: what a portion asks for is off
#: the disk before the next one asks.
PORTIONS = 3
#: Bytes that a word and the space behind it take at least, on the average of a corpus.
WORD_BYTES = 4

#: What is summed for an n-gram: the counts of its continuations, how many continuations have
#: the count 1, 2, and 3 or more, and its own count. For the highest order only the last.
PARTS = ("total", "ones", "twos", "more", "own")
#: For a language and an order: n-grams with the counts 1 to 4, and all n-grams, in their stead.
ASK = f"block long, checksum long, shard long, size long, keys binary, langs binary, {', '.join(f'{p} binary' for p in PARTS)}"
LIGHT = "block long, checksum long, shard long, size long, keys binary"
ANSWER = "block long, shard long, size long, owned binary, lang long, n1 long, n2 long, n3 long, n4 long, types long, mass long"
FOUND = f"block long, checksum long, shard long, size long, {', '.join(f'{p} binary' for p in PARTS)}"
COUNTED = f"shard long, size long, keys binary, {', '.join(f'{p} binary' for p in PARTS)}"
RESULT = "doc_id long, lang string, n_words long, nll long"

_BEGIN, _END, _STATS = np.uint64(0xB1), np.uint64(0xE2), np.uint64(0x57A7)
_SALT = np.uint64(0xD6E8FEB86659FD93)


def lang_hash(lang: str | None) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(b"" if lang is None else b"=" + lang.encode())


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def arrow(schema: str) -> pa.Schema:
    return pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in schema.split(", ")])


def ranked(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``numbered``, for codes from 0: code and place share one number where 63 bits hold both, and that is sorted by itself."""
    n = len(code)
    shift = n.bit_length()
    if not n or int(code.max()) >> (63 - shift):
        return numbered(code)
    packed = code.astype(np.int64) << shift
    packed |= np.arange(n, dtype=np.int32)
    packed.sort()
    number, fresh, base, step = np.empty(n, np.int32), np.empty(n, bool), -1, 1 << 18
    fresh[0] = True
    for a in range(0, n, step):
        part = packed[max(0, a - 1) : a + step] >> shift
        fresh[max(1, a) : a + step] = part[1:] != part[:-1]
        up = fresh[a : a + step].cumsum(dtype=np.int32)
        number[packed[a : a + step] & ((1 << shift) - 1)] = up + base
        base += int(up[-1])
    packed >>= shift
    return packed[fresh], number


class Keys:
    """The space of keys: order by order ``bits`` of a hash, in ``shards`` ranges that begin at ``edges``.

    What is told of languages has a range of its own behind them (in the last shard), which no n-gram falls on.
    """

    def __init__(self, bits: int, shards: int) -> None:
        self.bits = bits
        self.edges = [-(-(ORDER << bits) * k // shards) for k in range(shards)]

    def of(self, hashes: np.ndarray, order: int) -> np.ndarray:
        own = mixed(hashes, np.full_like(hashes, _SALT)) >> np.uint64(64 - self.bits)
        return own.astype(np.int64) + ((order - 1) << self.bits)

    def stats(self, langs: np.ndarray, order: int) -> np.ndarray:
        """Even keys, one for each language and order."""
        own = mixed(langs, np.full_like(langs, _STATS)) >> np.uint64(64 - STATS_BITS)
        return (own.astype(np.int64) << 3) + 2 * order + (ORDER << self.bits)


class Grams:
    """The distinct n-grams of a block's texts, a text with words standing between two BEGIN and an END.

    For each order: ``keys`` of the distinct n-grams, ``context`` and ``lower`` the numbers of the
    n-gram's first and last ORDER - 1 words an order below, ``lang`` the number of its language.
    ``at`` is the number of the n-gram of the highest order at each word to be scored.
    """

    def __init__(self, block: Block, space: Keys) -> None:
        langs: dict[str | None, int] = {}
        number = np.array([langs.setdefault(x, len(langs)) for x in block.meta.column("lang").to_pylist()], np.int64)
        self.langs = np.array([lang_hash(x) for x in langs], np.uint64)
        some = np.flatnonzero(block.size)
        size, width = block.size[some], len(block.hashes) + 2
        # Where words, the begins and the end of each text stand.
        ends = (size + 3).cumsum()
        seq = np.full(int(ends[-1]) if len(ends) else 0, len(block.hashes), np.int64)
        first = np.zeros(len(seq), bool)
        first[ends - size - 3] = True
        seq[ends - 1] = len(block.hashes) + 1
        word = np.ones(len(seq), bool)
        word[ends - 1] = word[ends - size - 3] = word[ends - size - 2] = False
        seq[word] = block.ids
        del word
        seq += np.repeat(number[some] * width, size + 3)
        tokens, seq = ranked(seq)
        hashes = np.concatenate([block.hashes, np.array([_BEGIN, _END], np.uint64)])
        token_hash = mixed(self.langs[tokens // width], hashes[tokens % width])
        begins = tokens % width == len(block.hashes)
        # Pairs that end at each place but a text's first, then triples at each place but its first two.
        inner = np.flatnonzero(~first)
        pairs, pair_at = ranked(seq[inner - 1].astype(np.int64) * len(tokens) + seq[inner])
        pair_hash = mixed(token_hash[pairs // len(tokens)], token_hash[pairs % len(tokens)]) if len(pairs) else np.zeros(0, np.uint64)
        scored = np.flatnonzero(~first[inner - 1])
        triples, self.at = ranked(pair_at[scored - 1].astype(np.int64) * len(pairs) + pair_at[scored])
        three = (triples // max(1, len(pairs))).astype(np.int32), (triples % max(1, len(pairs))).astype(np.int32)
        two = (pairs // max(1, len(tokens))).astype(np.int32), (pairs % max(1, len(tokens))).astype(np.int32)
        triple_hash = mixed(pair_hash[three[0]], token_hash[two[1][three[1]]])
        self.context, self.lower = {3: three[0], 2: two[0]}, {3: three[1], 2: two[1]}
        self.lang = {1: tokens // width}
        self.lang[2] = self.lang[1][two[0]]
        self.lang[3] = self.lang[2][three[0]]
        self.opening = begins[two[0]]  # pairs that begin a text
        self.keys = {k: space.of(h, k) for k, h in ((1, token_hash), (2, pair_hash), (3, triple_hash))}
        self.count = np.bincount(self.at, minlength=len(triples))
        self.scored = size + 1
        self.rows = some


def asked(row: dict, space: Keys, keys: np.ndarray, langs: np.ndarray, parts: dict[str, np.ndarray]) -> pa.RecordBatch:
    """ASK rows of a block: its keys by shard in order, with the sums of ``parts`` over equal keys."""
    keys, at = ranked(keys)
    n = len(keys)
    sums = [np.bincount(at, weights=parts[p], minlength=n).astype(np.int64) if p in parts else np.zeros(n, np.int64) for p in PARTS]
    own = np.zeros(n, np.int64)
    own[at] = langs
    return by_shard(row, space, keys, names(ASK), own, *sums)


def by_shard(row: dict, space: Keys, keys: np.ndarray, columns: list[str], *parts: np.ndarray) -> pa.RecordBatch:
    found = list(shards_of(keys, np.array(space.edges), parts))
    shard, size, *data = zip(*found) if found else [()] * (3 + len(parts))
    head = [pa.array([row[c]] * len(found), pa.int64()) for c in ("block", "checksum")]
    return pa.RecordBatch.from_arrays([*head, pa.array(shard, pa.int64()), pa.array(size, pa.int64()), *(pa.array(x, pa.binary()) for x in data)], names=columns)


def firsts(at: np.ndarray, n: int) -> np.ndarray:
    """Where each of the numbers below ``n``, all of which occur, stands first."""
    first = np.empty(n, np.int64)
    first[at[::-1]] = np.arange(len(at) - 1, -1, -1)  # the last write stays
    return first


def summed(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Distinct keys of a shard's ASK rows, the number of each row's keys among them, and the sums."""
    keys = [widened(r["keys"], r["size"]).cumsum() for r in rows]
    keys, at = ranked(np.concatenate([np.zeros(0, np.int64), *keys]))
    sums = {}
    for p in PARTS:
        own = np.concatenate([np.zeros(0, np.int64), *(widened(r[p], r["size"]) for r in rows)])
        sums[p] = np.bincount(at, weights=own, minlength=len(keys)).astype(np.int64)
    return keys, at, sums


def owners(asks: DataFrame, langs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ANSWER rows: to every block the sums of what it owns (others: 0); and each language's counts of counts."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        keys, at, sums = summed(rows)
        # The first row with a key, in the order of blocks, owns it.
        first = firsts(at, len(keys))
        mine = np.zeros(len(at), np.int64)
        mine[first] = sums["own"][at[first]]
        out = []
        for r, n in zip(rows, np.split(mine, np.cumsum([r["size"] for r in rows])[:-1])):
            out.append({"block": r["block"], "shard": r["shard"], "size": r["size"], "owned": narrow(n)})
            lang = widened(r["langs"], r["size"])
            for k in np.unique(lang[n > 0]).tolist():
                m = n[(n > 0) & (lang == k)]
                out.append({"block": r["block"], "lang": k, **{f"n{c}": int((m == c).sum()) for c in (1, 2, 3, 4)}, "types": len(m), "mass": int(m.sum())})
        return pa.Table.from_pylist(out, arrow(ANSWER))

    found = written(asks.groupBy("shard").applyInArrow(run, ANSWER), "owned")
    total = [F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4", "types", "mass")]
    stats = found.where("lang is not null").groupBy("block", "lang").agg(*total).join(langs, ["block", "lang"]).groupBy("hash").agg(*total)
    return found.where("owned is not null"), stats


def credited(dealt: DataFrame, answers: DataFrame, order: int, space: Keys) -> DataFrame:
    """ASK rows of the order below: owners credit their n-grams of ``order`` to contexts and lower n-grams."""

    def run(packed: pa.Table, mine: pa.Table) -> pa.Table:
        out = [pa.RecordBatch.from_pylist([], arrow(ASK))]
        for row in packed.to_pylist():
            grams = Grams(Block(row), space)
            keys, at = ranked(grams.keys[order])
            parts = sorted(zip(*(mine.column(c).to_pylist() for c in ("shard", "size", "owned"))))
            held = np.concatenate([np.zeros(0, np.int64), *(widened(x, n) for _, n, x in parts)])
            if len(held) != len(keys):
                raise RuntimeError("Kneser-Ney: a block's counts are not those it asked for")
            # One n-gram stands for a key.
            one = firsts(at, len(keys))
            n = np.zeros(len(at), np.int64)
            n[one] = held
            below, context = grams.keys[order - 1], grams.context[order]
            weights = {"total": n, "ones": n == 1, "twos": n == 2, "more": n > 2}
            sums = {p: np.bincount(context, weights=w, minlength=len(below)) for p, w in weights.items()}
            lower = grams.lower[order]
            kinds = np.where(grams.opening[lower], n, n > 0) if order == 3 else n > 0
            sums["own"] = np.bincount(lower, weights=kinds, minlength=len(below))
            out.append(asked(row, space, below, grams.lang[order - 1], sums))
        return pa.Table.from_batches(out)

    return written(dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, ASK), f"asks{order - 1}")


def trained(texts: DataFrame, space: Keys) -> DataFrame:
    """COUNTED rows, one a shard: the sums of all orders, and the languages' counts of counts, from the texts (lang, text)."""
    dealt = written(blocks(texts.select("lang", "text"), most=BLOCK_WORDS), "trusted")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams = Grams(Block(row), space)
                yield asked(row, space, grams.keys[3], grams.lang[3], {"own": grams.count})

    def languages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seen = dict.fromkeys(pa.ipc.open_stream(restored(row["meta"])).read_all().column("lang").to_pylist())
                signed = np.array([lang_hash(x) for x in seen], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(seen), pa.int64()), pa.array(range(len(seen)), pa.int64()), pa.array(signed)], names=["block", "lang", "hash"])

    langs = written(dealt.select("block", "meta").mapInArrow(tidy(languages), "block long, lang long, hash long"), "langs")
    asks = written(dealt.mapInArrow(tidy(ask), ASK), "asks3")
    every, counts, spent = [asks], [], [dealt, langs]
    for order in (3, 2, 1):
        answers, stats = owners(asks, langs)
        counts.append(stats.withColumn("order", F.lit(order)))
        spent.append(answers)
        if order > 1:
            asks = credited(dealt, answers, order, space)
            every.append(asks)

    def stat_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                key = space.stats(np.array([r["hash"]], np.int64).view(np.uint64), r["order"])
                values = (r["n1"], r["n2"], r["n3"], r["mass"], r["types"])
                yield asked({"block": -1, "checksum": 0}, space, key, 0, {p: np.array([v]) for p, v in zip(PARTS, values)})
                # The number of n-grams that occur four times has a key of its own.
                yield asked({"block": -1, "checksum": 0}, space, key ^ 1, 0, {"own": np.array([r["n4"]])})

    stats = reduce(DataFrame.unionByName, counts)
    every.append(written(stats.mapInArrow(tidy(stat_rows), ASK), "stats"))
    for x in spent:
        dropped(x)
    counts = written(totalled(reduce(DataFrame.unionByName, every)), "counts")
    for x in every:
        dropped(x)
    return counts


def totalled(asks: DataFrame) -> DataFrame:
    """COUNTED: each shard's sums once, in order, so that no later reader sums them again."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys, _, sums = summed(rows)
        row = {"shard": rows[0]["shard"], "size": len(keys), "keys": narrow(np.diff(keys, prepend=0)), **{p: narrow(sums[p]) for p in PARTS}}
        return pa.Table.from_pylist([row], arrow(COUNTED))

    return asks.select("shard", "size", "keys", *PARTS).groupBy("shard").applyInArrow(run, COUNTED)


def lookup(asks: DataFrame, counts: DataFrame) -> DataFrame:
    """FOUND rows: the sums of ``counts`` (COUNTED) for every block's keys; 0 for what was never counted."""

    def run(wanted: pa.Table, known: pa.Table) -> pa.Table:
        rows = known.to_pylist()  # one at most
        size = rows[0]["size"] if rows else 0
        keys = widened(rows[0]["keys"], size).cumsum() if rows else np.zeros(0, np.int64)
        sums = {p: widened(rows[0][p], size) for p in PARTS} if rows else {}
        out = {c: [] for c in names(FOUND)}
        for r in wanted.select(["block", "checksum", "shard", "size", "keys"]).to_pylist():
            own = widened(r["keys"], r["size"]).cumsum()
            place = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
            hit = keys[place] == own if len(keys) else np.zeros(len(own), bool)
            for c in ("block", "checksum", "shard", "size"):
                out[c].append(r[c])
            for p in PARTS:
                out[p].append(narrow(np.where(hit, sums[p][place], 0) if len(keys) else np.zeros(len(own), np.int64), 1))  # read once, soon
        return pa.table([pa.array(out[c], pa.binary() if c in PARTS else pa.int64()) for c in names(FOUND)], names=names(FOUND))

    return asks.groupBy("shard").cogroup(counts.groupBy("shard")).applyInArrow(run, FOUND)


def discounts(n1: np.ndarray, n2: np.ndarray, n3: np.ndarray, n4: np.ndarray) -> list[np.ndarray]:
    """The modified Kneser-Ney discounts of counts of 1, 2, and 3 or more, from counts of counts."""
    y = n1 / np.maximum(n1 + 2 * n2, 1)
    pairs = ((n1, n2), (n2, n3), (n3, n4))
    return [np.maximum(LEAST, np.minimum(k, k - (k + 1) * y * b / np.maximum(a, 1))) for k, (a, b) in enumerate(pairs, 1)]


def wanted(grams: Grams, space: Keys) -> tuple[np.ndarray, list[np.ndarray]]:
    """Keys that a block needs, in order, and where the parts stand among them: those of the n-grams
    of the orders 1 to ORDER, of the languages' counts by order, and of what occurs four times by order."""
    stats = [space.stats(grams.langs, k) for k in (1, 2, 3)]
    stats = [*stats, *(x ^ 1 for x in stats)]
    # Orders have ranges of their own, one behind the other, and the languages' counts come last.
    keys, at, base = [], [], 0
    for part in (*(grams.keys[k] for k in (1, 2, 3)), np.concatenate(stats)):
        own, places = ranked(part)
        keys.append(own)
        at.append(places.astype(np.int64) + base)
        base += len(own)
    return np.concatenate(keys), [*at[:3], *np.split(at[3], np.cumsum([len(x) for x in stats])[:-1])]


def log_probabilities(grams: Grams, sums: dict[str, np.ndarray], at: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Integer log probability of each distinct n-gram of the highest order, and whether its language has a model.

    ``sums`` are those of the keys, and ``at`` the places, that :func:`wanted` gives.
    """

    def values(part: int) -> dict[str, np.ndarray]:
        return {p: sums[p][at[part]] for p in PARTS}

    cut, has = {}, None
    for order in (1, 2, 3):
        s = values(ORDER + order - 1)
        cut[order] = discounts(s["total"], s["ones"], s["twos"], sums["own"][at[2 * ORDER + order - 1]])
        if order == 1:
            d, has, mass, types = cut[1], s["own"] > 0, np.maximum(s["more"], 1), s["own"]
            left = (d[0] * s["total"] + d[1] * s["ones"] + d[2] * (types - s["total"] - s["ones"])) / mass
            unseen = left / (types + 1)

    def share(n: np.ndarray, order: int, lang: np.ndarray, total: np.ndarray) -> np.ndarray:
        d = [x[lang] for x in cut[order]]
        off = np.select([n >= 3, n == 2, n == 1], [d[2], d[1], d[0]], 0.0)
        return np.maximum(0.0, n - off) / np.maximum(total, 1)

    def back(s: dict[str, np.ndarray], order: int, lang: np.ndarray) -> np.ndarray:
        d = [x[lang] for x in cut[order]]
        freed = d[0] * s["ones"] + d[1] * s["twos"] + d[2] * s["more"]
        return np.where(s["total"] > 0, freed / np.maximum(s["total"], 1), 1.0)

    one, lang = values(0), grams.lang
    p = share(one["own"], 1, lang[1], mass[lang[1]]) + unseen[lang[1]]
    held, below = one, p
    for order in (2, 3):
        own = values(1) if order == 2 else {"own": sums["own"][at[2]]}
        context, lower = grams.context[order], grams.lower[order]
        weight = back(held, order, grams.lang[order - 1])
        below = share(own["own"], order, lang[order], held["total"][context]) + weight[context] * below[lower]
        held = own
    model = has[lang[3]]
    return np.rint(np.log(np.where(model, below, 1.0)) * UNIT).astype(np.int64), model


def scores(docs: DataFrame, counts: DataFrame, space: Keys) -> DataFrame:
    """RESULT of every document: blocks ask the shards of ``counts`` for their n-grams."""
    dealt = blocks(docs.select("doc_id", "lang", "text"), most=BLOCK_WORDS)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield by_shard(row, space, wanted(Grams(Block(row), space), space)[0], names(LIGHT))

    def run(packed: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for row in packed.to_pylist():
            block = Block(row)
            grams = Grams(block, space)
            if any(x != row["checksum"] for x in found.column("checksum").to_pylist()):
                raise RuntimeError("Kneser-Ney: a block was dealt otherwise than before")
            keys, at = wanted(grams, space)
            parts = sorted(zip(*(found.column(c).to_pylist() for c in ("shard", "size", *PARTS))))
            sums = {p: np.concatenate([np.zeros(0, np.int64), *(widened(x[k], x[1]) for x in parts)]) for k, p in enumerate(PARTS, 2)}
            if len(sums["own"]) != len(keys):
                raise RuntimeError("Kneser-Ney: a block's counts are not those it asked for")
            n_words, nll = block.size, [None] * len(block.size)
            if len(grams.rows):
                logs, model = log_probabilities(grams, sums, at)
                ends = grams.scored.cumsum()
                up = np.concatenate([[0], logs[grams.at].cumsum()])
                total, known = up[ends] - up[ends - grams.scored], model[grams.at[ends - 1]]
                for k, x, y in zip(grams.rows.tolist(), total.tolist(), known.tolist()):
                    nll[k] = -x if y else None
            out.append(pa.table([*(block.meta.column(c) for c in ("doc_id", "lang")), pa.array(n_words, pa.int64()), pa.array(nll, pa.int64())], names=names(RESULT)))
        return pa.concat_tables(out)

    found = lookup(dealt.mapInArrow(tidy(ask), LIGHT), counts)
    return dealt.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, RESULT)


def held_out() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0


def key_space(train: DataFrame, docs: DataFrame) -> Keys:
    """Keys and shards for the bytes of the trusted and of all texts."""
    own, every = ((df.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // WORD_BYTES for df in (train, docs))
    return Keys(min(61, max(LEAST_BITS, own.bit_length() + ROOM_BITS)), max(1, ORDER * every // SHARD_GRAMS))


def perplexities(docs: DataFrame, labels: DataFrame, space: Keys | None = None) -> DataFrame:
    """RESULT and ``trusted`` of every document. ``nll`` is in units of 2**-20 nats."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    trusted = trusted_ids(labels)
    train = with_flag(docs, trusted.where(~held_out()), "trusted").where("trusted")
    space = space or key_space(train, docs)
    counts = trained(train, space)
    portion = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(PORTIONS))
    found = [written(scores(docs.where(portion == k), counts, space), "scores") for k in range(PORTIONS)]
    dropped(counts)
    return with_flag(reduce(DataFrame.unionByName, found), trusted, "trusted")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, space: Keys | None = None) -> DataFrame:
    """(doc_id, lang, n_words, perplexity, threshold, trusted, kept) of every document.

    ``perplexity`` is that of the words and the text's end. ``threshold`` is the perplexity up to
    which (itself included) a document of this length is kept: what the given share of the
    language's held-out trusted documents stay within, in steps of a thousandth of a nat of the
    drawn mean; without any, all are kept.
    """
    found = perplexities(docs, labels, space)
    known = found.where(F.col("trusted") & F.col("nll").isNotNull() & held_out())
    units = F.col("n_words") + 1
    means = known.groupBy(F.col("lang").alias("_l")).agg((F.sum("nll") / F.sum(units) / UNIT).alias("_mean"))
    means = written(means, "means")
    means = F.broadcast(means) if means.count() <= BROADCAST_IDS else means

    def drawn(df: DataFrame) -> DataFrame:
        score = (F.col("nll") / UNIT + PRIOR * F.col("_mean")) / (units + PRIOR)
        return df.join(means, F.col("lang").eqNullSafe(F.col("_l")), "left").drop("_l").withColumn("_step", F.ceil(score * 1000))

    steps = drawn(known).groupBy("lang", "_step").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("lang")
    limits = (
        steps.withColumn("_up", F.sum("_n").over(w.orderBy("_step"))).withColumn("_all", F.sum("_n").over(w))
        .where(F.col("_up") >= F.col("_all") * quantile)
        .groupBy(F.col("lang").alias("_ll"))
        .agg((F.min("_step") + F.ceil(1000 * SLACK * F.least(F.lit(1.0), ENOUGH / F.first("_all")))).alias("_limit"))
    )
    limits = written(limits, "limits")
    limits = F.broadcast(limits) if limits.count() <= BROADCAST_IDS else limits
    judged = drawn(found).join(limits, F.col("lang").eqNullSafe(F.col("_ll")), "left")
    # The limit on the drawn mean, as a limit on the document's own sum.
    most = F.floor((F.col("_limit") / 1000 * (units + PRIOR) - PRIOR * F.col("_mean")) * UNIT)
    return judged.select(
        "doc_id", "lang", "n_words",
        F.exp(F.col("nll") / units / UNIT).alias("perplexity"),
        F.when(F.col("n_words") > 0, F.exp(most / units / UNIT)).alias("threshold"), "trusted",
        ((F.col("n_words") > 0) & F.coalesce(F.col("nll") <= most, F.lit(True))).alias("kept"),
    )
