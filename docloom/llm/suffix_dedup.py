"""Operator 3, suffix-array dedup: threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if some string of ``length`` bytes that covers it also starts anywhere else,
in another document or in the same one. Strings are judged on the input.

1. Cut. Every window of ``length`` bytes picks an anchor: among its ``gram``-byte strings
   the one of least hash, the leftmost of equals. Equal windows pick equal anchors at
   equal offsets, so only windows with the same anchor hash need meet. Consecutive windows
   with one anchor make a region, on average (length - gram + 2) / 2 windows.
2. Meet. Regions are grouped by anchor hash; anchors seen once are done. Equal regions
   (128-bit digests) are one string with a weight, so any number of copies is one row.
   A group in which every string has weight two or more is repeated as it stands.
3. Expand. The strings of the other groups are put, many groups at a time, into one
   Burrows-Wheeler transform. Intervals are extended backward, breadth first: level ``l``
   fixes all common prefixes of value ``l``, and the expansion stops at ``length``. The
   borders that are still open are those of suffixes that share ``length`` bytes or more;
   a run of such suffixes with total weight two or more is a repeat.
4. Remove. Covered intervals go back to the regions' documents, are merged, and cut out.

A group of more than MANY different strings would not fit one transform; it is settled
exactly by the digests of its windows, which are counted in a shuffle of their own, so no
task ever holds a group that grows with the input. (The transform itself cuts what is
over LIMIT bytes by longer anchors, for callers that use it on its own.)

Edge cases: a null or empty text, or one under ``length`` bytes, loses nothing; repeated
rows (same id and text) are occurrences of their own; rows are told apart by id and text,
so ids may repeat or be null; an empty table gives an empty result; columns of ``docs``
other than ``doc_id`` and ``text`` are not read by the query and are kept by ``cleaned``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import BROADCAST_IDS, bounded_batches, dropped, tidy, written

LENGTH = 400
#: Bytes of an anchor.
GRAM = 160
#: Different strings of a group that share a transform at most.
MANY = 512
#: Bytes of strings in one Burrows-Wheeler transform.
LIMIT = 400_000
#: Windows that are hashed at a time.
CHUNK = 1 << 20
_ODD = 0x9E3779B97F4A7C15 | 1
_POSITION = np.uint64((1 << 21) - 1)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of an odd number and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        _powers[:] = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers.append(np.cumprod(table, dtype=np.uint64))
    return _powers[0], _powers[1]


def anchors(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Regions of a text: (anchor hash, first window, last window), windows by their start."""
    windows = len(data) - length + 1
    if windows < 1:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 2
    parts = []
    span = length - gram + 1
    for at in range(0, windows, CHUNK):
        m = min(CHUNK, windows - at)
        b = np.frombuffer(data, np.uint8, m + length - 1, at).astype(np.uint64)
        power, inverse = _power_tables(len(b))
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b + np.uint64(1)) * power[: len(b)], out=total[1:])
        h = (total[gram:] - total[:-gram]) * inverse[: len(b) - gram + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        least = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        pos = (least & _POSITION).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]]))
        last = np.concatenate([first[1:] - 1, [m - 1]])
        parts.append((h[pos[first]], first + at, last + at))
    return tuple(np.concatenate(x) for x in zip(*parts))


def sorted_suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their first ``depth`` symbols at least, by prefix doubling."""
    n, width = len(symbols), 7
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(width, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(width):
        key = (key << 9) | padded[k : k + n]
    while True:
        order = np.argsort(key)
        ordered = key[order]
        step = np.concatenate([[0], ordered[1:] != ordered[:-1]]).cumsum()
        if width >= depth or step[-1] == n - 1:
            return order
        rank = np.empty(n + width, np.int64)
        rank[n:] = 0
        rank[order] = step + 1
        key = rank[:n] * (n + 2) + rank[width : width + n]
        width *= 2


def open_runs(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the number of the run of each: a new run starts wherever the
    common prefix with the suffix before is shorter than ``depth``. Symbol 0 separates
    strings; runs are meaningful for suffixes with ``depth`` symbols before a separator."""
    n = len(symbols)
    suffixes = sorted_suffixes(symbols, depth)
    bwt = symbols[suffixes - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    back = np.empty(n, np.int64)
    back[by_symbol] = np.arange(n)
    same = bwt[by_symbol][1:] == bwt[by_symbol][:-1]
    before, after = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    after[by_symbol[:-1][same]] = by_symbol[1:][same]

    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    lo, hi = np.array([0]), np.array([n])
    for level in range(depth):
        size = hi - lo
        ends = size.cumsum()
        at = np.repeat(lo - (ends - size), size) + np.arange(ends[-1])
        first = before[at] < np.repeat(lo, size)
        last = after[at] >= np.repeat(hi, size)
        if level:  # a separator can end a common prefix but not stand inside
            letter = bwt[at] != 0
            first &= letter
            last &= letter
        # Strings of one length have disjoint intervals, so sorted ends belong together.
        new_lo, new_hi = np.sort(back[at[first]]), np.sort(back[at[last]]) + 1
        fresh = ~known[new_hi]
        lo, hi = new_lo[fresh], new_hi[fresh]
        known[hi] = True
        if not len(lo):
            break
    return suffixes, known[:n].cumsum() - 1


def runs_of(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal covered intervals of sorted window starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(starts[1:] > starts[:-1] + length)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), (starts[np.concatenate([cut, [len(starts) - 1]])] + length).tolist()))


def repeated_windows(strings: list[bytes], weights: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each string, the starts of its windows that occur twice or more in all, by weight."""
    if min(weights) > 1:
        return [np.arange(max(0, len(s) - length + 1)) for s in strings]
    joined = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.uint16) + 1
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    begin = np.concatenate([[0], (sizes + 1).cumsum()[:-1]])
    joined[begin + sizes] = 0
    owner = np.repeat(np.arange(len(strings)), sizes + 1)
    whole = np.arange(len(joined)) + length <= (begin + sizes)[owner]
    suffixes, run = open_runs(joined, length)
    kept = whole[suffixes]
    suffixes, run = suffixes[kept], run[kept]
    times = np.bincount(run, weights=np.asarray(weights, np.float64)[owner[suffixes]], minlength=1)
    found = np.sort(suffixes[times[run] > 1])
    edges = np.searchsorted(found, np.concatenate([begin, [len(joined)]]))
    return [found[edges[k] : edges[k + 1]] - begin[k] for k in range(len(strings))]


def bounded_windows(strings: list[bytes], weights: list[int], length: int, limit: int = LIMIT, gram: int | None = None) -> list[np.ndarray]:
    """:func:`repeated_windows` in bounded memory: above ``limit`` bytes, strings are cut by longer anchors."""
    if sum(map(len, strings)) <= limit or gram == length:
        return repeated_windows(strings, weights, length)
    finer = length - 15 if gram is None and length > 30 else length
    groups: dict[int, dict[bytes, list]] = {}
    for k, s in enumerate(strings):
        for h, a, b in zip(*(x.tolist() for x in anchors(s, length, finer))):
            cell = groups.setdefault(h, {}).setdefault(s[a : b + length], [0, []])
            cell[0] += weights[k]
            cell[1].append((k, a))
    out: list[list[np.ndarray]] = [[] for _ in strings]

    def settle(cells: list[tuple[bytes, list]]) -> None:
        for (_, (_, places)), starts in zip(cells, bounded_windows([c[0] for c in cells], [c[1][0] for c in cells], length, limit, finer)):
            for k, a in places:
                out[k].append(starts + a)

    held, size = [], 0
    for cells in groups.values():
        if len(cells) == 1 and next(iter(cells.values()))[0] < 2:
            continue
        held += cells.items()
        size += sum(map(len, cells))
        if size > limit // 2:
            settle(held)
            held, size = [], 0
    if held:
        settle(held)
    return [np.unique(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in out]


def keys() -> list[Column]:
    """96 bits that tell rows apart by id and text."""
    return [F.xxhash64("doc_id", "text").alias("k1"), F.hash("doc_id", "text").alias("k2")]


def regions(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """(k1, k2, h, s1, s2, lo, hi): anchor hash, digest of the region's bytes, its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for k, text in enumerate(batch.column("text").to_pylist()):
                data = text.encode()
                h, lo, hi = anchors(data, length, gram)
                digest = hashlib.blake2b
                s = b"".join([digest(data[a:b], digest_size=16).digest() for a, b in zip(lo.tolist(), (hi + length).tolist())])
                parts.append((np.full(len(h), k), h, np.frombuffer(s, "<i8").reshape(-1, 2), lo, hi))
            if not parts:
                continue
            row, h, s, lo, hi = (np.concatenate(x) for x in zip(*parts))
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("k1").take(row), batch.column("k2").take(row), *map(pa.array, (h.view(np.int64), np.ascontiguousarray(s[:, 0]), np.ascontiguousarray(s[:, 1]), lo, hi))],
                names=["k1", "k2", "h", "s1", "s2", "lo", "hi"],
            )

    long_enough = keyed.where(F.octet_length("text") >= length)
    return long_enough.mapInArrow(tidy(run), "k1 long, k2 int, h long, s1 long, s2 long, lo long, hi long")


def strings_of(keyed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(h, s1, s2, w, bytes) of the wanted regions, read from one document each."""
    lists = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "s1", "s2", "w", "lo", "hi")).alias("parts"))
    few = written(lists, "wanted")
    texts = keyed
    if few.count() <= BROADCAST_IDS:  # then other texts needn't be shuffled
        texts = texts.join(F.broadcast(few.select("k1", "k2")), ["k1", "k2"], "left_semi")

    # Repeated rows have the same key; one of them is enough, and which one is all the same.
    joined = texts.join(few, ["k1", "k2"]).select("text", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, parts in zip(batch.column("text").to_pylist(), batch.column("parts").to_pylist()):
                data = text.encode()
                rows += [(p["h"], p["s1"], p["s2"], p["w"], data[p["lo"] : p["hi"] + length]) for p in parts]
            kinds = (pa.int64(),) * 4 + (pa.binary(),)
            if not rows:
                continue
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), kinds)], names=["h", "s1", "s2", "w", "bytes"])

    return joined.mapInArrow(tidy(run), "h long, s1 long, s2 long, w long, bytes binary")


def expanded(strings: DataFrame, length: int) -> DataFrame:
    """(h, s1, s2, spans) of the strings that hold repeated windows; spans are relative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled(rows: list[tuple]) -> pa.RecordBatch:
            found = bounded_windows([r[4] for r in rows], [r[3] for r in rows], length)
            out = [(*r[:3], [{"a": a, "b": b} for a, b in runs_of(f, length)]) for r, f in zip(rows, found) if len(f)]
            kinds = (pa.int64(),) * 3 + (pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])),)
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(list(zip(*out)) or [[]] * 4, kinds)], names=["h", "s1", "s2", "spans"])

        held, size, seen = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] == seen:
                    continue  # a repeated row's copy
                if size > LIMIT // 2 and row[0] != seen[0]:
                    yield settled(held)
                    held, size = [], 0
                seen = row[:3]
                held.append(row)
                size += len(row[4])
        if held:
            yield settled(held)

    dealt = strings.repartition("h").sortWithinPartitions("h", "s1", "s2")
    return dealt.mapInArrow(tidy(run), "h long, s1 long, s2 long, spans array<struct<a:long,b:long>>")


SPANS = "array<struct<a:long,b:long>>"


def counted_windows(strings: DataFrame, length: int) -> DataFrame:
    """(h, s1, s2, spans) like :func:`expanded`, for groups of any size: by the digests of single windows."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for k, data in enumerate(batch.column("bytes").to_pylist()):
                n = max(0, len(data) - length + 1)
                d = b"".join([hashlib.blake2b(data[a : a + length], digest_size=16).digest() for a in range(n)])
                parts.append((np.full(n, k), np.arange(n), np.frombuffer(d, "<i8").reshape(-1, 2)))
            if parts:
                row, start, d = (np.concatenate(x) for x in zip(*parts))
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(row) for c in ("h", "s1", "s2", "w")), pa.array(start), *(pa.array(np.ascontiguousarray(d[:, k])) for k in (0, 1))],
                    names=["h", "s1", "s2", "w", "start", "d1", "d2"],
                )

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"a": a, "b": b} for a, b in runs_of(np.array(x), length)] for x in batch.column("starts").to_pylist()]
            kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h", "s1", "s2")), pa.array(found, type=kind)], names=["h", "s1", "s2", "spans"])

    unique = strings.dropDuplicates(["h", "s1", "s2"])  # a repeated row's copies
    every = written(unique.mapInArrow(digests, "h long, s1 long, s2 long, w long, start long, d1 long, d2 long"), "windows")
    often = written(every.groupBy("d1", "d2").agg(F.sum("w").alias("n")).where("n > 1").select("d1", "d2"), "windows")
    met = every.join(often, ["d1", "d2"]).groupBy("h", "s1", "s2").agg(F.array_sort(F.collect_list("start")).alias("starts"))
    return met.mapInArrow(spans, f"h long, s1 long, s2 long, spans {SPANS}")


def covered(keyed: DataFrame, length: int = LENGTH, gram: int | None = None, many: int = MANY) -> DataFrame:
    """(k1, k2, spans): intervals of each document that repeated windows cover, unmerged."""
    bounded_batches(keyed.sparkSession)
    gram = GRAM if gram is None and length > GRAM else gram or max(1, length // 2)
    every = written(regions(keyed, length, gram), "regions")
    often = written(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "often")
    met = written(every.join(often, "h"), "met")
    dropped(every)
    distinct = written(
        met.groupBy("h", "s1", "s2").agg(F.count("*").alias("w"), F.min(F.struct("k1", "k2", "lo", "hi")).alias("at")), "strings"
    )
    # A region whose digest occurs twice is repeated as a whole. The rest of its group needs the transform.
    groups = distinct.groupBy("h").agg(F.min("w").alias("least"), F.count("*").alias("n")).where("least = 1")
    mixed = written(groups.select("h", "n"), "mixed")
    alike = distinct.join(mixed.select("h"), "h", "left_anti").select("h", "s1", "s2", F.lit(None).cast(SPANS).alias("spans"))
    own = ["h", "s1", "s2", "w", "at.*"]
    small = strings_of(keyed, distinct.join(mixed.where(F.col("n") <= many).select("h"), "h").select(*own), length)
    found = alike.unionByName(expanded(small, length))
    large = mixed.where(F.col("n") > many)
    if not large.isEmpty():
        found = found.unionByName(counted_windows(strings_of(keyed, distinct.join(large.select("h"), "h").select(*own), length), length))
    found = written(found, "found")
    whole = F.array(F.struct(F.col("lo").alias("a"), (F.col("hi") + length).alias("b")))
    moved = F.transform("spans", lambda x: F.struct((x["a"] + F.col("lo")).alias("a"), (x["b"] + F.col("lo")).alias("b")))
    return (
        met.join(found, ["h", "s1", "s2"])
        .select("k1", "k2", F.coalesce(moved, whole).alias("spans"))
        .groupBy("k1", "k2")
        .agg(F.flatten(F.collect_list("spans")).alias("spans"))
    )


def cut(data: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """What is left of a text, bytes removed, and maximal removed runs."""
    if not spans:
        return data, 0, 0
    kept, end, removed, runs = [], 0, 0, 0
    at = None
    for a, b in sorted((x["a"], x["b"]) for x in spans):
        if at is None or a > end:
            kept.append(data[end:a])
            runs += 1
            removed += b - a
            at, end = a, b
        elif b > end:
            removed += b - end
            end = b
    kept.append(data[end:])
    return b"".join(kept), removed, runs


def _joined(docs: DataFrame, length: int) -> DataFrame:
    """(row, doc_id, text, spans) of every row of ``docs``, ``row`` all its columns.

    Documents without spans aren't shuffled where the others' keys are few enough.
    """
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", *keys())
    spans = written(covered(keyed.select("k1", "k2", "text"), length), "spans")
    if spans.count() > BROADCAST_IDS:
        return keyed.join(spans, ["k1", "k2"], "left").drop("k1", "k2")
    some = F.broadcast(spans.select("k1", "k2"))
    hit = keyed.join(some, ["k1", "k2"], "left_semi").join(spans, ["k1", "k2"])
    rest = keyed.join(some, ["k1", "k2"], "left_anti").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    return hit.unionByName(rest).drop("k1", "k2")


def removed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                data = (text or "").encode()
                kept, n, runs = cut(data, spans)
                rows.append((len(data), n, runs, hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(),) * 3 + (pa.string(),)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(c, type=k) for c, k in zip(list(zip(*rows)) or [[]] * 4, kinds))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    joined = _joined(docs.select("doc_id", "text"), length).select("doc_id", "text", "spans")
    return joined.mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes cut from ``text``; characters cut in two go too.

    A null text stays null. Other columns are kept as they are, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                t if s is None or t is None else cut(t.encode(), s)[0].decode("utf-8", "ignore")
                for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, type=pa.string())], names=["row", "text"])

    rest = [c for c in docs.columns if c != "text"]
    joined = _joined(docs, length).select(F.struct(*[F.col("row")[c].alias(c) for c in rest]).alias("row"), "text", "spans")
    made = joined.mapInArrow(tidy(run), joined.select("row", "text").schema)
    return made.select(*[(F.col("text") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
