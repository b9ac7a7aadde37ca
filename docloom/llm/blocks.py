"""Texts as blocks of numbered words, and values looked up for a block in shards of a table.

What a language model knows about the n-grams of a corpus grows with the corpus, so no task
may hold all of it. Tasks turn the texts they read into blocks of about BLOCK_WORDS words:
a dictionary of the distinct words and the number of each word, compressed. A block asks
each shard (a range of hashed n-grams) for its own distinct n-grams, as sorted keys in
compressed byte planes, and is joined to the answers. Blocks and shards grow in number with
the corpus and not in size; no text is shuffled and none is split into words twice.

Rows of a block belong together only as long as a lost task deals them alike again. That
holds where the rows are read from files; a block and its answers carry a checksum, so
another dealing ends the job instead of giving wrong values.

Edge cases: a null or empty text has no words and keeps its row; repeated rows are rows of
their own; a text longer than a block is a block of its own; an empty table has no blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm.common import tidy

BLOCK_WORDS = 3 << 20
#: Words that are numbered by frequency.
FREQUENT = 1 << 16
#: Words of texts whose n-grams are looked at together.
SLICE_WORDS = 1 << 19
BLOCK = "block long, checksum long, meta binary, words binary, ids binary"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def narrow(values: np.ndarray, level: int = 5) -> bytes:
    """Integers from 0, byte plane by byte plane, compressed."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    planes = values.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes()
    return bytes([kind.itemsize]) + pa.Codec("zstd", compression_level=level).compress(planes, asbytes=True)


def widened(data: bytes, count: int, kind: type = np.int64) -> np.ndarray:
    width = data[0]
    planes = pa.decompress(data[1:], decompressed_size=width * count, codec="zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(width, count).T.copy().view(f"<u{width}").ravel().astype(kind)


def squeezed(data: bytes, level: int = 9) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(data, asbytes=True)


def restored(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def word_ids(words: list[bytes]) -> tuple[np.ndarray, dict[bytes, int]]:
    """Numbers of words in order of first appearance, and the words."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)), seen


class Block:
    """The rows and words of a block (one row at least): ``meta`` a table, ``size`` words of each row,
    ``hashes`` of the distinct words, ``ids`` the number of every word, row after row."""

    def __init__(self, row: dict) -> None:
        from xxhash import xxh64_intdigest

        self.meta = pa.ipc.open_stream(restored(row["meta"])).read_all()
        self.size = self.meta.column("n_words").to_numpy().astype(np.int64)
        self.ends = self.size.cumsum()
        words = restored(row["words"]).split()
        self.hashes = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
        self.ids = widened(row["ids"], int(self.ends[-1]), np.int32 if len(words) < 1 << 31 else np.int64)

    def column(self, name: str) -> np.ndarray:
        return np.array(self.meta.column(name).to_pylist(), dtype=np.int64)

    def slices(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Rows of about SLICE_WORDS words: which rows, their word numbers, and the row (from 0) of each."""
        first = 0
        while first < len(self.ends):
            begin = int(self.ends[first] - self.size[first])
            last = max(first + 1, int(np.searchsorted(self.ends, begin + SLICE_WORDS, side="right")))
            rows = slice(first, last)
            yield rows, self.ids[begin : int(self.ends[last - 1])], np.repeat(np.arange(last - first), self.size[rows])
            first = last


def only_words(text: str, words: list[bytes], ids: np.ndarray, distinct: int) -> tuple[int]:
    return (len(words),)


def blocks(rows: DataFrame, measure: Callable = only_words, measured: tuple[str, ...] = ("n_words",), most: int | None = None) -> DataFrame:
    """BLOCK rows of ``rows``, all of whose columns but ``text`` go along.

    ``most`` words or a little more make a block (None: BLOCK_WORDS). Large blocks ask for
    less in all, small ones take less memory of a task.
    ``measure(text, words, ids, distinct)`` gives the integers ``measured`` of a text, the number of words first.
    """
    kept, most = [c for c in rows.columns if c != "text"], most or BLOCK_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        part, made = TaskContext.get().partitionId(), 0
        metas: list[pa.RecordBatch] = []
        known: dict[bytes, int] = {}
        held: list[np.ndarray] = []
        count = 0

        def out() -> pa.RecordBatch:
            nonlocal made, count
            number = np.concatenate([np.zeros(0, np.int32), *held])
            # Frequent words get low numbers, which makes short planes; the rest is in order, which makes a short list.
            order = np.argsort(-np.bincount(number, minlength=len(known)), kind="stable")
            words = list(known)
            order[FREQUENT:] = sorted(order[FREQUENT:].tolist(), key=words.__getitem__)
            rank = np.empty(len(known), np.int32)
            rank[order] = np.arange(len(known))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, metas[0].schema) as stream:
                for meta in metas:
                    stream.write_batch(meta)
            meta, ids = squeezed(sink.getvalue().to_pybytes()), narrow(rank[number])
            row = (part << 32 | made, xxh64_intdigest(ids, xxh64_intdigest(meta)) - (1 << 63), meta, squeezed(b" ".join([words[k] for k in order.tolist()])), ids)
            made, count = made + 1, 0
            for x in (metas, known, held):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=[x.split()[0] for x in BLOCK.split(", ")])

        for batch in batches:
            texts = batch.column("text").to_pylist()
            meta, first, found = batch.select(kept), 0, []
            for k, text in enumerate(texts):
                text = text or ""
                words = text.encode().split()
                ids, seen = word_ids(words)
                found.append(measure(text, words, ids, len(seen)))
                held.append(np.fromiter((known.setdefault(w, len(known)) for w in seen), np.int32, len(seen))[ids])
                count += len(words)
                if count >= most or k == len(texts) - 1:
                    sizes = [pa.array(x, pa.int64()) for x in zip(*found)]
                    metas.append(pa.RecordBatch.from_arrays([*meta.slice(first, len(found)).columns, *sizes], names=[*kept, *measured]))
                    first, found = k + 1, []
                if count >= most:
                    yield out()
        if metas:
            yield out()

    return rows.select(*kept, "text").mapInArrow(tidy(run), BLOCK).repartition("block")


def mixed(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    pair = (head * _MIX) ^ (tail * np.uint64(0xC2B2AE3D27D4EB4F))
    pair ^= pair >> np.uint64(29)
    return pair * np.uint64(0xBF58476D1CE4E5B9)


def tallied(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the number of each."""
    ordered = np.sort(code)
    starts = np.flatnonzero(np.concatenate([ordered[:1] == ordered[:1], ordered[1:] != ordered[:-1]]))
    return ordered[starts], np.diff(np.append(starts, len(code)))


def numbered(code: np.ndarray, most: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and for every code the number (32 bits) of its value among them.

    Ranges of about ``most`` codes are sorted on their own, which takes little memory.
    """
    sample = np.sort(code[:: max(1, len(code) >> 12)])
    parts = max(1, len(code) // most)
    edges = np.unique(sample[np.arange(1, parts) * len(sample) // parts])
    number, found, base = np.empty(len(code), np.int32), [code[:0]], 0
    for low, high in zip([None, *edges.tolist()], [*edges.tolist(), None]):
        inside = np.ones(len(code), bool) if low is None else code >= low
        if high is not None:
            inside &= code < high
        at = np.flatnonzero(inside)
        part = code[at]
        order = np.argsort(part)
        ordered = part[order]
        fresh = np.concatenate([ordered[:1] == ordered[:1], ordered[1:] != ordered[:-1]])
        number[at[order]] = fresh.cumsum(dtype=np.int32) + (base - 1)
        found.append(ordered[fresh])
        base += len(found[-1])
    return np.concatenate(found), number


def shards_of(keys: np.ndarray, edges: np.ndarray, parts: tuple[np.ndarray, ...]) -> Iterator[tuple]:
    """(shard, size, compressed keys, compressed parts...) of sorted keys; ``edges`` the shards' first keys."""
    at = np.append(np.searchsorted(keys, edges), len(keys))
    for shard, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        if b > a:
            yield shard, b - a, narrow(np.diff(keys[a:b], prepend=edges[shard])), *(narrow(p[a:b]) for p in parts)
