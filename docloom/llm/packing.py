"""Operator 5, token-id output: best-fit-decreasing packing into rows of equal length.

Texts are encoded (with an end token each), documents longer than a row are split into
whole rows and a rest, and the rests are packed: longest first, each into the fullest row
that still has room. A segment tree over the rooms 0 to ``length`` finds that row in
log2(length) steps. Documents are dealt to shards by a hash of id and text, so a shard's
size does not grow with the input; every shard is packed on its own.

A packed row holds its ids as a little-endian matrix row (padded), the cumulative lengths
of its segments, and the offsets at which positions start again at 0. Nothing is lost:
``unpacked`` gives every document's ids back.

Edge cases: a null text is an empty text, which is just an end token; repeated rows are
packed each; ids may repeat or be null, pieces then carry the same id; an empty table gives
no rows; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded_batches, shared_dir

#: The split of byte-level BPE (a fixed value of the public tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTH = 2048
END = 50256
PAD = 50256
#: Documents of a shard, about.
SHARD_DOCS = 1024
#: Ids are kept in two bytes; vocabularies of more than 65,536 ids need "<u4".
KIND = "<u2"

PACKED = "shard long, row long, n_tokens long, doc_ids array<long>, pieces array<long>, cu_seqlens array<int>, resets array<int>, ids binary"


class Rooms:
    """Rows by the room left in them, and the least room that is large enough.

    Leaf ``r`` counts the rows with room ``r``; an inner node counts those below it.
    """

    def __init__(self, length: int) -> None:
        self.leaves = 1 << (length + 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """A row with the least room of at least ``size``, and that room."""
        count, node = self.count, self.leaves + size
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        row = self.rows[room].pop()
        self._add(room, -1)
        return row, room

    def _add(self, room: int, n: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += n
            node >>= 1


def best_fit(sizes: list[int], length: int) -> list[int]:
    """The row of each piece; pieces in falling order of size."""
    rooms, rows, out = Rooms(length), 0, []
    for size in sizes:
        found = rooms.take(size)
        if found is None:
            row, room = rows, length
            rows += 1
        else:
            row, room = found
        out.append(row)
        if room > size:
            rooms.put(room - size, row)
    return out


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(docs: DataFrame, path: str, end: int | None = END, kind: str = KIND) -> DataFrame:
    """(doc_id, shard key, ids) of every whole text, ids as little-endian binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_to_numpy
        tail = np.array([] if end is None else [end], dtype=kind).tobytes()
        for batch in batches:
            ids = [(encode(t, disallowed_special=()).astype(kind).tobytes() if t else b"") + tail for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("deal"), pa.array(ids, type=pa.binary())], names=["doc_id", "deal", "ids"])

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("deal"), "text").mapInArrow(run, "doc_id long, deal long, ids binary")


def pack(frame: pd.DataFrame, length: int, kind: str, pad: int) -> pd.DataFrame:
    """The packed rows of one shard."""
    frame = frame.sort_values(["deal", "doc_id"], kind="stable")
    pieces = []
    for k, ids in enumerate(frame["ids"]):
        own = np.frombuffer(ids, dtype=kind)
        pieces += [(min(length, len(own) - at), k, n, own[at : at + length]) for n, at in enumerate(range(0, len(own), length))]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    rows: dict[int, list] = {}
    for row, piece in zip(best_fit([p[0] for p in pieces], length), pieces):
        rows.setdefault(row, []).append(piece)
    doc_ids = [None if no else i for i, no in zip(frame["doc_id"].tolist(), frame["no_id"])]
    shard, out = int(frame["shard"].iloc[0]) if len(frame) else 0, []
    for row, held in sorted(rows.items()):
        ends = np.cumsum([p[0] for p in held]).tolist()
        ids = np.full(length, pad, dtype=kind)
        ids[: ends[-1]] = np.concatenate([p[3] for p in held])
        owners = [doc_ids[p[1]] for p in held]
        out.append((shard, row, ends[-1], owners, [p[2] for p in held], [0, *ends], [0, *ends[:-1]], ids.tobytes()))
    return pd.DataFrame(out, columns=[x.split()[0] for x in PACKED.split(", ")])


def packed(docs: DataFrame, path: str, length: int = LENGTH, end: int | None = END, pad: int = PAD, kind: str = KIND) -> DataFrame:
    """Packed rows of all documents; see PACKED."""
    shards = max(1, docs.count() // SHARD_DOCS)
    # Nulls would make the ids of a shard floats.
    dealt = encoded(docs, path, end, kind).withColumns(
        {"shard": F.pmod("deal", F.lit(shards)), "no_id": F.col("doc_id").isNull(), "doc_id": F.coalesce("doc_id", F.lit(0).cast("long"))}
    )
    return dealt.groupBy("shard").applyInPandas(lambda frame: pack(frame, length, kind, pad), PACKED)


def with_positions(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """Packed rows with the position of every token in its segment."""
    parts = F.transform(
        F.sequence(F.lit(1), F.size("cu_seqlens") - 1),
        lambda k: F.sequence(F.lit(0), F.element_at("cu_seqlens", k + 1) - F.element_at("cu_seqlens", k) - 1),
    )
    return rows.withColumn("positions", F.flatten(parts))


def written_rows(rows: DataFrame, path: str) -> None:
    """Write packed rows as Parquet: one matrix row, its lengths and resets a record."""
    rows.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def unpacked(rows: DataFrame, kind: str = KIND) -> DataFrame:
    """(doc_id, piece, ids) of packed rows: what was packed, piece by piece."""
    width = np.dtype(kind).itemsize
    parts = F.transform(
        F.sequence(F.lit(1), F.size("doc_ids")),
        lambda k: F.struct(
            F.element_at("doc_ids", k).alias("doc_id"),
            F.element_at("pieces", k).alias("piece"),
            F.expr("ids").substr(F.element_at("cu_seqlens", k) * width + 1, (F.element_at("cu_seqlens", k + 1) - F.element_at("cu_seqlens", k)) * width).alias("ids"),
        ),
    )
    return rows.select("shard", "row", F.explode(parts).alias("p")).select("shard", "row", "p.*")


def stored(rows: DataFrame) -> DataFrame:
    """Packed rows written to the shared folder and read back from there."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/docloom/packed-{uuid.uuid4().hex}"
    written_rows(rows, path)
    return spark.read.schema(rows.schema).parquet(path)


def digests(rows: DataFrame) -> DataFrame:
    """Packed rows with a digest in place of the ids."""
    return rows.withColumn("ids_sha256", F.sha2("ids", 256)).drop("ids")
