"""Operator 8, exact byte-level BPE encoding and decoding.

Every prefix of a piece has exactly one BPE encoding, so it has exactly one last token.
A suffix automaton over the vocabulary gives, for each prefix, the tokens that end there,
longest first; the one whose pair with the last token of the rest is compatible (encoding
the two tokens' text gives back these two tokens) is stored. Following the stored tokens
back from the end gives the ids. The work is linear in a piece's bytes times the tokens
that end at a byte, also for pieces of any length; texts are never cut.

Pieces are the matches of the tokenizer's split pattern; the strings of its added special
tokens are split off first, as the tokenizer does. Encoded pieces are kept in a table of
bounded size in each Python worker. Nothing is shuffled.

Edge cases: a null or empty text has no tokens; repeated rows are encoded alike; an empty
table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import json
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm.common import bounded_batches, tidy

#: The split of byte-level BPE (a fixed value of the public tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Encoded pieces that a worker keeps, in each of two generations.
KEPT = 300_000
#: The same in a pipeline, whose executors are fuller; there they go at the end of a task too.
STAGE_KEPT = 150_000
#: Longer pieces are not kept.
KEPT_BYTES = 64

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable Latin-1 bytes
    stand for themselves, the others in order for the letters from code point 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pieces(dict):
    """Piece -> ids as bytes, computed when missing; forgets the older half when full."""

    def __init__(self, encode, kept: int | None = None) -> None:
        self.encode, self.kept, self.older = encode, kept or KEPT, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = np.array(self.encode(piece.encode()), dtype="<u4").tobytes()
        if len(piece) <= KEPT_BYTES:
            if len(self) >= self.kept:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Vocabulary, merges and suffix automaton of a byte-level BPE tokenizer file."""

    def __init__(self, path: str, kept: int = KEPT) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.id_of = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: t for t, i in self.id_of.items()} | {i: t.encode() for t, i in self.added.items()}
        self.size = max(self.bytes_of) + 1
        # Rank of the merge that makes a token (-1: a byte), its two parts, and the token of two parts.
        self.rank, self.parts, self.joined = [-1] * self.size, [None] * self.size, {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = (self.id_of[bytes(letters[c] for c in x)] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            made = self.id_of[self.bytes_of[left] + self.bytes_of[right]]
            self.rank[made], self.parts[made], self.joined[left, right] = rank, (left, right), made
        self.length = [len(self.bytes_of.get(i, b"")) for i in range(self.size)]
        self._automaton()
        self.fits: dict[int, bool] = {}
        self.pieces = Pieces(self.encode_piece, kept)
        self.find = regex.compile(PATTERN).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def _automaton(self) -> None:
        """States are prefixes of tokens. ``step[state << 8 | byte]`` extends one; ``back`` is
        the longest proper suffix that is a state; ``ends`` the longest token that is a suffix;
        ``shorter[token]`` the next shorter token that is a suffix of a token."""
        step, back, ends = {}, [0], [-1]
        for token in sorted(self.id_of):
            at = 0
            for b in token:
                nxt = step.get(at << 8 | b)
                if nxt is None:
                    nxt = step[at << 8 | b] = len(back)
                    back.append(0)
                    ends.append(-1)
                at = nxt
            ends[at] = self.id_of[token]
        children: dict[int, list[tuple[int, int]]] = {}
        for key, to in step.items():
            children.setdefault(key >> 8, []).append((key & 255, to))
        self.shorter = [-1] * self.size
        queue = deque([0])
        while queue:
            state = queue.popleft()
            for b, to in children.get(state, ()):
                if state:
                    at = back[state]
                    while at and (at << 8 | b) not in step:
                        at = back[at]
                    back[to] = step.get(at << 8 | b, 0)
                suffix = ends[back[to]]
                if ends[to] < 0:
                    ends[to] = suffix
                else:
                    self.shorter[ends[to]] = suffix
                queue.append(to)
        self.step, self.back, self.ends = step, back, ends

    def compatible(self, a: int, b: int) -> bool:
        """Does the text of ``a`` and ``b`` encode to just these two tokens?

        It does unless some merge across the border comes before the merges that made the
        parts on both sides of it. The parts at the border are undone, latest merge first;
        ``before`` is the rank below which a merge across it would have come first.
        """
        key = a << 20 | b
        rank, parts, joined = self.rank, self.parts, self.joined
        before, left_undone, fits = 1 << 60, False, True
        while True:
            made = joined.get((a, b))
            if made is not None and (rank[made] < before or (rank[made] == before and not left_undone)):
                fits = False
                break
            if rank[a] < 0 and rank[b] < 0:
                break
            # The side whose top merge is later is undone first. At equal ranks (both sides
            # are one token) the right one is the later of the two, as merges run left to right.
            if rank[a] > rank[b]:
                before, left_undone, a = rank[a], True, parts[a][1]
            else:
                before, left_undone, b = rank[b], False, parts[b][0]
        if len(self.fits) > self.pieces.kept * 4 // 3:
            self.fits.clear()
        self.fits[key] = fits
        return fits

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.id_of.get(piece)
        if whole is not None and self.rank[whole] < 0:
            return [whole]
        step, back, ends, length, shorter, fits = self.step, self.back, self.ends, self.length, self.shorter, self.fits
        last = [-1] * (len(piece) + 1)
        state = 0
        for end, b in enumerate(piece, 1):
            nxt = step.get(state << 8 | b)
            while nxt is None and state:
                state = back[state]
                nxt = step.get(state << 8 | b)
            state = nxt or 0
            token = ends[state]
            while token >= 0:
                start = end - length[token]
                if not start:
                    last[end] = token
                    break
                fit = fits.get(last[start] << 20 | token)
                if fit if fit is not None else self.compatible(last[start], token):
                    last[end] = token
                    break
                token = shorter[token]
            else:
                raise ValueError("a byte is missing from the vocabulary")
        ids, end = [], len(piece)
        while end:
            ids.append(last[end])
            end -= length[last[end]]
        return ids[::-1]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        get, find = self.pieces.__getitem__, self.find
        if self.specials is None or not any(t in text for t in self.added):
            return b"".join(map(get, find(text)))
        out = []
        for part in self.specials.split(text):
            if part in self.added:
                out.append(np.array([self.added[part]], dtype="<u4").tobytes())
            else:
                out.extend(map(get, find(part)))
        return b"".join(out)

    def forget(self) -> None:
        """Drop what was learned from texts; the vocabulary stays."""
        self.pieces.clear()
        self.pieces.older.clear()
        self.fits.clear()

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are not UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str, kept: int = KEPT) -> Encoder:
    """One encoder for each worker process and vocabulary file."""
    return Encoder(path, kept)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers, for every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            ids = [coder.encode(t) if t else b"" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(ids, type=pa.binary())], names=["doc_id", "ids"])

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of the rows of :func:`encode_documents`; null ids: an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            texts = [coder.decode(x) if x else "" for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    bounded_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, kept: int = KEPT, forget: bool = False) -> DataFrame:
    """Encode and decode every text; see RESULT. One pass, so ids need not travel.

    A worker keeps ``kept`` pieces in each generation; with ``forget`` none beyond a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, kept)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                ids = coder.encode(text) if text else b""
                back = coder.decode(ids).encode()
                rows.append((len(ids) // 4, sha(ids), sha(back), len(back)))
            columns = list(zip(*rows)) or [[]] * 4
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(c, type=k) for c, k in zip(columns, kinds))],
                names=[x.split()[0] for x in RESULT.split(", ")],
            )

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(tidy(run, lambda: encoder(path, kept).forget()) if forget else run, RESULT)
