"""Operator 13, fill-in-middle transformation: a table-driven byte automaton finds units and sentinels.

One automaton reads the bytes of UTF-8 text. Its states tell continuation bytes from the
first byte of a code point, the start of a unit (a line with its newline) from its inside,
and how much of a sentinel was read; each transition has what it emits: a code point begins,
a unit ends, a sentinel is complete. A batch of texts is one run of bytes with a separator
that no UTF-8 text has, which brings every state back to the start. The state after three bytes
doesn't depend on the one before them, so a run is cut into lanes that read three bytes of the
lane before and then go forward together, one table lookup a step for all lanes. Counting
what was emitted gives the units of each text; the second pass looks up where the cuts are.

A document's prefix, middle and suffix follow from a digest of seed and doc_id, so a rerun
gives the same. ``restored`` rebuilds the text from output and form alone.

Edge cases: a null or empty text, and one that contains a sentinel, stays as it is (form
``plain``); a null doc_id counts as an empty number; repeated rows are changed alike; ties (equal
cuts) leave the middle empty; very long texts are cut whole and take about ten times their
bytes in a task; an empty table gives an empty result; of columns with the operator's own names
the operator's stay, others are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import bounded_batches, tidy

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MADE = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}

# States of the automaton and what its transitions emit.
START, INSIDE, OPEN, NAMED, MORE1, MORE2, MORE3 = range(7)
CHAR, UNIT, SENTINEL = 1, 2, 4
SEPARATOR = 0xFF
#: Bytes that settle the state.
WARM = 3
#: Most lanes of a scan.
LANES = 8192


def tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emitted) for each state and byte."""
    to, emits = np.full((7, 256), INSIDE, np.uint8), np.zeros((7, 256), np.uint8)
    for state in range(7):
        for byte in range(256):
            if byte == SEPARATOR:  # ends a unit that has begun
                to[state, byte], emits[state, byte] = START, 0 if state == START else UNIT
            elif 0x80 <= byte < 0xC0:
                to[state, byte] = {MORE3: MORE2, MORE2: MORE1}.get(state, INSIDE)
            else:
                emits[state, byte] = CHAR
                if byte == 0x0A:
                    to[state, byte] = START
                    emits[state, byte] |= UNIT
                elif byte >= 0xC0:
                    to[state, byte] = MORE1 if byte < 0xE0 else MORE2 if byte < 0xF0 else MORE3
                elif byte == ord("<"):
                    to[state, byte] = OPEN
                elif state == OPEN and chr(byte) in "PSM":
                    to[state, byte] = NAMED
                elif state == NAMED and byte == ord(">"):
                    emits[state, byte] |= SENTINEL
    return to.ravel(), emits.ravel()


TO, EMITS = tables()


def scan(data: bytes) -> np.ndarray:
    """What the automaton emits at each byte, from START."""
    size = len(data)
    lanes = max(1, min(LANES, size // 256))
    steps = -(-size // lanes) if size else 0
    if steps < WARM:  # a handful of bytes
        lanes, steps = 1, size
    held = np.full(lanes * steps, SEPARATOR, np.uint8)
    held[:size] = np.frombuffer(data, np.uint8)
    columns = np.ascontiguousarray(held.reshape(lanes, steps).T)
    state = np.zeros(lanes, np.intp)
    if lanes > 1:
        for k in range(steps - WARM, steps):  # the end of the lane before; the first lane has none
            state[1:] = TO[state[1:] << 8 | columns[k, :-1]]
    out = np.empty((steps, lanes), np.uint8)
    for k in range(steps):
        at = state << 8 | columns[k]
        out[k] = EMITS[at]
        state = TO[at].astype(np.intp)
    return np.ascontiguousarray(out.T).ravel()[:size]


def draws(doc_id: int | None, seed: int) -> list[int]:
    """The first four 32-bit numbers of a document's digest."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def cut(texts: list[bytes], ids: list[int | None], seed: int, rate: int, spm_rate: int) -> Iterator[tuple]:
    """(units, form, prefix chars, middle chars, output bytes) of each text."""
    data = b"\xff".join([*texts, b""])
    events = scan(data)
    ends = np.cumsum([len(x) + 1 for x in texts]) - 1
    starts = ends - [len(x) for x in texts]
    units = np.flatnonzero(events & UNIT)
    bounds = units + (np.frombuffer(data, np.uint8)[units] != SEPARATOR)
    first, last = np.searchsorted(units, starts), np.searchsorted(units, ends, side="right")
    marks = np.flatnonzero(events & SENTINEL)
    marked = np.searchsorted(marks, ends) > np.searchsorted(marks, starts)
    for k, text in enumerate(texts):
        n, begin = int(last[k] - first[k]), int(starts[k])
        h1, h2, h3, h4 = draws(ids[k], seed)
        if not text or marked[k] or h3 % 100 >= rate:
            yield n, "plain", None, None, text
            continue
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        # The second pass: where the counted units end.
        x, y = (int(bounds[first[k] + u - 1]) if u else begin for u in (a, b))
        chars = [int(np.count_nonzero(events[i:j] & CHAR)) for i, j in ((begin, x), (x, y))]
        prefix, middle, suffix = data[begin:x], data[x:y], data[y : int(ends[k])]
        if h4 % 100 < spm_rate:
            yield n, "spm", *chars, b"".join((SUFFIX.encode(), suffix, PREFIX.encode(), prefix, MIDDLE.encode(), middle))
        else:
            yield n, "psm", *chars, b"".join((PREFIX.encode(), prefix, SUFFIX.encode(), suffix, MIDDLE.encode(), middle))


def transformed(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """``docs`` with MADE: ``rate`` of 100 documents are cut, ``spm_rate`` of 100 of those begin with the suffix."""
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in MADE]
    rows = docs.select(*kept)
    schema = T.StructType([rows.schema[c] for c in kept]).add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            if batch.num_rows:
                texts = [(x or "").encode() for x in batch.column("text").to_pylist()]
                made = list(zip(*cut(texts, batch.column("doc_id").to_pylist(), seed, rate, spm_rate)))
                own = [pa.array(x, kind) for x, kind in zip(made, kinds)]
                output = pa.array([x.decode() for x in made[4]], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, *own, output], names=[*kept, *MADE])

    return rows.mapInArrow(tidy(run), schema)


def restored(output: Column, form: Column) -> Column:
    """The text of an output: what lies between the sentinels, in order."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    second, third, fourth = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(second, fourth, third)).when(form == "spm", F.concat(third, fourth, second)).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """The query's columns: outputs and restored texts as digests."""
    rows = transformed(docs.select("doc_id", "text"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
        CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(units[1 : a], '') AS x, array_to_string(units[a + 1 : b], '') AS y, array_to_string(units[b + 1 : ], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""
