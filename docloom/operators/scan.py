"""Running values of ordered groups, by a parallel scan that no hot group can hold up.

Rows are dealt to ranges of (group, order) of about ``rows_per_range`` rows, whatever the groups are, and
written in order. A group that fills many ranges is so many tasks. Each task reads its stretch of rows
twice: first it tells what the stretch does to a value that enters it, then it goes through its
rows with what does enter. Only a stretch's last group goes on beyond it, so what is told is one row a
stretch: an affine map (two numbers) and the last ``keep`` values. These
rows, one for each ``rows_per_range`` of the input, are put together on the driver.

Edge cases: a null group is a group; nulls of ``scale`` and ``shift`` leave the value as it is and a
null ``value`` is a null in the tail; rows whose order is equal come in the order of their other columns where
those can be compared; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.sinks import folders

#: Rows of a range.
ROWS = 1_000_000
TOLD = "at long, whole boolean, first long, last long, scale double, shift double, tail array<double>, rows long"


def running(df: DataFrame, group: list[str], order: list[str], scale: Column | None = None, shift: Column | None = None, value: Column | None = None, keep: int = 0, start: float = 0.0, rows_per_range: int | None = None) -> DataFrame:
    """``df`` with ``after``, the value x of the group once the row has made it ``scale * x + shift`` (from ``start``),
    and ``tail``, the last ``keep`` of the group's ``value`` up to the row, oldest first."""
    spark = df.sparkSession
    size = rows_per_range or ROWS
    n = df.count()
    kinds = (T.ArrayType, T.MapType, T.StructType, T.VariantType, T.BinaryType)
    ties = [f.name for f in df.schema.fields if f.name not in group + order and not isinstance(f.dataType, kinds)]
    by = [*group, *order, *ties]
    made = df.withColumns({
        "_g": F.xxhash64(*group) if group else F.lit(0).cast("long"),
        "_a": F.coalesce((F.lit(1.0) if scale is None else scale).cast("double"), F.lit(1.0)),
        "_b": F.coalesce((F.lit(0.0) if shift is None else shift).cast("double"), F.lit(0.0)),
        "_v": (F.lit(None) if value is None else value).cast("double"),
    })
    path = folders.fresh(spark, "ranges")
    dealt = made.repartitionByRange(-(-n // size) or 1, *by).sortWithinPartitions(*by)
    dealt.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.schema(T.StructType([*made.schema.fields]).add("_at", "long")).parquet(path)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: list | None = None
        for batch in batches:
            at, g = (batch.column(c).to_numpy() for c in ("_at", "_g"))
            a, b = (batch.column(c).to_numpy() for c in ("_a", "_b"))
            for x, y in stretches(at):
                if told is not None and told[0] + told[7] != at[x]:
                    yield row_of(told)
                    told = None
                if told is None:
                    told = [int(at[x]), True, int(g[x]), int(g[x]), 1.0, 0.0, [], 0]
                last = int(g[y - 1])
                others = np.flatnonzero(g[x:y] != last)
                begin = x + int(others[-1]) + 1 if len(others) else x  # where the last group begins, or goes on
                if len(others) or last != told[3]:
                    told[1], told[3:7] = False, [last, 1.0, 0.0, []]
                s, t = told[4], told[5]
                for p, q in zip(a[begin:y].tolist(), b[begin:y].tolist()):
                    s, t = s * p, t * p + q
                told[4], told[5] = s, t
                if keep:
                    told[6] = (told[6] + batch.column("_v").slice(max(begin, y - keep), y - max(begin, y - keep)).to_pylist())[-keep:]
                told[7] += y - x
        if told is not None:
            yield row_of(told)

    stretch = sorted(rows.select("_at", "_g", "_a", "_b", "_v").mapInArrow(tell, TOLD).collect(), key=lambda r: r["at"])
    enters: dict[int, tuple[float, list]] = {}
    group_before, x, tail = None, start, []
    for r in stretch:
        enters[r["at"]] = (x, tail) if r["first"] == group_before else (start, [])
        x0, tail0 = enters[r["at"]] if r["whole"] else (start, [])
        x, tail = r["scale"] * x0 + r["shift"], ([*tail0, *r["tail"]])[-keep:] if keep else []
        group_before = r["last"]
    shared = spark.sparkContext.broadcast(enters)
    names = df.columns
    schema = T.StructType([*df.schema.fields]).add("after", "double").add("tail", T.ArrayType(T.DoubleType()))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ended, now, x, tail = shared.value, None, None, start, []
        for batch in batches:
            at, g = batch.column("_at").to_pylist(), batch.column("_g").to_pylist()
            after, tails = [], []
            for k, p, q, v, m in zip(at, batch.column("_a").to_pylist(), batch.column("_b").to_pylist(), batch.column("_v").to_pylist(), g):
                if k != ended:
                    x, tail = held[k]
                elif m != now:
                    x, tail = start, []
                ended, now = k + 1, m
                x = p * x + q
                after.append(x)
                if keep:
                    tail = [*tail, v][-keep:]
                    tails.append(tail)
            own = [pa.array(after, pa.float64()), pa.array(tails or [None] * len(after), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *own], names=[*names, "after", "tail"])

    return rows.mapInArrow(go, schema)


def stretches(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where numbers go on one by one."""
    cuts = np.flatnonzero(np.diff(at) != 1) + 1
    edges = [0, *cuts.tolist(), len(at)]
    for x, y in zip(edges, edges[1:]):
        if y > x:
            yield x, y


def row_of(told: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(told, kinds)], names=[c.split()[0] for c in TOLD.split(", ")])
