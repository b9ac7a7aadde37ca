"""Streams: incremental indexing, memoised functions, event windows, circuit breaker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(stream: DataFrame, ts: str, size: str, late: str, group: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates over event-time windows; rows later than ``late`` are dropped by the watermark."""
    windowed = stream.withWatermark(ts, late) if stream.isStreaming else stream
    out = windowed.groupBy(F.window(ts, size), *group).agg(*aggregates)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in out.columns if c != "window"])


def sliding(stream: DataFrame, ts: str, size: str, slide: str, late: str, group: list[str], *aggregates: Column) -> DataFrame:
    windowed = stream.withWatermark(ts, late) if stream.isStreaming else stream
    out = windowed.groupBy(F.window(ts, size, slide), *group).agg(*aggregates)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in out.columns if c != "window"])


def sessions(stream: DataFrame, ts: str, gap: str, late: str, group: list[str], *aggregates: Column) -> DataFrame:
    windowed = stream.withWatermark(ts, late) if stream.isStreaming else stream
    out = windowed.groupBy(F.session_window(ts, gap), *group).agg(*aggregates)
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *[c for c in out.columns if c != "session_window"])


def memoised(inputs: DataFrame, cache: DataFrame | None, key: Column, fn: Callable[[DataFrame], DataFrame], version: int = 1) -> tuple[DataFrame, DataFrame]:
    """Results for all inputs, computing only keys that the cache lacks: (results, new cache rows).

    The key is a digest of the inputs and the function's version; ``fn`` maps rows with
    ``_key`` to (_key, result). Equal inputs are computed once.
    """
    keyed = inputs.withColumn("_key", F.sha2(F.concat_ws("\x1f", key, F.lit(str(version))), 256))
    unique = keyed.dropDuplicates(["_key"])
    missing = unique if cache is None else unique.join(cache.select("_key"), "_key", "left_anti")
    made = fn(missing)
    every = made if cache is None else cache.unionByName(made)
    return keyed.join(every, "_key", "left"), made


def index(files: DataFrame, pages: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Files -> pages -> points, each new file once: run it again to update."""

    def put(batch: DataFrame, n: int) -> None:
        embed(pages(batch)).withColumn("_batch", F.lit(n).cast("long")).write.mode("append").parquet(path)

    return files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()


def stub_embedding(data: Column, dim: int = 16) -> Column:
    """A vector that depends on the bytes only, in place of a model."""
    d = F.sha2(data, 512)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: (F.conv(F.substring(d, k * 2 + 1, F.lit(2)), 16, 10).cast("float") / 255).cast("float"))


# Circuit breaker.

FAILURES, RECOVERY, HALF_OPEN_CALLS, SUCCESSES = 5, 60.0, 3, 2


class Breaker:
    """closed -> open after failures -> half_open after the recovery time -> closed after successes."""

    def __init__(self, state: str = "closed", failures: int = 0, successes: int = 0, calls: int = 0, last: float | None = None) -> None:
        self.state, self.failures, self.successes, self.calls, self.last = state, failures, successes, calls, last

    def step(self, at: float, ok: bool) -> tuple[bool, str]:
        """A call at a time: was it let through, and the state after it."""
        if self.state == "open":
            if self.last is not None and at - self.last < RECOVERY:
                return False, self.state
            self.state, self.calls, self.successes = "half_open", 0, 0
        elif self.state == "half_open" and self.calls >= HALF_OPEN_CALLS:
            return False, self.state
        if self.state == "half_open":
            self.calls += 1
        if ok:
            if self.state == "half_open":
                self.successes += 1
                if self.successes >= SUCCESSES:
                    self.state, self.failures, self.successes, self.calls = "closed", 0, 0, 0
            else:
                self.failures = 0
        else:
            self.failures += 1
            self.last = at
            if self.state == "half_open" or self.failures >= FAILURES:
                self.state, self.calls = "open", 0
        return True, self.state

    def values(self) -> tuple:
        return self.state, self.failures, self.successes, self.calls, self.last


BREAKER = "circuit string, event_id long, at double, ok boolean, allowed boolean, state string"


def breaker(events: DataFrame) -> DataFrame:
    """BREAKER of a bounded log (circuit, event_id, at seconds, ok): a machine for each circuit, its events in order.

    A circuit's calls are a sequence by nature; sorted batches stream through the machine, so
    a long log isn't held in memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, machine = None, Breaker()
        for frame in batches:
            out = []
            for circuit, event, at, ok in zip(frame["circuit"], frame["event_id"], frame["at"], frame["ok"]):
                if circuit != name:
                    name, machine = circuit, Breaker()
                out.append((circuit, event, at, ok, *machine.step(at, ok)))
            yield pd.DataFrame(out, columns=["circuit", "event_id", "at", "ok", "allowed", "state"])

    dealt = events.select("circuit", "event_id", "at", "ok").repartition("circuit").sortWithinPartitions("circuit", "at", "event_id")
    return dealt.mapInPandas(run, BREAKER)


def breaker_stream(events: DataFrame) -> DataFrame:
    """The same over a stream, with the machine as state of its circuit."""
    state = "state string, failures int, successes int, calls int, last double"

    def run(key, frames, held):
        machine = Breaker(*held.get) if held.exists else Breaker()
        for frame in frames:
            frame = frame.sort_values(["at", "event_id"])
            out = [(key[0], e, at, ok, *machine.step(at, ok)) for e, at, ok in zip(frame["event_id"], frame["at"], frame["ok"])]
            yield pd.DataFrame(out, columns=["circuit", "event_id", "at", "ok", "allowed", "state"])
        held.update(machine.values())

    return events.groupBy("circuit").applyInPandasWithState(run, BREAKER, state, "append", "NoTimeout")
