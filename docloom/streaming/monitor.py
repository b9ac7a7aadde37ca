"""Progress of streams as rows of a metrics table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

METRIC = "query string, batch long, timestamp string, rows long, rows_per_second double, seconds double, error string"


class Metrics(StreamingQueryListener):
    """Keeps the last ``keep`` progress records of all queries; ``table`` gives them as rows."""

    def __init__(self, keep: int = 1000) -> None:
        super().__init__()
        self.keep, self.rows = keep, []

    def put(self, row: tuple) -> None:
        self.rows.append(row)
        del self.rows[: -self.keep]

    def onQueryStarted(self, event) -> None:
        self.put((str(event.id), -1, event.timestamp, 0, None, None, None))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        rate = p.processedRowsPerSecond
        self.put((str(p.id), p.batchId, p.timestamp, p.numInputRows, float(rate) if rate == rate else None, p.durationMs.get("triggerExecution", 0) / 1000, None))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.put((str(event.id), -1, None, 0, None, None, event.exception))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, METRIC)


def log_line(level: str, message: str, **fields) -> str:
    """A structured log record."""
    return json.dumps({"level": level, "message": message, **fields}, sort_keys=True, default=str)
