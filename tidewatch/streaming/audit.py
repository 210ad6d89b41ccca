"""What each micro-batch of a stream read, wrote and dropped, as a table.

The numbers are observed inside the batch's own plan and arrive with its progress report, so
nothing is counted twice and no row is read again.
"""

from __future__ import annotations

import threading
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

_SCHEMA = "query string, batch bigint, metric string, value bigint"


def observed(stream: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """``stream`` with aggregates that are reported after each batch."""
    return stream.observe(name, *[c.alias(m) for m, c in metrics.items()])


def cleaning_metrics(clean: DataFrame) -> dict[str, Column]:
    """Rows that left the cleaning, and those whose address has no country."""
    return {"rows_out": F.count(F.lit(1)), "unmatched": F.count_if(F.col("iploc") == "")}


class StreamAudit(StreamingQueryListener):
    """Collects rows in, late rows and observed metrics of every batch of the session's streams."""

    def __init__(self, spark: SparkSession):
        self.spark, self._lock = spark, threading.Lock()
        self._rows: dict[tuple[str, int, str], int] = {}
        self._ended: set[str] = set()

    def __enter__(self) -> StreamAudit:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        found = {"rows_in": p.numInputRows, "late": sum(s.numRowsDroppedByWatermark for s in p.stateOperators)}
        for row in p.observedMetrics.values():
            found.update(row.asDict())
        with self._lock:
            # a batch that is reported again replaces its numbers
            self._rows.update({(str(p.id), p.batchId, m): int(v or 0) for m, v in found.items()})

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._ended.add(str(event.runId))

    def wait(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        """Until the reports of an ended stream have arrived; they come after its last batch."""
        query.awaitTermination()
        until = time.monotonic() + seconds
        while str(query.runId) not in self._ended:
            if time.monotonic() > until:
                raise TimeoutError("the reports of the stream did not arrive")
            time.sleep(0.05)

    def table(self) -> DataFrame:
        """(query, batch, metric, value) so far: a few rows for every batch."""
        with self._lock:
            rows = [(*key, value) for key, value in sorted(self._rows.items())]
        return self.spark.createDataFrame(rows, _SCHEMA)
