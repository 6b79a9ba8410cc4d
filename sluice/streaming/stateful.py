"""Stateful streams on `transformWithState`: totals of documents out of segments, counters that may only grow.

State is by key and bounded: a document's sums and the numbers of its segments so far, until it is whole or has waited
too long; a run's last step and total. It survives a restart with the query's checkpoint. Needs the RocksDB state store,
which `prepared` turns on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TOTALS = "id string, n_loss_tokens long, sum_loss double, n_segments long, complete boolean"
COUNTERS = "run_name string, step long, n_tokens long, total_tokens long"


def prepared(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


class SegmentTotals(StatefulProcessor):
    """A row for each document once all its segments have come, or, incomplete, once the watermark is `patience_ms` behind its first ones."""

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "n long, tokens long, loss double, due long")
        self.seen = handle.getMapState("seen", "segment long", "there boolean")

    def _out(self, key: tuple, n: int, tokens: int, loss: float, complete: bool) -> pd.DataFrame:
        self.sums.clear()
        self.seen.clear()
        return pd.DataFrame({"id": [key[0]], "n_loss_tokens": [tokens], "sum_loss": [loss], "n_segments": [n], "complete": [complete]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.sums.exists()
        n, tokens, loss, due = self.sums.get() if known else (0, 0, 0.0, 0)
        own = pd.concat(list(rows))  # a document's segments of one batch
        own = own[~own.segment.duplicated()]
        for segment, x, m in zip(own.segment.tolist(), own.loss.tolist(), own.n_tokens.tolist(), strict=True):
            if not self.seen.containsKey((segment,)):  # a segment that comes again counts once
                self.seen.updateValue((segment,), (True,))
                n, tokens, loss = n + 1, tokens + int(m), loss + float(x)
        if n >= int(own.n_total.max()):
            if known:
                self.handle.deleteTimer(due)
            yield self._out(key, n, tokens, loss, True)
            return
        if not known:
            due = max(int(own.at_ms.max()), timerValues.getCurrentWatermarkInMs()) + self.patience_ms
            self.handle.registerTimer(due)
        self.sums.update((n, tokens, loss, due))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.sums.exists():
            n, tokens, loss, _ = self.sums.get()
            yield self._out(key, n, tokens, loss, False)

    def close(self) -> None:
        pass


def document_totals(stream: DataFrame, at: str = "at", late: str = "10 minutes", patience_ms: int = 86_400_000) -> DataFrame:
    """(id, n_loss_tokens, sum_loss, n_segments, complete) of documents whose segments (id, segment, loss, n_tokens, n_total, at) come one by one.

    `at` is the segments' event time. A document that isn't whole when the watermark (`late` behind the latest event) is
    `patience_ms` beyond its first segments comes out incomplete, and its state goes; what comes later begins it anew.
    """
    own = stream.select(
        F.col("id").cast("string").alias("id"),
        F.col("segment").cast("long").alias("segment"),
        F.col("loss").cast("double").alias("loss"),
        F.col("n_tokens").cast("long").alias("n_tokens"),
        F.col("n_total").cast("long").alias("n_total"),
        F.col(at).cast("timestamp").alias("at"),
    )
    own = own.withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    return own.groupBy("id").transformWithStateInPandas(SegmentTotals(patience_ms), TOTALS, "Append", "EventTime")


class Counters(StatefulProcessor):
    """Rows with running totals; a step that doesn't grow, or negative tokens, ends the query with an error."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "step long, total long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        step, total = self.last.get() if self.last.exists() else (None, 0)
        own = pd.concat(list(rows)).sort_values("step", kind="stable")  # a run's rows of one batch
        out = []
        for s, n in zip(own.step.tolist(), own.n_tokens.tolist(), strict=True):
            if s != s or n != n or n < 0 or (step is not None and s <= step):
                raise ValueError(f"counters of {key[0]} don't grow: step {s} behind {step}, {n} tokens")
            step, total = int(s), total + int(n)
            out.append((key[0], step, int(n), total))
        self.last.update((step, total))
        yield pd.DataFrame(out, columns=["run_name", "step", "n_tokens", "total_tokens"])

    def close(self) -> None:
        pass


def counted(stream: DataFrame) -> DataFrame:
    """(run_name, step, n_tokens, total_tokens) of metric rows (run_name, step, n_tokens), each run by itself."""
    own = stream.select(F.col("run_name").cast("string").alias("run_name"), F.col("step").cast("long").alias("step"), F.col("n_tokens").cast("long").alias("n_tokens"))
    return own.groupBy("run_name").transformWithStateInPandas(Counters(), COUNTERS, "Append", "None")
