"""Structured Streaming: pollers, keyed accumulators, running counters; and the event-time windows Spark has beside them."""

from __future__ import annotations

import itertools
import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sluice.operators.prefix import accumulated
from sluice.sources.storage import checkpointed


class Ingest:
    """A running ingestion: `awaitTermination` returns once the input or the budget is used up."""

    def __init__(self, query, reached: threading.Event):
        self.query, self.reached, self._ended = query, reached, threading.Event()
        threading.Thread(target=self._watch, daemon=True).start()

    def _watch(self) -> None:
        while self.query.isActive and not self.reached.wait(0.2):
            pass
        if self.reached.is_set():
            self.query.stop()
        self._ended.set()

    def awaitTermination(self, timeout: float | None = None) -> bool:  # noqa: N802  as Spark's queries have it
        done = self._ended.wait(timeout)
        if done and not self.reached.is_set():
            self.query.awaitTermination()  # raises what has ended it
        return done


def ingest_until(stream: DataFrame, sink: str, checkpoint: str, budget: int, tokens: str = "n_tokens") -> Ingest:
    """Appends micro-batches until their tokens reach the budget, and ends the query then; what is behind stays unread.

    A batch's tokens are counted while it is written. The total so far goes into a log beside the checkpoint, a small
    file for each batch, so that neither a batch nor a restart reads the sink. A batch's rows are written under its
    number, so that a repeated batch replaces itself.
    """
    spark, reached = stream.sparkSession, threading.Event()
    log = f"{checkpoint}-totals"

    def total_before(epoch: int) -> int:
        before = [e for e in _numbers(spark, log) if e < epoch]
        return int(_text(spark, f"{log}/{max(before)}")) if before else 0

    def step(batch: DataFrame, epoch: int) -> None:
        have = total_before(epoch)
        if have < budget:
            seen = Observation()
            own = batch.withColumn("epoch", F.lit(epoch)).observe(seen, F.coalesce(F.sum(tokens), F.lit(0)).alias("n"))
            own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(sink)
            have += int(seen.get["n"])
            _put(spark, f"{log}/{epoch}", str(have))
        if have >= budget:
            reached.set()

    return Ingest(stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(), reached)


def _store(spark: SparkSession, path: str):
    """(file system, path) as Spark's own Hadoop client has them: any storage that Spark can write."""
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), own


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    fs, path = _store(spark, folder)
    return [int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit()] if fs.exists(path) else []


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file, there as a whole or not at all."""
    fs, final = _store(spark, path)
    _, part = _store(spark, f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(final, False)
    fs.rename(part, final)


def _text(spark: SparkSession, path: str) -> str:
    fs, own = _store(spark, path)
    stream = fs.open(own)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def poll_evaluations(spark: SparkSession, folder: str, labels: int, max_files: int = 100) -> DataFrame:
    """(step, labels, macro) of complete evaluation files, each step once.

    The file source takes each name once, so a suite that was incomplete has to come back under a new name.
    """
    raw = spark.readStream.schema("step long, labels map<string,double>").option("maxFilesPerTrigger", max_files).json(folder)
    whole = raw.where(F.size("labels") == labels)
    macro = F.aggregate(F.map_values("labels"), F.lit(0.0), lambda a, x: a + x) / F.size("labels")
    return whole.withColumn("macro", macro).dropDuplicates(["step"])


def poll_into(spark: SparkSession, folder: str, sink: str, labels: int) -> int:
    """Appends the evaluations (step, labels, macro) that are complete by now and not in the sink yet; how many.

    Called again and again: a suite that was incomplete is read again under the same name, and each step is added once.
    """
    from pyspark.errors import AnalysisException

    rows = spark.read.schema("step long, labels map<string,double>").json(folder).where((F.size("labels") == labels) & F.col("step").isNotNull())
    macro = F.aggregate(F.map_values("labels"), F.lit(0.0), lambda a, x: a + x) / F.size("labels")
    new = rows.groupBy("step").agg(F.max_by("labels", F.to_json("labels")).alias("labels")).withColumn("macro", macro)
    try:
        new = new.join(spark.read.schema("step long").parquet(sink), "step", "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new = checkpointed(new)
    if n := new.count():
        new.write.mode("append").parquet(sink)
    return n


ACCUMULATED = "id string, n_loss_tokens long, sum_loss double, n_segments long"


def accumulate_segments(stream: DataFrame) -> DataFrame:
    """(id, …) once all segments of a document (id, loss, n_tokens, n_total) have come; its state goes then."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        loss, tokens, seen = state.get if state.exists else (0.0, 0, 0)
        total = None
        for pdf in batches:
            loss, tokens, seen, total = loss + float(pdf.loss.sum()), tokens + int(pdf.n_tokens.sum()), seen + len(pdf), int(pdf.n_total.iloc[0])
        if total is not None and seen >= total:
            state.remove() if state.exists else None
            yield pd.DataFrame({"id": [key[0]], "n_loss_tokens": [tokens], "sum_loss": [loss], "n_segments": [seen]})
        else:
            state.update((loss, tokens, seen))

    return stream.groupBy("id").applyInPandasWithState(step, ACCUMULATED, "loss double, tokens long, seen long", "append", GroupStateTimeout.NoTimeout)


def pending(keys: DataFrame, done: DataFrame, on: str = "key") -> DataFrame:
    """What a resumed run still has to do."""
    return keys.join(done.select(on), on, "left_anti")


def adaptive_updates(weights: DataFrame, steps: list[int], evaluate: Callable[[DataFrame, int], DataFrame], update: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """At each step: evaluate the weights, turn losses into new weights, keep a snapshot; a weight that isn't finite is an error."""
    for step in steps:
        weights = update(evaluate(weights, step))
        bad = weights.where(F.col("p").isNull() | F.isnan("p") | (F.col("p") < 0)).count()
        if bad:
            raise ValueError(f"step {step}: {bad} weights are not finite")
        if save:
            save(weights, step)
    return weights


def epoch_order(df: DataFrame, key: str, epochs: int, seed: int = 42) -> DataFrame:
    """Each epoch's rows in an order of its own: (epoch, position)."""
    own = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col(key).cast("string")))
    return accumulated(own, [order, key], None, ["epoch"]).withColumn("position", F.col("rn") - 1).drop("rn", "incl", "excl", "total")


def epochs(df: DataFrame, key: str, batch_rows: int, seed: int = 42) -> Iterator[DataFrame]:
    """Without end, an epoch's batches of rows (epoch, batch, position) after another's; whole batches only."""
    for epoch in itertools.count():
        order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col(key).cast("string")))
        own = accumulated(df, [order, key]).withColumn("position", F.col("rn") - 1).withColumn("batch", F.floor(F.col("position") / batch_rows))
        whole = own.where((F.col("batch") + 1) * batch_rows <= F.col("total"))
        yield whole.withColumn("epoch", F.lit(epoch)).drop("rn", "incl", "excl", "total")


class CounterError(ValueError):
    pass


def log_metrics(rows: DataFrame, log: str, by: str = "run_name") -> None:
    """Appends metric rows (run, step, n_tokens) of schema 2 with running totals to a log of JSON lines.

    Steps have to grow from row to row and beyond what the log has, tokens must not be negative; else nothing is written.
    """
    from pyspark.errors import AnalysisException

    spark = rows.sparkSession
    try:
        had = spark.read.schema(f"{by} string, step long, total_tokens long").json(log).groupBy(by).agg(F.max("step").alias("_step"), F.max("total_tokens").alias("_total"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        had = spark.createDataFrame([], f"{by} string, _step long, _total long")
    run = checkpointed(accumulated(rows.select(by, "step", "n_tokens"), ["step"], "n_tokens", [by]).join(had, by, "left"))
    again = run.groupBy(by, "step").count().where("count > 1").select(by, "step")
    bad = run.where("step <= _step OR n_tokens < 0 OR step IS NULL OR n_tokens IS NULL").select(by, "step").union(again)
    if first := bad.limit(3).collect():
        raise CounterError(f"counters don't grow: {first}")
    out = run.select(F.lit(2).alias("schema_version"), by, "step", "n_tokens", (F.coalesce("_total", F.lit(0)) + F.col("incl")).alias("total_tokens"))
    out.write.mode("append").json(log)


def migrated(metrics: DataFrame) -> DataFrame:
    """Metric rows of schema 1 (step, tokens) as schema 2 (schema_version, step, n_tokens)."""
    old = F.coalesce(F.col("schema_version"), F.lit(1)) < 2 if "schema_version" in metrics.columns else F.lit(True)
    n = F.when(old, F.col("tokens")).otherwise(F.col("n_tokens")) if "n_tokens" in metrics.columns else F.col("tokens")
    return metrics.select(F.lit(2).alias("schema_version"), "step", n.cast("long").alias("n_tokens"))


def running_totals(stream: DataFrame, by: str = "run_name") -> DataFrame:
    """Monotone counters of each run over all that came so far (update mode)."""
    return stream.groupBy(by).agg(F.max("step").alias("step"), F.sum("n_tokens").alias("n_tokens"))


def windowed(stream: DataFrame, at: str = "ts", width: str = "1 day", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Extension: event-time windows with a watermark."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def sessions(stream: DataFrame, at: str = "ts", gap: str = "1 hour", late: str = "10 minutes", by: str = "user_id") -> DataFrame:
    """Extension: sessions by a gap."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap), by).agg(F.count("*").alias("n"))
