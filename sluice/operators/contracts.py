"""Validation that fails closed: each check gives a table of violations, and require() turns any into an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import uniform
from .packing import is_permutation
from .selection import offset_gaps


class ContractError(ValueError):
    pass


def require(violations: DataFrame, what: str, show: int = 5) -> None:
    if rows := violations.limit(show).collect():
        raise ContractError(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))


def _rows(df: DataFrame, path: Column | str, reason: str, bad: Column) -> DataFrame:
    return df.where(F.coalesce(bad, F.lit(True))).select((F.col(path) if isinstance(path, str) else path).alias("path"), F.lit(reason).alias("reason"))


def manifest_violations(manifest: DataFrame, files: DataFrame, n_tokens: int, tokenizer: str | None = None, dtype_bytes: int = 4) -> DataFrame:
    """(path, reason) of a manifest (path, n_tokens, tokenizer, dtype, bytes) against files (path, bytes)."""
    everything = F.lit("*")
    checks = [
        _rows(manifest.agg(F.count("*").alias("n")), everything, "no shards", F.col("n") == 0),
        _rows(manifest, "path", "no path", F.col("path").isNull() | (F.col("path") == "")),
        _rows(manifest, "path", "path escapes", F.col("path").startswith("/") | F.col("path").rlike(r"(^|/)\.\.(/|$)")),
        _rows(manifest.groupBy("path").count(), "path", "listed twice", F.col("count") > 1),
        manifest.select("path").join(files.select("path"), "path", "left_anti").withColumn("reason", F.lit("not on disk")),
        files.where(F.col("path").rlike(r"(\.u32le\.bin|\.npy)$")).select("path").join(manifest.select("path"), "path", "left_anti").withColumn("reason", F.lit("not listed")),
        _rows(manifest, "path", "n_tokens", F.col("n_tokens") <= 0),
        uniform(manifest, ["tokenizer", "dtype"]).select(everything.alias("path"), F.concat(F.lit("mixed "), "field").alias("reason")),
    ]
    both = manifest.select("path", "n_tokens").join(files.select("path", F.col("bytes").alias("size")), "path")
    checks += [_rows(both, "path", "not whole tokens", F.col("size") % dtype_bytes != 0), _rows(both.where(F.col("size") % dtype_bytes == 0), "path", "wrong count", F.col("size") / dtype_bytes != F.col("n_tokens"))]
    checks.append(_rows(both.agg(F.coalesce(F.sum(F.floor(F.col("size") / dtype_bytes)), F.lit(0)).alias("n")), everything, "wrong total", F.col("n") != n_tokens))
    if tokenizer is not None:
        checks.append(_rows(manifest, "path", "tokenizer", F.col("tokenizer") != tokenizer))
    return reduce(DataFrame.unionByName, checks)


def built_manifest(sidecars: DataFrame, dtype_bytes: int = 4) -> DataFrame:
    """One row: totals of sidecars and their shards sorted by path; an error where formats differ or bytes don't fit."""
    require(uniform(sidecars, ["tokenizer", "dtype", "eos_token_id"]), "sidecars differ")
    require(_rows(sidecars, "path", "bytes", F.col("bytes") != F.col("n_tokens") * dtype_bytes), "sidecars")
    shard = F.struct("path", "n_tokens", "domain")
    return sidecars.agg(F.sum("n_tokens").alias("n_tokens"), F.first("tokenizer").alias("tokenizer"), F.first("dtype").alias("dtype"), F.first("eos_token_id").alias("eos_token_id"), F.array_sort(F.collect_list(shard)).alias("shards"))


def layout_violations(layout: DataFrame, identity: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Fields of the parent's identity that differ, shards without a start, and gaps between shards."""
    rows = [identity.select(F.lit(k).alias("path"), F.lit("identity").alias("reason")).where(~F.coalesce(F.col(k).cast("string") == v, F.lit(False))) for k, v in expected.items()]
    rows.append(_rows(layout, "path", "no start", F.col("start").isNull()))
    rows.append(offset_gaps(layout.where("start is not null")).select("path", F.lit("gap").alias("reason")))
    return reduce(DataFrame.unionByName, rows)


def stream_violations(docs: DataFrame, totals: DataFrame, by: str = "source", ordinal: str = "ordinal", tokens: str = "n_tokens", total: str = "total_tokens") -> DataFrame:
    """Sources whose ordinals aren't 0 to n - 1 or whose tokens (an end token each) don't add up."""
    g = docs.groupBy(by).agg(F.min(ordinal).alias("lo"), F.max(ordinal).alias("hi"), F.count_distinct(ordinal).alias("d"), F.count("*").alias("n"), (F.sum(tokens) + F.count("*")).alias("t"))
    j = g.join(totals.select(by, F.col(total).alias("due")), by, "full")
    reason = F.when(F.col("n").isNull() | F.col("due").isNull(), "missing").when((F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("d") != F.col("n")), "ordinals").when(F.col("t") != F.col("due"), "total")
    return j.select(by, reason.alias("reason")).where("reason is not null")


def payload_violations(payloads: DataFrame, required: list[str], version: int = 2) -> DataFrame:
    """Metric rows without the version or a required number."""
    bad = [F.when(~F.coalesce(F.col("schema_version") == version, F.lit(False)), F.lit("schema_version"))]
    bad += [F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.lit(c)) for c in required]
    return payloads.select("step", F.explode(F.filter(F.array(*bad), lambda x: x.isNotNull())).alias("reason"))


def ready(spark, folder: str) -> bool:
    """Whether a READY marker row or a committed table is there: the gate in front of filters."""
    from pyspark.errors import AnalysisException

    try:
        return not spark.read.format("binaryFile").option("pathGlobFilter", "{READY,_READY}").load(folder).isEmpty()
    except AnalysisException:
        return False


def finalised(manifest: DataFrame, shards: DataFrame, on: str = "path") -> tuple[DataFrame, DataFrame]:
    """(manifest rows with status, all shards' rows); the second is an error to read unless no shard is missing."""
    status = manifest.join(shards.select(on).distinct().withColumn("_there", F.lit(True)), on, "left").withColumn("status", F.when(F.col("_there"), "ok").otherwise("missing")).drop("_there")
    n = status.agg(F.count_if(F.col("status") == "missing").alias("_missing"))
    gate = F.when(F.col("_missing") > 0, F.raise_error(F.lit("shards are missing")).cast("boolean")).otherwise(F.lit(True))
    return status, shards.crossJoin(F.broadcast(n)).where(gate).drop("_missing")  # one row


def dependency_violations(published: DataFrame, parents: DataFrame) -> DataFrame:
    """Dependencies (dataset, fingerprint) that no published parent has, or has with another fingerprint."""
    j = published.select("dataset", F.col("fingerprint").alias("due")).join(parents.select("dataset", "fingerprint"), "dataset", "left")
    reason = F.when(F.col("fingerprint").isNull(), "unknown").when(F.col("fingerprint") != F.col("due"), "changed")
    return j.select("dataset", reason.alias("reason")).where("reason is not null")


def require_permutation(df: DataFrame, index: str) -> None:
    if not is_permutation(df, index).first()["ok"]:
        raise ContractError(f"{index} is no permutation")
