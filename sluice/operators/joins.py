"""Joins of documents with labels, spans, owners and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .prefix import accumulated, carried


def joined_labels(left: DataFrame, right: DataFrame, on: str = "id", keep_left: tuple[str, ...] = ("domain",)) -> DataFrame:
    """Inner join; columns that both have come from the right, but for keep_left, where the left wins unless null."""
    both = [c for c in left.columns if c in right.columns and c != on]
    r = right.select(on, *[F.col(c).alias(f"_r_{c}") for c in both], *[c for c in right.columns if c != on and c not in both])
    j = left.join(r, on)
    for c in both:
        j = j.withColumn(c, F.coalesce(c, f"_r_{c}") if c in keep_left else F.coalesce(f"_r_{c}", c)).drop(f"_r_{c}")
    return j


def coverage(left: DataFrame, right: DataFrame, on: str = "id") -> DataFrame:
    """One row: how many keys are in both, only left, only right, and the share of each side that is joined."""
    a, b = left.select(on).distinct().withColumn("l", F.lit(1)), right.select(on).distinct().withColumn("r", F.lit(1))
    n = a.join(b, on, "full").agg(
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("n_joined"),
        F.count_if(F.col("r").isNull()).alias("n_left_only"),
        F.count_if(F.col("l").isNull()).alias("n_right_only"),
    )
    share = lambda other: F.try_divide(F.col("n_joined"), F.col("n_joined") + F.col(other))
    return n.withColumn("left_rate", share("n_left_only")).withColumn("right_rate", share("n_right_only"))


def owners(points: DataFrame, intervals: DataFrame, by: str, at: str = "offset", start: str = "start", end: str = "end", strict: bool = False) -> DataFrame:
    """Each point with the interval [start, end) of its group that holds it: a sort and a running last value (prefix.carried), no range join.

    Points outside all intervals have nulls, or are an error if strict. Intervals of a group don't overlap.
    """
    rest = [c for c in intervals.columns if c not in (by, start)]
    side = intervals.select(by, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col(start).alias(start), *rest).alias("_own"), *[F.lit(None).cast(points.schema[c].dataType).alias(f"_p_{c}") for c in points.columns if c != by])
    rows = points.select(by, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(side.schema["_own"].dataType).alias("_own"), *[F.col(c).alias(f"_p_{c}") for c in points.columns if c != by])
    last = carried(side.unionByName(rows), ["_at", "_kind"], "_own", [by]).where("_kind = 1")
    inside = F.col("_at") < F.col(f"_last.{end}")
    own = F.when(inside, F.col("_last"))
    if strict:
        own = F.when(inside, F.col("_last")).otherwise(F.raise_error(F.concat(F.lit("no owner at "), F.col("_at").cast("string"))).cast(side.schema["_own"].dataType))
    out = last.select(by, *[F.col(f"_p_{c}").alias(c) for c in points.columns if c != by], own.alias("_own"))
    return out.select(by, *[c for c in points.columns if c != by], F.col(f"_own.{start}").alias(start), *[F.col(f"_own.{c}").alias(c) for c in rest])


def with_spans(docs: DataFrame, spans: DataFrame, on: str = "doc_id", index: str = "fact_idx", span: str = "span") -> DataFrame:
    """All documents, each with the ordered list of its spans (null without any)."""
    own = spans.groupBy(on).agg(F.transform(F.array_sort(F.collect_list(F.struct(index, span))), lambda x: x[span]).alias("spans"))
    return docs.join(own, on, "left")


def kept(docs: DataFrame, ids: DataFrame, on: str = "id") -> DataFrame:
    return docs.join(ids.select(on), on, "left_semi")


def missing(ids: DataFrame, docs: DataFrame, on: str = "id") -> DataFrame:
    """Keys that no document has."""
    return ids.select(on).distinct().join(docs.select(on), on, "left_anti")


def materialised(docs: DataFrame, ranks: DataFrame, on: str = "id", rank: str = "rank") -> DataFrame:
    """Ranked documents in the order of their ranks."""
    return docs.join(ranks.select(on, rank), on).orderBy(rank)


def with_lookup(docs: DataFrame, table: DataFrame, on: str, rules: list[tuple[str, Column]], absent: str = "not_listed") -> DataFrame:
    """Documents with the table's columns and `reason`: absent, the first rule that fails, or kept."""
    j = docs.join(table.withColumn("_there", F.lit(True)), on, "left")
    out = F.when(F.col("_there").isNull(), absent)
    for name, ok in rules:
        out = out.when(~F.coalesce(ok, F.lit(False)), name)
    return j.withColumn("reason", out.otherwise("kept")).drop("_there")


def zipped(left: DataFrame, right: DataFrame, by: str, left_order: list[str], right_order: list[str]) -> DataFrame:
    """The k-th row of each group of one side with the k-th of the other; sides of different length leave nulls.

    A null group is a group like any other.
    """
    number = lambda df, order: accumulated(df, order, None, [by]).withColumn("ordinal", F.col("rn") - 1).drop("rn", "incl", "excl", "total")
    a, b = number(left, left_order), number(right, right_order).withColumnsRenamed({by: "_b_by", "ordinal": "_b_ordinal"})
    both = a.join(b, F.col(by).eqNullSafe(F.col("_b_by")) & (F.col("ordinal") == F.col("_b_ordinal")), "full")
    # which side has the row is told by its ordinal, as the group may be null
    out = both.withColumn(by, F.when(F.col("ordinal").isNull(), F.col("_b_by")).otherwise(F.col(by))).withColumn("ordinal", F.coalesce("ordinal", "_b_ordinal"))
    return out.select(by, "ordinal", *[c for c in a.columns if c not in (by, "ordinal")], *[c for c in b.columns if c not in ("_b_by", "_b_ordinal")])


def to_do(manifest: DataFrame, done: DataFrame, failed: DataFrame | None = None, on: str = "path", order: str = "index") -> DataFrame:
    """Manifest rows without output; those that failed before come last."""
    left = manifest.join(done.select(on), on, "left_anti")
    if failed is None:
        return left.orderBy(order)
    flag = failed.select(on).distinct().withColumn("failed", F.lit(True))
    return left.join(flag, on, "left").withColumn("failed", F.coalesce("failed", F.lit(False))).orderBy("failed", order)


def overlaid(history: DataFrame, later: DataFrame, on: str = "step", values: str = "metrics") -> DataFrame:
    """Maps of both sides by step; where both have a key, the later side wins."""
    b = later.select(on, F.col(values).alias("_b"))
    j = history.select(on, F.col(values).alias("_a")).join(b, on, "full")
    only_a = F.map_filter("_a", lambda k, v: ~F.map_contains_key(F.col("_b"), k))
    return j.select(on, F.when(F.col("_a").isNull(), F.col("_b")).when(F.col("_b").isNull(), F.col("_a")).otherwise(F.map_concat(only_a, "_b")).alias(values))


def differences(left: DataFrame, right: DataFrame, on: str = "path") -> DataFrame:
    """(key, side): keys that only one side has; empty if the sets are equal."""
    a = left.select(on).distinct().join(right.select(on), on, "left_anti").withColumn("side", F.lit("left"))
    return a.unionByName(right.select(on).distinct().join(left.select(on), on, "left_anti").withColumn("side", F.lit("right")))


def with_sidecars(manifest: DataFrame, sidecars: DataFrame, on: str = "path") -> DataFrame:
    """Every manifest row with its sidecar; `status` is ok or missing."""
    j = manifest.join(sidecars.withColumn("_there", F.lit(True)), on, "left")
    return j.withColumn("status", F.when(F.col("_there"), "ok").otherwise("missing")).drop("_there")
