"""Set operations on keys and manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_keys(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    return a.select(on).union(b.select(on)).distinct()


def common_keys(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    return a.select(on).intersect(b.select(on))


def difference(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    return a.select(on).distinct().join(b.select(on), on, "left_anti")


def first_of_each(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by order, in order: deduplication that keeps the order."""
    rest = [c for c in df.columns if c not in key]
    one = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*key, "_row.*")
    return one.select(*df.columns).orderBy(*order)


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """All parts, columns by name, with the part's number as `part`."""
    numbered = [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def merged_manifest(existing: DataFrame, added: DataFrame, kept: DataFrame, on: str = "path") -> DataFrame:
    """Existing rows, and of the added ones those that are still kept."""
    return existing.unionByName(added.join(kept.select(on), on, "left_semi"), allowMissingColumns=True)


def span_union(spans: Column) -> Column:
    """Sorted spans (s, e) with overlapping and touching ones made one."""
    none = F.array().cast("array<struct<s:int,e:int>>")
    whole = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].cast("int").alias("s"), x["e"].cast("int").alias("e"))))

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))))
        return F.when(F.size(acc) == 0, F.array(x)).when(x["s"] <= last["e"], grown).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(whole, none, step)
