"""Ranks and running sums, by group or over everything; the heart of budgets, bands, ranks and layouts.

A window brings a group (or all rows) into one task. What the plan's statistics show to be small takes it, unless the
plan makes rows (by explode or Python, whose results statistics don't see) or starts from rows without any. Anything
else is written once, and its largest group is counted from there; beyond `single_task_rows` rows two phases follow:
rows are range-partitioned by group and order, each range sums its part of each group, these few sums are accumulated
and joined back, and a window runs within each range. All ways give the same numbers.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.sources.storage import checkpointed

SINGLE_TASK_ROWS = 2_000_000
#: Bytes of sums by group and range (as text) that may be broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 1 << 26


def _named(order: list) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


#: What makes rows that statistics don't see, or has none of its own: a written result keeps those of the plan behind it.
_UNSEEN = re.compile(r"\b(Generate|Expand|LogicalRDD|MapIn\w+|MapPartitions\w*|MapGroups|FlatMap\w*|CoGroup\w*|\w*PythonUDTF\w*|Sample)\b")


def planned_bytes(df: DataFrame) -> int | None:
    """The optimizer's estimate of the result's size, None if it can't see that; no job runs."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return None if _UNSEEN.search(plan.toString()) else int(str(plan.stats().sizeInBytes()))


def is_small(df: DataFrame, rows: int) -> bool:
    size = planned_bytes(df)
    return size is not None and size <= 16 * rows


def ranged(df: DataFrame, by: list[str], order: list[Column], single_task_rows: int = SINGLE_TASK_ROWS, ranges: int | None = None) -> tuple[DataFrame, bool]:
    """(rows, whether they have a _range): _range is there if a group is too large for one task."""
    if is_small(df, single_task_rows):
        return df, False
    df = checkpointed(df)
    largest = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= single_task_rows:
        return df, False
    out = df.repartitionByRange(*([ranges] if ranges else []), *[F.col(b) for b in by], *order).withColumn("_range", F.spark_partition_id())
    return checkpointed(out), True  # the ranges' bounds are sampled: fix them


def with_before(rows: DataFrame, by: list[str], before: DataFrame) -> DataFrame:
    """Rows with the columns that `before` has for their group and range; nulls are a group like any other."""
    before = checkpointed(before.withColumnsRenamed({c: f"_b_{c}" for c in ("_range", *by)}))
    on = F.col("_range") == F.col("_b__range")
    for b in by:
        on = on & F.col(b).eqNullSafe(F.col(f"_b_{b}"))
    size = before.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 64), F.lit(0))).first()[0]
    side = F.broadcast(before) if size <= BROADCAST_BYTES else before
    return rows.join(side, on).drop("_b__range", *[f"_b_{b}" for b in by])


def accumulated(df: DataFrame, order: list, value: Column | str | None = None, by: list[str] | None = None, single_task_rows: int = SINGLE_TASK_ROWS, ranges: int | None = None) -> DataFrame:
    """Adds rn (from 1), and with a value: incl and excl, its running sums with and without the row, and total."""
    value = F.lit(1) if value is None else F.col(value) if isinstance(value, str) else value
    by, order = by or [], _named(order)
    df, split = ranged(df, by, order, single_task_rows, ranges)
    group = Window.partitionBy(*by, *(["_range"] if split else []))
    own = group.orderBy(*order)
    out = df.withColumn("rn", F.row_number().over(own)).withColumn("incl", F.sum(value).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    if not split:
        return out.withColumn("excl", F.col("incl") - value).withColumn("total", F.sum(value).over(group))
    sums = df.groupBy(*by, "_range").agg(F.count("*").alias("_n"), F.sum(value).alias("_v"))  # a row for each group and range
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    up_to = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    before = sums.select(*by, "_range", up_to("_n").alias("_before"), up_to("_v").alias("_sum"), F.sum("_v").over(Window.partitionBy(*by)).alias("total"))
    total = [c for c in (*df.columns, "rn", "incl", "total") if c != "_range"]
    out = with_before(out, by, before).withColumn("rn", F.col("rn") + F.col("_before")).withColumn("incl", F.col("incl") + F.col("_sum"))
    return out.select(*total).withColumn("excl", F.col("incl") - value).select(*total[:-1], "excl", "total")


def carried(df: DataFrame, order: list, value: str, by: list[str] | None = None, single_task_rows: int = SINGLE_TASK_ROWS, ranges: int | None = None) -> DataFrame:
    """Adds `_last`: the last value of `value` that isn't null, up to the row, in its group's order."""
    by, order = by or [], _named(order)
    df, split = ranged(df, by, order, single_task_rows, ranges)
    w = Window.partitionBy(*by, *(["_range"] if split else [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_last", F.last(value, ignorenulls=True).over(w))
    if not split:
        return out
    ends = df.groupBy(*by, "_range").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_end"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*by, "_range", F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    return with_before(out, by, before).withColumn("_last", F.coalesce("_last", "_carry")).drop("_carry", "_range")


def lagged(df: DataFrame, order: list, values: list[str], by: list[str] | None = None, single_task_rows: int = SINGLE_TASK_ROWS, ranges: int | None = None) -> DataFrame:
    """Adds `_before`: struct of the values of the row before in its group's order; null for the first one."""
    by, order = by or [], _named(order)
    df, split = ranged(df, by, order, single_task_rows, ranges)
    own = F.struct(*values)
    out = df.withColumn("_before", F.lag(own).over(Window.partitionBy(*by, *(["_range"] if split else [])).orderBy(*order)))
    if not split:
        return out
    ends = df.groupBy(*by, "_range").agg(F.max_by(own, F.struct(*order)).alias("_end"))  # a row for each group and range
    before = ends.select(*by, "_range", F.lag("_end").over(Window.partitionBy(*by).orderBy("_range")).alias("_ahead"))
    return with_before(out, by, before).withColumn("_before", F.coalesce("_before", "_ahead")).drop("_ahead", "_range")
