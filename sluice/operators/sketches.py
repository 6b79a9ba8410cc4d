"""Quantiles from mergeable sketches (KLL): a small one for each group is stored, and reports merge what they need.

A sketch of parameter k ranks a value with an error of about 1.7 / k of the rows (99 %), and exactly while a group has
no more than k rows. So a day's sketch is made once, and a month's or a domain's quantiles read sketches, not rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 4096


def sketched(df: DataFrame, by: list[str], value: str, k: int = K) -> DataFrame:
    """(by, n, low, high, sketch) of a numeric column's values that aren't null; groups without any have none."""
    own = df.where(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double"))
    return own.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.kll_sketch_agg_double("_v", k).alias("sketch"))


def rolled_up(sketches: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """Sketches of coarser groups out of finer ones, by merging them."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def reported(sketches: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """The groups with a column for each quantile: the least value whose rank reaches it."""
    return sketches.select("*", *[F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(name) for name, q in quantiles.items()]).drop("sketch")
