"""Tables written once in buckets of a key, sorted by it, so that later joins and groupings on it move no rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import shared_dir


def write(df: DataFrame, key: str, buckets: int = 64, path: str | None = None, name: str | None = None) -> DataFrame:
    """The rows as a bucketed table (in the shared folder if no path is given), read back.

    Rows go to their buckets' tasks first, so that each bucket is one file. A join may still sort a bucket, which is a
    task's share; it shuffles nothing. A key with more rows than a task can hold needs a table of its own; ids of
    documents have few.
    """
    spark = df.sparkSession
    name = name or f"bucketed_{uuid.uuid4().hex}"
    path = path or f"{shared_dir(spark)}/sluice-{spark.sparkContext.applicationId}/{name}"
    df.repartition(buckets, F.col(key)).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


def opened(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def exchanges(df: DataFrame) -> int:
    """How many shuffles the plan has."""
    return str(df._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning") + str(df._jdf.queryExecution().executedPlan()).count("Exchange rangepartitioning")
