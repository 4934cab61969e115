"""Checks of query results against the plain predicate, and timing."""

from __future__ import annotations

import time
from statistics import median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mismatches(got: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: rows in only one of both, and rows wanted."""
    a, b = got.select(F.col("rid"), F.lit(1).alias("g")), wanted.select("rid", F.lit(1).alias("w"))
    both = a.join(b, "rid", "full_outer")
    return both.agg(F.count(F.when(F.col("g").isNull() | F.col("w").isNull(), 1)).alias("mismatches"), F.count("w").alias("wanted"))


def seconds(df: DataFrame, runs: int = 5) -> float:
    """Median seconds to compute df, after one run to warm up; rows go nowhere."""
    took = []
    for _ in range(runs + 1):
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    return median(took[1:])
