"""Aggregates of a value per grid cell: what raster blending computes for each pixel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cells(binned: DataFrame, value: str, depth: str | None = None) -> DataFrame:
    """(bin, cell_sum, cell_min, cell_max, cell_last, cell_and, cell_or, cell_xor[, cell_nearest]) of an integer value.

    The last writer is the row with the greatest id; the nearest is the row with the least (depth, id).
    """
    v = F.col(value)
    aggs = [F.sum(v).alias("cell_sum"), F.min(v).alias("cell_min"), F.max(v).alias("cell_max"), F.max_by(v, "rid").alias("cell_last"), F.bit_and(v).alias("cell_and"), F.bit_or(v).alias("cell_or"), F.bit_xor(v).alias("cell_xor")]
    if depth:
        aggs.append(F.min_by(v, F.struct(depth, "rid")).alias("cell_nearest"))
    return binned.groupBy("bin").agg(*aggs)


def blend(binned: DataFrame, value: str, alpha: str) -> DataFrame:
    """(bin, color): out = alpha * value + (1 - alpha) * before, in order of row ids, from 0.

    The order matters, so a cell's rows are gathered; rank encoding keeps cells to n / resolution rows.
    """
    own = F.array_sort(F.collect_list(F.struct("rid", F.col(value).cast("double").alias("v"), F.col(alpha).cast("double").alias("a"))))
    fold = F.aggregate("_own", F.lit(0.0), lambda acc, r: r["a"] * r["v"] + (1 - r["a"]) * acc)
    return binned.groupBy("bin").agg(own.alias("_own")).select("bin", fold.alias("color"))
