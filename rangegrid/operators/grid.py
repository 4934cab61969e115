"""The grid: parameters, bins, histogram, prefix sums, directory."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rangegrid.functions.names import fresh

RESOLUTION, TILE = 1024, 256


@dataclass(frozen=True)
class GridParams:
    """n rows, positions lo <= p < hi, resolution cells a side, each ``width`` positions wide."""

    n: int
    resolution: int = RESOLUTION
    lo: int = 0

    @property
    def hi(self) -> int:
        return self.lo + self.n

    @property
    def width(self) -> int:
        return max(1, (self.n + self.resolution - 1) // self.resolution)

    def cell(self, c: Column) -> Column:
        """The cell of a position, held within the grid."""
        at = F.floor((F.greatest(c, F.lit(self.lo)) - F.lit(self.lo)) / F.lit(self.width)).cast("long")
        return F.least(at, F.lit(self.resolution - 1))


def with_bin(encoded: DataFrame, p: GridParams, tile: int = TILE) -> DataFrame:
    """encoded with bx, by, tx, ty and bin = bx + by * resolution; without a column y the grid has one row."""
    cells = encoded.withColumns({"bx": p.cell(F.col("x")), "by": p.cell(F.col("y")) if "y" in encoded.columns else F.lit(0).cast("long")})
    return cells.withColumns({"bin": F.col("bx") + F.col("by") * p.resolution, "tx": F.expr(f"cast(bx div {tile} as int)"), "ty": F.expr(f"cast(by div {tile} as int)")})


def histogram(binned: DataFrame) -> DataFrame:
    """(bin, cnt) of the bins that hold rows."""
    return binned.groupBy("bin").agg(F.count("*").alias("cnt"))


def dense(hist: DataFrame, p: GridParams) -> DataFrame:
    """hist with empty bins too."""
    every = hist.sparkSession.range(p.resolution**2).withColumnRenamed("id", "bin")
    return every.join(hist, "bin", "left").select("bin", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def max_count(hist: DataFrame) -> DataFrame:
    return hist.agg(F.max("cnt").alias("max_cnt"))


def prefix_sum(df: DataFrame, key: str, value: str, out: str = "st", block: int = 4096) -> DataFrame:
    """df with the sum of value over all smaller keys: sums within blocks of keys, plus what the blocks before hold."""
    blk, total, mine, off = fresh(df, "blk", "t", "own", "off")
    blocked = df.withColumn(blk, F.floor(F.col(key) / block).cast("long"))
    totals = blocked.groupBy(blk).agg(F.sum(value).alias(total))
    before = totals.select(blk, F.coalesce(F.sum(total).over(W.orderBy(blk).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(off))
    own = F.coalesce(F.sum(value).over(W.partitionBy(blk).orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return blocked.withColumn(mine, own).join(before, blk).withColumn(out, (F.col(mine) + F.col(off)).cast("long")).drop(blk, mine, off)


def directory(hist: DataFrame) -> DataFrame:
    """(bin, st, en): where each bin's rows lie in slot order, half open."""
    return prefix_sum(hist, "bin", "cnt").select("bin", "st", (F.col("st") + F.col("cnt")).cast("long").alias("en"))


def scatter(binned: DataFrame, direct: DataFrame) -> DataFrame:
    """binned with its slot: the bin's start and the place within the bin by row id."""
    local = F.row_number().over(W.partitionBy("bin").orderBy("rid")).cast("long") - 1
    return binned.withColumn("_local", local).join(direct.select("bin", "st"), "bin").withColumn("slot", F.col("st") + F.col("_local")).drop("_local", "st")
