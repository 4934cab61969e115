"""Row-id bitmaps: words of 32 bits, held as longs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def words(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys..., word, bits) of a table with rid."""
    return rows.groupBy(*keys, F.shiftright("rid", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(rid & 31 as int))")).alias("bits"))


def popcount(bitmap: DataFrame) -> DataFrame:
    return bitmap.agg(F.coalesce(F.sum(F.bit_count("bits").cast("long")), F.lit(0)).cast("long").alias("matches"))


def probe(rids: DataFrame, bitmap: DataFrame) -> DataFrame:
    """rids with ``hit``: whether the bit is set."""
    own = rids.withColumn("word", F.shiftright("rid", 5)).join(bitmap, "word", "left")
    return own.select("rid", F.coalesce(F.expr("shiftright(bits, cast(rid & 31 as int)) & 1") == 1, F.lit(False)).alias("hit"))


def union(*bitmaps: DataFrame) -> DataFrame:
    """The bits that any of the bitmaps has."""
    out = bitmaps[0].select("word", "bits")
    for b in bitmaps[1:]:
        out = out.unionByName(b.select("word", "bits"))
    return out.groupBy("word").agg(F.bit_or("bits").alias("bits"))
