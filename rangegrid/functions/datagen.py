"""Synthetic workloads: columns of unsigned 32-bit values by a plain integer recipe on the row id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Multiplier and increment of a linear congruential generator modulo 2 ** 32.
MULTIPLIER, INCREMENT, MODULUS = 1664525, 1013904223, 1 << 32


def lcg(c: Column, seed: int) -> Column:
    """A repeatable number below 2 ** 32 from an integer column: three rounds of the generator, the upper half folded into the lower.

    Without the fold, columns of different seeds would differ by a constant.
    """
    out = (c + seed) % MODULUS
    for _ in range(3):
        out = (out * MULTIPLIER + INCREMENT) % MODULUS
        out = out.bitwiseXOR(F.shiftright(out, 16))
    return out


def uniform(spark: SparkSession, n: int, columns: int = 3) -> DataFrame:
    """(rid, c0, c1, ...), uniform."""
    return spark.range(n).select(F.col("id").alias("rid"), *[lcg(F.col("id"), 7919 * k + 1).alias(f"c{k}") for k in range(columns)])


def normal(spark: SparkSession, n: int, columns: int = 3) -> DataFrame:
    """(rid, c0, ...), about normal: means of twelve uniform numbers."""
    mean = lambda k: F.floor(sum((lcg(F.col("id"), 104729 * k + 31 * j) for j in range(12)), F.lit(0)) / 12).cast("long")
    return spark.range(n).select(F.col("id").alias("rid"), *[mean(k).alias(f"c{k}") for k in range(columns)])


def zipf(spark: SparkSession, n: int, exponent: float, columns: int = 3) -> DataFrame:
    """(rid, c0, ...), heavy-tailed: the inverse of a power law's distribution at uniform numbers."""
    u = lambda k: (lcg(F.col("id"), 15485863 * k + 3) + 1) / F.lit(float(MODULUS))
    value = lambda k: F.floor(F.least(F.pow(u(k), F.lit(-1.0 / (exponent - 1.0))), F.lit(4.0e9))).cast("long")
    return spark.range(n).select(F.col("id").alias("rid"), *[value(k).alias(f"c{k}") for k in range(columns)])


def queries(spark: SparkSession, n: int, top: int, columns: int = 3) -> DataFrame:
    """(qid, col, op, value): n lt-queries with repeatable thresholds below ``top``."""
    return spark.range(n * columns).select((F.col("id") / columns).cast("long").alias("qid"), (F.col("id") % columns).cast("int").alias("col"), F.lit("lt").alias("op"), (lcg(F.col("id"), 17) % top).alias("value"))
