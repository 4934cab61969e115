"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangegrid.llm.common import new_path, remove


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge that links two: root is the least node of its component.

    Large and small stars take turns until nothing changes, a number of rounds that grows with the logarithm of the
    longest chain. Each star joins the edges to the least neighbour of each node, a table that partial sums make; a hub
    with many edges is on the side of the join that can be split. Every round is a table in the shared folder, and only
    two numbers of it reach the driver.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    old, mark, path = None, None, None
    while True:
        if mark is not None:
            both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            now = small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        old, path = path, new_path(spark, "stars")
        now.write.parquet(path)
        now = spark.read.schema(now.schema).parquet(path)
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if old:
            remove(spark, old)
        if new == mark or not new[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = new
