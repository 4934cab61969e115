"""Mixing sources to target weights: tokens per source, repetition rates, and floor(rate) copies plus a seeded coin.

Defined results: a null or empty text has size 0 and takes nothing however often it is copied; a null source is a source
of its own, the last one; a source without words has target 0; repeated rows are rows of their own and, having the same
id, toss the same coin; an empty table gives an empty table; columns of the input named as an added one are replaced, all
others stay; a text of any length is counted whole within its row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rangegrid.functions.names import fresh
from rangegrid.llm.common import columns_clear, word_count, written

#: The weights of the sources in order, repeating; what all targets add up to, in percent of all sizes; and the most
#: that a source's target may be, in multiples of its size.
WEIGHTS, SHARE_PERCENT, MOST_TIMES, SEED = (3, 1, 2), 150, 2, "mix-1"


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_TIMES) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size) that has one row for each source.

    Sharing out by weight with caps, and the excess anew until none is above its cap, ends where every source gets
    min(cap, level * weight). The sources that reach their cap are the first ones by cap / weight, so that one pass in
    this order finds the level. The table has one row a source, so its order is taken in one task.
    """
    kinds = len(weights)
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % kinds + 1).cast("int")).cast("long")
    t = sizes.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * most)
    order = W.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    before, rest, everything = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = t.withColumns({
        "_sum": F.sum("source_size").over(everything),
        "_used": F.coalesce(F.sum("_cap").over(before), F.lit(0)),
        "_left": F.sum("_w").over(rest),
    })
    total = F.col("_sum").cast("double") * share_percent / 100
    t = t.withColumn("_level", (total - F.col("_used")) / F.col("_left"))
    # the level is that of the first source that stays below its cap; sources before it get their caps
    t = t.withColumn("_fits", F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct((F.col("_cap") / F.col("_w")).alias("r"), F.col("source").isNull().alias("z"), F.col("source").alias("s"), F.col("_level").alias("level"))))
    level = F.min("_fits").over(everything)["level"]
    return t.withColumn("_at", level).select("source", "source_size", F.when(F.col("_at").isNull(), F.col("_cap").cast("double")).otherwise(F.least(F.col("_cap").cast("double"), F.col("_at") * F.col("_w"))).alias("target"))


def coin(doc_id, seed: str = SEED):
    """A number in [0, 1) that follows from the id and the seed alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def plan(docs: DataFrame, text: str = "text", seed: str = SEED, **shares) -> DataFrame:
    """docs with size, source_size, target and copies: how often the mix takes the document."""
    docs = columns_clear(docs, "size", "source_size", "target", "copies")
    of, rate = fresh(docs, "source", "rate")
    docs = docs.withColumn("size", word_count(F.col(text)))
    # one row a source; partial sums come before the shuffle, so that a hot source moves no more than others
    sized = docs.groupBy(F.col("source").alias("source")).agg(F.sum("size").alias("source_size"))
    # a written table has a known size: Spark broadcasts it below its own threshold, and documents aren't dealt by source
    goal = written(targets(sized, **shares).select(F.col("source").alias(of), "source_size", "target"), "targets")
    return (
        docs.join(goal, F.col("source").eqNullSafe(F.col(of)))
        .drop(of)
        .withColumn(rate, F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
        .withColumn("copies", F.floor(rate) + F.when(coin(F.col("doc_id"), seed) < F.col(rate) - F.floor(rate), 1).otherwise(0))
        .drop(rate)
    )


def mix(docs: DataFrame, text: str = "text", seed: str = SEED, **shares) -> DataFrame:
    """The mix itself: docs' rows and columns, each row as often as the plan says."""
    names = docs.columns
    coded = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "doc_id", "source", F.col(text).alias("_text"))
    planned = plan(coded, "_text", seed, **shares).where("copies > 0")
    return planned.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return plan(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = rf"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, 2 * source_size as cap, ([3, 1, 2])[cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)] as w from s),
l as (select *, (sum(source_size) over ()::double * {SHARE_PERCENT} / 100 - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0)::double)
  / sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following)::double as level from w),
t as (select source, source_size, case when x is null then cap::double else least(cap::double, x * w) end as target
  from (select *, (select arg_min(level, cap / w) from l where level * w <= cap) as x from l)),
r as (select d.*, source_size, target, case when source_size > 0 then target / source_size else 0.0 end as rate from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  cast(size * (floor(rate) + case when cast('0x' || substr(md5('{SEED}:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) / 4294967296.0 < rate - floor(rate) then 1 else 0 end) as bigint) as taken
from r"""
