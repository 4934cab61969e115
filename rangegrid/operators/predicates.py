"""From predicates on values to closed ranges of positions, and from query texts to predicates.

"exact" gives the ranges that the predicates mean. "compat" gives, for lt and le, the bounds of a reader that looks up
q - 1 (lt) or the next key minus one (le) with unsigned 32-bit wrap-around; UNBOUNDED stands for no bound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rangegrid.functions.names import constant_array
from rangegrid.operators.encode import _below, _edges, _parts

UNBOUNDED = 4294967295
OPERATORS = ("lt", "le", "gt", "ge", "eq", "between")
#: Distinct values of queries that are looked up as literals; more are joined with the map by ranges of values.
MOST_LITERALS = 4096


def _looked_up(wanted: DataFrame, mapping: DataFrame, most: int) -> DataFrame:
    """(t, ge, gt): for each distinct value t of ``wanted`` the first position whose value is t or more, and more than t."""
    kind = dict(wanted.dtypes)["t"]
    wanted = wanted.where("t is not null").distinct()
    few = [r[0] for r in wanted.limit(most + 1).collect()]
    spark = wanted.sparkSession
    if len(few) <= most:
        # every entry of the map counts how many of the values it reaches; one row is left for each count
        values = sorted(few)
        if not values:
            return spark.createDataFrame([], f"t {kind}, ge bigint, gt bigint")
        every = constant_array(values, kind)
        slots = mapping.select(F.size(F.filter(every, lambda t: t <= F.col("v"))).alias("reach"), F.size(F.filter(every, lambda t: t < F.col("v"))).alias("beyond"), "pos")
        found = slots.groupBy("reach", "beyond").agg(F.min("pos").alias("pos")).collect()  # 2 * len(values) + 1 rows at most
        first = lambda col, k: min((r.pos for r in found if r[col] > k), default=None)
        return spark.createDataFrame([(t, first("reach", k), first("beyond", k)) for k, t in enumerate(values)], f"t {kind}, ge bigint, gt bigint")
    edges = _edges(mapping, ["v"], _parts(mapping, None))["v"]
    v_kind = dict(mapping.dtypes)["v"]
    marks = mapping.select(F.col("v"), F.col("pos"), F.lit(None).cast(kind).alias("t"))
    asks = wanted.select(F.col("t").cast(v_kind).alias("v"), F.lit(None).cast("bigint").alias("pos"), "t")
    both = marks.unionByName(asks).withColumn("b", _below("v", edges, v_kind))
    # ge: the first entry of v or more is among the rows that follow in order of (v, asks first); gt: entries come first
    ge = W.partitionBy("b").orderBy(F.col("v").asc(), F.col("pos").isNull().desc()).rowsBetween(0, W.unboundedFollowing)
    gt = W.partitionBy("b").orderBy(F.col("v").asc(), F.col("pos").isNull().asc()).rowsBetween(0, W.unboundedFollowing)
    firsts = both.groupBy("b").agg(F.min("pos").alias("p"))  # a row a range
    carried = firsts.select("b", F.min("p").over(W.orderBy("b").rowsBetween(1, W.unboundedFollowing)).alias("after"))
    near = both.withColumns({"ge": F.min("pos").over(ge), "gt": F.min("pos").over(gt)}).where("t is not null").join(carried, "b")
    return near.select("t", F.coalesce("ge", "after").alias("ge"), F.coalesce("gt", "after").alias("gt"))


def bounds(queries: DataFrame, mapping: DataFrame, n, mode: str = "exact", most_literals: int = MOST_LITERALS) -> DataFrame:
    """queries (qid, op, q[, q2]) with (lo, hi), closed; lo > hi where nothing can match.

    mapping is (v, pos), n the number of rows. The map is never broadcast: up to ``most_literals`` distinct values of
    queries are looked up in one pass over it, which leaves two rows a value; more are dealt into ranges of values with it.
    """
    if "q2" not in queries.columns:
        queries = queries.withColumn("q2", F.lit(None).cast(dict(queries.dtypes)["q"]))
    n = F.lit(n).cast("long") if not hasattr(n, "_jc") else n
    kind = dict(queries.dtypes)["q"]
    before = F.when(F.col("q") == 0, F.lit(UNBOUNDED)).otherwise(F.col("q") - 1).cast(kind) if mode == "compat" else F.lit(None).cast(kind)
    asked = queries.withColumn("before", before)
    found = _looked_up(reduce(DataFrame.union, [asked.select(F.col(c).alias("t")) for c in ("q", "q2", "before")]), mapping, most_literals)
    for name, col in (("1", "q"), ("2", "q2"), ("3", "before")):
        asked = asked.join(found.select(F.col("t").alias(f"t{name}"), F.col("ge").alias(f"ge{name}"), F.col("gt").alias(f"gt{name}")), F.col(col) == F.col(f"t{name}"), "left")
    ge, gt, gt2 = (F.coalesce(c, n) for c in ("ge1", "gt1", "gt2"))
    op = F.col("op")
    known = F.when(op.isin(*OPERATORS), op).otherwise(F.raise_error(F.concat(F.lit("unknown operator "), F.coalesce(op, F.lit("null")))))
    lo = F.when(known == "gt", gt).when(op.isin("ge", "eq", "between"), ge).otherwise(F.lit(0))
    hi = F.when(op == "lt", ge - 1).when(op.isin("le", "eq"), gt - 1).when(op == "between", gt2 - 1).otherwise(n - 1)
    if mode == "compat":
        le = F.when(F.col("gt1").isNull(), F.lit(UNBOUNDED)).otherwise((F.col("gt1") - 1).bitwiseAND(UNBOUNDED))
        hi = F.when(op == "lt", F.coalesce("ge3", F.lit(UNBOUNDED))).when(op == "le", le).otherwise(hi)
    return asked.select("qid", "op", "q", "q2", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))


# ---- query texts ----


def read_query_file(spark: SparkSession, path: str) -> DataFrame:
    """(line, text) of a query file: a line a predicate, counted from 0. Query files are small; one is read by one task."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), "\r?\n")).alias("line", "text")).select(F.col("line").cast("long"), "text")


def parse_query_text(lines: DataFrame, columns: int = 3) -> DataFrame:
    """(line, text) -> (qid, col, op, value): one predicate a line, as many lines as columns a query, "exit" ends the list.

    Only the first number of a list counts; one with a fraction or an exponent is cut to a whole number, as the files'
    own reader does; text that is no number gives null. A line without an operand is an error that names the line.
    """
    parts = F.split(F.trim("text"), r"\s+")
    rows = lines.select("line", F.trim("text").alias("text"), parts.alias("p"))
    stop = rows.where("text = 'exit'").agg(F.min("line").alias("_stop"))
    kept = rows.join(F.broadcast(stop), F.lit(True), "left")  # one row
    kept = kept.where("(_stop is null or line < _stop) and text <> ''")
    lacking = F.raise_error(F.concat(F.lit("no operand in line "), F.col("line"), F.lit(": "), F.col("text"))).cast("string")
    # guarded once more: a filter on the value may be moved before the one on lines
    first = F.split(F.when(F.size("p") > 1, F.get("p", 1)).when((F.col("_stop").isNull() | (F.col("line") < F.col("_stop"))) & (F.col("text") != ""), lacking), ",")[0]
    whole = F.coalesce(first.try_cast("bigint"), F.when(F.abs(first.try_cast("double")) < 2.0**63, first.try_cast("double")).cast("bigint"))
    return kept.select(F.expr(f"line div {columns}").cast("long").alias("qid"), F.expr(f"line % {columns}").cast("int").alias("col"), F.get("p", 0).alias("op"), whole.alias("value"))


def assemble(parsed: DataFrame, maps: list[DataFrame], n, mode: str = "exact") -> DataFrame:
    """(qid, xlo, xhi[, ylo, yhi[, zlo, zhi]]) of ``parse_query_text``, by the value map of each column.

    A column that a query doesn't name is unbounded; predicates on the same column must all hold; a value that is no
    number is an error.
    """
    value = F.coalesce("value", F.raise_error(F.concat(F.lit("no number in query "), F.col("qid"))).cast("bigint"))
    parts = []
    for k, m in enumerate(maps):
        own = parsed.where(F.col("col") == k).select("qid", "op", value.alias("q"))
        parts.append(bounds(own, m, n, mode).select("qid", F.lit(k).alias("col"), "lo", "hi"))
    every = reduce(DataFrame.unionByName, parts)
    aggs = []
    for k, c in zip(range(len(maps)), "xyz", strict=False):
        at = F.col("col") == k
        aggs += [F.coalesce(F.max(F.when(at, F.col("lo"))), F.lit(0)).cast("long").alias(f"{c}lo"), F.coalesce(F.min(F.when(at, F.col("hi"))), F.lit(UNBOUNDED)).cast("long").alias(f"{c}hi")]
    return every.groupBy("qid").agg(*aggs)
