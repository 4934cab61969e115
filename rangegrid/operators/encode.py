"""Order-preserving rank encoding: value counts, value maps, positions, decoding.

Ties are ordered by row id. Rows with a null value get no position: they are left out, as a range predicate leaves them out.
Columns of the input keep their names; only an added column replaces one of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rangegrid.functions.names import constant_array, fresh

#: Rows that one task ranks, about; the most ranges that a column is dealt into; rows sampled to place the borders of
#: ranges of strings, which have no say in results.
ROWS_A_RANGE, MOST_PARTS, SAMPLED_ROWS = 100_000, 65_536, 200_000
#: Borders compared one after the other, twice, to find a value's range.
STEP = 256


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """(v, cnt) of each distinct value, by partial and final hash aggregation."""
    return df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("cnt"))


def _numeric(df: DataFrame, value: str) -> bool:
    kind = df.schema[value].dataType.typeName()
    return kind in ("byte", "short", "integer", "long", "float", "double", "date", "timestamp", "timestamp_ntz") or kind.startswith("decimal")


def _orderable(df: DataFrame, value: str) -> bool:
    return _numeric(df, value) or df.schema[value].dataType.typeName() in ("string", "boolean")


def _edges(df: DataFrame, columns: list[str], parts: int, n: int | None = None) -> dict[str, list]:
    """At most parts - 1 distinct quantiles of each column: bounded, and all that the driver sees.

    Columns with a measure share one scan; strings take theirs from a bounded sample of rows.
    """
    if parts < 2 or not columns:
        return {c: [] for c in columns}
    at, out = [k / parts for k in range(1, parts)], {}
    own = [c for c in columns if _numeric(df, c)]
    if own:
        row = df.agg(*[F.percentile_approx(c, at, max(10_000, 4 * parts)) for c in own]).first()
        out = {c: sorted(set(got or [])) for c, got in zip(own, row, strict=True)}
    others = [c for c in columns if c not in own]
    if others:
        share = min(1.0, SAMPLED_ROWS / max(1, n if n is not None else df.count()))
        rows = df.select(*others).sample(share, seed=1).limit(2 * SAMPLED_ROWS).collect()
        for c in others:
            got = sorted(r[c] for r in rows if r[c] is not None)
            out[c] = sorted({got[len(got) * k // parts] for k in range(1, parts)}) if got else []
    return out


def _below(value: str, edges: list, kind: str, step: int = STEP) -> Column:
    """Number of edges below the value: first among every 256th edge, then among the 256 that follow."""
    if not edges:
        return F.lit(0)
    less = lambda e: e < F.col(value)
    if len(edges) <= step:
        return F.size(F.filter(constant_array(edges, kind), less))
    coarse = F.size(F.filter(constant_array(edges[step - 1 :: step], kind), less)) * step
    return coarse + F.size(F.filter(F.slice(constant_array(edges, kind), coarse + 1, F.lit(step)), less))


def _dealt(df: DataFrame, value: str, rid: str, edges: list, places: list, b: str, s: str) -> DataFrame:
    """df with columns b and s: ranges of values and, for values that are range edges and so may be heavy, ranges of row ids."""
    kinds = dict(df.dtypes)
    at = _below(value, edges, kinds[value])
    on_edge = F.coalesce(F.get(constant_array(edges, kinds[value]), at) == F.col(value), F.lit(False)) if edges else F.lit(False)
    return df.withColumns({b: at * 2 + on_edge.cast("int"), s: F.when(on_edge, _below(rid, places, kinds[rid])).otherwise(F.lit(0))})


def _offsets(counts: DataFrame, keys: list[str], n: str, out: str) -> DataFrame:
    """counts with ``out``: the sum of n over all rows before, by keys; one row a range, so one task orders them."""
    return counts.withColumn(out, F.coalesce(F.sum(n).over(W.orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long"))


def _parts(df: DataFrame, parts: int | None, n: int | None = None) -> int:
    return parts or min(MOST_PARTS, -(-(df.count() if n is None else n) // ROWS_A_RANGE))


def rank_encode(df: DataFrame, value: str, rid: str, out: str = "pos", method: str = "ranges", parts: int | None = None, edges: list | None = None, places: list | None = None) -> DataFrame:
    """df with the 0-based position of each row in the order of (value, rid).

    "ranges" deals rows into ranges of values (heavy values into ranges of ids), ranks within each and adds what the
    ranges before hold, so that no task sorts more than a range. "window" is one global window, for small tables and
    types that have no order of their own but a struct's.
    """
    df = df.where(F.col(value).isNotNull())
    if method == "window" or not (_orderable(df, value) and _orderable(df, rid)):
        return df.withColumn(out, F.row_number().over(W.orderBy(value, rid)).cast("long") - 1)
    if edges is None:
        n = df.count() if parts is None else None
        got = _edges(df, [value, rid], _parts(df, parts, n), n)
        edges, places = got[value], got[rid]
    b, s, own, size, off = fresh(df, "b", "s", "local", "n", "off")
    dealt = _dealt(df, value, rid, edges, places or [], b, s)
    local = F.row_number().over(W.partitionBy(b, s).orderBy(value, rid)).cast("long") - 1
    if not edges:
        return dealt.withColumn(out, local).drop(b, s)
    # two rows a range of values and, at most, one a range of ids for each edge that is heavy
    offsets = _offsets(dealt.groupBy(b, s).agg(F.count("*").alias(size)), [b, s], size, off).select(b, s, off)
    return dealt.withColumn(own, local).join(offsets, [b, s]).withColumn(out, F.col(off) + F.col(own)).drop(b, s, own, off)


def value_map(df: DataFrame, value: str, parts: int | None = None) -> DataFrame:
    """(v, pos): the number of rows with a smaller value, for each distinct value."""
    counts = value_counts(df, value)
    if not _orderable(df, value):
        return counts.select("v", (F.sum("cnt").over(W.orderBy("v")) - F.col("cnt")).cast("long").alias("pos"))
    n = df.count() if parts is None else None
    edges = _edges(df.select(value), [value], _parts(df, parts, n), n)[value]
    # the range is an aggregate of its own: as an expression over v, a join on it would be given filters that lose v
    at = F.min(_below(value, edges, dict(df.dtypes)[value])).alias("_b")
    dealt = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("cnt"), at)
    offsets = _offsets(dealt.groupBy("_b").agg(F.sum("cnt").alias("_n")), ["_b"], "_n", "off").select("_b", "off")
    running = F.sum("cnt").over(W.partitionBy("_b").orderBy("v")) - F.col("cnt")
    return dealt.withColumn("_run", running).join(offsets, "_b").select("v", (F.col("off") + F.col("_run")).cast("long").alias("pos"))


def encode_columns(df: DataFrame, rid: str, columns: dict[str, str], method: str = "ranges", n: int | None = None, keep_values: bool = False) -> DataFrame:
    """(rid, <out> ...) for columns {out: source}; rows with a null in any of them are left out first. n: rows, if known.

    keep_values: with v_<out> too, the values themselves.
    """
    base = df.select(F.col(rid).alias("rid"), *[F.col(c).alias(f"v_{o}") for o, c in columns.items()]).dropna()
    own = [c for c in ["rid", *[f"v_{o}" for o in columns]] if _orderable(base, c)]
    n = base.count() if n is None else n
    edges, out = _edges(base, own, _parts(base, None, n), n), base
    for o in columns:
        out = rank_encode(out, f"v_{o}", "rid", o, method, edges=edges.get(f"v_{o}", []), places=edges.get("rid", []))
    return out.select("rid", *columns, *[f"v_{o}" for o in columns if keep_values])


def unpivot(encoded: DataFrame, columns: list[str]) -> DataFrame:
    """(col, rid, pos): the columns one under the other."""
    return encoded.select("rid", F.explode(F.array(*[F.struct(F.lit(k).alias("col"), F.col(c).alias("pos")) for k, c in enumerate(columns)])).alias("x")).select("x.col", "rid", "x.pos")


def decode(encoded: DataFrame, pos: str, mapping: DataFrame, out: str = "v") -> DataFrame:
    """encoded with the value of each position: that of the greatest first position at or below it.

    Positions and map entries meet in fixed ranges of positions; a range that begins amid a value takes that value from
    the ranges before, one row each.
    """
    width = 1 << 16
    marks = mapping.select(F.col("pos").alias("_p"), F.lit(0).alias("_k"), F.col("v").alias("_v"))
    rows = encoded.select(F.col(pos).alias("_p"), F.lit(1).alias("_k"), F.lit(None).cast(dict(mapping.dtypes)["v"]).alias("_v"), F.struct(*encoded.columns).alias("_row"))
    both = marks.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)).unionByName(rows).withColumn("_b", F.expr(f"_p div {width}"))
    own = W.partitionBy("_b").orderBy("_p", "_k").rowsBetween(W.unboundedPreceding, 0)
    lasts = both.groupBy("_b").agg(F.max_by("_v", F.when(F.col("_k") == 0, F.col("_p"))).alias("_last"))
    carried = lasts.select("_b", F.last("_last", ignorenulls=True).over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)).alias("_carry"))
    filled = both.withColumn("_f", F.last("_v", ignorenulls=True).over(own)).join(carried, "_b")
    return filled.where("_k = 1").select("_row.*", F.coalesce("_f", "_carry").alias("_decoded")).select(*[f"`{c}`" for c in encoded.columns if c != out], F.col("_decoded").alias(out))


def encode_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n, n_distinct) of each column."""
    parts = [df.agg(F.lit(c).alias("name"), F.count(c).alias("n"), F.countDistinct(c).alias("n_distinct")) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
