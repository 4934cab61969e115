"""The registered queries of the range-scan engine, and the DuckDB SQL they are checked against.

Base: orders, row id o_orderkey, x, y, z = o_custkey, o_totalprice, o_orderdate. The SQL states each result in its own
terms (ranks, raw predicates), never by way of the grid.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangegrid.functions import datagen
from rangegrid.operators import bitmap, cellagg, encode, grid, predicates, query, validate
from rangegrid.operators.index import GridIndex
from rangegrid.plans import datasets
from rangegrid.sources import u32

RID, COLUMNS = "o_orderkey", ["o_custkey", "o_totalprice", "o_orderdate"]
R, SMALL_R = 1024, 32


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(RID, *COLUMNS)


def _index(spark, sf_dir, columns=COLUMNS, resolution=R) -> GridIndex:
    return GridIndex.build(orders(spark, sf_dir), RID, list(columns), resolution)


def _encoded(spark, sf_dir) -> DataFrame:
    return encode.encode_columns(orders(spark, sf_dir), RID, dict(zip("xyz", COLUMNS, strict=True)))


def _halves(df: DataFrame) -> dict[str, tuple]:
    """Thresholds that scale with the table: lt bounds for the three columns."""
    x, y, z = df.agg(F.expr("max(o_custkey) div 2"), F.expr("floor(max(o_totalprice) / 2)"), F.expr("date'1998-01-01'").alias("d")).first()
    return {"o_custkey": x, "o_totalprice": float(y), "o_orderdate": z}


def _positions(df: DataFrame, tests: dict[str, list[tuple]]) -> dict[str, tuple[int, int]]:
    """{column: closed range of positions} for {column: [(op, value[, value2]), ...]}: counts of smaller values, in one scan."""
    aggs, n = [], F.count("*")
    for c, ops in tests.items():
        for op, *v in ops:
            below = lambda strict, value, c=c: F.count(F.when(F.col(c) < F.lit(value) if strict else F.col(c) <= F.lit(value), 1))
            lo = {"gt": lambda: below(False, v[0]), "ge": lambda: below(True, v[0]), "eq": lambda: below(True, v[0]), "between": lambda: below(True, v[0])}.get(op, lambda: F.lit(0))()
            hi = {"lt": lambda: below(True, v[0]) - 1, "le": lambda: below(False, v[0]) - 1, "eq": lambda: below(False, v[0]) - 1, "between": lambda: below(False, v[1]) - 1}.get(op, lambda: n - 1)()
            aggs += [lo.cast("long").alias(f"{c}_lo_{op}"), hi.cast("long").alias(f"{c}_hi_{op}")]
    row, out = df.agg(*aggs).first(), {}
    for c, ops in tests.items():
        out[c] = (max(row[f"{c}_lo_{op}"] for op, *_ in ops), min(row[f"{c}_hi_{op}"] for op, *_ in ops))
    return out


def _new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; only where all run in one process may that be unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(root or 'file:///tmp/rangegrid-shared').rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: The stored index of a table, by session and folder: built once, whatever the number of queries over it.
_STORED: dict[tuple, GridIndex] = {}


def _stored(spark, sf_dir) -> GridIndex:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = _new_path(spark, "index")
        _index(spark, sf_dir).write(path)
        _STORED[key] = GridIndex.load(spark, path)
    return _STORED[key]


QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


_ENC = """enc as (select o_orderkey rid, row_number() over (order by o_custkey, o_orderkey) - 1 x, row_number() over (order by o_totalprice, o_orderkey) - 1 y,
  row_number() over (order by o_orderdate, o_orderkey) - 1 z from orders), p as (select count(*) n, (count(*) + {r} - 1) // {r} w from orders)"""
_BIN = _ENC + ", b as (select enc.*, cast((x // w) + (y // w) * {r} as bigint) bin from enc, p), h as (select bin, count(*) cnt from b group by bin)"
_LT3 = "o_custkey < (select max(o_custkey) // 2 from orders) and o_totalprice < (select floor(max(o_totalprice) / 2) from orders) and o_orderdate < date '1998-01-01'"
_LT2 = "o_custkey < (select max(o_custkey) // 2 from orders) and o_totalprice < (select floor(max(o_totalprice) / 2) from orders)"


# ---- encoding ----


@register("enc_value_counts", "select o_custkey v, count(*) cnt from orders group by 1")
def _(spark, sf):
    return encode.value_counts(orders(spark, sf), "o_custkey")


@register("enc_value_map", "select distinct o_custkey v, rank() over (order by o_custkey) - 1 pos from orders")
def _(spark, sf):
    return encode.value_map(orders(spark, sf), "o_custkey")


_RANK = "select o_orderkey rid, row_number() over (order by o_totalprice, o_orderkey) - 1 pos from orders"


@register("enc_rank", _RANK)
def _(spark, sf):
    return encode.rank_encode(orders(spark, sf), "o_totalprice", RID, method="window").select(F.col(RID).alias("rid"), "pos")


@register("enc_rank_distributed", _RANK)
def _(spark, sf):
    return encode.rank_encode(orders(spark, sf), "o_totalprice", RID, parts=64).select(F.col(RID).alias("rid"), "pos")


@register("enc_columns3", f"with {_ENC.format(r=R)} select rid, x, y, z from enc")
def _(spark, sf):
    return _encoded(spark, sf)


@register("enc_unpivot", f"with {_ENC.format(r=R)} select 0 col, rid, x pos from enc union all select 1, rid, y from enc union all select 2, rid, z from enc")
def _(spark, sf):
    return encode.unpivot(_encoded(spark, sf), ["x", "y", "z"])


@register("enc_stats", " union all ".join(f"select '{c}' as name, count({c}) n, count(distinct {c}) n_distinct from orders" for c in COLUMNS))
def _(spark, sf):
    return encode.encode_stats(orders(spark, sf), COLUMNS)


@register("enc_decode", "select o_orderkey rid, o_custkey v from orders")
def _(spark, sf):
    df = orders(spark, sf)
    return encode.decode(encode.rank_encode(df, "o_custkey", RID).select(F.col(RID).alias("rid"), "pos"), "pos", encode.value_map(df, "o_custkey")).select("rid", "v")


# ---- predicates ----

_QS = (0, 1, 10, 700, 1499, 5000)
_VALUES = ", ".join(f"({k}, {q})" for k, q in enumerate(_QS))


def _bounds(op: str, lo: str, hi: str):
    sql = f"select qid, {lo} as lo, {hi} as hi from (select q.qid, q.q, count(*) filter (where o_custkey < q.q) b, count(*) filter (where o_custkey <= q.q) e, count(*) n from (values {_VALUES}) q(qid, q), orders group by 1, 2)"

    @register(f"pred_bounds_{op}", sql)
    def _(spark, sf):
        df = orders(spark, sf)
        asked = spark.createDataFrame([(k, op, q) for k, q in enumerate(_QS)], "qid int, op string, q bigint")
        return predicates.bounds(asked, encode.value_map(df, "o_custkey"), df.count()).select("qid", "lo", "hi")


for _op, _lo, _hi in (("lt", "0::bigint", "b - 1"), ("le", "0::bigint", "e - 1"), ("gt", "e", "n - 1"), ("ge", "b", "n - 1"), ("eq", "b", "e - 1")):
    _bounds(_op, _lo, _hi)


@register(
    "pred_lt_compat",
    f"""with m as (select distinct o_custkey v, rank() over (order by o_custkey) - 1 pos from orders)
select qid, 0::bigint lo, coalesce((select min(pos) from m where v >= case when q = 0 then 4294967295 else q - 1 end), 4294967295) hi from (values {_VALUES}) q(qid, q)""",
)
def _(spark, sf):
    df = orders(spark, sf)
    asked = spark.createDataFrame([(k, "lt", q) for k, q in enumerate(_QS)], "qid int, op string, q bigint")
    return predicates.bounds(asked, encode.value_map(df, "o_custkey"), df.count(), mode="compat").select("qid", "lo", "hi")


_ASKED = [(0, "lt", 700, None), (1, "le", 700, None), (2, "gt", 5, None), (3, "ge", 5, None), (4, "eq", 33, None), (5, "between", 10, 20), (6, "between", 30, 20)]


@register(
    "pred_batch_bounds",
    "select qid, op, count(*) filter (where case op when 'lt' then o_custkey < q when 'le' then o_custkey <= q when 'gt' then o_custkey > q when 'ge' then o_custkey >= q when 'eq' then o_custkey = q else o_custkey between q and q2 end) matches from (values "
    + ", ".join(f"({k}, '{o}', {q}, {q2 if q2 is not None else 'null'})" for k, o, q, q2 in _ASKED)
    + ") q(qid, op, q, q2), orders group by 1, 2",
)
def _(spark, sf):
    df = orders(spark, sf)
    asked = spark.createDataFrame(_ASKED, "qid int, op string, q bigint, q2 bigint")
    b = predicates.bounds(asked, encode.value_map(df, "o_custkey"), df.count())
    return b.select("qid", "op", F.greatest(F.lit(0).cast("long"), F.col("hi") - F.col("lo") + 1).alias("matches"))


_TEXT = ["lt 700", "le 40000,5", "ge x", "lt 3", "between 4", "lt 9", "lt 1e3", "lt 40000.7", "le -2.5", "exit", "lt 1"]


@register(
    "pred_parse_text",
    "select * from (values (0::bigint, 0, 'lt', 700::bigint), (0, 1, 'le', 40000), (0, 2, 'ge', null), (1, 0, 'lt', 3), (1, 1, 'between', 4), (1, 2, 'lt', 9), (2, 0, 'lt', 1000), (2, 1, 'lt', 40000), (2, 2, 'le', -2)) t(qid, col, op, value)",
)
def _(spark, sf):
    return predicates.parse_query_text(spark.createDataFrame(list(enumerate(_TEXT)), "line bigint, text string"))


# ---- grid ----


@register("grid_params", f"select count(*) n, {R} resolution, (count(*) + {R} - 1) // {R} width from orders")
def _(spark, sf):
    p = _index(spark, sf).params
    return spark.createDataFrame([(p.n, p.resolution, p.width)], "n bigint, resolution int, width bigint")


@register("grid_bin", f"with {_BIN.format(r=R)} select rid, bin from b")
def _(spark, sf):
    return _index(spark, sf).rows.select("rid", "bin")


@register("grid_histogram", f"with {_BIN.format(r=R)} select bin, cnt from h")
def _(spark, sf):
    return grid.histogram(_index(spark, sf).rows)


@register("grid_histogram_dense", f"with {_BIN.format(r=SMALL_R)} select r.range bin, coalesce(cnt, 0) cnt from range({SMALL_R**2}) r left join h on h.bin = r.range")
def _(spark, sf):
    i = _index(spark, sf, resolution=SMALL_R)
    return grid.dense(grid.histogram(i.rows), i.params)


@register("grid_max_bin", f"with {_BIN.format(r=R)} select max(cnt) max_cnt from h")
def _(spark, sf):
    return grid.max_count(grid.histogram(_index(spark, sf).rows))


@register("grid_prefix_sum", f"with {_BIN.format(r=SMALL_R)}, d as (select r.range bin, coalesce(cnt, 0) cnt from range({SMALL_R**2}) r left join h on h.bin = r.range) select bin, cnt, cast(sum(cnt) over (order by bin) - cnt as bigint) st from d")
def _(spark, sf):
    i = _index(spark, sf, resolution=SMALL_R)
    return grid.prefix_sum(grid.dense(grid.histogram(i.rows), i.params), "bin", "cnt", block=100)


@register("grid_directory", f"with {_BIN.format(r=R)} select bin, cast(sum(cnt) over (order by bin) - cnt as bigint) st, cast(sum(cnt) over (order by bin) as bigint) en from h")
def _(spark, sf):
    return _index(spark, sf).directory


@register("grid_scatter", f"with {_BIN.format(r=R)} select row_number() over (order by bin, rid) - 1 slot, x, y, z, rid, bin from b")
def _(spark, sf):
    return _index(spark, sf).payload()


# ---- queries ----

_BOX = f"with {_BIN.format(r=R)}, q as (select count(*) filter (where o_custkey < (select max(o_custkey) // 2 from orders)) - 1 x2, count(*) filter (where o_totalprice < (select floor(max(o_totalprice) / 2) from orders)) - 1 y2 from orders), c as (select distinct bin from b, p, q where x // w <= x2 // w and y // w <= y2 // w)"


def _lt(df: DataFrame, columns) -> dict[str, tuple[int, int]]:
    halves = _halves(df)
    got = _positions(df, {c: [("lt", halves[c])] for c in columns})
    return dict(zip("xyz", (got[c] for c in columns), strict=False))


@register("query_candidate_bins", f"{_BOX} select bin from c")
def _(spark, sf):
    i, ranges = _index(spark, sf), _lt(orders(spark, sf), COLUMNS)
    return query.candidate_bins(i.directory, i.params, ranges["x"], ranges["y"]).select("bin")


@register("query_candidate_spans", f"{_BOX}, d as (select bin, cast(sum(cnt) over (order by bin) - cnt as bigint) st, cast(sum(cnt) over (order by bin) as bigint) en from h) select d.* from d join c using (bin)")
def _(spark, sf):
    i, ranges = _index(spark, sf), _lt(orders(spark, sf), COLUMNS)
    return query.candidate_bins(i.directory, i.params, ranges["x"], ranges["y"]).select("bin", "st", "en")


@register("query_refine_2col", f"select o_orderkey rid from orders where {_LT2}")
def _(spark, sf):
    return query.two_pass(_index(spark, sf, COLUMNS[:2]), **_lt(orders(spark, sf), COLUMNS[:2]))


@register("query_range_3col", f"select o_orderkey rid from orders where {_LT3}")
def _(spark, sf):
    return query.range_query(_index(spark, sf), **_lt(orders(spark, sf), COLUMNS))


@register("query_two_pass_3col", f"select o_orderkey rid from orders where {_LT3}")
def _(spark, sf):
    return query.two_pass(_index(spark, sf), **_lt(orders(spark, sf), COLUMNS))


@register("query_between_3col", "select o_orderkey rid from orders where o_custkey between 20 and 900 and o_totalprice between 50000 and 250000 and o_orderdate between date '1993-01-01' and date '1996-06-30'")
def _(spark, sf):
    got = _positions(orders(spark, sf).withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")), {"o_custkey": [("between", 20, 900)], "o_totalprice": [("between", 50000.0, 250000.0)], "o_orderdate": [("between", *map(_day, ("1993-01-01", "1996-06-30")))]})
    return query.range_query(_index(spark, sf), **dict(zip("xyz", got.values(), strict=True)))


def _day(text: str):
    from datetime import datetime

    return datetime.fromisoformat(text)


@register("query_unbounded", "select o_orderkey rid from orders where o_custkey >= 10 and o_totalprice is not null and o_orderdate is not null")
def _(spark, sf):
    got = _positions(orders(spark, sf), {"o_custkey": [("ge", 10)]})["o_custkey"]
    far = (0, predicates.UNBOUNDED)
    return query.range_query(_index(spark, sf), x=got, y=far, z=far)


@register("query_empty", "select o_orderkey rid from orders where o_custkey < 0")
def _(spark, sf):
    got = _positions(orders(spark, sf), {"o_custkey": [("lt", 0)]})["o_custkey"]
    return query.two_pass(_index(spark, sf), x=got, y=(0, predicates.UNBOUNDED), z=(0, predicates.UNBOUNDED))


_BATCH = [(0, 0, 100, 0, 2000, 0, 10**9), (1, 50, 5000, 50, 700, 100, 9000), (2, 10, 5, 0, 10**9, 0, 10**9), (3, 0, 10**9, 0, 10**9, 0, 10**9), (4, 900, 1200, 0, 10**9, 3000, 4000)]


@register("query_batch", f"with {_ENC.format(r=R)} select qid, rid from enc, (values {', '.join(map(str, _BATCH))}) q(qid, xlo, xhi, ylo, yhi, zlo, zhi) where x between xlo and xhi and y between ylo and yhi and z between zlo and zhi")
def _(spark, sf):
    return query.batch(_index(spark, sf), spark.createDataFrame(_BATCH, "qid int, xlo bigint, xhi bigint, ylo bigint, yhi bigint, zlo bigint, zhi bigint"))


@register("query_bitmap_words", f"select o_orderkey >> 5 as word, bit_or(1::bigint << (o_orderkey & 31)) bits from orders where {_LT3} group by 1")
def _(spark, sf):
    return bitmap.words(QUERIES["query_range_3col"](spark, sf))


@register("query_bitmap_popcount", f"select count(*) matches from orders where {_LT3}")
def _(spark, sf):
    return bitmap.popcount(QUERIES["query_bitmap_words"](spark, sf))


@register("query_bitmap_probe", f"select o_orderkey rid, coalesce({_LT3}, false) hit from orders")
def _(spark, sf):
    return bitmap.probe(orders(spark, sf).select(F.col(RID).alias("rid")), QUERIES["query_bitmap_words"](spark, sf))


@register("query_union_bitmap", f"select o_orderkey >> 5 as word, bit_or(1::bigint << (o_orderkey & 31)) bits from orders where ({_LT3}) or o_custkey >= 10 group by 1")
def _(spark, sf):
    return bitmap.union(QUERIES["query_bitmap_words"](spark, sf), bitmap.words(QUERIES["query_unbounded"](spark, sf)))


@register("validate_bruteforce", f"select 0::bigint mismatches, count(*) wanted from orders where {_LT3}")
def _(spark, sf):
    df = orders(spark, sf)
    halves = _halves(df)
    plain = df.where((F.col("o_custkey") < halves["o_custkey"]) & (F.col("o_totalprice") < halves["o_totalprice"]) & (F.col("o_orderdate") < F.lit(halves["o_orderdate"])))
    return validate.mismatches(QUERIES["query_two_pass_3col"](spark, sf), plain.select(F.col(RID).alias("rid")))


@register("query_stored_index", f"select o_orderkey rid from orders where {_LT3}")
def _(spark, sf):
    """The same query on an index that was written and loaded: folders, row groups and bins prune the scan."""
    return query.range_query(_stored(spark, sf), **_lt(orders(spark, sf), COLUMNS))


#: Query texts over (o_custkey, o_totalprice, o_orderkey): three lines a query.
_QUERY_TEXT = ["lt 700", "le 250000.5", "ge 100", "eq 33", "gt 1e3", "lt 12000", "le 50,7", "ge 1000", "lt 0", "exit", "lt 1"]
_STORED_TEXT = "select 0::bigint qid, o_orderkey rid from orders where o_custkey < 700 and o_totalprice <= 250000 and o_orderkey >= 100 union all select 1, o_orderkey from orders where o_custkey = 33 and o_totalprice > 1000 and o_orderkey < 12000"


def _text_index(spark, sf) -> GridIndex:
    key = (spark.sparkContext.applicationId, sf, "text")
    if key not in _STORED:
        path = _new_path(spark, "index")
        df = orders(spark, sf).withColumn("z", F.col(RID))
        GridIndex.build(df, RID, [*COLUMNS[:2], "z"]).write(path)
        _STORED[key] = GridIndex.load(spark, path)
    return _STORED[key]


@register("query_text_batch", _STORED_TEXT)
def _(spark, sf):
    """From query texts to rows, by the value maps that the index stores: the table itself isn't read."""
    return query.text_batch(_text_index(spark, sf), spark.createDataFrame(list(enumerate(_QUERY_TEXT)), "line bigint, text string"))


@register("query_text_file", _STORED_TEXT)
def _(spark, sf):
    """The same from a query file."""
    path = _new_path(spark, "queries")
    spark.createDataFrame([("\n".join(_QUERY_TEXT),)], "value string").coalesce(1).write.text(path)
    return datasets.run_query_file(spark, _text_index(spark, sf), path)


@register("query_stored_values", "select qid, rid from (select 0 qid, o_orderkey rid from orders where o_custkey between 20 and 900 union all select 1, o_orderkey from orders where o_custkey >= 1200 union all select 2, o_orderkey from orders where o_custkey <= 3)")
def _(spark, sf):
    """Predicates on values, translated by a stored value map, then one batch."""
    index = _stored(spark, sf)
    asked = spark.createDataFrame([(0, "between", 20, 900), (1, "ge", 1200, None), (2, "le", 3, None)], "qid int, op string, q bigint, q2 bigint")
    far = {f"{c}{end}": F.lit(predicates.UNBOUNDED if end == "hi" else 0).cast("long") for c in "yz" for end in ("lo", "hi")}
    b = predicates.bounds(asked, index.maps[0], index.params.n).select("qid", F.col("lo").alias("xlo"), F.col("hi").alias("xhi")).withColumns(far)
    return query.batch(index, b)


@register("query_range_1col", "select o_orderkey rid from orders where o_custkey >= 100 and o_custkey < (select max(o_custkey) // 2 from orders)")
def _(spark, sf):
    df = orders(spark, sf)
    got = _positions(df, {"o_custkey": [("ge", 100), ("lt", _halves(df)["o_custkey"])]})["o_custkey"]
    return query.range_query(_index(spark, sf, COLUMNS[:1]), x=got)


@register("u32_roundtrip", "select o_orderkey rid, o_custkey c0, cast(floor(o_totalprice) as bigint) c1 from orders")
def _(spark, sf):
    """A table written as a binary column file and read back; its ids are 0 to n - 1."""
    path = _new_path(spark, "u32")
    df = orders(spark, sf).select(F.col(RID).alias("rid"), F.col("o_custkey").cast("long").alias("a"), F.floor("o_totalprice").cast("long").alias("b"))
    u32.write_columns(df, path, ["a", "b"])
    return u32.read_columns(spark, path, 2)


@register("u32_maps", "select 0 col, v, pos from (select distinct o_custkey::bigint v, rank() over (order by o_custkey) - 1 pos from orders) union all select 1, v, pos from (select distinct cast(floor(o_totalprice) as bigint) v, rank() over (order by floor(o_totalprice)) - 1 pos from orders)")
def _(spark, sf):
    """Value maps written as a binary file and read back."""
    path = _new_path(spark, "maps")
    df = orders(spark, sf).select(F.col("o_custkey").cast("long").alias("a"), F.floor("o_totalprice").cast("long").alias("b"))
    u32.write_maps([encode.value_map(df, c) for c in "ab"], path)
    return u32.read_maps(spark, path)


@register(
    "dataset_encode_query",
    "select 0::bigint qid, o_orderkey rid from orders where o_custkey < 700 and floor(o_totalprice) <= 250000 and o_orderkey >= 100 union all select 1, o_orderkey from orders where o_custkey = 33 and floor(o_totalprice) > 1000 and o_orderkey < 12000",
)
def _(spark, sf):
    """A binary data set encoded to files, loaded from them, and asked by query texts."""
    raw, prefix = _new_path(spark, "raw"), _new_path(spark, "encoded")
    df = orders(spark, sf).select(F.col(RID).alias("rid"), F.col("o_custkey").alias("a"), F.floor("o_totalprice").alias("b"), F.col(RID).alias("c"))
    u32.write_columns(df, raw, ["a", "b", "c"])
    datasets.encode_dataset(spark, raw, prefix)
    return query.text_batch(datasets.load_encoded(spark, prefix), spark.createDataFrame(list(enumerate(_QUERY_TEXT)), "line bigint, text string"))


# ---- aggregates of cells ----

_CELL = f"with {_BIN.format(r=SMALL_R)}, v as (select bin, rid, z, cast(round(o_totalprice * 100) as bigint) v from b join orders on rid = o_orderkey)"


def _valued(spark, sf) -> DataFrame:
    cents = orders(spark, sf).select(F.col(RID).alias("rid"), F.round(F.col("o_totalprice") * 100).cast("long").alias("v"))
    return _index(spark, sf, resolution=SMALL_R).rows.join(cents, "rid")


for _name, _sql in {
    "sum": "cast(sum(v) as bigint)", "min": "min(v)", "max": "max(v)", "last": "arg_max(v, rid)", "and": "bit_and(v)", "or": "bit_or(v)", "xor": "bit_xor(v)", "nearest": "arg_min(v, z)",
}.items():

    @register(f"cell_{_name}", f"{_CELL} select bin, {_sql} cell_{_name} from v group by bin")
    def _(spark, sf, _name=_name):
        return cellagg.cells(_valued(spark, sf), "v", "z").select("bin", f"cell_{_name}")


@register("cell_blend", f"{_CELL} select bin, list_reduce(list_prepend(0.0::double, list(v::double order by rid)), lambda acc, x: 0.25::double * x + (1 - 0.25::double) * acc) as color from v group by bin")
def _(spark, sf):
    return cellagg.blend(_valued(spark, sf).withColumn("a", F.lit(0.25)), "v", "a")


# ---- other tables ----


@register("events_range_3col", "select event_id rid from events where user_id < 60 and value < 40.5 and ts < (select max(ts) from events)")
def _(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "value", "ts")
    top = df.agg(F.max("ts")).first()[0]
    got = _positions(df, {"user_id": [("lt", 60)], "value": [("lt", 40.5)], "ts": [("lt", top)]})
    return query.two_pass(GridIndex.build(df, "event_id", ["user_id", "value", "ts"]), **dict(zip("xyz", got.values(), strict=True)))


@register("customer_range_2col", "select c_custkey rid from customer where c_nationkey < 12 and c_acctbal <= 100.0")
def _(spark, sf):
    df = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_nationkey", "c_acctbal")
    got = _positions(df, {"c_nationkey": [("lt", 12)], "c_acctbal": [("le", 100.0)]})
    return query.range_query(GridIndex.build(df, "c_custkey", ["c_nationkey", "c_acctbal"]), x=got["c_nationkey"], y=got["c_acctbal"])


@register("part_range_string", "select p_partkey rid from part where p_size < 20 and p_brand <= 'Brand#33'")
def _(spark, sf):
    df = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size", "p_brand")
    got = _positions(df, {"p_size": [("lt", 20)], "p_brand": [("le", "Brand#33")]})
    return query.range_query(GridIndex.build(df, "p_partkey", ["p_size", "p_brand"]), x=got["p_size"], y=got["p_brand"])


def _lcg(seed: int, c: str = "id") -> str:
    out = f"({c} + {seed}) % 4294967296"
    for _ in range(3):
        step = f"((({out}) * 1664525 + 1013904223) % 4294967296)"
        out = f"xor({step}, {step} >> 16)"
    return out


@register("datagen_uniform", f"select id rid, {_lcg(1)} c0, {_lcg(7920)} c1, {_lcg(15839)} c2 from (select range id from range(20000))")
def _(spark, sf):
    return datagen.uniform(spark, 20_000)


_MEANS = ", ".join(f"cast(floor(({' + '.join(f'({_lcg(104729 * k + 31 * j)})' for j in range(12))}) / 12) as bigint) c{k}" for k in range(3))


@register("datagen_normal", f"select id rid, {_MEANS} from (select range id from range(20000))")
def _(spark, sf):
    return datagen.normal(spark, 20_000)


@register("datagen_zipf")
def _(spark, sf):
    """Powers of doubles may differ in the last place from one library to the next, so that this one has a test instead of SQL."""
    return datagen.zipf(spark, 20_000, 1.3)


@register("datagen_queries", f"select id // 3 qid, cast(id % 3 as int) col, 'lt' op, ({_lcg(17)}) % 20000 as value from (select range id from range(30))")
def _(spark, sf):
    return datagen.queries(spark, 10, 20_000)
