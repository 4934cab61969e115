"""The golden fixture of eight rows, property tests on skewed data, file round trips and every query with SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rangegrid.functions import datagen
from rangegrid.operators import bitmap, cellagg, encode, grid, predicates, query, validate
from rangegrid.operators.index import GridIndex
from rangegrid.plans import catalog, datasets
from rangegrid.sources import u32

SF = "/root/testdata/sf0.001"
G8 = [(0, 5, 10, 2), (1, 3, 20, 2), (2, 5, 10, 2), (3, 9, 40, 2), (4, 1, 30, 1), (5, 3, 20, 3), (6, 5, 50, 3), (7, 7, 60, 1)]


@pytest.fixture(scope="module")
def g8(spark):
    return spark.createDataFrame(G8, "rid bigint, X bigint, Y bigint, Z bigint")


@pytest.fixture(scope="module")
def index(g8):
    return GridIndex.build(g8, "rid", ["X", "Y", "Z"], resolution=4)


def test_fixture_encoding(g8, index):
    want = [(0, 3, 0, 2, 1), (1, 1, 2, 3, 4), (2, 4, 1, 4, 2), (3, 7, 5, 5, 11), (4, 0, 4, 0, 8), (5, 2, 3, 6, 5), (6, 5, 6, 7, 14), (7, 6, 7, 1, 15)]
    assert sorted(map(tuple, index.rows.select("rid", "x", "y", "z", "bin").collect())) == want
    assert sorted(map(tuple, encode.value_map(g8, "X").collect())) == [(1, 0), (3, 1), (5, 3), (7, 6), (9, 7)]
    dense = grid.dense(grid.histogram(index.rows), index.params).orderBy("bin").collect()
    assert [r.cnt for r in dense] == [0, 1, 1, 0, 1, 1, 0, 0, 1, 0, 0, 1, 0, 0, 1, 1]
    assert [r.rid for r in index.payload().orderBy("slot").collect()] == [0, 2, 1, 5, 4, 3, 6, 7]


EXACT_LT = [0, 0, 1, 1, 3, 3, 6, 6, 7, 7, 8, 8]
EXACT_LE = [0, 1, 1, 3, 3, 6, 6, 7, 7, 8, 8, 8]
MAX = 4294967295
COMPAT_LT = [MAX, 0, 0, 1, 1, 3, 3, 6, 6, 7, 7, MAX]
COMPAT_LE = [MAX, 0, 0, 2, 2, 5, 5, 6, 6, MAX, MAX, MAX]


def test_fixture_bounds(spark, g8):
    ask = spark.createDataFrame([(q, op, q) for q in range(12) for op in ("lt", "le")], "qid int, op string, q bigint")
    m = encode.value_map(g8, "X")
    exact = {(r.op, r.q): r.hi + 1 for r in predicates.bounds(ask, m, 8).collect()}
    assert [exact["lt", q] for q in range(12)] == EXACT_LT and [exact["le", q] for q in range(12)] == EXACT_LE
    compat = {(r.op, r.q): r.hi for r in predicates.bounds(ask, m, 8, mode="compat").collect()}
    assert [compat["lt", q] for q in range(12)] == COMPAT_LT and [compat["le", q] for q in range(12)] == COMPAT_LE
    with pytest.raises(Exception, match="unknown operator"):
        predicates.bounds(spark.createDataFrame([(0, "like", 1)], "qid int, op string, q bigint"), m, 8).collect()


def test_fixture_query(index):
    exact, compat = {"x": (0, 5), "y": (0, 4), "z": (0, 5)}, {"x": (0, 6), "y": (0, 5), "z": (0, 2)}
    for ranges, rids, word in ((exact, [0, 1, 2, 4], 23), (compat, [0, 4], 17)):
        for run in (query.two_pass, query.range_query):
            got = run(index, **ranges)
            assert sorted(r.rid for r in got.collect()) == rids
            assert [tuple(r) for r in bitmap.words(got).collect()] == [(0, word)]


@pytest.mark.parametrize("n", [0, 1, 7, 1025, 3000])
@pytest.mark.parametrize("kind", ["uniform", "zipf", "equal"])
def test_encoding_properties(spark, monkeypatch, n, kind):
    df = {"uniform": lambda: datagen.uniform(spark, n, 2), "zipf": lambda: datagen.zipf(spark, n, 1.3, 2), "equal": lambda: spark.range(n).selectExpr("id as rid", "7L as c0", "7L as c1")}[kind]()
    monkeypatch.setattr(encode, "ROWS_A_RANGE", 20)
    i = GridIndex.build(df, "rid", ["c0", "c1"], resolution=16)
    rows = i.rows.collect()
    assert sorted(r.x for r in rows) == list(range(n)) and sorted(r.y for r in rows) == list(range(n))
    raw = {r.rid: r for r in df.collect()}
    assert [r.rid for r in sorted(rows, key=lambda r: r.x)] == sorted(raw, key=lambda k: (raw[k].c0, k))
    if n:
        assert grid.max_count(grid.histogram(i.rows)).first()[0] <= i.params.width
        spans = sorted((r.st, r.en) for r in i.directory.collect())
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_nulls_are_left_out(spark):
    df = spark.createDataFrame([(0, 1, 2.5), (1, None, 1.0), (2, 3, None), (3, 0, -1.0)], "rid bigint, a int, b double")
    i = GridIndex.build(df, "rid", ["a", "b"])
    assert i.params.n == 2 and {r.rid for r in i.rows.collect()} == {0, 3}
    with pytest.raises(ValueError):
        GridIndex.build(df, "rid", [])
    one = GridIndex.build(df, "rid", ["b"])
    assert {r.rid for r in query.range_query(one, x=(0, 1)).collect()} == {1, 3} == {r.rid for r in query.two_pass(one, x=(0, 1)).collect()}


def test_stored_index_prunes_folders(spark, tmp_path):
    df = datagen.uniform(spark, 4000)
    GridIndex.build(df, "rid", ["c0", "c1", "c2"]).write(str(tmp_path / "i"))
    i = GridIndex.load(spark, str(tmp_path / "i"))
    got = query.range_query(i, x=(0, 500), y=(100, 700), z=(0, 2000))
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(tx" in plan and "PushedFilters: [IsNotNull(bx)" in plan
    whole = GridIndex.build(df, "rid", ["c0", "c1", "c2"])
    assert validate.mismatches(got, query.two_pass(whole, x=(0, 500), y=(100, 700), z=(0, 2000))).first().mismatches == 0


def test_strings_are_ranked_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(encode, "ROWS_A_RANGE", 40)
    words = ["", "a", "ab", "é", "日本", "z", "😀", None]
    rows = [(f"r{k:04d}", words[k * k * 5 % 11 % 8], k) for k in range(1200)]
    df = spark.createDataFrame(rows, "id string, w string, _b int").selectExpr("*", "1 as _s", "2 as _local", "3 as off", "4 as _off", "5 as _n")
    got = encode.rank_encode(df, "w", "id")
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange SinglePartition") == 1  # that of the offsets, a row a range
    want = sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1].encode(), r[0]))
    out = sorted(got.collect(), key=lambda r: r.pos)
    assert [(r.id, r["_b"]) for r in out] == [(r[0], r[2]) for r in want] and [r.pos for r in out] == list(range(len(want)))
    assert all((r["_s"], r["_local"], r.off, r["_off"], r["_n"]) == (1, 2, 3, 4, 5) for r in out)
    m = {r.v: r.pos for r in encode.value_map(df, "w").collect()}
    assert m == {w: next(k for k, r in enumerate(want) if r[1] == w) for w in {r[1] for r in want}}
    plan = encode.value_map(df, "w")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange SinglePartition") == 1  # that of the offsets, a row a range


def test_bounds_beyond_the_literals(spark, g8, monkeypatch):
    monkeypatch.setattr(encode, "ROWS_A_RANGE", 2)
    ask = spark.createDataFrame([(q, op, q, q + 2) for q in range(12) for op in predicates.OPERATORS], "qid int, op string, q bigint, q2 bigint")
    m = encode.value_map(g8, "X")
    for mode in ("exact", "compat"):
        few, many = (sorted(map(tuple, predicates.bounds(ask, m, 8, mode, most_literals=k).collect())) for k in (4096, 1))
        assert few == many
    plan = predicates.bounds(ask, m, 8)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert predicates.bounds(ask.limit(0), m, 8).count() == 0


def test_query_text(spark, tmp_path, g8):
    path = tmp_path / "q.txt"
    path.write_text("lt 7\r\nlt 40\r\nlt 3\r\nle 5.9\ngt 1e1,7\nge 0\nexit\nlt 1\n")
    lines = predicates.read_query_file(spark, str(path))
    assert [tuple(r) for r in predicates.parse_query_text(lines).orderBy("qid", "col").collect()] == [(0, 0, "lt", 7), (0, 1, "lt", 40), (0, 2, "lt", 3), (1, 0, "le", 5), (1, 1, "gt", 10), (1, 2, "ge", 0)]
    GridIndex.build(g8, "rid", ["X", "Y", "Z"], resolution=4).write(str(tmp_path / "i"))
    index = GridIndex.load(spark, str(tmp_path / "i"))
    assert sorted(map(tuple, query.text_batch(index, lines).collect())) == [(0, 0), (0, 1), (0, 2), (0, 4), (1, 1), (1, 4), (1, 5), (1, 6)]
    assert sorted(r.rid for r in query.text_batch(index, lines, "compat").where("qid = 0").collect()) == [0, 4]
    for text, said in (("lt 1\nlt\nlt 2", "no operand in line 1: lt"), ("lt 1\nlt x", "no number in query 0"), ("like 1", "unknown operator like")):
        path.write_text(text)
        with pytest.raises(Exception, match=said):
            query.text_batch(index, predicates.read_query_file(spark, str(path))).collect()


def test_many_queries_meet_rows_by_tiles(spark):
    df = datagen.uniform(spark, 3000)
    i = GridIndex.build(df, "rid", ["c0", "c1", "c2"], resolution=64)
    asked = spark.createDataFrame([(k, k * 37 % 2500, k * 37 % 2500 + 300, k * 91 % 2000, k * 91 % 2000 + 700, 0, 2500 - k) for k in range(40)], "qid int, xlo bigint, xhi bigint, ylo bigint, yhi bigint, zlo bigint, zhi bigint")
    few, many = query.batch(i, asked), query.batch(i, asked, most_broadcast=5)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and few.count() > 100
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()


def test_datasets(spark, tmp_path, capsys):
    df = datagen.uniform(spark, 500).withColumn("c1", F.col("c1") % 10)
    u32.write_columns(df, str(tmp_path / "a.dat"), ["c0", "c1", "c2"])
    (tmp_path / "q.txt").write_text("lt 2000000000\nle 4\nlt 3000000000\nlt 100\ngt 3\nge 0\nexit")
    datasets.main(["encode", "--input", str(tmp_path / "a.dat"), "--output", str(tmp_path)])
    datasets.main(["query", "--input", str(tmp_path / "a"), "--queries", str(tmp_path / "q.txt")])
    got = sorted(map(tuple, datasets.run_query_file(spark, datasets.load_encoded(spark, str(tmp_path / "a")), str(tmp_path / "q.txt")).collect()))
    rows = df.collect()
    assert got == sorted([(0, r.rid) for r in rows if r.c0 < 2_000_000_000 and r.c1 <= 4 and r.c2 < 3_000_000_000] + [(1, r.rid) for r in rows if r.c0 < 100 and r.c1 > 3])
    assert np.array_equal(np.sort(np.fromfile(tmp_path / "a-data.bin", "<u4")[500:1000]), np.arange(500))
    assert f'"0": {len(got)}' in capsys.readouterr().out


def test_generated_columns_are_independent(spark):
    got = np.array(datagen.uniform(spark, 20_000).collect(), float)[:, 1:]
    assert np.abs(np.corrcoef(got.T) - np.eye(3)).max() < 0.03 and np.abs(got.mean(0) / 2**31 - 1).max() < 0.02
    assert 0.012 < ((got[:, 0] < 2**29) & (got[:, 1] < 2**29)).mean() < 0.019


def test_zipf(spark):
    got = np.array([(r.rid, r.c0, r.c1) for r in datagen.zipf(spark, 5000, 1.3, 2).collect()])
    for k in range(2):
        x = (np.arange(5000, dtype=np.uint64) + np.uint64(15485863 * k + 3)) % np.uint64(2**32)
        for _ in range(3):
            x = (x * np.uint64(1664525) + np.uint64(1013904223)) % np.uint64(2**32)
            x ^= x >> np.uint64(16)
        want = np.floor(np.minimum(((x + np.uint64(1)) / 2.0**32) ** (-1 / 0.3), 4e9))
        own = got[np.argsort(got[:, 0]), k + 1]
        assert (np.abs(own - want) <= 1).all() and (own == want).mean() > 0.999


def test_u32_files(spark, tmp_path, g8):
    df = datagen.uniform(spark, 1000).union(spark.createDataFrame([(1000, 0, MAX, 5)], "rid bigint, c0 bigint, c1 bigint, c2 bigint"))
    path = str(tmp_path / "a.dat")
    u32.write_columns(df, path, ["c0", "c1", "c2"])
    assert np.fromfile(path, "<u4")[1000 + 1001] == MAX
    assert sorted(map(tuple, u32.read_columns(spark, path).collect())) == sorted(map(tuple, df.collect()))
    maps = [encode.value_map(g8, c) for c in "XYZ"]
    u32.write_maps(maps, str(tmp_path / "m.bin"))
    got = sorted(map(tuple, u32.read_maps(spark, str(tmp_path / "m.bin")).collect()))
    assert got == sorted((k, r.v, r.pos) for k, m in enumerate(maps) for r in m.collect())
    assert sorted(x.name for x in tmp_path.iterdir() if not x.name.endswith(".crc")) == ["a.dat", "m.bin"]
    u32.write_columns(df.limit(0), str(tmp_path / "none.dat"), ["c0"])
    assert u32.read_columns(spark, str(tmp_path / "none.dat"), 1).count() == 0
    u32.write_maps([maps[0].limit(0)], str(tmp_path / "none.bin"))
    assert u32.read_maps(spark, str(tmp_path / "none.bin")).count() == 0
    with pytest.raises(Exception, match="beyond 32 bits"):
        u32.write_columns(df.withColumn("c0", F.lit(-1)), str(tmp_path / "bad.dat"), ["c0"])
    with open(path, "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="bytes"):
        u32.read_columns(spark, path).collect()


def test_blend(spark):
    rows = spark.createDataFrame([(0, 0, 10, 0.5), (0, 1, 20, 0.5), (1, 2, 8, 1.0)], "bin bigint, rid bigint, v bigint, a double")
    assert sorted(map(tuple, cellagg.blend(rows, "v", "a").collect())) == [(0, 12.5), (1, 8.0)]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("orders", "events", "customer", "part"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries_equal_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    rows = sorted((tuple(r[c] for c in names) for r in got.collect()), key=str)
    if name in catalog.ORACLE_SQL:
        want = duck.sql(catalog.ORACLE_SQL[name])
        columns = want.columns
        assert sorted(columns) == names
        assert rows == sorted((tuple(r[columns.index(c)] for c in names) for r in want.fetchall()), key=str)
    else:
        assert rows


def test_positions_match_decoded_values(spark):
    df = catalog.orders(spark, SF)
    pos = encode.rank_encode(df, "o_custkey", "o_orderkey").where(F.col("pos") < 100).agg(F.max("o_custkey")).first()[0]
    assert df.where(F.col("o_custkey") < pos).count() <= 100
