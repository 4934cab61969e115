"""Headline timings: one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the threads, BENCH_ROWS the rows of a generated workload.

Builds and queries are reported apart. The five workloads are the survey's distributions (normal, three heavy tails, uniform),
each indexed once, written, loaded and asked by query texts; candidate rows and files say how much a query reads.
"""

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from rangegrid.functions import datagen  # noqa: E402
from rangegrid.operators import predicates, query, validate  # noqa: E402
from rangegrid.operators.index import GridIndex  # noqa: E402
from rangegrid.plans import catalog  # noqa: E402

WORKLOADS = {
    "normal": lambda spark, n: datagen.normal(spark, n),
    "zipf1.5": lambda spark, n: datagen.zipf(spark, n, 1.5),
    "zipf1.3": lambda spark, n: datagen.zipf(spark, n, 1.3),
    "zipf1.1": lambda spark, n: datagen.zipf(spark, n, 1.1),
    "uniform": lambda spark, n: datagen.uniform(spark, n),
}


def built(df: DataFrame, rid: str, columns: list[str], path: str) -> tuple[GridIndex, float]:
    began = time.perf_counter()
    GridIndex.build(df, rid, columns).write(path)
    return GridIndex.load(df.sparkSession, path), time.perf_counter() - began


def files_read(df: DataFrame) -> int:
    """Files that a scan of these rows opens."""
    return df.select(F.input_file_name().alias("f")).distinct().count()


def workload(spark: SparkSession, name: str, n: int, work: str) -> dict:
    """One le query over three columns that keeps about an eighth of each of the first two, by index and by plain filter."""
    raw = WORKLOADS[name](spark, n)
    raw.write.parquet(f"{work}/{name}-raw")
    raw = spark.read.parquet(f"{work}/{name}-raw")
    index, build = built(raw, "rid", ["c0", "c1", "c2"], f"{work}/{name}")
    cuts = [int(x) for x in raw.select(*[F.percentile_approx(c, 0.125, 1000) for c in ("c0", "c1")], F.percentile_approx("c2", 0.5, 1000)).first()]
    lines = spark.createDataFrame([(k, f"le {c}") for k, c in enumerate(cuts)], "line bigint, text string")
    b = predicates.assemble(predicates.parse_query_text(lines), index.maps, index.params.n).first()
    ranges = {c: (b[f"{c}lo"], b[f"{c}hi"]) for c in "xyz"}
    plain = raw.where(" and ".join(f"c{k} <= {c}" for k, c in enumerate(cuts))).select("rid")
    near = query.candidates(index, **ranges)
    out = {
        "build": build,
        "index_query": validate.seconds(query.range_query(index, **ranges), 3),
        "plain_filter": validate.seconds(plain, 3),
        "text_to_rows": validate.seconds(query.text_batch(index, lines), 2),
        "matches": plain.count(), "candidate_rows": near.count(), "files_read": files_read(near), "files": files_read(index.rows),
    }
    assert validate.mismatches(query.range_query(index, **ranges), plain).first().mismatches == 0
    return {k: round(v, 4) for k, v in out.items()}


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    rows = int(os.environ.get("BENCH_ROWS", "10000000"))
    work = tempfile.mkdtemp(prefix="rangegrid-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(4 * int(cpus)))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{work}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took, builds = {}, {}
    df = catalog.orders(spark, sf)
    ranges = catalog._lt(df, catalog.COLUMNS)
    for name in ("orders_cold", "orders"):  # the first build compiles code
        index, builds[name] = built(df, catalog.RID, catalog.COLUMNS, f"{work}/{name}")
    halves = catalog._halves(df)
    plain = df.where((F.col("o_custkey") < halves["o_custkey"]) & (F.col("o_totalprice") < halves["o_totalprice"]) & (F.col("o_orderdate") < F.lit(halves["o_orderdate"]))).select(F.col(catalog.RID).alias("rid"))
    took["range_3col_index"] = validate.seconds(query.range_query(index, **ranges))
    took["range_3col_plain_filter"] = validate.seconds(plain)
    narrow = {c: (0, index.params.n // 50) for c in "xyz"}
    took["range_narrow_index"] = validate.seconds(query.range_query(index, **narrow))
    took["query_batch"] = validate.seconds(query.batch(index, spark.createDataFrame(catalog._BATCH, "qid int, xlo bigint, xhi bigint, ylo bigint, yhi bigint, zlo bigint, zhi bigint")), 3)
    took["query_text_batch"] = validate.seconds(catalog.QUERIES["query_text_batch"](spark, sf), 3)
    for name in ("enc_rank_distributed", "grid_histogram", "cell_sum"):
        took[name] = validate.seconds(catalog.QUERIES[name](spark, sf), 3)
    generated = {name: workload(spark, name, rows if name == "uniform" else rows // 5, work) for name in WORKLOADS}
    out = {
        "metric": "mean_query_seconds", "value": round(sum(took.values()) / len(took), 4), "unit": "sec",
        "queries": {k: round(v, 4) for k, v in took.items()}, "builds": {k: round(v, 4) for k, v in builds.items()}, "sf": sf.rsplit("sf", 1)[-1], "cpus": int(cpus), "rows": index.params.n,
        "matches": plain.count(), "plain_equals_index": validate.mismatches(query.range_query(index, **ranges), plain).first().mismatches == 0, "generated_rows": rows, "workloads": generated,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
