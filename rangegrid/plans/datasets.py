"""Batches over data sets: encode binary column files, then answer query files over them, with timings.

    python -m rangegrid.plans.datasets encode --input raw/a.dat raw/b.dat --output encoded --columns 3
    python -m rangegrid.plans.datasets query --input encoded/a encoded/b --queries a.txt b.txt --mode exact
"""

from __future__ import annotations

import argparse
import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from rangegrid.operators import encode, grid, predicates, query
from rangegrid.operators.index import GridIndex
from rangegrid.sources import u32


def encode_dataset(spark: SparkSession, source: str, prefix: str, columns: int = 3) -> None:
    """Write <prefix>-data.bin (positions, in order of row ids) and <prefix>-map.bin (first positions of values) of a raw file."""
    raw = u32.read_columns(spark, source, columns)
    names = {f"p{k}": f"c{k}" for k in range(columns)}
    u32.write_columns(encode.encode_columns(raw, "rid", names), f"{prefix}-data.bin", list(names))
    u32.write_maps([encode.value_map(raw, c) for c in names.values()], f"{prefix}-map.bin")


def load_encoded(spark: SparkSession, prefix: str, columns: int = 3, resolution: int = grid.RESOLUTION) -> GridIndex:
    """The grid index of an encoded data set: positions as stored, value maps beside them."""
    names = "xyz"[:columns]
    rows = u32.read_columns(spark, f"{prefix}-data.bin", columns).withColumnsRenamed({f"c{k}": c for k, c in enumerate(names)})
    maps = u32.read_maps(spark, f"{prefix}-map.bin")
    p = grid.GridParams(rows.count(), resolution)
    return GridIndex(p, grid.with_bin(rows, p), columns, [maps.where(f"col = {k}").select("v", "pos") for k in range(columns)])


def run_query_file(spark: SparkSession, index: GridIndex, path: str, mode: str = "exact") -> DataFrame:
    """(qid, rid) of all queries of a file."""
    return query.text_batch(index, predicates.read_query_file(spark, path), mode)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("what", choices=["encode", "query"])
    parser.add_argument("--input", nargs="+", required=True)
    parser.add_argument("--output", default=".")
    parser.add_argument("--queries", nargs="*", default=[])
    parser.add_argument("--columns", type=int, default=3)
    parser.add_argument("--mode", choices=["exact", "compat"], default="exact")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.what == "encode":
        for source in args.input:
            began = time.perf_counter()
            prefix = f"{args.output.rstrip('/')}/{os.path.splitext(os.path.basename(source))[0]}"
            encode_dataset(spark, source, prefix, args.columns)
            print(json.dumps({"dataset": source, "encoded": prefix, "seconds": round(time.perf_counter() - began, 3)}))
        return
    for prefix, path in zip(args.input, args.queries, strict=True):
        index = load_encoded(spark, prefix, args.columns)
        began = time.perf_counter()
        counts = {r.qid: r["count"] for r in run_query_file(spark, index, path, args.mode).groupBy("qid").count().collect()}
        took = time.perf_counter() - began
        print(json.dumps({"dataset": prefix, "rows": index.params.n, "matches": counts, "seconds": round(took, 3)}))


if __name__ == "__main__":
    main()
