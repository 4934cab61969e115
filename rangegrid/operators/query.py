"""Range queries over the grid index: candidate bins, refinement, batches, query texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangegrid.operators import predicates
from rangegrid.operators.grid import TILE, GridParams
from rangegrid.operators.index import GridIndex

EVERY = (0, predicates.UNBOUNDED)
#: Queries that are broadcast to the rows of the index; more meet them by tiles of MANY bins a side.
MOST_BROADCAST, MANY = 4096, 32


def _box(p: GridParams, x: tuple[int, int], y: tuple[int, int]) -> tuple[int, int, int, int]:
    at = lambda v: min(max(v - p.lo, 0) // p.width, p.resolution - 1)
    return at(x[0]), at(x[1]), at(y[0]), at(y[1])


def candidate_bins(directory: DataFrame, p: GridParams, x: tuple[int, int], y: tuple[int, int] = EVERY) -> DataFrame:
    """Entries of the directory whose bin touches the rectangle; empty bins have none."""
    x1, x2, y1, y2 = _box(p, x, y)
    if x[0] > x[1] or y[0] > y[1]:
        return directory.where(F.lit(False))
    r = p.resolution
    return directory.where(F.expr(f"bin % {r}").between(x1, x2) & F.expr(f"bin div {r}").between(y1, y2))


def refine(rows: DataFrame, **ranges: tuple[int, int]) -> DataFrame:
    """Rows within every closed range."""
    test: Column = F.lit(True)
    for c, (lo, hi) in ranges.items():
        test = test & F.col(c).between(lo, hi)
    return rows.where(test)


def two_pass(index: GridIndex, **ranges: tuple[int, int]) -> DataFrame:
    """rid of matching rows: candidate bins first, then a semi-join of the rows with these and the full test."""
    bins = candidate_bins(index.directory, index.params, ranges["x"], ranges.get("y", EVERY)).select("bin")
    return refine(index.rows.join(bins, "bin", "left_semi"), **ranges).select("rid")


def candidates(index: GridIndex, **ranges: tuple[int, int]) -> DataFrame:
    """Rows in the bins that the rectangle touches: what a range query reads. Tiles prune folders, bins prune row groups."""
    if any(lo > hi for lo, hi in ranges.values()):
        return index.rows.where(F.lit(False))
    x1, x2, y1, y2 = _box(index.params, ranges["x"], ranges.get("y", EVERY))
    return index.rows.where(F.col("tx").between(x1 // TILE, x2 // TILE) & F.col("ty").between(y1 // TILE, y2 // TILE) & F.col("bx").between(x1, x2) & F.col("by").between(y1, y2))


def range_query(index: GridIndex, **ranges: tuple[int, int]) -> DataFrame:
    """rid of matching rows in one scan: candidates, of which the ranges themselves decide."""
    return refine(candidates(index, **ranges), **ranges).select("rid")


def batch(index: GridIndex, queries: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(qid, rid) for queries (qid, xlo, xhi, ylo, yhi, zlo, zhi): an equi-join on the tiles each query touches, then the test.

    Up to ``most_broadcast`` queries (56 bytes each, counted first) are broadcast, so that no row of the index moves. More
    meet the rows by finer tiles, whose number follows the grid, not the queries. Inverted ranges match nothing.
    """
    p, own = index.params, "xyz"[: index.n_columns]
    alive = " and ".join(f"{c}lo <= {c}hi" for c in own)
    test = " and ".join(f"{c} between {c}lo and {c}hi" for c in own)
    q = queries.where(alive).select("qid", *[f"{c}{end}" for c in own for end in ("lo", "hi")])
    if "y" not in own:
        q = q.withColumns({"ylo": F.lit(0).cast("long"), "yhi": F.lit(0).cast("long")})
    few = q.limit(most_broadcast + 1).count() <= most_broadcast
    side = TILE if few else MANY
    tile = lambda c: F.floor(p.cell(F.col(c)) / side).cast("int")
    q = q.withColumn("tx", F.explode(F.sequence(tile("xlo"), tile("xhi")))).withColumn("ty", F.explode(F.sequence(tile("ylo"), tile("yhi"))))
    if few:
        return index.rows.join(F.broadcast(q), ["tx", "ty"]).where(test).select("qid", "rid")
    q = q.withColumnsRenamed({"tx": "fx", "ty": "fy"})
    rows = index.rows.withColumns({"fx": F.expr(f"cast(bx div {side} as int)"), "fy": F.expr(f"cast(by div {side} as int)")})
    return rows.join(q, ["fx", "fy"]).where(test).select("qid", "rid")


def text_batch(index: GridIndex, lines: DataFrame, mode: str = "exact") -> DataFrame:
    """(qid, rid) of query texts (line, text): parsed, translated by the index's own value maps, and scanned."""
    if len(index.maps) != index.n_columns:
        raise ValueError("this index has no value maps")
    parsed = predicates.parse_query_text(lines, index.n_columns)
    return batch(index, predicates.assemble(parsed, index.maps, index.params.n, mode))
