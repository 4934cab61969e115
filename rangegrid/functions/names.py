"""Column names that don't clash, and constant arrays."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, for columns that an operator drops again."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        n = f"_{n}"
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def constant_array(values: list, kind: str) -> Column:
    """An array literal of values of one Spark type; a long one is read from text once, when the plan is optimized."""
    plain = all(isinstance(v, int | str) for v in values)
    if len(values) <= 64 or not plain:
        if all(isinstance(v, float | datetime.date) for v in values) and len(values) > 64:
            return F.split(F.lit("\n".join(repr(v) if isinstance(v, float) else str(v) for v in values)), "\n").cast(f"array<{kind}>")
        return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")
    if all(isinstance(v, int) for v in values):
        return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")
