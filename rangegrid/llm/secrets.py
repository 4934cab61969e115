"""Secret scans: three fixed patterns, and sliding-window entropy over candidate strings; native expressions only.

Places are code points, ends exclusive. Defined results: a null or empty text has no span; every row is scanned by
itself, so ties, repeated rows and empty tables need nothing; columns of the input named as an added one are replaced, all
others stay; texts are scanned whole, whatever their length, within their row.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangegrid.functions.names import fresh
from rangegrid.llm.common import columns_clear

#: Kind -> (pattern, group that must be long enough, its least length). A run that is too short as a whole has no
#: longer part, so that the lengths of access and hex stand in their patterns; one of assign that fails still takes its text.
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 4, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 2, 18),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{16,}", 2, 16),
}
#: Candidates for entropy, the characters they are made of, and the window.
CANDIDATE, ALPHABET, WINDOW = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 20
#: Character class -> (pattern of the candidate, least entropy of a window in bits), first match counts; the last takes all
#: the others. Of random strings of 20 characters, 1 % or less of each class stay below the bound.
CLASSES = {
    "hex": (r"^(?=.*[0-9])[0-9a-fA-F]+$", 2.85),
    "alnum": (r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9]+$", 3.35),
    "base64": (r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/_=-]+$", 3.6),
    "other": (r"^[A-Za-z0-9+/_=-]+$", 3.35),
}
#: Candidates that are one of these as a whole are no secrets: words and short or filler numbers between separators (in a word,
#: capitals stand before two small letters or more, or before none, save in some words of two letters), digits, UUIDs, digests named as such.
ALLOW = (
    r"^(?!.*(?:[A-Za-z][0-9]|[0-9][A-Za-z]|(?!(?:As|At|By|Db|Do|Go|Id|If|In|Io|Ip|Is|It|My|No|Of|On|Or|To|Ui|Up)(?![a-z]))[A-Z][a-z](?![a-z])|(?<![0-9])(?!0+(?![0-9])|12345(?:6(?:7(?:8(?:90?)?)?)?)?(?![0-9]))[0-9]{5}))",
    r"^[0-9]+$",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)^sha(1-([0-9a-f]{40}|[a-z0-9+/_-]{27}=?)|256-([0-9a-f]{64}|[a-z0-9+/_-]{43}=?)|384-([0-9a-f]{96}|[a-z0-9+/_-]{64})|512-([0-9a-f]{128}|[a-z0-9+/_-]{86}={0,2}))$",
)
MASK = "[SECRET]"
#: Matches of a text that are gathered at a time.
SPANS_A_PART = 256


def _spans(text: Column, kind: str, order: int, pattern: str, group: int, least: int, with_text: bool = False) -> Column:
    r"""Leftmost non-overlapping matches as an array of (start, ord, stop, kind[, value]).

    \G ties a match to the end of the one before, so that the lazy group in front holds what lies between them; lengths
    of gaps and matches add up to places. A text without any match is passed by after one plain search.
    """
    whole = rf"\G(?s:(.*?))({pattern})"
    gaps, hits = (F.regexp_extract_all(text, F.lit(whole), F.lit(g)) for g in (1, 2))
    values = hits if group == 2 else F.regexp_extract_all(text, F.lit(whole), F.lit(group))
    rows = F.arrays_zip(F.transform(gaps, lambda x: F.char_length(x)).alias("gap"), F.transform(hits, lambda x: F.char_length(x)).alias("len"), values.alias("value"))
    kept = [("start", "int"), ("ord", "int"), ("stop", "int"), ("kind", "string")] + [("value", "string")] * with_text
    kind_of = "struct<" + ",".join(f"{a}:{b}" for a, b in kept) + ">"

    def add(acc, x):
        start = acc["at"] + x["gap"]
        own = [start.alias("start"), F.lit(order).alias("ord"), (start + x["len"]).alias("stop"), F.lit(kind).alias("kind")] + [x["value"].alias("value")] * with_text
        longer = F.concat(acc["out"], F.array(F.struct(*own)).cast(f"array<{kind_of}>"))
        return F.struct((start + x["len"]).alias("at"), F.when(F.char_length(x["value"]) >= least, longer).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(f"array<{kind_of}>")
    named = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731  a fold over one element computes it once

    def part(matches):
        def next_part(acc, k):
            own = F.aggregate(F.slice(matches, k * SPANS_A_PART + 1, F.lit(SPANS_A_PART)), F.struct(acc["at"].alias("at"), none.alias("out")), add)
            return named(own, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

        last = F.floor((F.size(matches) - 1) / SPANS_A_PART).cast("int")
        return F.aggregate(F.sequence(F.lit(0), F.greatest(F.lit(0), last)), F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind_of}>>").alias("out")), next_part, lambda acc: F.flatten(acc["out"]))

    # an array grows by copying, so that spans are gathered in parts
    return F.when(text.rlike(pattern), named(rows, part)).otherwise(none)


def entropy(value: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of a window of ``value``: counts change by one character in and one out."""
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    code = lambda i: F.instr(F.lit(ALPHABET), F.substring(value, i, F.lit(1)))

    def bump(state, at, by):
        c = F.get(state["n"], at)
        n = F.transform(state["n"], lambda v, i: F.when(i == at, v + by).otherwise(v))
        return n, state["s"] + F.get(terms, c + by) - F.get(terms, c)

    def step(state, i):
        n, s = bump(state, code(i), 1)
        entered = F.struct(n.alias("n"), s.alias("s"), state["best"].alias("best"))

        def leave(st):
            n2, s2 = bump(st, code(i - window), -1)
            return F.struct(n2.alias("n"), s2.alias("s"), st["best"].alias("best"))

        # a one-element fold names the state after entering, so that it is computed once
        left = F.when(i > window, F.element_at(F.transform(F.array(entered), leave), 1)).otherwise(entered)
        bits = lambda st: F.lit(math.log2(window)) - st["s"] / window
        return F.element_at(
            F.transform(F.array(left), lambda st: F.struct(st["n"].alias("n"), st["s"].alias("s"), F.when(i >= window, F.greatest(st["best"], bits(st))).otherwise(st["best"]).alias("best"))),
            1,
        )

    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best"))
    return F.aggregate(F.sequence(F.lit(1), F.char_length(value)), start, step, lambda st: st["best"])


def _suspicious(value: Column) -> Column:
    bits = F.lit(None).cast("double")
    for pattern, least in reversed(CLASSES.values()):
        bits = F.when(value.rlike(pattern), F.lit(least)).otherwise(bits)
    allowed = reduce(lambda a, b: a | b, [value.rlike(p) for p in ALLOW])
    return F.when(bits.isNull() | allowed, F.lit(False)).otherwise(entropy(value) >= bits)


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """df with ``base_spans`` and ``spans``: arrays of (start, ord, stop, kind), by start, then kind as listed.

    A candidate whose entropy is high enough is a span of kind entropy unless a base span overlaps it.
    """
    df = columns_clear(df, "base_spans", "spans")
    t, found, more = fresh(df, "t", "found", "more")
    parts = [_spans(F.col(t), kind, k, *spec) for k, (kind, spec) in enumerate(BASE.items())]
    step = df.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    step = step.withColumns({"base_spans": F.sort_array(F.concat(*parts)), found: _spans(F.col(t), "entropy", len(BASE), CANDIDATE, 2, 20, with_text=True)})
    free = lambda x: ~F.exists("base_spans", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"]))
    fresh_ones = F.transform(F.filter(F.filter(found, free), lambda x: _suspicious(x["value"])), lambda x: F.struct(x["start"].alias("start"), x["ord"].alias("ord"), x["stop"].alias("stop"), x["kind"].alias("kind")))
    return step.withColumn(more, fresh_ones).withColumn("spans", F.sort_array(F.concat("base_spans", more))).drop(t, found, more)


def redact(df: DataFrame, text: str = "text", mask: str = MASK) -> DataFrame:
    """df with every span of ``text`` replaced by ``mask``; overlapping spans are replaced together; nulls stay null."""
    names = df.columns
    coded = scan(df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(text).alias("_text")), "_text")

    def splice(acc, x):
        gap = F.substring(F.col("_text"), acc["at"] + 1, F.greatest(F.lit(0), x["start"] - acc["at"]))
        fresh = x["start"] >= acc["at"]
        return F.struct(F.when(fresh, F.concat(acc["parts"], F.array(gap, F.lit(mask)))).otherwise(acc["parts"]).alias("parts"), F.greatest(acc["at"], x["stop"]).alias("at"))

    tail = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(F.col("_text"), acc["at"] + 1, F.char_length("_text")))
    clean = F.aggregate("spans", F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at")), splice, tail)
    done = coded.withColumn("_clean", F.when(F.size("spans") > 0, clean).otherwise(F.col("_text")))
    return done.select(*[F.col("_clean").alias(c) if c == text else F.col("_row")[c].alias(c) for c in names])


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    got = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return got.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
