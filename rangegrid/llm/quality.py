"""Quality rules: a table of thresholds, compiled into one projection of native expressions.

Defined results: a null or empty text counts as a text without words and fails the least number of words; ties and
repeated rows are judged row by row; an empty table gives an empty table; columns of the input named as an added one are
replaced, all others stay; a text of any length is judged whole within its row, whose words, their hashes and places are
arrays in memory, some 100 bytes a word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangegrid.functions.names import fresh
from rangegrid.llm.common import WORD, columns_clear

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and that with to in is for on as was by be "
    "le la les de des et un une que en dans pas "
    "der die das und zu den von mit ist "
    "el los las y por con del una"
).split()

#: The characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """Keeps a text if least <= 100 * part / whole <= most; judged only from ``from_words`` words on. None: no bound."""

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None
    from_words: int = 0


#: The threshold table. "one" is the constant 1, so that a count can be bounded too (times 100).
RULES = (
    Rule("enough_words", "n_words", "one", least=1000),
    Rule("repeated_windows", "n_repeat_words", "n_words", most=20),
    Rule("word_length", "word_chars", "n_words", least=150, most=2500),
    Rule("symbols", "n_symbols", "n_words", most=20),
    Rule("repeated_lines", "n_dup_lines", "n_lines", most=50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", most=90, from_words=50),
    Rule("cut_lines", "n_cut_lines", "n_lines", most=60, from_words=50),
    Rule("stop_words", "n_stop_words", "n_words", least=1, from_words=100),
)
#: The rules that the base verdict is made of.
BASE_RULES = ("enough_words", "repeated_windows")

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bullet_lines", "n_cut_lines", "n_stop_words")


def _long(c: Column) -> Column:
    return c.cast("long")


def metrics(df: DataFrame, text: str = "text", window: int = 5) -> DataFrame:
    """df with one long column for each of METRICS.

    Repeated windows are found by 64-bit hashes of ``window`` successive words, compared within a text only: hashes
    are sorted with their places, equal neighbours mark places, and a fold over these counts the words they cover.
    """
    df, kept = columns_clear(df, *METRICS), [c for c in df.columns if c.lower() not in METRICS]
    t, w, lines, n, h, win, s, at = fresh(df, "t", "w", "lines", "n", "h", "win", "s", "at")
    step = df.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    step = step.withColumns({w: F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lines: F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))})
    step = step.withColumns({n: F.size(w), h: F.transform(w, lambda x: F.xxhash64(x))})
    hashed = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(F.col(h), i + k) for k in range(1, window)]))
    step = step.withColumn(win, F.when(F.col(n) >= window, F.slice(hashed, F.lit(1), F.col(n) - (window - 1))).otherwise(F.array().cast("array<bigint>")))
    pairs = F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    step = step.withColumn(s, F.when(F.size(F.array_distinct(win)) < F.size(win), pairs))
    twin = lambda x, i: (F.coalesce(F.get(F.col(s), i - 1)["h"] == x["h"], F.lit(False)) & (i > 0)) | F.coalesce(F.get(F.col(s), i + 1)["h"] == x["h"], F.lit(False))
    step = step.withColumn(at, F.when(F.col(s).isNotNull(), F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))))
    covered = F.aggregate(
        at,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(window), x - a["last"])).alias("n"), x.alias("last")),
        lambda a: a["n"],
    )
    low = [x.lower() for x in STOP_WORDS]
    return step.select(
        *[F.col(f"`{c}`") for c in kept],
        _long(F.col(n)).alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
        _long(F.char_length(t) - F.char_length(F.regexp_replace(t, SYMBOLS, ""))).alias("n_symbols"),
        _long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        _long(F.size(lines)).alias("n_lines"),
        _long(F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\t]*[-*•]")))).alias("n_bullet_lines"),
        _long(F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\t\r]*$")))).alias("n_cut_lines"),
        _long(F.size(F.filter(w, lambda x: F.lower(x).isin(low)))).alias("n_stop_words"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The rules as one boolean expression over METRICS."""
    keep = F.lit(True)
    for r in rules:
        part, whole = F.col(r.part) * 100, F.lit(1) if r.whole == "one" else F.col(r.whole)
        ok = F.lit(True)
        if r.least is not None:
            ok = ok & (part >= whole * r.least)
        if r.most is not None:
            ok = ok & (part <= whole * r.most)
        keep = keep & ((F.col("n_words") < r.from_words) | ok if r.from_words else ok)
    return keep


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with METRICS, ``base_failed`` (any of BASE_RULES broken) and ``kept`` (no rule broken)."""
    df = columns_clear(df, "base_failed", "kept")
    base, (ok, place) = tuple(r for r in RULES if r.name in BASE_RULES), fresh(df, "ok", "place")
    judged = metrics(df, text).withColumns({"base_failed": ~verdict(base), ok: verdict(base) & verdict(rules), place: F.monotonically_increasing_id()})
    # the place is never negative, but no optimizer knows: a filter on the verdict stays above the projection, where the
    # metrics are computed once, instead of repeating their expressions in itself
    return judged.withColumn("kept", F.col(ok) & (F.col(place) >= 0)).drop(ok, place)


def keep(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of df that the rules keep, with df's own columns."""
    # added columns get names of their own, so that clashing input columns survive
    names = df.columns
    coded = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(text).alias("_text"))
    return judge(coded, "_text", rules).where("kept").select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL of ``query``; windows are compared as texts there."""
    test = []
    for r in rules:
        whole, ok = "1" if r.whole == "one" else r.whole, []
        if r.least is not None:
            ok.append(f"100 * {r.part} >= {r.least} * {whole}")
        if r.most is not None:
            ok.append(f"100 * {r.part} <= {r.most} * {whole}")
        test.append(f"(n_words < {r.from_words} or ({' and '.join(ok)}))")
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    word = r"[^\x20\x09-\x0D]"
    return f"""
with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '{word}+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) as ln from t),
p as (select rid, i, array_to_string(w[i:i+4], ' ') as g from (select rid, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5)),
f as (select rid, i, lag(i) over (partition by rid order by i) as before from (select rid, i, count(*) over (partition by rid, g) as n from p) where n > 1),
r as (select rid, cast(sum(least(5, i - coalesce(before, i - 5))) as bigint) as n from f group by rid),
m as (select doc_id, cast(len(w) as bigint) as n_words,
  cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
  cast(length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) as bigint) as n_symbols,
  cast(len(ln) - len(list_distinct(ln)) as bigint) as n_dup_lines,
  coalesce(r.n, 0) as n_repeat_words, cast(len(ln) as bigint) as n_lines,
  cast(len(list_filter(ln, lambda x: regexp_matches(x, '^[\\x20\\t]*[-*•]'))) as bigint) as n_bullet_lines,
  cast(len(list_filter(ln, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\t\\r]*$'))) as bigint) as n_cut_lines,
  cast(len(list_filter(w, lambda x: lower(x) in ({stop}))) as bigint) as n_stop_words
  from w left join r using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and {' and '.join(test)} as kept
from m"""
