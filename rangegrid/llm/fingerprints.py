"""Document fingerprints from closed syncmers, matched by position; native expressions only.

Every text is seen as its windows of K characters (code points). Of these, those count whose least inner string of S
characters (by hash) is the first or the last one: a choice that looks at nothing outside the window, so that an edit
leaves all anchors that it doesn't touch as they are, with or without spaces in the text. The fingerprint holds all
these windows, each with its place, whatever the length of the text: about one in eight characters begins one.

Likeness matches by position: an anchor counts as found in another text only where the same anchor is followed by the
same next anchor at the same distance. It is the Jaccard index of the sets of such links, 1 for equal texts.

Defined results: a null or empty text has the empty fingerprint, which is like itself (1.0) and like no other (0.0); a
text without a closed window (shorter than K, for one) is marked by its own hash at place 0; of equal least strings any
counts, so that a run of one character is an anchor at each place; repeated rows have equal fingerprints; documents with
equal ids follow each other by text; a null id comes first; ids may be of any type that can be ordered; a table of one
document has itself as its next; an empty table gives an empty table; input columns named as an added one are replaced,
all others stay; a long text is read whole, in overlapping blocks within its row, and its anchors (8 bytes each) are one
array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rangegrid.functions.names import constant_array, fresh
from rangegrid.llm.common import columns_clear

#: Characters of a window and of its inner strings: 16 inner strings, whose least one is found by twice four.
K, S = 20, 5
#: An anchor is one number: the place of its window's first character, then 31 bits of hash.
PLACE_SHIFT, HASH_MASK = 32, 0x7FFFFFFF
#: Windows of a text that are looked at together: what a row needs beside its text and its anchors.
BLOCK = 4096
#: Rows of a range of ids; the most ranges; ids sampled to place the borders where ids are no numbers.
ROWS_A_RANGE, MOST_RANGES, SAMPLED_IDS = 2_000, 65_536, 100_000


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: a fold over an array of one element gives it a name."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _anchors(text: Column, at: Column) -> Column:
    """Anchors of one block, which begins at place ``at``."""
    inner = K - S  # the last inner string of a window begins so many characters after the first

    def of(s: Column, fours: Column) -> Column:
        def anchor(x, i):
            last, four = F.get(s, i + inner), lambda k: F.get(fours, i + k)
            first_is_least = (x == four(0)) & (x <= four(4)) & (x <= four(8)) & (x <= four(inner - 3))
            last_is_least = (last == four(inner - 3)) & (last <= four(8)) & (last <= four(4)) & (last <= four(0))
            own = F.xxhash64(x, *[F.get(s, i + k) for k in range(S, inner + 1, S)]).bitwiseAND(HASH_MASK)
            return F.when((first_is_least | last_is_least) & last.isNotNull(), F.shiftleft(at + i, PLACE_SHIFT).bitwiseOR(own))

        return F.array_compact(F.transform(s, anchor))

    hashed = F.transform(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{S}}}))."), F.lit(1)), lambda x: F.xxhash64(x))
    fours = lambda s: F.transform(s, lambda x, i: F.least(x, *[F.get(s, i + k) for k in (1, 2, 3)]))
    return _let(hashed, lambda s: _let(fours(s), lambda m: of(s, m)))


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the anchors of ``text`` in column ``out``: all by place, repeated ones included, as an array of bigint."""
    kept, (own,) = [c for c in df.columns if c.lower() != out.lower()], fresh(df, "t")
    # blocks overlap by what a window reaches beyond its first character; a rest shorter than a window begins none
    cut = F.regexp_extract_all(F.col(own), F.lit(rf"(?s)(?=(.{{{K},{BLOCK + K - 1}}})).{{1,{BLOCK}}}"), F.lit(1))
    blocks = F.when(F.char_length(own) < BLOCK + K, F.array(own)).otherwise(cut)
    found = F.flatten(F.transform(blocks, lambda b, j: _anchors(b, j.cast("long") * BLOCK)))
    return df.withColumn(own, F.coalesce(F.col(text), F.lit(""))).select(*[F.col(f"`{c}`") for c in kept], found.alias(out))


def marked(anchors: Column, text: Column) -> Column:
    """The fingerprint of a text with these anchors: a text without any is marked by its own hash."""
    none, alone = F.array().cast("array<bigint>"), F.array(F.xxhash64(text).bitwiseAND(HASH_MASK))
    return F.when(F.coalesce(text, F.lit("")) == "", none).when(F.size(anchors) == 0, alone).otherwise(anchors)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the fingerprint of ``text`` in column ``out``."""
    (found,) = fresh(df, "a")
    step = with_anchors(df, text, found)
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower()]
    return step.select(*kept, marked(F.col(found), F.col(text)).alias(out))


def with_spliced(df: DataFrame, joined: str, a: str, n_a: str, b: str, n_b: str, out: str) -> DataFrame:
    """df with the anchors of ``joined``, which is the first n_a characters of one text and the first n_b of another.

    a and b are the anchors of both whole texts. An anchor looks at nothing outside its window, so that only windows
    across the seam are looked at anew.
    """
    seam, begin, fresh_ones = fresh(df, "seam", "begin", "new")
    step = df.withColumn(begin, F.greatest(F.lit(0), F.col(n_a) - (K - 1)).cast("int"))
    step = step.withColumn(seam, F.substring(F.col(joined), F.col(begin) + 1, (F.col(n_a) - F.col(begin) + F.least(F.lit(K - 1), F.col(n_b))).cast("int")))
    step = with_anchors(step, seam, fresh_ones)
    place = lambda x: F.shiftright(x, PLACE_SHIFT)
    moved = lambda found, by: F.transform(found, lambda x: x + F.shiftleft(F.col(by).cast("long"), PLACE_SHIFT))
    parts = [F.filter(a, lambda x: place(x) <= F.col(n_a) - K), moved(F.col(fresh_ones), begin), moved(F.filter(b, lambda x: place(x) <= F.col(n_b) - K), n_a)]
    return step.withColumn(out, F.flatten(F.array(*parts))).drop(seam, begin, fresh_ones)


def hashes(a: Column) -> Column:
    return F.transform(a, lambda x: x.bitwiseAND(HASH_MASK))


def places(a: Column) -> Column:
    return F.transform(a, lambda x: F.shiftright(x, PLACE_SHIFT).cast("int"))


def links(a: Column) -> Column:
    """The distinct links of a fingerprint: for each anchor a hash of its own hash, that of the next anchor and the distance to it; the last stands alone."""

    def link(x, i):
        after = F.get(a, i + 1)
        return F.xxhash64(x.bitwiseAND(HASH_MASK), after.bitwiseAND(HASH_MASK), F.shiftright(after, PLACE_SHIFT) - F.shiftright(x, PLACE_SHIFT))

    return F.array_distinct(F.transform(a, link))


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard index of two fingerprints' ``links``."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / every)


def as_text(a: Column) -> Column:
    """Hexadecimal numbers, comma-joined, an anchor each: its hash in the last eight digits, its place before them."""
    return F.array_join(F.transform(a, lambda x: F.hex(x)), ",")


def _borders(df: DataFrame, key: str, ranges: int | None) -> list:
    """Values that part the rows into ranges of about even size, in order; they have no say in results.

    Numbers: quantiles of all rows. Other types: quantiles of a bounded sample of ids.
    """
    n = df.count()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or max(2, min(MOST_RANGES, max(16 * parts, n // ROWS_A_RANGE)))  # many a task, so that tasks are even
    if df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long"):
        got = df.agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)], max(10_000, 4 * ranges))).first()[0] or []
    else:
        share = min(1.0, SAMPLED_IDS / max(1, n))
        ids = sorted(r[0] for r in df.select(key).where(F.col(key).isNotNull()).sample(share, seed=1).limit(2 * SAMPLED_IDS).collect())
        got = [ids[len(ids) * k // ranges] for k in range(1, ranges)] if ids else []
    return sorted(set(got))


def _range(df: DataFrame, key: str, borders: list) -> Column:
    """The number of borders below a row's key: first among every 256th, then among those that follow; 0 for a null key."""
    if not borders:
        return F.lit(0)
    kind, step = df.schema[key].dataType.simpleString(), 256
    array = lambda b: constant_array(b, kind)
    less = lambda b: b < F.col(key)
    coarse = F.size(F.filter(array(borders[step - 1 :: step]), less)) * step if len(borders) > step else F.lit(0)
    fine = F.slice(array(borders), coarse + 1, F.lit(step)) if len(borders) > step else array(borders)
    return F.when(F.col(key).isNull(), F.lit(0)).otherwise(coarse + F.size(F.filter(fine, less)))


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text", ranges: int | None = None, also=None) -> DataFrame:
    """df with next_<text>: the text of the row that follows by key, then text; after the last, that of the first.

    Rows are dealt into ranges of keys, as many as the table asks for. Within a range a window looks one row ahead; the
    first row of each range serves the last row of the range before. ``also(df, text, out)``, if given, derives a column
    of each row from its text (a fingerprint, say) once it is dealt; next_<out> is then that of the row that follows,
    looked up by the same window, so that it is computed once a row and never shuffled. Result: next_text, out, next_out.
    """
    df = columns_clear(df, f"next_{text}", "out", "next_out") if also else columns_clear(df, f"next_{text}")
    at, more, of, head, after = fresh(df, "range", "more", "of", "head", "after")
    df = df.withColumn(at, _range(df, key, _borders(df, key, ranges)))
    # a row a range: its first row, and that of the next range that has rows
    heads = df.groupBy(at).agg(F.min(F.struct(F.col(key), F.col(text))).alias(head))
    every = W.orderBy(at).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    heads = heads.select(F.col(at).alias(of), F.coalesce(F.lead(head).over(W.orderBy(at)), F.first(head).over(every))[text].alias(after))
    own = W.partitionBy(at).orderBy(F.col(key).asc_nulls_first(), F.col(text).asc_nulls_first())
    ahead = df.withColumns({f"next_{text}": F.lead(text).over(own), more: F.lead(F.lit(True)).over(own)})
    if also:
        ahead = also(ahead, text, "out").withColumn("next_out", F.lead("out").over(own))
        heads = also(heads, after, "out").withColumnRenamed("out", head)
    joined = ahead.join(heads, F.col(at) == F.col(of), "left")
    picked = {f"next_{text}": F.when(F.col(more), F.col(f"next_{text}")).otherwise(F.col(after))}
    if also:
        picked["next_out"] = F.when(F.col(more), F.col("next_out")).otherwise(F.col(head))
    return joined.withColumns(picked).drop(at, more, of, after, head)


def _anchors_and_links(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with column ``out``: (a: anchors, l: links of the fingerprint) of ``text``."""
    found, fp, l_ = fresh(df, "a", "f", "l")
    step = with_anchors(df, text, found)
    step = step.withColumn(fp, marked(F.col(found), F.col(text)))
    step = step.withColumn(l_, links(F.col(fp)))
    return step.withColumn(out, F.struct(F.col(found).alias("a"), F.col(l_).alias("l"))).drop(found, fp, l_)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # only texts are shuffled; a text's anchors and links are found once, after it
    docs = with_next(docs, also=_anchors_and_links)
    docs = docs.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("q", F.floor(F.col("n_chars") / 4).cast("int"))
    docs = docs.withColumns({"n_a": F.col("n_chars").cast("int") - F.col("q"), "n_b": F.least(F.col("q"), F.char_length("next_text"))})
    docs = docs.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_a")), F.substring(F.col("next_text"), F.lit(1), F.col("n_b"))))
    docs = docs.withColumns({"a": F.col("out.a"), "next_a": F.col("next_out.a")})
    docs = with_spliced(docs, "edited", "a", "n_a", "next_a", "n_b", "edited_a")
    docs = docs.withColumns({"fp": marked(F.col("a"), F.col("text")), "edited_fp": marked(F.col("edited_a"), F.col("edited"))})
    docs = docs.withColumn("edited_l", links(F.col("edited_fp")))
    return docs.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("out.l"), F.col("edited_l")).alias("near_edited"),
        likeness(F.col("out.l"), F.col("next_out.l")).alias("near_next"),
    )
