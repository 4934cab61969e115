import re

from pyspark.sql import Row

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


def words(text):
    return WORDS.findall(text or "")


def odd_documents(spark):
    """Nulls, empty, blank and long texts, repeated rows, shared ids, clashing and extra columns."""
    prose = "the quick brown fox jumps over the lazy dog and runs to the river with all of its friends "
    rows = [
        (0, None, "a", 1), (1, "", "a", 1), (2, " \t\n", None, 1), (3, prose * 3, None, 1), (3, prose * 3, None, 1), (4, prose * 900, "b", 1),
        (5, prose.upper() + "password = 'abcDEF123456xyz' tail é…", "b", 2), (6, "x", "c", 3), (6, "other text with one shared id", "c", 3), (None, "no id here at all", "c", None), (7, "ab" * 3000, "c", 1),
    ]
    schema = "doc_id bigint, text string, source string, size bigint"
    out = spark.createDataFrame(rows, schema).selectExpr("doc_id", "text", "source", "size", "size as kept", "'x' as lang", "1L as n_words", "2 as spans", "3 as edited", "1L as n_chars", "5L as copies")
    return out


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def docs_of(spark, sf_dir=SMALL):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def plain(rows):
    return [x.asDict() if isinstance(x, Row) else x for x in rows]
