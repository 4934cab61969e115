"""A corpus pipeline: quality rules, near-duplicate join, secret redaction, source mixing, best-fit packing.

Every stage takes (spark, docs, sf_dir) and all rows that its predecessor kept. ``run`` writes each stage's rows to the
shared folder and reads them back, so that a lost executor costs tasks of one stage only. Nulls, empty and very long
texts, ties and repeated rows are treated as the operators' docstrings say; an empty table passes as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangegrid.llm import mixing, near, packing, quality, secrets
from rangegrid.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule go."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word Jaccard 0.8 or more connect, the one with the least id stays."""
    return near.keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; the documents stay. n_chars follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate asks for."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 2048 tokens."""
    # workers of the stages before are still there: small pieces of text and few words keep an executor within its memory
    return packing.pack_documents(docs, with_ids=True, at_once=1 << 20, cache_bytes=16 << 20)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Near-duplicate components and tokens are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return docs
