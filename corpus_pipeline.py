"""Corpus pipeline: stages over documents, each written as Parquet and reread by the next.

1. quality: documents whose probability of the best grade is under one half go.
2. near_duplicates: of each group of documents linked by 5-word shingles, the smallest doc_id stays.
3. decontaminate: documents that hold three quarters of a benchmark item go.
4. secrets: every secret's span is replaced by a mark, n_chars follows.
5. tokenize: the rest, with token ids and the counts of tokens and characters.

Nulls: a null text is rated like an empty one and never a duplicate, contaminated or changed; it has no
tokens. Repeated rows leave one. An empty table of documents gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotcast.llm import bpe, decontam, jaccard, ordinal, secrets
from slotcast.llm.queries import vocabulary
from slotcast.sources.shared import settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of `docs` that the grade model selects; it is fitted on the labelled ones of its input."""
    model = ordinal.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return ordinal.select_documents(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return jaccard.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least three quarters of a benchmark item's 5-word shingles go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; their secrets do not."""
    return secrets.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token ids."""
    tokens = bpe.tokenize(docs, vocabulary())
    return tokens.select("doc_id", "lang", "source", "n_chars", F.size("token_ids").alias("n_tokens"), "token_ids")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", mask_secrets),
    ("tokenize", tokenize),
]

#: The quality stage is a fitted model, which SQL cannot express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each on what its predecessor wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
