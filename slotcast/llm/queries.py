"""Registered queries of the operators, one each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slotcast.llm import bpe, decontam, html_blocks, imatch, jaccard, ordinal, prefix_trie, records, secrets, sharding, spelling, substrings, wacz


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SHARDS = 40


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.fixed_number(table(spark, sf_dir, "documents"), SHARDS)


def op2_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_blocks.extract(pages, html_blocks.fit(pages))


def op4_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wacz.round_trip(table(spark, sf_dir, "pages"))


def vocabulary() -> str:
    """Path of the public vocabulary file, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.neighbours(table(spark, sf_dir, "documents"))


def op7_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_contained_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op10_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ordinal.rate(docs, ordinal.fit(docs, table(spark, sf_dir, "labels")))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.replayed_trie(table(spark, sf_dir, "conversations"))


def word_vocabulary() -> str:
    """Path of the public word vocabulary, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op12_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.round_trip(table(spark, sf_dir, "documents"), word_vocabulary(), end_id=1)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"), slips=True)


QUERIES = {
    "op1_shards": op1_shards,
    "op2_components": op2_components,
    "op3_main_text": op3_main_text,
    "op4_warc_records": op4_warc_records,
    "op5_bpe_digests": op5_bpe_digests,
    "op6_fingerprints": op6_fingerprints,
    "op7_secret_spans": op7_secret_spans,
    "op8_contained_items": op8_contained_items,
    "op9_repeated_words": op9_repeated_words,
    "op10_quality_grades": op10_quality_grades,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_token_records": op12_token_records,
    "op13_spelling_variants": op13_spelling_variants,
}

SQL = {
    "op2_components": jaccard.ORACLE,
    "op7_secret_spans": secrets.ORACLE,
    "op8_contained_items": decontam.ORACLE,
    "op11_conversation_trie": prefix_trie.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
