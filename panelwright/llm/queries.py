"""The registered queries of the operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm import align, bpe, decontaminate, jaccard, langid, license_scan, line_dedup, quality, repair, suffix_dedup, token_counts, toxicity, url_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op4_url_rules(spark, sf_dir):
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), url_rules.rules_frame(spark))


SQL["op4_url_rules"] = url_rules.SQL


@query
def op6_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op7_license_scan(spark, sf_dir):
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


@query
def op9_line_dedup(spark, sf_dir):
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


SQL["op9_line_dedup"] = line_dedup.SQL


@query
def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op2_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op10_quality_rules(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"))


@query
def op5_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_jaccard_join(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_suffix_dedup(spark, sf_dir):
    return suffix_dedup.dedup_digests(table(spark, sf_dir, "documents"), passages=True)


@query
def op11_token_alignment(spark, sf_dir):
    import public_tokenizers

    return align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op12_token_counts(spark, sf_dir):
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op13_conversation_repair(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    return repair.report(repair.damaged(conversations), conversations)


SQL["op13_conversation_repair"] = repair.SQL
