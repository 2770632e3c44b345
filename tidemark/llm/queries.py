"""The named queries of the text operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import conversation_repair, decontaminate, html_template, line_dedup, line_quality, lsh_forest, mixture_packing, packing, pii_boost, quality_gam, secret_crf, url_rules, whitening
from tidemark.llm.common import table

TOKENIZER = "word_bpe_49k.json"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@query
def op1_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.main_texts(table(spark, sf_dir, "pages"))


@query
def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"))


@query
def op3_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.drop_shared_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op5_pii_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_boost.find_personal(table(spark, sf_dir, "documents"))
    counts = [pii_boost.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in pii_boost.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii_boost.joined(F.col("base")), 256).alias("base_sha256"), pii_boost.joined(F.col("spans")).alias("spans"))


@query
def op6_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_crf.find_secrets(table(spark, sf_dir, "documents"))


@query
def op7_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge(table(spark, sf_dir, "documents"))


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, tokenizer_path())


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return decontaminate.find_items(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


@query
def op11_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_packing.pack_mixture(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_report(table(spark, sf_dir, "conversations"))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))  # null where a long cannot hold it
