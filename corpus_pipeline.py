"""The corpus pipeline: stages over ``documents``, each stored as Parquet before the next reads it.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of ``docs``, whatever they are. Defined cases: null or empty texts, long texts, repeated rows and extra columns pass
through every stage; rows that repeat an id go or stay together where a stage decides by id; a row without an id is
judged by its text alone and takes no part in near-duplicate groups; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_dedup, lsh_forest, packing, quality_gam
from tidemark.llm.common import stored, table
from tidemark.llm.queries import tokenizer_path


def unused(name: str, frame: DataFrame) -> str:
    """``name``, or with underscores if a column of the frame has it."""
    while name in frame.columns:
        name += "_"
    return name


def with_n_chars(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def without(docs: DataFrame, judged: DataFrame, gone: str) -> DataFrame:
    """The documents but those of whose rows all are marked ``gone``. Rows without an id stay."""
    ids = judged.filter("doc_id is not null").groupBy("doc_id").agg(F.min(gone).alias("gone")).filter("gone").select("doc_id")
    return docs.join(ids, "doc_id", "left_anti").select(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model scores at its threshold or above."""
    model = quality_gam.learn(docs, table(spark, sf_dir, "labels"))
    name = unused("score", docs)
    return quality_gam.score(docs, model, score_col=name).filter(F.col(name) >= quality_gam.THRESHOLD).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that documents share; ``n_chars`` follows."""
    counts = (unused("n_lines", docs), unused("n_dropped", docs))
    return with_n_chars(line_dedup.drop_shared_lines(docs, counts=counts).select(*docs.columns))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the least id."""
    return without(docs, lsh_forest.near_duplicates(docs).select("doc_id", (~F.col("kept")).alias("gone")), "gone")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no passage of a test item occurs."""
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.select("doc_id", (F.col("n_hit") > 0).alias("gone")), "gone")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest as sequences of 4096 tokens, one row per piece."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality", keep_quality), ("line_dedup", drop_lines), ("near_duplicates", one_of_each), ("decontaminate", drop_contaminated), ("packing", pack)]
#: Tokenization and a trained model cannot be written in SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
