"""From raw documents to packed training sequences: four stages over the table ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askalot.llm.common import shared_path, table
from askalot.llm.line_dedup import drop_boilerplate_lines
from askalot.llm.ngram_join import near_duplicates
from askalot.llm.packing import pack_documents
from askalot.llm.toxicity import drop_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on those of ``docs`` that have labels, doesn't reject."""
    return drop_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand on many sources, but for the first document that shows each; n_chars follows the text."""
    cleaned = drop_boilerplate_lines(docs, keep_first=True)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id. Documents without an id all stay."""
    groups = near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(groups, docs["doc_id"] == groups["__gone"], "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenised and packed into sequences of 2048 tokens."""
    import public_tokenizers as public

    return pack_documents(docs, public.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("packing", packing)]

#: SQL can't express a fitted classifier or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
