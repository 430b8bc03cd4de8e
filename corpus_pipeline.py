"""The corpus pipeline: language ID, line dedup, near-duplicate removal, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmill.llm.jaccard_join import keep_one
from vecmill.llm.langid import accepted_documents
from vecmill.llm.line_dedup import drop_boilerplate
from vecmill.llm.packing import pack_documents
from vecmill.llm.queries import LINE_PAGES, LINE_RATIO, byte_vocabulary
from vecmill.llm.storage import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified go on; those it rejects go."""
    return accepted_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines leave the texts; n_chars follows.  Exact copies are one page, as the next stage is to find them whole."""
    kept = drop_boilerplate(docs, ratio=LINE_RATIO, min_pages=LINE_PAGES, copies_once=True, counts=False)
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five words, Jaccard 0.8."""
    return keep_one(docs, width=5, num=4, den=5).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens."""
    return pack_documents(docs, byte_vocabulary(), window=2048)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", packing)]

#: Tokenization, language models and components of links are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each over what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
