"""A training corpus from raw documents: language, exact copies, near copies, source mix, packed batches.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents. All but the last return the columns of `documents`. The stages
read only doc_id, text, lang and source; other columns, of whatever names, pass as they are. An empty table gives an
empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanmill.llm import exact, language, mixing, neardup, packing
from spanmill.llm.shared import Staging, free_names, named, released
from spanmill.workers import ship


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those that language identification rejects go.

    Null, empty and letterless texts go; rows alike are judged alike; a text is read whole, however long. Null ids are
    judged but not learnt from. If no row is labelled, every text with a letter stays.
    """
    ship(spark)
    return language.keep_identified(spark, docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that of the largest id, null ids last, of a repeated id the first read.

    Null and empty texts are one group. Texts are compared whole.
    """
    return exact.keep_distinct(spark, docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the least id, null ids last, of a repeated id the first read.

    Texts without words have no near duplicate and stay. Texts are compared whole.
    """
    return neardup.keep_representatives(spark, docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by the target weights of their sources, in a random order.

    A null source is a source. Draws depend on id and text, so rows alike in both are drawn alike.
    """
    added = tuple(free_names(docs.columns, *mixing.ADDED))
    return mixing.poisson_mix(spark, docs, added=added).select(*(named(n) for n in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of documents' pieces: doc_id, piece, start, length, first_byte, last_byte, bucket, batch, place.

    A null or empty text is a piece of one token, its end mark; a long text is cut into pieces, whole. Repeated rows are
    packed as often as they come.
    """
    return packing.length_buckets(spark, docs)


STAGES = [
    ("language", identified),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: The language filters are a fitted model, which SQL cannot express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; stages meet in tables of the shared folder, and what a stage staged on its
    way goes as soon as its own table is written."""
    return run_on(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)


def run_on(spark: SparkSession, docs: DataFrame, sf_dir: str = "") -> DataFrame:
    staging = Staging(spark, "corpus_pipeline")
    before = None
    for name, stage in STAGES[:-1]:
        with released():
            docs = staging.write(stage(spark, docs, sf_dir), name)
        if before:
            staging.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
