"""The corpus pipeline: toxicity, fuzzy line dedup, n-gram Jaccard join, benchmark decontamination, packing.

Every stage but the last returns the columns that it got. Null and empty texts pass all of them; a null doc_id
is a document like any other; rows of one doc_id are told apart by their texts, and of fully equal rows the
near-copy stage keeps one; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliant.llm import decontamination, jaccard, lines, packing, toxicity
from foliant.llm.common import Scratch, owned
from foliant.llm.queries import vocabulary
from foliant.session import ship


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labels, doesn't reject."""
    ship(spark)
    return toxicity.keep_clean(docs, _read(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier one; n_chars follows the text."""
    ship(spark)
    out = lines.strip_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles at a similarity of 0.8 connect."""
    ship(spark)
    return jaccard.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship(spark)
    return decontamination.keep_clean(docs, _read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of every document left."""
    ship(spark)
    return packing.pack(docs, *vocabulary())


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", drop_leaks), ("packing", pack)]

#: Trained models, hashes and a tokenizer aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    docs, scratch = _read(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        before = docs
        with owned():
            docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if name != STAGES[0][0]:
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
