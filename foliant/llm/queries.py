"""The queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship
from . import decontamination, extraction, jaccard, language, lines, packing, substrings, toxicity, warc, winnowing


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary() -> tuple[str, str, dict[str, int]]:
    """Rank file and split pattern of the byte-level vocabulary whose ids are those of byte_bpe_50k.json, and the special tokens named there."""
    import json

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        specials = {t["content"]: t["id"] for t in json.load(f)["added_tokens"] if t["special"]}
    return str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, specials


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return winnowing.neighbour_report(_read(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 1024 tokens."""
    return packing.pack(_read(spark, sf_dir, "documents"), *vocabulary())


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages written to archives, normalised and read back."""
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, how many repeat earlier ones, and the hash of what stays."""
    return lines.report(_read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    return decontamination.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extraction.main_text(_read(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated strings of 100 bytes take from every document."""
    return substrings.strip_repeats(_read(spark, sf_dir, "documents")).drop("kept")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return language.identify(_read(spark, sf_dir, "documents"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle counts and link components of every document."""
    return jaccard.link_components(_read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_winnowing, op2_packing, op3_warc, op4_lines, op5_decontamination, op6_main_text, op7_toxicity, op8_substrings, op9_language, op10_jaccard)}
ORACLE_SQL: dict[str, str] = {}
