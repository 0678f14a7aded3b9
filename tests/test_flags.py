"""All rules of validation and all heading levels."""

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import blocks as B


def test_references_and_terms(spark):
    terms = [("pulp", "Tủy", "approved", False), ("root", "chân", "approved", None), ("gum", "lợi", "draft", False), ("cusp", "múi", "approved", True)]
    rows = [("See Figure 3.2a and Fig. 4, Table 5 and Table 5.", "Hình 3.2a, tủy", "para", terms), ("x Table 7", "", "para", terms), ("abc", "x", "cell", terms), ("word", "từ", "para", None)]
    got = spark.createDataFrame(rows, f"s string, d string, k string, t {T.TERMS}").select(T.flags(F.col("s"), F.col("d"), F.col("k"), F.col("t"))).collect()
    gone = T.REFERENCE_GONE
    assert [r[0] for r in got] == [[T.NUMBERS_GONE + "4, 5", gone + "4", gone + "5", gone + "5", T.TERM_UNUSED + "root → chân"], [T.EMPTY], [], []]
    assert spark.range(1).select(T.flags(F.lit("Figure 3"), F.lit("Hình 3"), F.lit("para"))).first()[0] == []


def test_length_and_language(spark):
    long = "a long source of words that runs on and on for over sixty signs"
    rows = [(long, "ngắn"), (long, "dài " * 60), (long, long), ("abc", "the end of it is near"), ("abc", "(the end of it is near) xong")]
    got = [r[0] for r in spark.createDataFrame(rows, "s string, d string").select(T.flags(F.col("s"), F.col("d"), F.lit("para"))).collect()]
    assert got == [[T.SHORT.replace("%d%%", "6%")], [T.LONG.replace("%d%%", "381%")], [T.SAME], [T.ENGLISH_LEFT], []]


def test_headings(spark):
    rows = [(1, k, "heading", f"H{k}", k + 1) for k in range(4)] + [(1, 4, "para", "p", 0), (1, 5, "heading", "T", 0), (1, 6, "para", "q", 0)]
    got = {r.block: r.section for r in B.section_path(spark.createDataFrame(rows, "doc_id int, block int, kind string, text string, level int")).collect()}
    assert got[4] == "H0 > H1 > H2 > H3" and got[5] == "" and got[6] == "T"
