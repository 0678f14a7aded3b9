import duckdb
import pytest

from foliant.functions import text as T
from foliant.operators import blocks as B
from foliant.plans.documents import ORACLE_SQL, QUERIES
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels conversations events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, name):
    if name not in ORACLE_SQL:
        assert QUERIES[name](spark, DATA).count() > 0
        return
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    numeric = [c for c in columns if ours[c].dtype.kind == "f" or theirs[c].dtype.kind == "f"]
    for x in (ours, theirs):
        x[numeric] = x[numeric].astype(float).round(9)
    ours, theirs = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (ours, theirs))
    assert ours.equals(theirs)


def test_section_path_and_context(spark):
    rows = [(1, 0, "heading", "A", 1), (1, 1, "para", "p", 0), (1, 2, "heading", "B", 2), (1, 3, "note", "n", 0), (1, 4, "heading", "C", 1), (1, 5, "para", "q", 0)]
    blocks = spark.createDataFrame(rows, "doc_id int, block int, kind string, text string, level int")
    assert [r.section for r in B.section_path(blocks).orderBy("block").collect()] == ["", "A", "A", "A > B", "", "C"]
    assert [r.previous for r in B.previous_context(blocks).orderBy("block").collect()] == ["", "", "", "p", "", "p"]


def test_merge_continuations(spark):
    rows = [(1, 0, "para", "A hyphen-"), (1, 1, "figure", ""), (1, 2, "para", "ated word"), (1, 3, "para", "goes on."), (1, 4, "para", "new")]
    blocks = spark.createDataFrame([(*r, 1, 0) for r in rows], "doc_id int, block int, kind string, text string, page int, level int")
    got = {r.block: r.text for r in B.merge_continuations(blocks).collect()}
    assert got == {0: "A hyphenated word goes on.", 1: "", 4: "new"}


def test_text_functions(spark):
    def one(c):
        return spark.range(1).select(c).first()[0]

    assert one(T.clean_output(F.lit("<think>x</think>```\nTranslation: \"a\"\n```"))) == "a"
    assert one(T.missing_numbers(F.lit("1,5 and 1000 and 7"), F.lit("1.5"))) == ["1000", "7"]
    assert one(T.plural_forms(F.lit("vertex"))) == ["vertexes", "vertexs", "vertices"]
    assert one(T.join_lines(F.array(F.lit("hyphen-"), F.lit("ated"), F.lit("• item")))) == "hyphenated\n• item"
    assert one(T.duration(F.lit(3725))) == "1 giờ 2 phút"
    assert one(T.worth_listing(F.lit("12 mm"))) is False
    assert one(T.safe_name(F.lit(" ..."))) == "tai-lieu"
    assert one(T.flags(F.lit("abc 5"), F.lit(" "), F.lit("para"))) == [T.EMPTY]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_page_ranges(spark):
    from foliant.operators import assembly as A

    def pages(spec):
        return spark.range(1).select(A.page_range(F.lit(spec), F.lit(9))).first()[0]

    assert pages("3-1, 7;5–6 20") == [1, 2, 3, 5, 6, 7] and pages(" ") == list(range(1, 10))
    for bad in ("x", "11-12"):
        with pytest.raises(Exception, match="page"):
            pages(bad)


def test_text_blocks_of_blank_texts(spark):
    from foliant.operators import assembly as A

    rows = spark.createDataFrame([(1, None), (2, " \n\n "), (3, "a-\nb-\nC")], "id int, text string")
    assert [(r.id, r.kind, r.text) for r in A.text_blocks(rows).collect()] == [(3, "para", "ab- C")]


@pytest.mark.parametrize("name", ["glossary_terms", "glossary_upsert", "surface_forms", "term_match", "bilingual_terms"])
def test_terms_with_letters_that_have_no_single_capital(spark, tmp_path, name):
    """ß and ŉ are one letter in capitals too, as in SQL: a key in capitals stays the key."""
    texts = ["das schß ǰein Groß der ﬁn", "der ŉals straße Fuß und ein", "die Maß weiß heiß und so", "ein ᾳb weiß fuß der Rest", "les schß été ßen une mot"]
    spark.createDataFrame([(i, t) for i, t in zip((1, 5, 6, 9, 12), texts, strict=True)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    documents = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 5")
    more = documents.limit(1).selectExpr("1000L as doc_id", "'Das SCHẞ und schß, SCHSS.\n\nWeiß weiss ᾳb ŉals ŉALS.\n\nMaß, MAẞ und heiß.' as text", "lang", "source", "70L as n_chars")
    documents.unionByName(more.select(*documents.columns)).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    ours = QUERIES[name](spark, str(tmp_path))
    want = con.sql(ORACLE_SQL[name]).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in ours.collect())
