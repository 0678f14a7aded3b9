"""Queries over the provided tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..operators import assembly as A, blocks as B, rendering as R
from ..session import ship

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: The block view of operators.blocks.line_blocks in SQL.
BLOCKS = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block FROM documents),
kinds AS (SELECT *, (doc_id * 7 + block * 3) % 10 AS m, (doc_id * 13 + block * 29) % 100 AS spot FROM lines WHERE text <> ''),
blocks AS (SELECT doc_id, CAST(block AS INT) AS block, text, CASE m WHEN 0 THEN 'heading' WHEN 1 THEN 'list' WHEN 2 THEN 'figure' WHEN 3 THEN 'note' WHEN 4 THEN 'label' ELSE 'para' END AS kind,
  CAST(CASE WHEN m = 0 THEN 1 + (doc_id + block) % 3 ELSE 0 END AS INT) AS level, CAST(1 + block // 4 AS INT) AS page, CAST(8 + (doc_id * 3 + block) % 6 AS INT) AS size,
  CASE WHEN spot % 2 = 0 THEN 50 ELSE 310 END AS x0, CAST(40 + spot * 7 AS INT) AS y0, CASE WHEN spot % 5 = 0 THEN 480 ELSE 230 END AS width,
  CAST(1 + length(text) // 90 AS INT) AS lines, (doc_id * 5 + block * 11) % 10 / 10 AS bold, x0 + width AS x1, y0 + 12 * lines AS y1 FROM kinds)"""


def query(sql: str | None):
    """Register a query with its SQL; None where SQL can't express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql.replace("{BLOCKS}", BLOCKS)
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.line_blocks(_table(spark, sf_dir, "documents"))


@query("""WITH {BLOCKS} SELECT doc_id, block, kind, coalesce(CASE WHEN kind IN ('para', 'list', 'note') THEN last_value(CASE WHEN kind IN ('para', 'list') THEN right(text, 600) END IGNORE NULLS)
OVER (PARTITION BY doc_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END, '') AS previous FROM blocks""")
def previous_context(spark, sf_dir):
    return B.previous_context(_blocks(spark, sf_dir)).select("doc_id", "block", "kind", "previous")


@query("""WITH {BLOCKS}, h AS (SELECT a.doc_id, a.block, a.level, b.level AS hl, max(b.block) AS at FROM blocks a JOIN blocks b ON a.doc_id = b.doc_id AND b.level > 0 AND b.block < a.block AND (a.level = 0 OR b.level < a.level) GROUP BY ALL),
o AS (SELECT h.* FROM h WHERE NOT EXISTS (SELECT 1 FROM h g WHERE g.doc_id = h.doc_id AND g.block = h.block AND g.hl < h.hl AND g.at > h.at)),
p AS (SELECT o.doc_id, o.block, string_agg(t.text, ' > ' ORDER BY o.hl) AS section FROM o JOIN blocks t ON t.doc_id = o.doc_id AND t.block = o.at GROUP BY ALL)
SELECT b.doc_id, b.block, coalesce(p.section, '') AS section FROM blocks b LEFT JOIN p USING (doc_id, block)""")
def section_path(spark, sf_dir):
    return B.section_path(_blocks(spark, sf_dir)).select("doc_id", "block", "section")


@query("""WITH {BLOCKS}, m AS (SELECT *, lag(kind) OVER w AS pk, lag(text) OVER w AS pt FROM blocks WHERE kind NOT IN ('figure', 'label') WINDOW w AS (PARTITION BY doc_id ORDER BY block)),
g AS (SELECT *, sum(CASE WHEN kind = 'para' AND pk = 'para' AND NOT regexp_matches(pt, '[.!?:;…”")\\]]\\s*$') AND regexp_matches(text, '^\\p{Ll}') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY block) AS run FROM m),
e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY block DESC) = 1 AS ends FROM g)
SELECT doc_id, min(block) AS block, arg_min(page, block) AS page, CAST(count(*) AS INT) AS n_parts, sha256(string_agg(CASE WHEN ends THEN text WHEN regexp_matches(text, '\\p{L}-$') THEN left(text, length(text) - 1) ELSE text || ' ' END, '' ORDER BY block)) AS digest FROM e GROUP BY doc_id, run
UNION ALL SELECT doc_id, block, page, 1, sha256(text) FROM blocks WHERE kind IN ('figure', 'label')""")
def merge_continuations(spark, sf_dir):
    return B.merge_continuations(_blocks(spark, sf_dir)).select("doc_id", "block", "page", "n_parts", F.sha2("text", 256).alias("digest"))


@query("""WITH {BLOCKS} SELECT doc_id, block, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS INT) AS id FROM blocks WHERE kind <> 'figure'""")
def segment_ids(spark, sf_dir):
    return B.segment_ids(_blocks(spark, sf_dir)).select("doc_id", "block", "id")


@query("""WITH {BLOCKS}, w AS (SELECT DISTINCT doc_id, block, lower(u) AS term FROM (SELECT doc_id, block, unnest(string_split(text, ' ')) AS u FROM blocks) WHERE lower(u) IN ('the', 'und', 'les', 'que')),
e AS (SELECT doc_id, block, kind, sum(CASE WHEN level BETWEEN 1 AND 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block) AS epoch FROM blocks)
SELECT w.doc_id, w.block, w.term, max(CASE WHEN kind <> 'label' THEN 1 END) OVER (PARTITION BY w.doc_id, epoch, term ORDER BY w.block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NULL AS "first" FROM w JOIN e USING (doc_id, block)""")
def first_mention(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    mentions = blocks.select("doc_id", "block", F.explode(F.split(F.lower("text"), " ")).alias("term")).where(F.col("term").isin("the", "und", "les", "que")).distinct()
    return B.first_mention(mentions, blocks).select("doc_id", "block", "term", "first")


@query("""WITH {BLOCKS}, f AS (SELECT *, width > 330 OR (x0 < 290 AND x0 + width > 310) AS wide FROM blocks), t AS (SELECT *, max(CASE WHEN NOT wide AND x0 >= 300 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page) = 1 AS two FROM f),
b AS (SELECT a.*, CASE WHEN a.wide THEN (SELECT count(*) FROM t s WHERE s.doc_id = a.doc_id AND s.page = a.page AND s.wide AND (s.y0 < a.y0 OR s.y0 = a.y0 AND s.block < a.block)) ELSE (SELECT count(*) FROM t s WHERE s.doc_id = a.doc_id AND s.page = a.page AND s.wide AND s.y0 <= a.y0) END AS band FROM t a)
SELECT doc_id, page, block, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN two THEN band ELSE 0 END, CASE WHEN two AND wide THEN 1 ELSE 0 END, CASE WHEN two AND NOT wide AND x0 >= 300 THEN 1 ELSE 0 END, y0, CASE WHEN two THEN 0 ELSE x0 END, block) AS INT) AS place FROM b""")
def reading_order(spark, sf_dir):
    return B.reading_order(_blocks(spark, sf_dir)).select("doc_id", "page", "block", "place")


@query("""WITH {BLOCKS}, s AS (SELECT doc_id, size, sum(length(text)) AS w, min(block) AS f FROM blocks GROUP BY ALL) SELECT doc_id, size AS body FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, f) = 1""")
def weighted_mode(spark, sf_dir):
    return B.body_size(_blocks(spark, sf_dir))


_LEVELS = """{BLOCKS}, s AS (SELECT doc_id, size, sum(length(text)) AS w, min(block) AS f FROM blocks GROUP BY ALL), o AS (SELECT doc_id, size AS body FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, f) = 1),
c AS (SELECT DISTINCT doc_id, size FROM blocks JOIN o USING (doc_id) WHERE size >= 1.15 * body AND length(text) < 200 AND lines <= 4), l AS (SELECT doc_id, size, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY size DESC) AS INT) AS lv FROM c QUALIFY lv <= 3)"""


@query(f"WITH {_LEVELS} SELECT doc_id, size, lv AS level FROM l")
def heading_levels(spark, sf_dir):
    return B.heading_levels(_blocks(spark, sf_dir)).select("doc_id", "size", "level")


@query(f"""WITH {_LEVELS}, n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id), k AS (SELECT doc_id, block, text, lv, coalesce(n, 0) AS n, CASE WHEN lv IS NOT NULL AND length(text) < 200 THEN 'size' WHEN regexp_matches(text, '^(?i:fig\\.?|figure|table|box|chart|plate)\\s*[\\dIVX]+[\\d.\\-–A-Za-z]*[.:]?(\\s+[A-Z(\\d]|\\s*$)') THEN 'caption'
WHEN bold > 0.8 AND length(text) < 100 AND lines <= 2 AND NOT regexp_matches(rtrim(text, ':'), '[.!?:;…”")\\]]\\s*$') THEN 'bold'
WHEN regexp_matches(text, '^[•●○◦▪■□▸►‣–*·] ') THEN 'list' WHEN size < 0.85 * body AND length(text) < 400 THEN 'note' ELSE 'para' END AS rule FROM blocks JOIN o USING (doc_id) LEFT JOIN l USING (doc_id, size) LEFT JOIN n USING (doc_id))
SELECT doc_id, block, CASE WHEN rule IN ('size', 'bold') THEN 'heading' ELSE rule END AS kind, CAST(CASE rule WHEN 'size' THEN lv WHEN 'bold' THEN least(4, n + 1) ELSE 0 END AS INT) AS level, sha256(CASE WHEN rule = 'list' THEN trim(regexp_replace(text, '^[•●○◦▪■□▸►‣–*·]\\s*', '')) ELSE text END) AS digest FROM k""")
def classify_blocks(spark, sf_dir):
    return B.classify(_blocks(spark, sf_dir)).select("doc_id", "block", "kind", "level", F.sha2("text", 256).alias("digest"))


_REPEATED = """{BLOCKS}, n AS (SELECT source, count(*) AS n FROM documents GROUP BY source), k AS (SELECT d.source, b.doc_id, trim(regexp_replace(lower(b.text), '\\d+', '#', 'g')) AS line FROM blocks b JOIN documents d USING (doc_id) WHERE length(b.text) < 120 AND (y0 < 64 OR y1 > 736)),
r AS (SELECT source AS book, line, count(DISTINCT doc_id) AS pages FROM k JOIN n USING (source) WHERE line <> '' AND n >= 3 GROUP BY source, line, n HAVING count(DISTINCT doc_id) >= greatest(3, floor(n * {SHARE})))"""


@query(f"WITH {_REPEATED} SELECT * FROM r".replace("{SHARE}", "0.02"))
def repeated_lines(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    lines = _blocks(spark, sf_dir).where(B.in_margin()).join(docs.select("doc_id", "source"), "doc_id").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), "text")
    return B.repeated_lines(lines, docs.groupBy(F.col("source").alias("book")).agg(F.count("*").alias("n")), 0.02).select("book", "line", "pages")


@query("""WITH {BLOCKS}, t AS (SELECT doc_id, block AS pos, level, page AS start FROM blocks WHERE level > 0) SELECT a.doc_id, a.pos, a.level, a.start, CAST(coalesce(greatest(a.start, (SELECT arg_min(b.start, b.pos) FROM t b WHERE b.doc_id = a.doc_id AND b.pos > a.pos AND b.level <= a.level AND b.start >= a.start) - 1), 999) AS INT) AS "end" FROM t a""".replace("coalesce(greatest(a.start, (", "coalesce((SELECT greatest(a.start, x.s - 1) FROM (").replace(") - 1), 999)", ") x(s) WHERE x.s IS NOT NULL), 999)"))
def toc_ranges(spark, sf_dir):
    toc = _blocks(spark, sf_dir).where("level > 0").select("doc_id", F.col("block").alias("pos"), "level", F.col("page").alias("start"))
    return B.toc_ranges(toc, 999).select("doc_id", "pos", "level", "start", "end")


@query("""WITH {BLOCKS}, c AS (SELECT doc_id, block // 10 AS part, max(page) AS last_page FROM blocks WHERE kind <> 'figure' GROUP BY ALL) SELECT f.doc_id, f.block, coalesce(min(CASE WHEN last_page >= f.page THEN part END), max(part)) AS part FROM blocks f JOIN c USING (doc_id) WHERE f.kind = 'figure' GROUP BY ALL""")
def figure_asof(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    chunks = blocks.where("kind <> 'figure'").groupBy("doc_id", F.floor(F.col("block") / 10).cast("int").alias("part")).agg(F.max("page").alias("last_page"))
    return B.figure_parts(blocks.where("kind = 'figure'").select("doc_id", "block", "page"), chunks).select("doc_id", "block", "part")


@query("""WITH {BLOCKS}, r AS (SELECT doc_id, CAST((page - 1) // 2 AS INT) AS batch, row_number() OVER (PARTITION BY doc_id ORDER BY length(text), block) AS done FROM blocks), n AS (SELECT doc_id, batch, max(done) AS needs, count(*) AS segments FROM r GROUP BY ALL)
SELECT doc_id, batch, segments, CAST(max(needs) OVER (PARTITION BY doc_id ORDER BY batch) AS INT) AS step FROM n""")
def batch_release(spark, sf_dir):
    return B.batch_release(_blocks(spark, sf_dir)).select("doc_id", "batch", "segments", "step")


@query("""WITH {BLOCKS}, p AS (SELECT DISTINCT doc_id, page FROM blocks WHERE kind = 'para' AND block % 3 > 0), i AS (SELECT *, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS g FROM p), r AS (SELECT doc_id, min(page) AS a, max(page) AS z FROM i GROUP BY doc_id, g)
SELECT doc_id, string_agg(CASE WHEN a = z THEN CAST(a AS VARCHAR) ELSE a || '–' || z END, ', ' ORDER BY a) AS runs FROM r GROUP BY doc_id""")
def page_runs(spark, sf_dir):
    pages = _blocks(spark, sf_dir).where("kind = 'para' and block % 3 > 0").select("doc_id", "page")
    told = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat(F.col("first").cast("string"), F.lit("–"), F.col("last").cast("string")))
    runs = B.runs_of_pages(pages).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("first", told.alias("t")))).alias("r"))
    return runs.select("doc_id", F.array_join(F.transform("r", lambda x: x["t"]), ", ").alias("runs"))


@query("""WITH {BLOCKS} SELECT page, count(*) AS blocks, CAST(count_if(kind = 'para') AS BIGINT) AS paras, CAST(count_if(length(text) > 400) AS BIGINT) AS long_blocks FROM blocks GROUP BY page""")
def job_summary(spark, sf_dir):
    return _blocks(spark, sf_dir).groupBy("page").agg(F.count("*").alias("blocks"), F.count_if(F.col("kind") == "para").alias("paras"), F.count_if(F.length("text") > 400).alias("long_blocks"))


@query("""WITH {BLOCKS} SELECT doc_id, block, format('tr{}-{}', page, row_number() OVER (PARTITION BY doc_id, page ORDER BY block)) AS name, printf('fig-%04d', block) AS figure FROM blocks WHERE kind = 'figure'""")
def figure_names(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("block"))
    return _blocks(spark, sf_dir).where("kind = 'figure'").select("doc_id", "block", F.format_string("tr%d-%d", "page", n).alias("name"), F.format_string("fig-%04d", "block").alias("figure"))


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '\\d+(?:[.,]\\d+)*'), lambda x: replace(x, ',', '.')))), ' ') AS numbers FROM documents""")
def numbers(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.numbers(F.col("text")), " ").alias("numbers"))


@query("""SELECT conv_id, turn, sha256(role || chr(31) || text) AS key FROM conversations""")
def cache_keys(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", T.cache_key(F.col("role"), F.col("text")).alias("key"))


@query("""WITH k AS (SELECT conv_id, turn, sha256(text) AS key FROM conversations), c AS (SELECT DISTINCT key FROM k WHERE conv_id % 3 = 0) SELECT conv_id, turn, c.key IS NOT NULL AS hit FROM k LEFT JOIN c USING (key)""")
def cache_hit_miss(spark, sf_dir):
    keyed = _table(spark, sf_dir, "conversations").select("conv_id", "turn", T.cache_key(F.col("text")).alias("key"))
    cache = keyed.where("conv_id % 3 = 0").select("key").distinct().withColumn("hit", F.lit(True))
    return keyed.join(cache, "key", "left").select("conv_id", "turn", F.coalesce("hit", F.lit(False)).alias("hit"))


@query("""WITH w AS (SELECT DISTINCT u AS word FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS u FROM benchmark)) SELECT word, array_to_string(list_sort(list_distinct(list_filter([word || 's', CASE WHEN regexp_matches(word, '(s|x|z|ch|sh)$') THEN word || 'es' END, CASE WHEN regexp_matches(word, '[^aeiou]y$') THEN word[:-2] || 'ies' END,
CASE WHEN word LIKE '%us' AND length(word) > 4 THEN word[:-3] || 'i' END, CASE WHEN word LIKE '%um' AND length(word) > 4 THEN word[:-3] || 'a' END, CASE WHEN word LIKE '%on' AND length(word) > 4 THEN word[:-3] || 'a' END, CASE WHEN word LIKE '%is' AND length(word) > 4 THEN word[:-3] || 'es' END,
CASE WHEN word LIKE '%a' AND length(word) > 3 THEN word[:-2] || 'ae' END, CASE WHEN word LIKE '%ex' AND length(word) > 4 THEN word[:-3] || 'ices' END, CASE WHEN word LIKE '%ix' AND length(word) > 4 THEN word[:-3] || 'ices' END], lambda x: x IS NOT NULL))), ' ') AS forms FROM w""")
def plural_forms(spark, sf_dir):
    words = _table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", F.array_join(T.plural_forms(F.col("word")), " ").alias("forms"))


@query("""SELECT page_id, CASE WHEN n = '' THEN 'tai-lieu' ELSE n END AS name FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g') AS n FROM pages)""")
def safe_name(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


@query("""SELECT event_id, CASE WHEN s < 60 THEN s || ' giây' WHEN s < 3600 THEN s // 60 || ' phút ' || s % 60 || ' giây' ELSE s // 3600 || ' giờ ' || s // 60 % 60 || ' phút' END AS took FROM (SELECT event_id, event_id * 37 % 9001 AS s FROM events)""")
def fmt_duration(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", T.duration(F.col("event_id") * 37 % 9001).alias("took"))


@query("""SELECT item_id, nfc_normalize(regexp_replace(regexp_replace(t, '\\b(?:Fig\\.|Figure)\\s+(\\d)', 'Hình \\1', 'g'), '\\bTable\\s+(\\d)', 'Bảng \\1', 'g')) AS fixed FROM (SELECT item_id, 'e' || chr(769) || ' See Fig. ' || item_id || ' and Table  ' || item_id || '. Figure it. ' || text AS t FROM benchmark)""")
def fix_refs(spark, sf_dir):
    ship(spark)
    n = F.col("item_id").cast("string")
    return _table(spark, sf_dir, "benchmark").select("item_id", T.fix_references(F.concat(F.lit("e\u0301 See Fig. "), n, F.lit(" and Table  "), n, F.lit(". Figure it. "), F.col("text"))).alias("fixed"))


@query("""SELECT conv_id, turn, trim(text, chr(10) || ' ') AS cleaned FROM conversations""")
def clean_output(spark, sf_dir):
    said, k = F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")), F.col("turn") % 4
    raw = F.when(k == 0, F.concat(F.lit("<think>a\nb</think>\n<SOURCE>Translation: \""), said, F.lit("\"</SOURCE>\n"))).when(k == 1, F.concat(F.lit("```text\n"), said, F.lit("\n```"))).when(k == 2, F.concat(F.lit("<THINK>x</THINK><TRANSLATION>\n Bản dịch : '"), said, F.lit("'"))).otherwise(F.concat(F.lit("  “"), said, F.lit("“ ")))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean_output(raw).alias("cleaned"))


@query("""WITH {BLOCKS}, n AS (SELECT doc_id, count(*) AS n FROM blocks WHERE kind <> 'figure' GROUP BY doc_id) SELECT doc_id, block, CAST((row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1) // CAST(ceil(n / 3) AS BIGINT) AS INT) AS part FROM blocks JOIN n USING (doc_id) WHERE kind <> 'figure'""")
def agent_partition(spark, sf_dir):
    rows = B.segment_ids(_blocks(spark, sf_dir)).withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    return rows.select("doc_id", "block", F.floor(F.col("id") / F.ceil(F.col("n") / 3)).cast("int").alias("part"))


@query("""WITH {BLOCKS}, t AS (SELECT doc_id, block, v, CASE WHEN v % 4 = 0 THEN '' ELSE v || ':' || left(text, 40) END AS dst FROM blocks, (VALUES (1), (2), (4)) x(v) WHERE (doc_id + block + v) % 3 > 0), l AS (SELECT doc_id, block, arg_max(dst, v) AS dst FROM t GROUP BY ALL)
SELECT doc_id, block, coalesce(nullif(dst, ''), text) AS text FROM blocks LEFT JOIN l USING (doc_id, block)""")
def agent_assemble(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    told = blocks.withColumn("v", F.explode(F.lit([1, 2, 4]))).where("(doc_id + block + v) % 3 > 0")
    dst = F.when(F.col("v") % 4 == 0, "").otherwise(F.concat(F.col("v").cast("string"), F.lit(":"), F.left("text", F.lit(40))))
    latest = told.groupBy("doc_id", "block").agg(F.max_by(dst, "v").alias("dst"))
    return blocks.join(latest, ["doc_id", "block"], "left").select("doc_id", "block", F.coalesce(F.nullif(F.col("dst"), F.lit("")), F.col("text")).alias("text"))


_HINTS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.HINTS.items())
_PROMPT = """concat_ws(chr(10) || chr(10), CASE WHEN section <> '' OR previous <> '' THEN '<CONTEXT>' || chr(10) || concat_ws(chr(10), CASE WHEN section <> '' THEN 'Section: ' || section END, CASE WHEN previous <> '' THEN 'Previous paragraph: ' || previous END) || chr(10) || '</CONTEXT>' END,
{TERMS} CASE kind {HINTS} END, '<SOURCE>' || chr(10) || text || chr(10) || '</SOURCE>')""".replace("{HINTS}", _HINTS)
_CONTEXT = f"""p AS ({ORACLE_SQL['previous_context']}), s AS ({ORACLE_SQL['section_path']}), q AS (SELECT b.*, p.previous, s.section FROM blocks b JOIN p USING (doc_id, block) JOIN s USING (doc_id, block))"""


@query(f"""WITH {{BLOCKS}}, {_CONTEXT}, t AS (SELECT *, CASE WHEN block % 3 = 0 THEN '' ELSE '- ' || left(text, 5) || ' -> x' || CASE WHEN block % 3 = 2 THEN CASE WHEN level = 0 THEN ' (only if this meaning fits: m)' ELSE ' (if this meaning fits)' END WHEN doc_id % 2 = 0 THEN ' (' || left(text, 5) || ')' ELSE '' END END AS told FROM q)
SELECT doc_id, block, sha256({_PROMPT.replace("{TERMS}", "CASE WHEN told <> '' THEN '<TERMS>' || chr(10) || told || chr(10) || '</TERMS>' END,")}) AS key FROM t""")
def build_prompt(spark, sf_dir):
    rows, k = B.previous_context(B.section_path(_blocks(spark, sf_dir))), F.col("block") % 3
    term = F.struct(F.left("text", F.lit(5)).alias("en"), F.lit("x").alias("vi"), (k == 2).alias("ambiguous"), F.when(F.col("level") == 0, "m").otherwise("").alias("note"), (F.col("doc_id") % 2 == 0).alias("first"))
    terms = F.filter(F.array(term), lambda t: k != 0)
    return rows.select("doc_id", "block", T.cache_key(T.prompt(F.col("text"), F.col("kind"), F.col("section"), F.col("previous"), terms)).alias("key"))


_UNITS = ", ".join(f"'{u}'" for u in T.UNITS)


@query(f"""SELECT doc_id, pos, word, len(list_filter(regexp_extract_all(word, '\\p{{L}}{{2,}}'), lambda w: lower(w) NOT IN ({_UNITS}))) > 0 AS worth
FROM (SELECT doc_id, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS word FROM (SELECT doc_id, string_split(left(text, 60) || ' 12 mm A1 5 mg/dl MHz µg', ' ') AS x FROM documents))""".replace("AS pos,", "::INT AS pos,").replace("- 1::INT", "- 1"))
def worth_listing(spark, sf_dir):
    words = F.posexplode(F.split(F.concat(F.left("text", F.lit(60)), F.lit(" 12 mm A1 5 mg/dl MHz µg")), " ")).alias("pos", "word")
    return _table(spark, sf_dir, "documents").select("doc_id", words).select("doc_id", "pos", "word", T.worth_listing(F.col("word")).alias("worth"))


@query("""WITH t AS (SELECT lower(text) AS k, text, 1 AS p, item_id AS i FROM benchmark UNION ALL SELECT lower(text), '!' || text, 2, item_id FROM benchmark WHERE item_id % 4 = 0) SELECT k AS key, text FROM t QUALIFY row_number() OVER (PARTITION BY k ORDER BY p DESC, i DESC) = 1""")
def glossary_override(spark, sf_dir):
    core = _table(spark, sf_dir, "benchmark").select(F.lower("text").alias("key"), "text", F.lit(1).alias("p"), "item_id")
    own = core.where("item_id % 4 = 0").withColumns({"text": F.concat(F.lit("!"), "text"), "p": F.lit(2)})
    return core.unionByName(own).groupBy("key").agg(F.max_by("text", F.struct("p", "item_id")).alias("text"))


_STOPS = ", ".join(f"'{w}'" for w in T.STOPWORDS)
#: Sources with a reference, targets that fail each rule in turn, one required term.
_PAIRS = """x AS (SELECT doc_id, block, page, CASE WHEN block % 7 = 0 THEN 'cell' ELSE kind END AS kind, CASE WHEN block % 7 = 0 THEN left(text, 3 + block % 3) WHEN block % 5 = 0 THEN 'Fig. 2.1 and Table 3a: ' || text || ' 7,5' ELSE text END AS src FROM blocks),
d AS (SELECT *, CASE (doc_id + block) % 6 WHEN 0 THEN ' ' WHEN 1 THEN src WHEN 2 THEN left(src, 20) WHEN 3 THEN repeat(src, 3) WHEN 4 THEN 'the vi1 of (the) and with' ELSE replace(src, 'e', 'x') || ' Vi1 2.1' END AS dst FROM x)"""


def flags_sql(required: str = "") -> str:
    """The rules in SQL over src, dst, kind; required: a condition under which the term "en1" must be used as "vi1"."""
    strip = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    numbers = lambda c: f"list_distinct(list_transform(regexp_extract_all({c}, '\\d+(?:[.,]\\d+)*'), lambda n: replace(n, ',', '.')))"
    gone = f"list_transform(list_sort(list_transform(list_filter({numbers('src')}, lambda n: NOT list_contains({numbers('dst')}, n)), lambda n: {{'k': -length(n), 'n': n}})), lambda z: z.n)[:5]"
    english = f"len(list_filter(regexp_extract_all(regexp_replace(dst, '\\([^)]*\\)', ' ', 'g'), '[A-Za-z]+'), lambda w: lower(w) IN ({_STOPS})))"
    total = "greatest(1, len(list_filter(regexp_split_to_array(dst, '\\s+'), lambda w: w <> '')))"
    sized, ratio = "kind IN ('para', 'list', 'note') AND length(src) > 60", "length(dst) / length(src)"
    percent = f"CAST(CAST(round_even({ratio} * 100, 0) AS INT) AS VARCHAR)"
    short, long = (text.replace("%d%%", "~").split("~") for text in (T.SHORT, T.LONG))
    term = f"CASE WHEN {required} AND NOT contains(lower(nfc_normalize(dst)), 'vi1') THEN ['{T.TERM_UNUSED}en1 → Vi1'] ELSE [] END" if required else "[]"
    first = f"""[CASE WHEN len({gone}) > 0 THEN '{T.NUMBERS_GONE}' || array_to_string({gone}, ', ') END, CASE WHEN {strip('dst')} = {strip('src')} AND regexp_matches(src, '[a-z]{{3,}}') THEN '{T.SAME}' WHEN {english} >= 3 AND {english} / {total} > 0.12 THEN '{T.ENGLISH_LEFT}' END,
    CASE WHEN {sized} AND {ratio} < 0.55 THEN '{short[0]}' || {percent} || '%{short[1]}' WHEN {sized} AND {ratio} > 2.6 THEN '{long[0]}' || {percent} || '%{long[1]}' END]"""
    references = f"list_transform(list_filter(regexp_extract_all(src, '\\b(?:Fig\\.|Figure|Table)\\s+(\\d+(?:[.\\-–]\\d+)*[A-Za-z]?)', 1), lambda r: NOT contains(dst, r)), lambda r: '{T.REFERENCE_GONE}' || r)"
    return f"CASE WHEN {strip('dst')} = '' THEN ['{T.EMPTY}'] WHEN kind = 'cell' AND length(src) < 4 THEN [] ELSE list_concat(list_filter({first}, lambda f: f IS NOT NULL), {references}, {term}) END"


@query(f"WITH {{BLOCKS}}, {_PAIRS} SELECT doc_id, block, page, kind, sha256(src) AS src, sha256(dst) AS dst, array_to_string({flags_sql('block % 2 = 0 AND doc_id % 3 > 0')}, ';') AS flags FROM d")
def validate_flags(spark, sf_dir):
    ship(spark)
    k, text, block = (F.col("doc_id") + F.col("block")) % 6, F.col("text"), F.col("block")
    rows = _blocks(spark, sf_dir).withColumns({"src": F.when(block % 7 == 0, F.substring(text, F.lit(1), 3 + block % 3)).when(block % 5 == 0, F.concat(F.lit("Fig. 2.1 and Table 3a: "), text, F.lit(" 7,5"))).otherwise(text), "kind": F.when(block % 7 == 0, "cell").otherwise(F.col("kind"))})
    src = F.col("src")
    rows = rows.withColumn("dst", F.when(k == 0, " ").when(k == 1, src).when(k == 2, F.left(src, F.lit(20))).when(k == 3, F.repeat(src, F.lit(3))).when(k == 4, "the vi1 of (the) and with").otherwise(F.concat(F.replace(src, F.lit("e"), F.lit("x")), F.lit(" Vi1 2.1"))))
    term = F.struct(F.lit("en1").alias("en"), F.lit("Vi1").alias("vi"), F.when(F.col("doc_id") % 3 > 0, "approved").otherwise("draft").alias("status"), (block % 2 == 1).alias("ambiguous"))
    rows = rows.withColumn("flags", F.array_join(T.flags(src, F.col("dst"), F.col("kind"), F.array(term)), ";"))  # before src and dst get other meanings
    return rows.select("doc_id", "block", "page", "kind", F.sha2("src", 256).alias("src"), F.sha2("dst", 256).alias("dst"), "flags")


_PASTED = "'# ' || role || chr(10) || chr(10) || '- one' || chr(10) || '- two' || chr(10) || chr(10) || 'hyphen-' || chr(10) || 'ated' || chr(10) || chr(10) || text"


@query(f"""WITH c AS (SELECT conv_id, turn, unnest(x) AS chunk, generate_subscripts(x, 1) - 1 AS block FROM (SELECT conv_id, turn, regexp_split_to_array(trim({_PASTED}, chr(10) || ' '), '\\n\\s*\\n') AS x FROM conversations)),
l AS (SELECT *, list_filter(list_transform(string_split(chunk, chr(10)), lambda y: trim(y)), lambda y: y <> '') AS lines FROM c), k AS (SELECT *, CASE WHEN len(list_filter(lines, lambda y: NOT regexp_matches(y, '^[-•*·]\\s+'))) = 0 THEN 'list' WHEN len(lines) = 1 AND starts_with(lines[1], '#') THEN 'heading' ELSE 'para' END AS kind FROM l)
SELECT conv_id, turn, CAST(block AS INT) AS block, kind, CAST(CASE WHEN kind = 'heading' THEN least(4, length(lines[1]) - length(ltrim(lines[1], '#'))) ELSE 0 END AS INT) AS level,
CASE kind WHEN 'list' THEN array_to_string(list_transform(lines, lambda y: regexp_replace(y, '^[-•*·]\\s+', '')), chr(10)) WHEN 'heading' THEN trim(ltrim(lines[1], '#')) ELSE replace(regexp_replace(array_to_string(lines, chr(10)), '(\\pL)-\\n(\\p{{Ll}})', '\\1\\2', 'g'), chr(10), ' ') END AS text FROM k""")
def text_blocks(spark, sf_dir):
    pasted = F.concat(F.lit("# "), F.col("role"), F.lit("\n\n- one\n- two\n\nhyphen-\nated\n\n"), F.col("text"))
    return A.text_blocks(_table(spark, sf_dir, "conversations").select("conv_id", "turn", pasted.alias("text"))).select("conv_id", "turn", "block", "kind", "level", "text")


@query("""SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(list_concat(range(least(conv_id % 9, conv_id % 5), greatest(conv_id % 9, conv_id % 5) + 1), [turn + 1]), lambda p: p BETWEEN 1 AND 7))), ',') AS pages FROM conversations WHERE turn < 7""")
def page_range(spark, sf_dir):
    spec = F.concat_ws("", (F.col("conv_id") % 9).cast("string"), F.lit("–"), (F.col("conv_id") % 5).cast("string"), F.lit(" ; "), (F.col("turn") + 1).cast("string"))
    rows = _table(spark, sf_dir, "conversations").where("turn < 7")
    return rows.select("conv_id", "turn", F.array_join(A.page_range(spec, F.lit(7)).cast("array<string>"), ",").alias("pages"))


@query(f"""WITH {_REPEATED}, s AS (SELECT doc_id, size, sum(length(text)) AS w, min(block) AS f FROM blocks GROUP BY ALL), o AS (SELECT doc_id, size AS body FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, f) = 1)
SELECT b.doc_id, b.block FROM blocks b JOIN documents d USING (doc_id) JOIN o USING (doc_id) WHERE NOT ((y0 < 64 OR y1 > 736) AND size < 1.15 * body AND (regexp_matches(b.text, '(?i)^(page\\s*)?[\\divxlcdm]{{1,6}}$') OR EXISTS (SELECT 1 FROM r WHERE r.book = d.source AND r.line = trim(regexp_replace(lower(b.text), '\\d+', '#', 'g')))))""".replace("{SHARE}", "0.02"))
def drop_margins(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    blocks = _blocks(spark, sf_dir).join(docs.select("doc_id", F.col("source").alias("book")), "doc_id")
    again = B.repeated_lines(blocks.where(B.in_margin()).select("book", F.col("doc_id").alias("page"), "text"), docs.groupBy(F.col("source").alias("book")).agg(F.count("*").alias("n")), 0.02)
    return A.drop_margins(blocks, again).select("doc_id", "block")


@query("""WITH {BLOCKS}, c AS (SELECT doc_id, block, unnest(x) AS cell, generate_subscripts(x, 1) AS nth FROM (SELECT doc_id, block, string_split(text, ' ') AS x FROM blocks WHERE kind = 'note')), f AS (SELECT doc_id, block, cell, min(nth) AS nth FROM c WHERE regexp_matches(cell, '[A-Za-z]{3}') GROUP BY ALL)
SELECT doc_id, block, CAST(row_number() OVER (PARTITION BY doc_id, block ORDER BY nth) - 1 AS INT) AS pos, cell FROM f""")
def table_cells(spark, sf_dir):
    return A.table_cells(_blocks(spark, sf_dir).where("kind = 'note'").select("doc_id", "block", F.array(F.split("text", " ")).alias("rows")))


@query("""WITH {BLOCKS}, a AS (SELECT m.*, CASE WHEN m.kind <> 'figure' THEN m.block ELSE coalesce((SELECT min(t.block) FROM blocks t WHERE t.doc_id = m.doc_id AND t.page = m.page AND t.kind <> 'figure' AND t.y0 >= m.y0), 2147483647) END AS anchor FROM blocks m)
SELECT doc_id, page, block, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY anchor, CASE WHEN kind = 'figure' THEN 0 ELSE 1 END, y0, block) AS INT) AS place FROM a""")
def interleave_media(spark, sf_dir):
    return A.interleave_media(_blocks(spark, sf_dir)).select("doc_id", "page", "block", "place")


@query("""WITH {BLOCKS}, s AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS id FROM blocks WHERE kind <> 'figure'), t AS (SELECT doc_id, id, page FROM s UNION ALL SELECT doc_id, id, page + 1 FROM s WHERE id % 5 = 0),
n AS (SELECT *, (dense_rank() OVER (PARTITION BY doc_id ORDER BY page) - 1) // 3 AS batch FROM t) SELECT doc_id, CAST(batch AS INT) AS batch, array_to_string(list_sort(list(DISTINCT id)), ',') AS needs FROM n GROUP BY ALL""")
def batch_needs(spark, sf_dir):
    segments = B.segment_ids(_blocks(spark, sf_dir))
    segments = segments.withColumn("pages", F.when(F.col("id") % 5 == 0, F.array("page", F.col("page") + 1)).otherwise(F.array("page")))
    return A.batch_needs(segments, 3).select("doc_id", "batch", F.array_join(F.col("needs").cast("array<string>"), ",").alias("needs"))


@query(f"SELECT doc_id, block, page, kind, src, dst, flags FROM ({ORACLE_SQL['validate_flags']}) WHERE flags <> ''")
def review_items(spark, sf_dir):
    return validate_flags(spark, sf_dir).where("flags <> ''")


#: Blocks with tables (a note in an even place), scans, flags, translations and figure texts; and their Markdown.
_RICH = """{BLOCKS}, rich AS (SELECT * REPLACE (CASE WHEN kind = 'note' AND block % 2 = 0 THEN 'table' ELSE kind END AS kind, CASE WHEN kind = 'figure' AND block % 3 = 0 THEN 'scan' WHEN kind = 'note' AND block % 5 = 0 THEN '[Trang ' || text ELSE text END AS text), CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'x ' || text END AS dst, text AS plain FROM blocks)"""
_MARKDOWN = _RICH + """, tab AS (SELECT doc_id, block, list_transform(string_split(plain, '. '), lambda r: list_transform(string_split(r, ' '), lambda c: replace(CASE WHEN regexp_matches(c, '[A-Za-z]{3}') AND doc_id % 2 = 1 THEN '|' || c ELSE c END, '|', chr(92) || '|'))) AS rows FROM rich WHERE kind = 'table'),
wide AS (SELECT *, list_max(list_transform(rows, lambda r: len(r))) AS w FROM tab), tl AS (SELECT doc_id, block, list_transform(rows, lambda r: '| ' || array_to_string(list_concat(r, list_transform(range(w - len(r)), lambda i: '')), ' | ') || ' |') AS told, '|' || repeat(' --- |', w) AS rule FROM wide),
tm AS (SELECT doc_id, block, array_to_string(list_concat(told[:1], [rule], told[2:]), chr(10)) AS tm FROM tl),
p AS (SELECT doc_id, block, kind, concat_ws(chr(10) || chr(10), CASE WHEN doc_id % 3 > 0 AND lag(page) OVER (PARTITION BY doc_id ORDER BY block) IS DISTINCT FROM page THEN '<!-- Trang ' || page || ' -->' END,
CASE kind WHEN 'table' THEN tm WHEN 'figure' THEN concat_ws(chr(10) || chr(10), CASE WHEN text = 'scan' THEN '> *Trang ' || page || ' là ảnh scan — chưa đọc được chữ (OCR), giữ nguyên ảnh trang.*' END, CASE WHEN block % 2 = 0 THEN CASE WHEN text = 'scan' THEN '![Trang ' ELSE '![Hình — trang ' END || page || '](fig-' || block || ')' END,
  CASE WHEN block % 4 = 0 THEN '> **Chữ trong hình**' || chr(10) || '>' || chr(10) || '> - Aorta → động mạch' || chr(10) || '> - Vein' END) WHEN 'label' THEN NULL
ELSE CASE WHEN kind = 'note' AND starts_with(text, '[Trang ') THEN '> *' || text || '*' ELSE concat_ws(chr(10) || chr(10), CASE kind WHEN 'heading' THEN repeat('#', least(level, 3) + 1) || ' ' || coalesce(nullif(dst, ''), text) WHEN 'list' THEN '- ' || coalesce(nullif(dst, ''), text) WHEN 'note' THEN '> ' || coalesce(nullif(dst, ''), text) ELSE coalesce(nullif(dst, ''), text) END,
  CASE WHEN kind <> 'heading' THEN '> *Bản gốc:* ' || text END, CASE WHEN block % 6 = 0 THEN '<!-- ⚠ Cần kiểm tra: a; b -->' END) END END) AS part FROM rich LEFT JOIN tm USING (doc_id, block)),
md AS (SELECT doc_id, regexp_replace('# T' || doc_id || chr(10) || chr(10) || '> ' || CASE WHEN doc_id % 3 > 0 THEN 'Dịch từ **' || source || '** · ' ELSE '' END || 'Trang 1 · Máy dịch: m  ' || chr(10) || '> Bản dịch máy — cần đối chiếu bản gốc trước khi dùng cho mục đích chuyên môn.' || chr(10) || chr(10) || parts, '\\s+$', '') || chr(10) AS markdown
FROM (SELECT doc_id, coalesce(string_agg(part, chr(10) || chr(10) ORDER BY block) FILTER (part <> ''), '') AS parts FROM p GROUP BY doc_id) JOIN documents USING (doc_id))"""


def rich_blocks(spark, sf_dir) -> DataFrame:
    """The blocks of _RICH with rows, flags, links and items."""
    kind, block, text = F.col("kind"), F.col("block"), F.col("text")
    rows = _blocks(spark, sf_dir).withColumns({"plain": text, "kind": F.when((kind == "note") & (block % 2 == 0), "table").otherwise(kind), "text": F.when((kind == "figure") & (block % 3 == 0), "scan").when((kind == "note") & (block % 5 == 0), F.concat(F.lit("[Trang "), text)).otherwise(text)})
    items = F.from_json(F.lit('[{"en": "Aorta", "vi": "động mạch"}, {"en": "Vein", "vi": "vein "}]'), "array<struct<en:string,vi:string>>")
    return rows.withColumns({
        "dst": F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit("x "), text)), "rows": F.transform(F.split("plain", r"\. "), lambda r: F.split(r, " ")), "flags": F.when(block % 6 == 0, F.array(F.lit("a"), F.lit("b"))),
        "link": F.when(block % 2 == 0, F.format_string("fig-%d", "block")), "items": F.when(block % 4 == 0, items),
    })


def rich_markdown(spark, sf_dir) -> DataFrame:
    rows = rich_blocks(spark, sf_dir)
    tables = rows.where("kind = 'table'")
    cells = A.table_cells(tables).select("doc_id", "block", F.col("cell").alias("text"), F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("|"), "cell")).otherwise("").alias("dst"))
    done = A.translated_cells(tables, cells).withColumnRenamed("rows", "done")
    rows = rows.join(done, ["doc_id", "block"], "left").withColumn("rows", F.col("done")).drop("done")
    told = F.col("doc_id") % 3 > 0
    heads = _table(spark, sf_dir, "documents").select("doc_id", R.header(F.concat(F.lit("T"), F.col("doc_id").cast("string")), F.when(told, F.col("source")), F.lit("Trang 1"), F.lit("m"), F.lit("")).alias("head"), told.alias("paged"))
    return R.markdown(rows, heads, keep_source=True)


@query(f"WITH {_MARKDOWN} SELECT doc_id, sha256(markdown) AS digest FROM md")
def render_markdown(spark, sf_dir):
    return rich_markdown(spark, sf_dir).select("doc_id", F.sha2("markdown", 256).alias("digest"))


@query(f"WITH {_MARKDOWN} SELECT doc_id, sha256(regexp_replace(replace(replace(markdown, '&', '&amp;'), '<', '&lt;'), '&lt;(!-- (?:Trang \\d+|⚠ Cần kiểm tra: a; b) -->)', '<\\1', 'g')) AS digest FROM md")
def escape_preview(spark, sf_dir):
    return rich_markdown(spark, sf_dir).select("doc_id", F.sha2(A.escape_preview(F.col("markdown")), 256).alias("digest"))


@query("""SELECT doc_id, sha256(nfc_normalize(coalesce(text, '') || 'e' || chr(769))) AS digest FROM documents""")
def nfc_text(spark, sf_dir):
    ship(spark)
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("e\u0301"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.nfc(text), 256).alias("digest"))
