"""Queries of glossary, layout, rendering, translation and streaming operators, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as T
from ..operators import assembly as A, blocks as B, layout as L, rendering as R, terms as G, translation as X
from ..session import scratch_dir, ship
from ..sources import exchange, glossary
from ..streaming import assembly as S
from .queries import ORACLE_SQL, QUERIES, _PAIRS, _RICH, _blocks, _table, flags_sql, query, rich_blocks

# ---- glossary

#: Two files of terms from the benchmark: words of each item as en, variants and note; later files and lines win.
_TERMS = r"""raw AS (SELECT item_id, regexp_extract_all(text, '\p{L}+') AS w FROM benchmark),
tsv AS (SELECT 'a.tsv' AS file, item_id AS nr, lower(w[2]) AS en, 'v' || item_id || chr(9) AS vi, w[4] || ' ' || lower(w[5]) || '|' || w[6] AS variants, CASE WHEN item_id % 3 = 0 THEN upper(w[3]) ELSE '' END AS abbr, item_id % 5 = 0 AS ambiguous, CASE WHEN item_id % 2 = 0 THEN 'approved' ELSE 'draft' END AS status, 'n' AS note FROM raw
UNION ALL SELECT 'b.tsv', item_id, upper(w[2]), 'w' || item_id, '', '', false, 'draft', '' FROM raw WHERE item_id % 4 = 1),
terms AS (SELECT lower(en) AS key, en, trim(vi, chr(9)) AS vi, variants, abbr, '' AS domain, ambiguous, status, note, 'core' AS source FROM tsv QUALIFY row_number() OVER (PARTITION BY lower(en) ORDER BY file DESC, nr DESC) = 1)"""


def _terms(spark, sf_dir) -> DataFrame:
    w, n = F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)), F.col("item_id")
    rows = _table(spark, sf_dir, "benchmark").select("item_id", w.alias("w"))
    word = lambda i: F.get("w", F.lit(i - 1))
    tab = F.lit("\t")
    a = F.concat(F.lower(word(2)), F.lit(" "), tab, F.lit("v"), n.cast("string"), F.lit(" "), tab, word(4), F.lit(" "), F.lower(word(5)), F.lit("|"), word(6), tab, F.when(n % 3 == 0, T.upper(word(3))).otherwise(""), tab, tab, F.when(n % 5 == 0, "yes").otherwise("0"), tab, F.when(n % 2 == 0, "approved").otherwise(""), tab, F.lit("n\r"))
    b = F.concat(F.lit("w"), n.cast("string"), tab, T.upper(word(2)))
    made = rows.select(F.lit("a.tsv").alias("file"), n.cast("int").alias("at"), a.alias("value")).unionByName(rows.where("item_id % 4 = 1").select(F.lit("b.tsv").alias("file"), n.cast("int").alias("at"), b.alias("value")))
    more = spark.createDataFrame([("a.tsv", -3, "# terms"), ("a.tsv", -2, "\t".join(glossary.COLUMNS)), ("a.tsv", -1, "\tno en\t"), ("b.tsv", -2, ""), ("b.tsv", -1, "vi\ten")], "file string, at int, value string")
    return glossary.reloaded(glossary.parsed(made.unionByName(more), "core"))


@query(f"WITH {_TERMS} SELECT * FROM terms")
def glossary_terms(spark, sf_dir):
    ship(spark)
    return _terms(spark, sf_dir).select("key", *glossary.COLUMNS, "source")


_PLURALS = "list_filter([w || 's', CASE WHEN regexp_matches(w, '(s|x|z|ch|sh)$') THEN w || 'es' END, CASE WHEN regexp_matches(w, '[^aeiou]y$') THEN w[:-2] || 'ies' END, " + ", ".join(f"CASE WHEN w LIKE '%{a}' AND length(w) > {len(a) + 2} THEN w[:-{len(a) + 1}] || '{b}' END" for a, b in T.PLURALS) + "], lambda x: x IS NOT NULL)"
_FORMS = f"""{_TERMS}, phrases AS (SELECT key, abbr, unnest(list_distinct(list_concat([en], list_filter(list_transform(string_split(variants, '|'), lambda v: trim(v)), lambda v: v <> '')))) AS phrase FROM terms),
parts AS (SELECT *, regexp_extract(phrase, '^(.*\\s)?(\\p{{Ll}}+)$', 1) AS head, regexp_extract(phrase, '^(.*\\s)?(\\p{{Ll}}+)$', 2) AS w FROM phrases),
every AS (SELECT key, abbr, phrase AS form FROM parts UNION SELECT key, abbr, head || unnest({_PLURALS}) FROM parts WHERE w <> '' UNION SELECT key, abbr, abbr FROM terms WHERE length(abbr) >= 2),
forms AS (SELECT CASE WHEN form = abbr THEN form ELSE lower(form) END AS lookup, min(key) AS key FROM every GROUP BY ALL)"""


@query(f"WITH {_FORMS} SELECT lookup, lower(lookup) AS match_key, key, CAST(len(regexp_extract_all(lookup, '[\\p{{L}}\\p{{N}}_-]+')) AS INT) AS words FROM forms")
def surface_forms(spark, sf_dir):
    ship(spark)
    return G.surface_forms(_terms(spark, sf_dir)).select("lookup", "match_key", "key", "words")


#: The scan from word to word: of each start the longest form (of three words at most), each match pointing to the next start after its end.
_WORD = "[\\p{L}\\p{N}_-]"
_MET = f"""{_FORMS}, pc AS (SELECT doc_id, block, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, block, regexp_extract_all(text, '{_WORD}+[^{_WORD[1:]}*') AS p FROM blocks)),
ld AS (SELECT doc_id, block, i, piece, lead(piece, 1) OVER w AS p2, lead(piece, 2) OVER w AS p3 FROM pc WINDOW w AS (PARTITION BY doc_id, block ORDER BY i)),
sp AS (SELECT doc_id, block, i, n, regexp_replace(s, '[^{_WORD[1:]}+$', '') AS span FROM (SELECT doc_id, block, i, 1 AS n, piece AS s FROM ld UNION ALL SELECT doc_id, block, i, 2, piece || p2 FROM ld WHERE p2 IS NOT NULL UNION ALL SELECT doc_id, block, i, 3, piece || p2 || p3 FROM ld WHERE p3 IS NOT NULL)),
c1 AS (SELECT doc_id, block, i, max(n) AS n, arg_max(span, n) AS surface FROM sp WHERE lower(span) IN (SELECT lower(lookup) FROM forms) GROUP BY ALL),
nx AS (SELECT a.doc_id, a.block, a.i, a.surface, b.i AS following FROM c1 a ASOF LEFT JOIN c1 b ON a.doc_id = b.doc_id AND a.block = b.block AND a.i + a.n <= b.i),
taken AS (SELECT * FROM (SELECT * FROM nx QUALIFY i = min(i) OVER (PARTITION BY doc_id, block)) UNION ALL SELECT nx.* FROM taken w JOIN nx ON nx.doc_id = w.doc_id AND nx.block = w.block AND nx.i = w.following),
met AS (SELECT doc_id, block, coalesce(e.key, f.key) AS key, min(i) AS nth FROM taken t LEFT JOIN forms e ON e.lookup = t.surface LEFT JOIN forms f ON f.lookup = lower(t.surface) WHERE coalesce(e.key, f.key) IS NOT NULL GROUP BY ALL)"""


@query(f"WITH RECURSIVE {{BLOCKS}}, {_MET} SELECT doc_id, block, key, CAST(row_number() OVER (PARTITION BY doc_id, block ORDER BY nth) AS INT) AS nth FROM met")
def term_match(spark, sf_dir):
    ship(spark)
    forms = G.surface_forms(_terms(spark, sf_dir))
    nth = F.row_number().over(Window.partitionBy("doc_id", "block").orderBy("at"))
    return G.match_terms(_blocks(spark, sf_dir).select("doc_id", "block", "text"), forms, ["doc_id", "block"]).select("doc_id", "block", "key", nth.alias("nth"))


@query(f"""WITH RECURSIVE {{BLOCKS}}, {_MET}, e AS (SELECT doc_id, block, kind, sum(CASE WHEN level BETWEEN 1 AND 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block) AS epoch FROM blocks)
SELECT doc_id, block, key AS term, NOT ambiguous AND max(CASE WHEN kind <> 'label' AND NOT ambiguous THEN 1 END) OVER (PARTITION BY doc_id, epoch, key ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NULL AS "first" FROM met JOIN e USING (doc_id, block) JOIN terms USING (key)""")
def bilingual_terms(spark, sf_dir):
    ship(spark)
    blocks, terms = _blocks(spark, sf_dir), _terms(spark, sf_dir)
    met = G.match_terms(blocks.select("doc_id", "block", "text"), G.surface_forms(terms), ["doc_id", "block"])
    mentions = met.join(terms.select("key", "ambiguous"), "key").select("doc_id", "block", F.col("key").alias("term"), "ambiguous")
    return B.first_mention(mentions, blocks).select("doc_id", "block", "term", "first")


@query(f"WITH {_TERMS} SELECT key, en, vi FROM terms WHERE contains(lower(en), 'th') OR contains(lower(vi), 'th') OR contains(lower(abbr), 'th') ORDER BY lower(en), key LIMIT 500")
def term_search(spark, sf_dir):
    ship(spark)
    return G.search(_terms(spark, sf_dir), " TH ").select("key", "en", "vi")


@query(f"WITH {_TERMS} SELECT key, CASE WHEN own IS NULL THEN vi ELSE 'own' || own END AS vi, CASE WHEN own IS NULL THEN en ELSE upper(key) END AS en FROM terms LEFT JOIN (SELECT key AS key, max(item_id) AS own FROM (SELECT lower(w[2]) AS key, item_id FROM raw WHERE item_id % 6 = 0) GROUP BY ALL) USING (key) UNION ALL SELECT 'new term', 'moi', 'New Term'")
def glossary_upsert(spark, sf_dir):
    ship(spark)
    terms = _terms(spark, sf_dir)
    word = F.get(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)), F.lit(1))
    own = _table(spark, sf_dir, "benchmark").where("item_id % 6 = 0").groupBy(F.concat(F.lit(" "), T.upper(word)).alias("en")).agg(F.concat(F.lit("own"), F.max("item_id").cast("string")).alias("vi"))
    own = own.unionByName(spark.createDataFrame([("New Term", " moi ")], "en string, vi string"))
    rest = [F.lit("").alias(c) for c in ("key", "variants", "abbr", "domain")] + [F.lit(False).alias("ambiguous"), F.lit("draft").alias("status"), F.lit("").alias("note"), F.lit("user").alias("source")]
    return G.upsert(terms, own.select("*", *rest)).select("key", "vi", "en")


# ---- segments and cells

_SEGMENTS = _RICH + r""", cl AS (SELECT doc_id, block, page, unnest(x) AS text, generate_subscripts(x, 1) AS nth FROM (SELECT doc_id, block, page, list_concat(*) AS x FROM (SELECT doc_id, block, page, regexp_split_to_array(plain, '(\. | )') AS x FROM rich WHERE kind = 'table')))""".replace("list_concat(*) AS x", "x") + r""",
cells AS (SELECT doc_id, block, page, text, min(nth) AS nth FROM cl WHERE regexp_matches(text, '[A-Za-z]{3}') GROUP BY ALL),
every AS (SELECT doc_id, block, -1 AS pos, page, kind, text FROM rich WHERE kind NOT IN ('table', 'figure') AND NOT (kind = 'note' AND starts_with(text, '[Trang ')) UNION ALL SELECT doc_id, block, nth, page, 'cell', text FROM cells),
seg AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block, pos) - 1 AS id FROM every)"""


@query(f"WITH {_SEGMENTS} SELECT doc_id, block, page, kind, text, CAST(id AS INT) AS id FROM seg")
def segment_rows(spark, sf_dir):
    return A.segments(rich_blocks(spark, sf_dir)).select("doc_id", "block", "page", "kind", "text", "id")


@query(_RICH.join(("WITH ", r""", rows AS (SELECT doc_id, block, list_transform(string_split(plain, '. '), lambda r: list_transform(string_split(r, ' '), lambda c: CASE WHEN regexp_matches(c, '[A-Za-z]{3}') AND length(c) % 2 = 0 THEN c || '+' ELSE c END)) AS rows FROM rich WHERE kind = 'table')
SELECT doc_id, block, array_to_string(list_transform(rows, lambda r: array_to_string(r, '|')), chr(10)) AS rows FROM rows""")))
def cell_translations(spark, sf_dir):
    tables = rich_blocks(spark, sf_dir).where("kind = 'table'")
    cells = A.cell_segments(tables).withColumn("dst", F.when(F.length("text") % 2 == 0, F.concat("text", F.lit("+"))))
    return A.translated_cells(tables, cells).select("doc_id", "block", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n").alias("rows"))


# ---- layout

#: Words of every line as spans in rows of nine.
_SPANS = r"""{BLOCKS}, wl AS (SELECT doc_id, page, block, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS n FROM (SELECT doc_id, page, block, string_split(text, ' ') AS w FROM blocks)),
spans AS (SELECT doc_id, page, block, n // 9 AS line, n % 9 AS span, word || CASE WHEN n % 9 = 8 AND n % 2 = 0 THEN '-' ELSE ' ' END AS text, 9 + length(word) % 3 + 0.04 AS size, CAST(length(word) % 2 * 255 AS INT) AS color, length(word) > 6 AS bold FROM wl)"""


def _spans(spark, sf_dir) -> DataFrame:
    words = _blocks(spark, sf_dir).select("doc_id", "page", "block", F.posexplode(F.split("text", " ")).alias("n", "word"))
    n, size = F.col("n"), F.length("word")
    ending = F.when((n % 9 == 8) & (n % 2 == 0), "-").otherwise(" ")
    return words.select("doc_id", "page", "block", F.floor(n / 9).alias("line"), (n % 9).alias("span"), F.concat("word", ending).alias("text"), (9 + size % 3 + 0.04).cast("double").alias("size"), (size % 2 * 255).alias("color"), (size > 6).alias("bold"))


@query(f"""WITH {_SPANS}, t AS (SELECT *, length(trim(text)) AS k FROM spans), ln AS (SELECT doc_id, block, line, trim(string_agg(text, '' ORDER BY span)) AS said, sum(k) AS k, sum(CASE WHEN bold THEN k ELSE 0 END) AS heavy FROM t GROUP BY ALL),
lk AS (SELECT *, lead(said) OVER (PARTITION BY doc_id, block ORDER BY line) AS following FROM ln WHERE said <> ''),
bl AS (SELECT doc_id, block, string_agg(CASE WHEN following IS NULL THEN said WHEN regexp_matches(said, '\\p{{L}}-$') AND regexp_matches(following, '^\\p{{Ll}}') THEN left(said, length(said) - 1) WHEN regexp_matches(following, '^[•●○◦▪■□▸►‣–*·] ') THEN said || chr(10) ELSE said || ' ' END, '' ORDER BY line) AS text, sum(heavy) / sum(k) AS bold, CAST(count(*) AS INT) AS lines FROM lk GROUP BY ALL),
sz AS (SELECT * FROM (SELECT doc_id, block, round(size, 1) AS size, sum(k) AS w, min(line * 100 + span) AS f FROM t GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id, block ORDER BY w DESC, f) = 1),
co AS (SELECT * FROM (SELECT doc_id, block, color, sum(k) AS w, min(line * 100 + span) AS f FROM t GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id, block ORDER BY w DESC, f) = 1)
SELECT doc_id, block, sha256(trim(regexp_replace(text, '[ \\t]+', ' ', 'g'))) AS digest, CAST(round(bold * 1000) AS INT) AS bold, lines, CAST(round(size * 10) AS INT) AS size, color FROM bl JOIN sz USING (doc_id, block) JOIN co USING (doc_id, block)""")
def span_blocks(spark, sf_dir):
    rows = L.blocks_of_spans(_spans(spark, sf_dir))
    return rows.select("doc_id", "block", F.sha2("text", 256).alias("digest"), F.round(F.col("bold") * 1000).cast("int").alias("bold"), "lines", F.round(F.col("size") * 10).cast("int").alias("size"), "color")


@query(f"""WITH {_SPANS}, c AS (SELECT * FROM (SELECT doc_id, block, size, count(*) AS n FROM spans WHERE trim(text) <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id, block ORDER BY n DESC, size) = 1) SELECT doc_id, block, CAST(round(size * 100) AS INT) AS size FROM c""")
def common_sizes(spark, sf_dir):
    return L.common_size(_spans(spark, sf_dir)).select("doc_id", "block", F.round(F.col("size") * 100).cast("int").alias("size"))


@query(_RICH.join(("WITH ", r""", raw AS (SELECT doc_id, block, list_concat([['', '  ']], list_transform(string_split(plain, '. '), lambda r: list_transform(string_split(r, ', '), lambda c: trim(regexp_replace('  ' || c || chr(10), '\s+', ' ', 'g'))))) AS rows FROM rich WHERE kind = 'table'),
good AS (SELECT doc_id, block, list_filter(list_transform(rows, lambda r: list_transform(r, lambda c: trim(c))), lambda r: len(list_filter(r, lambda c: c <> '')) > 0) AS rows FROM raw)
SELECT doc_id, block, array_to_string(list_transform(rows, lambda r: array_to_string(r, '|')), chr(10)) AS rows FROM good WHERE len(rows) >= 2 AND list_max(list_transform(rows, lambda r: len(r))) >= 2""")))
def clean_tables(spark, sf_dir):
    tables = rich_blocks(spark, sf_dir).where("kind = 'table'")
    rows = F.concat(F.array(F.array(F.lit(None).cast("string"), F.lit("  "))), F.transform(F.split("plain", r"\. "), lambda r: F.transform(F.split(r, ", "), lambda c: F.concat(F.lit("  "), c, F.lit("\n")))))
    return L.clean_tables(tables.withColumn("rows", rows)).select("doc_id", "block", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n").alias("rows"))


_SHARED = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_AREA = "greatest(0, a.x1 - a.x0) * greatest(0, a.y1 - a.y0)"


@query(f"""WITH {{BLOCKS}}, t AS (SELECT * FROM blocks WHERE kind = 'note') SELECT doc_id, block FROM blocks a WHERE kind <> 'note' AND NOT EXISTS (SELECT 1 FROM t b WHERE b.doc_id = a.doc_id AND b.page = a.page AND {_AREA} > 0 AND {_SHARED} > 0.5 * {_AREA})""")
def outside_tables(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    return L.outside_tables(blocks.where("kind <> 'note'"), blocks.where("kind = 'note'")).select("doc_id", "block")


#: Drawn boxes: text blocks grown to 150 points of height, on pages of 600 by 800.
_DRAWN = f"""{{BLOCKS}}, g AS (SELECT * REPLACE (y0 + 30 + 40 * (block % 5) AS y1, x0 + width * (1 + block % 3) // 2 AS x1) FROM blocks WHERE kind <> 'note'), c AS (SELECT doc_id, page, block, greatest(x0, 0) AS x0, greatest(y0, 0) AS y0, least(x1, 600) AS x1, least(y1, 800) AS y1 FROM g), t AS (SELECT * FROM blocks WHERE kind = 'note'),
drawn AS (SELECT * FROM c a WHERE x1 - x0 >= 40 AND y1 - y0 >= 40 AND {_AREA} BETWEEN 0.008 * 480000 AND 0.92 * 480000 AND NOT EXISTS (SELECT 1 FROM t b WHERE b.doc_id = a.doc_id AND b.page = a.page AND {_SHARED} > 0.5 * {_AREA}))"""


def _drawn(spark, sf_dir) -> DataFrame:
    blocks = _blocks(spark, sf_dir)
    grown = blocks.where("kind <> 'note'").withColumns({"y1": F.col("y0") + 30 + 40 * (F.col("block") % 5), "x1": F.col("x0") + F.floor(F.col("width") * (1 + F.col("block") % 3) / 2).cast("int")})
    return L.figure_candidates(grown, blocks.where("kind = 'note'"))


@query(f"WITH {_DRAWN} SELECT doc_id, block, CAST(x0 AS INT) AS x0, CAST(y0 AS INT) AS y0, CAST(x1 AS INT) AS x1, CAST(y1 AS INT) AS y1 FROM drawn")
def figure_candidates(spark, sf_dir):
    return _drawn(spark, sf_dir).select("doc_id", "block", *(F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")))


@query(None)
def united_figures(spark, sf_dir):
    """Closures aren't SQL: a union can reach a box that no part of it touches; tests hold it against brute force."""
    ship(spark)
    return L.united_figures(_drawn(spark, sf_dir))


@query("""WITH {BLOCKS}, p AS (SELECT doc_id, page, count_if(kind = 'para') AS paras, count_if(kind = 'note') AS notes, count_if(kind = 'figure') AS images FROM blocks GROUP BY ALL) SELECT doc_id, page, 'figure' AS kind, 'scan' AS text FROM p WHERE paras = 0 AND notes = 0 AND images > 0""")
def scan_pages(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    of = lambda k: blocks.where(F.col("kind") == k)
    return L.scan_pages(blocks.select("doc_id", "page").distinct(), of("para"), of("note"), of("figure")).select("doc_id", "page", "kind", "text")


@query("""WITH {BLOCKS}, p AS (SELECT doc_id, page, count_if(kind = 'figure') > 0 AS scanned, count(*) OVER (PARTITION BY doc_id) AS total FROM blocks GROUP BY doc_id, page), s AS (SELECT *, greatest(1, total // 40) AS stride FROM p)
SELECT doc_id, total AS pages, CAST(round_even(count_if(scanned) * total / count(*), 0) AS BIGINT) AS scanned_pages FROM s WHERE (page - 1) % stride = 0 GROUP BY doc_id, total""")
def scanned_estimate(spark, sf_dir):
    pages = _blocks(spark, sf_dir).groupBy("doc_id", "page").agg((F.count_if(F.col("kind") == "figure") > 0).alias("scanned"))
    return L.scanned_estimate(pages)


@query(f"""WITH {{BLOCKS}}, f AS (SELECT * REPLACE (y0 - 250 AS y0, y0 + 450 AS y1, x0 - 300 AS x0, x0 + 500 AS x1) FROM blocks WHERE kind = 'figure') SELECT doc_id, block, CASE WHEN EXISTS (SELECT 1 FROM f b WHERE b.doc_id = a.doc_id AND b.page = a.page AND {_SHARED} > 0.8 * greatest({_AREA}, 1e-6)) THEN 'label' ELSE kind END AS kind FROM blocks a WHERE kind <> 'figure'""")
def label_blocks(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    figures = blocks.where("kind = 'figure'").withColumns({"y0": F.col("y0") - 250, "y1": F.col("y0") + 450, "x0": F.col("x0") - 300, "x1": F.col("x0") + 500})
    return L.mark_labels(blocks.where("kind <> 'figure'"), figures).select("doc_id", "block", "kind")


_OWNERS = f"""{{BLOCKS}}, f AS (SELECT * REPLACE (y0 - 250 AS y0, y0 + 450 AS y1, x0 - 300 AS x0, x0 + 500 AS x1) FROM blocks WHERE kind = 'figure'), m AS (SELECT a.doc_id, a.block AS label, b.block AS figure, a.text AS en, {_SHARED} AS shared, greatest({_AREA}, 1e-6) AS own FROM blocks a JOIN f b ON b.doc_id = a.doc_id AND b.page = a.page WHERE a.kind = 'para'),
owners AS (SELECT doc_id, label, figure, en FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, label ORDER BY shared DESC, figure) = 1) WHERE shared > 0.5 * own)"""


def _owners(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    blocks = _blocks(spark, sf_dir)
    figures = blocks.where("kind = 'figure'").withColumns({"y0": F.col("y0") - 250, "y1": F.col("y0") + 450, "x0": F.col("x0") - 300, "x1": F.col("x0") + 500})
    return blocks, figures, L.label_owners(blocks.where("kind = 'para'"), figures)


@query(f"WITH {_OWNERS} SELECT doc_id, label, figure FROM owners")
def label_owners(spark, sf_dir):
    return _owners(spark, sf_dir)[2]


@query("""WITH {BLOCKS} SELECT a.doc_id, a.block, greatest(a.y1, least(768.0, coalesce((SELECT min(b.y0) - 2 FROM blocks b WHERE b.doc_id = a.doc_id AND b.page = a.page AND b.x0 < a.x1 - 2 AND b.x1 > a.x0 + 2 AND b.y0 >= a.y1 - 1), 768.0)))::DOUBLE AS "limit" FROM blocks a""")
def room_below(spark, sf_dir):
    return L.room_below(_blocks(spark, sf_dir)).select("doc_id", "block", "limit")


@query("""WITH {BLOCKS}, p AS (SELECT doc_id, list_sort(list(DISTINCT page) FILTER (kind = 'para')) AS sel, max(page) AS total FROM blocks GROUP BY doc_id HAVING count_if(kind = 'para') > 0),
s AS (SELECT doc_id, list_sort(list_distinct(list_concat(list_concat(list_filter(sel, lambda x, i: (i - 1) % greatest(1, len(sel) // 30) = 0), list_filter(range(sel[1] - 6, sel[1] + 7), lambda x: x BETWEEN 1 AND total)), range(1, total + 1, greatest(1, total // 12))))) AS pages FROM p) SELECT doc_id, array_to_string(pages, ',') AS pages FROM s""")
def margin_sample(spark, sf_dir):
    pages = _blocks(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.when(F.col("kind") == "para", F.col("page")))).alias("sel"), F.max("page").alias("total")).where(F.size("sel") > 0)
    return pages.select("doc_id", F.array_join(B.sample_pages(F.col("sel"), F.col("total")).cast("array<string>"), ",").alias("pages"))


# ---- figure texts and output

_KEY = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_FIGURE_TEXTS = f"""{_OWNERS}, rd AS (SELECT doc_id, figure, CAST(t.pos AS INT) AS pos, CASE t.pos WHEN 0 THEN '(' || en || '!' WHEN 1 THEN 'Aorta' WHEN 2 THEN '12 mm' ELSE 'AORTA.' END AS en, CASE t.pos WHEN 1 THEN 'dong mach' ELSE '' END AS vi FROM (SELECT doc_id, figure, min(en) AS en FROM owners GROUP BY ALL), (VALUES (0), (1), (2), (3)) t(pos)),
al AS (SELECT doc_id, figure, 0 AS fr, label AS nr, trim(regexp_replace(en, '\\s+', ' ', 'g')) AS en, 'nhan' AS vi FROM owners UNION ALL SELECT doc_id, figure, 1, pos, en, vi FROM rd),
w AS (SELECT * FROM al WHERE len(list_filter(regexp_extract_all(en, '\\p{{L}}{{2,}}'), lambda x: lower(x) NOT IN ({", ".join(f"'{u}'" for u in T.UNITS)}))) > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, figure, {_KEY.format('en')} ORDER BY fr, nr) AS again FROM w), ft AS (SELECT doc_id, figure, CAST(row_number() OVER (PARTITION BY doc_id, figure ORDER BY fr, nr) - 1 AS INT) AS pos, en, vi FROM k WHERE fr = 0 OR again = 1)"""


def _figure_texts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    blocks, figures, owners = _owners(spark, sf_dir)
    owned = owners.join(blocks.select("doc_id", F.col("block").alias("label"), F.col("text").alias("en")), ["doc_id", "label"]).withColumn("vi", F.lit("nhan"))
    lines = owned.groupBy("doc_id", "figure").agg(F.min("en").alias("en"))
    items = F.array(F.struct(F.concat(F.lit("("), "en", F.lit("!")).alias("en"), F.lit("").alias("vi")), F.struct(F.lit("Aorta").alias("en"), F.lit("dong mach").alias("vi")), F.struct(F.lit("12 mm").alias("en"), F.lit("").alias("vi")), F.struct(F.lit("AORTA.").alias("en"), F.lit("").alias("vi")))
    good = F.to_json(F.struct(F.format_string("fig-%04d", "figure").alias("figure"), items.alias("items")))
    stale = F.to_json(F.struct(F.format_string("fig-%04d", "figure").alias("figure"), F.slice(items, 1, 1).alias("items")))
    told = F.explode(F.array(F.struct(F.lit("figure_texts_1.jsonl").alias("file"), F.lit(0).alias("at"), stale.alias("value")), F.struct(F.lit("figure_texts_2.jsonl").alias("file"), F.lit(0).alias("at"), good.alias("value")), F.struct(F.lit("figure_texts_2.jsonl").alias("file"), F.lit(1).alias("at"), F.lit("{broken").alias("value"))))
    read = exchange.figure_texts(lines.select("doc_id", told.alias("t")).select("doc_id", "t.*"))
    return R.figure_texts(owned, read.where("pos is not null")), figures


@query(f"WITH {_FIGURE_TEXTS} SELECT * FROM ft")
def figure_texts(spark, sf_dir):
    return _figure_texts(spark, sf_dir)[0]


_LINE = f"CASE WHEN vi <> '' AND {_KEY.format('vi')} <> {_KEY.format('en')} THEN en || ' → ' || vi ELSE en END"


@query(f"""WITH {_FIGURE_TEXTS}, n AS (SELECT doc_id, figure, 'Chữ trong hình (Anh → Việt):' || chr(10) || string_agg('• ' || {_LINE}, chr(10) ORDER BY pos) AS note FROM ft GROUP BY ALL)
SELECT doc_id, page, string_agg(figure || ':' || note, '|' ORDER BY figure) AS notes FROM n JOIN f ON f.doc_id = n.doc_id AND f.block = n.figure WHERE page % 2 = 1 GROUP BY ALL""".replace("SELECT doc_id, page, string_agg", "SELECT n.doc_id, page, string_agg"))
def page_notes(spark, sf_dir):
    texts, figures = _figure_texts(spark, sf_dir)
    notes = R.page_notes(R.figure_items(texts), figures, figures.where("page % 2 = 1").select("doc_id", "page"))
    return notes.select("doc_id", "page", F.array_join(F.transform("notes", lambda x: F.concat(x["figure"].cast("string"), F.lit(":"), x["note"])), "|").alias("notes"))


@query(f"""WITH {_OWNERS}, kn AS (SELECT doc_id, figure, string_agg(trim(regexp_replace(en, '\\s+', ' ', 'g')), '|' ORDER BY label) AS known FROM owners GROUP BY ALL)
SELECT f.doc_id, printf('fig-%04d', f.block) AS figure, page, 'hinh-agent/' || printf('fig-%04d', f.block) || '.png' AS image, coalesce(known, '') AS known FROM f LEFT JOIN kn ON kn.doc_id = f.doc_id AND kn.figure = f.block""")
def figure_tasks(spark, sf_dir):
    blocks, figures, owners = _owners(spark, sf_dir)
    labels = owners.join(blocks.select("doc_id", F.col("block").alias("label"), F.col("text").alias("en")), ["doc_id", "label"])
    return R.figure_tasks(figures, labels).withColumn("known", F.array_join("known", "|"))


@query("""WITH RECURSIVE {BLOCKS}, toc AS (SELECT doc_id, block, level, page AS start FROM blocks WHERE level > 0), sel AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) * 2 AS new FROM (SELECT DISTINCT doc_id, page FROM blocks WHERE page % 3 > 0)),
en AS (SELECT t.doc_id, block, level, new, row_number() OVER (PARTITION BY t.doc_id ORDER BY block) AS n FROM toc t JOIN sel s ON s.doc_id = t.doc_id AND s.page = t.start),
w AS (SELECT doc_id, n, block, level, new, level <= 1 AS kept, CASE WHEN level <= 1 THEN level ELSE 0 END AS last FROM en WHERE n = 1 UNION ALL SELECT e.doc_id, e.n, e.block, e.level, e.new, e.level <= w.last + 1, CASE WHEN e.level <= w.last + 1 THEN e.level ELSE w.last END FROM w JOIN en e ON e.doc_id = w.doc_id AND e.n = w.n + 1)
SELECT doc_id, block AS pos, level, CAST(new AS INT) AS page FROM w WHERE kept""")
def outline_remap(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    toc = blocks.where("level > 0").select("doc_id", F.col("block").alias("pos"), "level", F.col("text").alias("title"), F.col("page").alias("start"))
    return R.outline_of(toc, blocks.where("page % 3 > 0").select("doc_id", "page"), interleave=True).select("doc_id", "pos", "level", "page")


@query("""SELECT doc_id, coalesce(nullif(left(lower(trim(regexp_replace(regexp_replace(replace(replace(strip_accents(left(text, 90)), 'đ', 'd'), 'Đ', 'D'), '[^\\x00-\\x7F]', '', 'g'), '[^A-Za-z0-9]+', '-', 'g'), '-')), 60), ''), 'tai-lieu') AS slug FROM documents""")
def slugs(spark, sf_dir):
    ship(spark)
    return _table(spark, sf_dir, "documents").select("doc_id", T.slug(F.left("text", F.lit(90))).alias("slug"))


@query("""WITH {BLOCKS} SELECT doc_id, block, sha256('<div style="font-size: ' || printf('%.2f', size / 4) || 'px; line-height: ' || CASE WHEN kind IN ('heading', 'label', 'cell') THEN '1.15' ELSE '1.22' END || '; color: #' || printf('%06x', (doc_id * 7919 + block) % 16777216) || '; text-align: ' || CASE WHEN kind = 'para' THEN 'justify' ELSE 'left' END || ';' || CASE WHEN bold > 0.6 THEN ' font-weight: bold;' ELSE '' END || '">' ||
replace(replace(replace(replace(replace(replace(text || chr(10) || '<a & "b">', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), chr(10), '<br>') || '</div>') AS digest FROM blocks""")
def placed_html(spark, sf_dir):
    html = T.placed_html(F.concat("text", F.lit('\n<a & "b">')), F.col("kind"), F.col("size") / 4, (F.col("doc_id") * 7919 + F.col("block")) % 16777216, F.col("bold") > 0.6)
    return _blocks(spark, sf_dir).select("doc_id", "block", F.sha2(html, 256).alias("digest"))


@query(None)
def placements(spark, sf_dir):
    """Pieces whose cut depends on the cut before aren't SQL; tests hold them against brute force."""
    ship(spark)
    parts = F.transform(F.sequence(F.lit(0), F.col("block") % 3), lambda i: F.struct((F.col("page") + i).alias("page"), "x0", "y0", "x1", "y1", "size", F.lit(0).alias("color"), (F.col("bold") > 0.6).alias("bold"), (10 + 7 * i).alias("nchars")))
    rows = _blocks(spark, sf_dir).withColumns({"parts": parts, "dst": F.when(F.col("block") % 4 == 0, F.col("text")).otherwise(F.upper("text"))})
    return R.placements(rows)


@query(_RICH.join(("WITH ", r""", cl AS (SELECT doc_id, block, page, r, unnest(x) AS text, generate_subscripts(x, 1) - 1 AS c FROM (SELECT doc_id, block, page, generate_subscripts(y, 1) - 1 AS r, string_split(unnest(y), ' ') AS x FROM (SELECT doc_id, block, page, string_split(plain, '. ') AS y FROM rich WHERE kind = 'table')))
SELECT doc_id, block, page, CAST(r AS INT) AS r, CAST(c AS INT) AS c, c * 10 + 1.5 AS x0, r * 10 + 1.0 AS y0, c * 10 + 8.5 AS x1, r * 10 + 9.0 AS y1, reverse(text) AS text FROM cl WHERE c % 4 < 3 AND regexp_matches(text, '[A-Za-z]{3}') AND reverse(text) <> text""")))
def cell_placements(spark, sf_dir):
    tables = rich_blocks(spark, sf_dir).where("kind = 'table'")
    box = lambda r, c: F.when(c % 4 < 3, F.array(*(x.cast("double") for x in (c * 10, r * 10, c * 10 + 10, r * 10 + 10))))
    tables = tables.withColumn("boxes", F.transform("rows", lambda row, r: F.transform(row, lambda _, c: box(r, c))))
    cells = A.cell_segments(tables).withColumn("dst", F.reverse("text"))
    return R.cell_placements(tables, cells).select("doc_id", "block", "page", "r", "c", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")), "text")


# ---- agents, translation, streams

@query(f"""WITH {_SEGMENTS}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM seg WHERE kind = 'cell' OR kind = 'label')
SELECT doc_id, id, CAST(id // CAST(ceil(n / least(3, n)) AS BIGINT) AS INT) AS part, sha256('{{"id":' || id || ',"kind":"' || kind || '","page":' || page || ',"section":"","previous":"","src":' || to_json(text) || '}}') AS record FROM n""".replace("SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM seg WHERE kind = 'cell' OR kind = 'label'", "SELECT * REPLACE (row_number() OVER (PARTITION BY doc_id ORDER BY id) - 1 AS id), count(*) OVER (PARTITION BY doc_id) AS n FROM seg WHERE kind IN ('cell', 'label')"))
def agent_records(spark, sf_dir):
    rows = A.segments(rich_blocks(spark, sf_dir)).where("kind in ('cell', 'label')").withColumns({"section": F.lit(""), "previous": F.lit("")})
    rows = rows.withColumn("id", F.row_number().over(Window.partitionBy("doc_id").orderBy("id")) - 1)
    return R.task_records(rows, 3).select("doc_id", "id", "part", F.sha2("record", 256).alias("record"))


#: Lines of two files a document: broken, without id, numbers as text, and a later file that wins.
_AGENT = f"""{_PAIRS}, seg AS (SELECT doc_id, block, kind, src, dst, row_number() OVER (PARTITION BY doc_id ORDER BY block) - 1 AS id FROM d),
told AS (SELECT doc_id, id, CASE WHEN id % 4 = 3 THEN NULL WHEN id % 4 = 1 THEN 'Table 4 ' || dst ELSE dst END AS dst FROM seg),
asm AS (SELECT s.doc_id, s.id, s.kind, s.src, coalesce(regexp_replace(t.dst, '\\bTable\\s+(\\d)', 'Bảng \\1', 'g'), '') AS dst FROM seg s LEFT JOIN told t USING (doc_id, id))"""


@query(f"""WITH {{BLOCKS}}, {_AGENT} SELECT doc_id, id, sha256(regexp_replace(dst, '\\b(?:Fig\\.|Figure)\\s+(\\d)', 'Hình \\1', 'g')) AS dst, CASE WHEN dst = '' THEN '{X.AGENT_MISSING}' ELSE array_to_string({flags_sql()}, ';') END AS flags FROM (SELECT * REPLACE (nfc_normalize(regexp_replace(dst, '\\b(?:Fig\\.|Figure)\\s+(\\d)', 'Hình \\1', 'g')) AS dst) FROM asm)""")
def agent_translations(spark, sf_dir):
    ship(spark)
    return _agent(spark, sf_dir).select("doc_id", "id", F.sha2("dst", 256).alias("dst"), F.array_join("flags", ";").alias("flags"))


def _agent(spark, sf_dir) -> DataFrame:
    k, text, block = (F.col("doc_id") + F.col("block")) % 6, F.col("text"), F.col("block")
    rows = _blocks(spark, sf_dir).withColumns({"src": F.when(block % 7 == 0, F.substring(text, F.lit(1), 3 + block % 3)).when(block % 5 == 0, F.concat(F.lit("Fig. 2.1 and Table 3a: "), text, F.lit(" 7,5"))).otherwise(text), "kind": F.when(block % 7 == 0, "cell").otherwise(F.col("kind"))})
    src = F.col("src")
    rows = rows.withColumn("dst", F.when(k == 0, " ").when(k == 1, src).when(k == 2, F.left(src, F.lit(20))).when(k == 3, F.repeat(src, F.lit(3))).when(k == 4, "the vi1 of (the) and with").otherwise(F.concat(F.replace(src, F.lit("e"), F.lit("x")), F.lit(" Vi1 2.1"))))
    rows = rows.withColumn("id", F.row_number().over(Window.partitionBy("doc_id").orderBy("block")) - 1)
    n = F.col("id")
    dst = F.when(n % 4 == 1, F.concat(F.lit("Table 4 "), "dst")).otherwise(F.col("dst"))
    line = lambda i, d: F.to_json(F.struct(i.alias("id"), d.alias("dst")))
    told = F.array(
        F.struct(F.lit("translations_1.jsonl").alias("file"), F.lit(0).alias("at"), F.when(n % 4 == 3, F.lit('{"id": "x"')).otherwise(line(n, F.lit("old"))).alias("value")),
        F.struct(F.lit("translations_2.jsonl").alias("file"), F.lit(0).alias("at"), F.when(n % 4 == 3, F.to_json(F.struct(dst.alias("dst")))).otherwise(line(F.concat(F.lit(" "), n.cast("string")), dst)).alias("value")),
        F.struct(F.lit("translations_2.jsonl").alias("file"), F.lit(1).alias("at"), F.lit("").alias("value")),
    )
    lines = rows.select("doc_id", F.explode(told).alias("t")).select("doc_id", "t.*")
    segments = rows.select("doc_id", F.col("id").cast("bigint").alias("id"), "kind", F.col("src").alias("text"))
    return X.with_agent(segments, exchange.translations(lines))


@query(f"""WITH {{BLOCKS}}, {_AGENT}, c AS (SELECT *, CASE WHEN dst = '' THEN 1 ELSE len({flags_sql()}) END AS n FROM (SELECT * REPLACE (nfc_normalize(regexp_replace(dst, '\\b(?:Fig\\.|Figure)\\s+(\\d)', 'Hình \\1', 'g')) AS dst) FROM asm))
SELECT doc_id, count(*) AS segments, CAST(count_if(dst <> '') AS BIGINT) AS done, CAST(0 AS BIGINT) AS cached, CAST(count_if(n > 0) AS BIGINT) AS flagged, CAST(count_if(dst = '') AS BIGINT) AS missing FROM c GROUP BY doc_id""")
def task_counters(spark, sf_dir):
    ship(spark)
    return X.counters(_agent(spark, sf_dir))


@query(f"""WITH {{BLOCKS}}, {_AGENT}, c AS (SELECT *, CASE WHEN dst = '' THEN 1 ELSE len({flags_sql()}) END AS n FROM (SELECT * REPLACE (nfc_normalize(regexp_replace(dst, '\\b(?:Fig\\.|Figure)\\s+(\\d)', 'Hình \\1', 'g')) AS dst) FROM asm))
SELECT doc_id, id, kind FROM c WHERE n > 0 ORDER BY doc_id, id LIMIT 300""")
def review_report(spark, sf_dir):
    ship(spark)
    return X.review_report(_agent(spark, sf_dir)).select("doc_id", "id", "kind")


@query("""SELECT event_id AS id, event_type AS kind, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created FROM events WHERE event_type = 'view'""")
def job_list(spark, sf_dir):
    jobs = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created"))
    return X.job_list(jobs, "view")


@query("""SELECT count(*) AS "rows" FROM (SELECT DISTINCT sha256(text) FROM conversations)""")
def cache_size(spark, sf_dir):
    return X.cache_size(_table(spark, sf_dir, "conversations").select(T.cache_key(F.col("text")).alias("key")).distinct())


@query(None)
def extracted_blocks(spark, sf_dir):
    """All steps of extraction after each other; a plain version of the whole is in the tests."""
    docs, blocks = _table(spark, sf_dir, "documents"), _blocks(spark, sf_dir)
    raw = blocks.where("kind <> 'figure'").join(docs.select("doc_id", F.col("source").alias("book")), "doc_id").drop("kind", "level")
    edges = raw.where(B.in_margin()).select("book", F.col("doc_id").alias("page"), "text")
    repeated = B.repeated_lines(edges, docs.groupBy(F.col("source").alias("book")).agg(F.count("*").alias("n")), 0.02)
    media = blocks.where("kind = 'figure'").withColumn("text", F.lit(""))
    return A.extracted_blocks(raw, media, repeated).select("doc_id", "block", "kind", "page", "level", "n_parts", F.sha2("text", 256).alias("digest"))


#: What the stub makes of a paragraph, heading, label or note; a list keeps its lines.
_STUB = """t AS (SELECT doc_id, block, kind, text AS src, regexp_replace(text, '[A-Za-z]+', 'từ', 'g') AS raw FROM blocks WHERE kind IN ('heading', 'label', 'list') AND doc_id % 4 = 0),
u AS (SELECT *, regexp_replace(regexp_replace(raw, '^\\s+|\\s+$', '', 'g'), '^\\s*(bản dịch|translation|dịch|vietnamese)\\s*:\\s*', '', 'i') AS said FROM t),
v AS (SELECT *, CASE WHEN length(said) >= 2 AND left(said, 1) = right(said, 1) AND left(said, 1) IN ('"', '''', '“', '”') THEN trim(said[2:-2]) ELSE said END AS q FROM u),
z AS (SELECT doc_id, block, kind, src, nfc_normalize(CASE WHEN kind = 'list' THEN trim(regexp_replace(q, '^[-•*·]\\s*', '')) ELSE trim(regexp_replace(q, '\\s+', ' ', 'g')) END) AS dst FROM v)"""


@query(f"WITH {{BLOCKS}}, {_STUB} SELECT doc_id, block, CASE WHEN doc_id % 8 = 0 THEN sha256('cached') ELSE sha256(dst) END AS dst, doc_id % 8 = 0 AS cached, array_to_string({flags_sql()}, ';') AS flags FROM (SELECT * REPLACE (CASE WHEN doc_id % 8 = 0 THEN 'cached' ELSE dst END AS dst) FROM z)".replace("CASE WHEN doc_id % 8 = 0 THEN sha256('cached') ELSE sha256(dst) END", "sha256(dst)"))
def translate_stub(spark, sf_dir):
    ship(spark)
    folder = f"{scratch_dir(spark)}/translate-{uuid.uuid4().hex}"

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    segments = _blocks(spark, sf_dir).where("kind in ('heading', 'label', 'list') and doc_id % 4 = 0").withColumns({"section": F.format_string("%d-%d", "doc_id", "block"), "previous": F.lit("")})
    cache = X.prompts(segments.where("doc_id % 8 = 0"), "stub").select("key", F.lit("cached").alias("dst")).distinct()
    done, _ = X.translate(segments.select("doc_id", "block", "kind", "text", "section", "previous"), cache, X.stub, "stub", keep)
    return done.select("doc_id", "block", F.sha2("dst", 256).alias("dst"), "cached", F.array_join("flags", ";").alias("flags"))


@query("""WITH k AS (SELECT sha256(text) AS key, role AS dst, conv_id, turn FROM conversations), c AS (SELECT key, min(dst) AS dst FROM k WHERE turn % 2 = 0 GROUP BY key), m AS (SELECT key, max('new ' || dst) AS dst FROM k WHERE conv_id % 3 = 0 GROUP BY key) SELECT coalesce(m.key, c.key) AS key, coalesce(m.dst, c.dst) AS dst FROM c FULL JOIN m USING (key)""")
def cache_upsert(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select(T.cache_key(F.col("text")).alias("key"), F.col("role").alias("dst"), "conv_id", "turn")
    return X.with_upserts(rows.where("turn % 2 = 0").groupBy("key").agg(F.min("dst").alias("dst")), rows.where("conv_id % 3 = 0").select("key", F.concat(F.lit("new "), "dst").alias("dst")))


@query("""WITH {BLOCKS}, s AS (SELECT doc_id, (page - 1) // 2 AS batch, count_if(kind <> 'figure') AS segments, max(CASE WHEN kind <> 'figure' AND block % 11 = 5 THEN 1 ELSE 0 END) AS lacks FROM blocks GROUP BY ALL),
o AS (SELECT *, max(lacks) OVER (PARTITION BY doc_id ORDER BY batch) AS stopped FROM s), d AS (SELECT DISTINCT doc_id FROM blocks WHERE kind <> 'figure' AND block % 11 <> 5) SELECT doc_id, CAST(batch AS INT) AS batch, CAST(segments AS INT) AS segments FROM o JOIN d USING (doc_id) WHERE stopped = 0""")
def release_stream(spark, sf_dir):
    ship(spark)
    base = f"{scratch_dir(spark)}/release-{uuid.uuid4().hex}"
    rows = _blocks(spark, sf_dir).withColumn("batch", F.floor((F.col("page") - 1) / 2).cast("int"))
    needs = rows.select("doc_id", "batch", F.when(F.col("kind") != "figure", F.col("block")).alias("id"))
    rows.where("kind <> 'figure' and block % 11 <> 5").select("doc_id", F.col("block").alias("id")).repartition(4).write.parquet(f"{base}/done")
    needs.write.parquet(f"{base}/needs")
    done = spark.readStream.schema("doc_id long, id int").option("maxFilesPerTrigger", 2).parquet(f"{base}/done")
    stream = S.release_stream(done, spark.read.parquet(f"{base}/needs")).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.schema("doc_id long, batch int, segments int").parquet(f"{base}/out")
