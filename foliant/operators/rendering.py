"""From translated segments to output: Markdown, figure texts, outlines, placed pieces, agent tasks."""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from . import blocks as B

# Texts of the rendered form.
SCAN = "> *Trang %d là ảnh scan — chưa đọc được chữ (OCR), giữ nguyên ảnh trang.*"
WARNING = "<!-- ⚠ Cần kiểm tra: "
SOURCE_LINE = "> *Bản gốc:* "
FIGURE_TEXTS = "> **Chữ trong hình**\n>\n"
NOTE_HEAD = "Chữ trong hình (Anh → Việt):\n"
DISCLAIMER = "> Bản dịch máy — cần đối chiếu bản gốc trước khi dùng cho mục đích chuyên môn."


def table_lines(rows: Column) -> Column:
    """A Markdown table: rows padded to the widest, the first as head."""
    width = F.array_max(F.transform(rows, F.size))
    padded = F.transform(rows, lambda r: F.concat(F.transform(r, T.escape_cell), F.array_repeat(F.lit(""), width - F.size(r))))
    told = F.transform(padded, lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |")))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- |"), width), ""))
    return F.array_join(F.concat(F.slice(told, 1, 1), F.array(rule), F.slice(told, F.lit(2), F.greatest(F.size(told) - 1, F.lit(0)))), "\n")


def figure_markdown(items: Column) -> Column:
    """items: array of en, vi. The list under a figure; null for no item."""
    rows = F.transform(items, lambda x: F.concat(F.lit("> - "), F.replace(T.pair_line(x["en"], x["vi"]), F.lit("\n"), F.lit(" "))))
    return F.when(F.size(items) > 0, F.concat(F.lit(FIGURE_TEXTS), F.array_join(rows, "\n")))


def note_text(items: Column) -> Column:
    return F.concat(F.lit(NOTE_HEAD), F.array_join(F.transform(items, lambda x: F.concat(F.lit("• "), T.pair_line(x["en"], x["vi"]))), "\n"))


def header(title: Column, source_name: Column, scope: Column, engine: Column, day: Column) -> Column:
    """The head of a document: title, then what is told of source, scope, day and engine. day is given, so that a run can be repeated."""
    told = lambda c, text: F.when(F.coalesce(c, F.lit("")) != "", text)
    meta = F.concat_ws(" · ", told(source_name, F.concat(F.lit("Dịch từ **"), source_name, F.lit("**"))), told(scope, scope), told(day, day), told(engine, F.concat(F.lit("Máy dịch: "), engine)))
    return F.concat(F.lit("# "), title, F.lit("\n\n> "), meta, F.lit("  \n" + DISCLAIMER))


def markdown(blocks: DataFrame, heads: DataFrame | None = None, keep_source: bool = False) -> DataFrame:
    """doc_id, markdown: a document's blocks in order.

    blocks: doc_id, block, kind, page, level, text, dst, and where known flags (array), rows (translated cells),
    link (a figure's image), items (a figure's texts), translated (false for a block without a segment).
    heads: doc_id, head, paged; without heads there is no head, and pages are marked. A block shows dst, or text where that is empty; tables, scans,
    labels (none: they stand in their figure) and notes of the engine have forms of their own. keep_source
    adds the source under all but headings; flags stand in a comment.
    """
    has = blocks.columns.__contains__
    column = lambda name, kind: F.col(name) if has(name) else F.lit(None).cast(kind)
    kind, text = F.col("kind"), F.col("text")
    said = F.coalesce(F.nullif(F.col("dst"), F.lit("")), text)
    segment = F.coalesce(column("translated", "boolean"), ~((kind == "note") & text.startswith("[Trang ")))
    link = column("link", "string") if has("link") else F.format_string("fig-%04d.png", "block")
    alt = F.when(text == "scan", F.format_string("Trang %d", "page")).otherwise(F.format_string("Hình — trang %d", "page"))
    image = F.when(link.isNotNull(), F.concat(F.lit("!["), alt, F.lit("]("), link, F.lit(")")))
    items = column("items", "array<struct<en:string,vi:string>>")
    figure = F.array_compact(F.array(F.when(text == "scan", F.format_string(SCAN, "page")), image, figure_markdown(items)))
    body = F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(3)) + 1), F.lit(" "), said))
    body = body.when(kind == "list", F.concat(F.lit("- "), F.replace(said, F.lit("\n"), F.lit("\n- ")))).when(kind == "caption", F.concat(F.lit("*"), said, F.lit("*"))).when(kind == "note", F.concat(F.lit("> "), said)).otherwise(said)
    source = F.when(F.lit(keep_source) & (kind != "heading"), F.concat(F.lit(SOURCE_LINE), F.replace(text, F.lit("\n"), F.lit(" · "))))
    flags = column("flags", "array<string>")
    warning = F.when(F.size(flags) > 0, F.concat(F.lit(WARNING), F.array_join(flags, "; "), F.lit(" -->")))
    table = F.array(table_lines(column("rows", "array<array<string>>")))
    parts = F.when(kind == "figure", figure).when(kind == "table", table).when(kind == "label", F.array().cast("array<string>"))
    parts = parts.when(segment, F.array_compact(F.array(body, source, warning))).when(kind == "note", F.array(F.concat(F.lit("> *"), text, F.lit("*")))).otherwise(F.array().cast("array<string>"))
    turned = ~F.lag("page").over(B.in_order()).eqNullSafe(F.col("page"))
    mark = F.when(turned, F.array(F.format_string("<!-- Trang %d -->", "page"))).otherwise(F.array().cast("array<string>"))
    rows = blocks.select("doc_id", "block", mark.alias("mark"), parts.alias("parts"))
    told = F.array_sort(F.collect_list(F.struct("block", "mark", "parts")))  # a document's blocks
    docs = rows.groupBy("doc_id").agg(told.alias("told"))
    paged = F.lit(True)
    if heads is not None:
        docs, paged = docs.join(heads, "doc_id", "left"), F.coalesce("paged", F.lit(True))
    whole = F.flatten(F.transform("told", lambda x: F.concat(F.when(paged, x["mark"]).otherwise(F.array().cast("array<string>")), x["parts"])))
    if heads is not None:
        whole = F.concat(F.array_compact(F.array("head")), whole)
    return docs.select("doc_id", F.concat(T.strip(F.array_join(whole, "\n\n")), F.lit("\n")).alias("markdown"))


def figure_texts(owned: DataFrame, read: DataFrame) -> DataFrame:
    """doc_id, figure, pos, en, vi: texts of each figure, first its own labels, then what was read from its image.

    owned: doc_id, figure, label, en, vi; read: doc_id, figure, pos, en, vi. Texts without a word are left out;
    of read ones those whose key (case and signs apart) a label or an earlier one has.
    """
    own = owned.select("doc_id", "figure", F.lit(0).alias("from_"), F.col("label").alias("at_"), F.trim(F.regexp_replace("en", r"(?U)\s+", " ")).alias("en"), "vi")
    both = own.unionByName(read.select("doc_id", "figure", F.lit(1).alias("from_"), F.col("pos").alias("at_"), "en", "vi")).where(T.worth_listing(F.col("en")))
    again = F.row_number().over(Window.partitionBy("doc_id", "figure", T.label_key(F.col("en"))).orderBy("from_", "at_"))
    kept = both.withColumn("again_", again).where("from_ = 0 or again_ = 1")
    pos = F.row_number().over(Window.partitionBy("doc_id", "figure").orderBy("from_", "at_")) - 1
    return kept.select("doc_id", "figure", pos.alias("pos"), "en", "vi")


def figure_items(texts: DataFrame) -> DataFrame:
    """doc_id, figure, items: figure_texts() as an array a figure."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("pos", "en", "vi"))), lambda x: F.struct(x["en"].alias("en"), x["vi"].alias("vi")))  # a figure's texts
    return texts.groupBy("doc_id", "figure").agg(items.alias("items"))


def page_notes(items: DataFrame, figures: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, notes: for each wanted page the notes of its figures in order."""
    rows = items.where(F.size("items") > 0).join(figures.select("doc_id", F.col("block").alias("figure"), "page"), ["doc_id", "figure"]).join(pages, ["doc_id", "page"], "left_semi")
    notes = F.array_sort(F.collect_list(F.struct("figure", note_text(F.col("items")).alias("note"))))  # a page's figures
    return rows.groupBy("doc_id", "page").agg(notes.alias("notes"))


def figure_tasks(figures: DataFrame, labels: DataFrame, folder: str = "hinh-agent") -> DataFrame:
    """doc_id, figure, page, image, known: what an agent needs to read each figure that isn't a scan. labels: doc_id, figure (a block), label, en."""
    known = labels.groupBy("doc_id", "figure").agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "en"))), lambda x: F.trim(F.regexp_replace(x["en"], r"(?U)\s+", " "))).alias("known"))  # a figure's labels
    name = F.format_string("fig-%04d", "block")
    rows = figures.where("text <> 'scan'").join(known.withColumnRenamed("figure", "block"), ["doc_id", "block"], "left")
    return rows.select("doc_id", name.alias("figure"), "page", F.concat(F.lit(f"{folder}/"), name, F.lit(".png")).alias("image"), F.coalesce("known", F.array().cast("array<string>")).alias("known"))


def outline_of(toc: DataFrame, pages: DataFrame, interleave: bool = False) -> DataFrame:
    """toc: doc_id, pos, level, title, start; pages: doc_id, page, the selected ones. doc_id, pos, level, title, page: the outline of a document of those pages only.

    An entry stays if its page is selected and its level is at most one below that of the last one that stays;
    pages are numbered anew, two apart if source pages lie between. An outline that doesn't begin at level 1
    is left out as a whole.
    """
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    placed = pages.distinct().withColumn("new", place * 2 if interleave else place)
    rows = toc.join(placed, (toc["doc_id"] == placed["doc_id"]) & (toc["start"] == placed["page"])).select(toc["doc_id"], "pos", "level", "title", "new")
    entries = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "level", "title", "new"))).alias("entries"))  # an outline's entries
    kind = "array<struct<pos:int,level:int,title:string,new:int>>"
    start = F.struct(F.lit(0).alias("last"), F.array().cast(kind).alias("kept"))

    def take(state: Column, e: Column) -> Column:
        after = F.struct(e["level"].alias("last"), F.concat(state["kept"], F.array(e)).alias("kept"))
        return F.when(e["level"] <= state["last"] + 1, after).otherwise(state)

    kept = entries.select("doc_id", F.aggregate(F.col("entries").cast(kind), start, take)["kept"].alias("kept"))
    kept = kept.where(F.get("kept", F.lit(0))["level"] == 1).select("doc_id", F.explode("kept").alias("e"))
    return kept.select("doc_id", "e.pos", "e.level", "e.title", F.col("e.new").alias("page"))


def cut_places(text: str, weights: list[float]) -> list[int]:
    """Places of the spaces nearest to each cumulative share of a text, each after the one before; the text's end once none is left."""
    spaces, whole = [i for i, c in enumerate(text) if c == " "], sum(weights) or 1
    cuts, unused = [], 0  # spaces before the unused ones can't be cut at any more
    for share in accumulate(weights[:-1]):
        goal = len(text) * share / whole
        right = max(unused, min(bisect_left(spaces, goal), len(spaces) - 1))
        if unused < right and goal - spaces[right - 1] <= spaces[right] - goal:
            right -= 1
        cuts.append(spaces[right] if unused < len(spaces) else len(text))
        unused = right + 1
    return cuts


def split_by_weights(text: Column, weights: Column) -> Column:
    """A text in as many pieces as there are weights, cut at the spaces nearest to the shares. Each cut depends on the one before, so it runs in Arrow batches."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series, shares: pd.Series) -> pd.Series:
        def pieces(t, w):
            if t is None or w is None or len(w) <= 1:
                return [t]
            ends = [0, *cut_places(t, [float(x) for x in w]), len(t)]
            return [t[a:z].strip() for a, z in zip(ends, ends[1:], strict=False)]

        return pd.Series([pieces(t, w) for t, w in zip(texts, shares, strict=True)])

    return run(text, weights)


def placements(blocks: DataFrame) -> DataFrame:
    """doc_id, block, piece, page, x0, y0, x1, y1, size, color, bold, kind, text: what to place for each translated text block.

    blocks: doc_id, block, kind, text, dst, parts (array of page, x0, y0, x1, y1, size, color, bold, nchars).
    Untranslated blocks, those equal to their source, tables, figures and blocks without parts are left alone; a
    list goes whole into its first part, other text is cut by the characters of each part.
    """
    done = T.strip(F.coalesce("dst", F.lit("")))
    rows = blocks.where(~F.col("kind").isin("figure", "table") & (F.size("parts") > 0)).withColumn("done", done).where((F.col("done") != "") & (F.col("done") != T.strip(F.col("text"))))
    bullets = F.concat(F.lit("• "), F.replace(F.col("done"), F.lit("\n"), F.lit("\n• ")))
    pieces = F.when(F.col("kind") == "list", F.array(bullets)).otherwise(split_by_weights(F.col("done"), F.transform("parts", lambda p: p["nchars"].cast("double"))))
    rows = rows.withColumn("pieces", pieces).select("doc_id", "block", "kind", F.posexplode(F.arrays_zip("parts", "pieces")).alias("piece", "z")).where("z.pieces is not null")
    part = lambda c: F.col(f"z.parts.{c}").alias(c)
    bold = (F.col("z.parts.bold") | (F.col("kind") == "heading")).alias("bold")
    return rows.select("doc_id", "block", "piece", *(part(c) for c in ("page", "x0", "y0", "x1", "y1", "size", "color")), bold, "kind", F.col("z.pieces").alias("text"))


def cell_placements(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """doc_id, block, page, x0, y0, x1, y1, kind, text: translated cells that differ from their source, in boxes drawn in a little. tables: doc_id, block, page, rows, boxes (array a row of arrays of four or null)."""
    zipped = F.posexplode(F.arrays_zip("rows", "boxes")).alias("r", "row")
    flat = tables.select("doc_id", "block", "page", zipped).select("doc_id", "block", "page", "r", F.posexplode(F.arrays_zip("row.rows", "row.boxes")).alias("c", "cell"))
    flat = flat.select("doc_id", "block", "page", "r", "c", F.col("cell.rows").alias("text"), F.col("cell.boxes").alias("box")).where("box is not null")
    told = cells.where("dst <> '' and dst <> text").select("doc_id", "block", "text", "dst").distinct()
    inset = [(F.get("box", F.lit(i)) + d).alias(c) for i, (c, d) in enumerate((("x0", 1.5), ("y0", 1), ("x1", -1.5), ("y1", -1)))]
    return flat.join(told, ["doc_id", "block", "text"]).select("doc_id", "block", "page", "r", "c", *inset, F.lit("cell").alias("kind"), F.col("dst").alias("text"))


def task_records(segments: DataFrame, parts: int, context: int = 300) -> DataFrame:
    """doc_id, part, id, record: agent tasks in as many runs of equal length as given, a JSON record a segment with the end of its context."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    most = F.least(F.lit(max(1, parts)), n)
    fields = F.struct("id", "kind", "page", "section", F.right("previous", F.lit(context)).alias("previous"), *(["terms"] if "terms" in segments.columns else []), F.col("text").alias("src"))
    return segments.select("doc_id", F.floor(F.col("id") / F.ceil(n / most)).cast("int").alias("part"), "id", F.to_json(fields).alias("record"))
