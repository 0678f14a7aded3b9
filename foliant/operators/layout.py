"""Page geometry: spans to blocks, tables, figures, labels, scanned pages, room below a block."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T


def overlap(a: str, b: str) -> Column:
    """Area that two boxes with columns {a}x0 .. {a}y1 and {b}x0 .. {b}y1 share."""
    width = F.least(f"{a}x1", f"{b}x1") - F.greatest(f"{a}x0", f"{b}x0")
    height = F.least(f"{a}y1", f"{b}y1") - F.greatest(f"{a}y0", f"{b}y0")
    return F.greatest(width, F.lit(0)) * F.greatest(height, F.lit(0))


def area(a: str = "") -> Column:
    return F.greatest(F.col(f"{a}x1") - F.col(f"{a}x0"), F.lit(0)) * F.greatest(F.col(f"{a}y1") - F.col(f"{a}y0"), F.lit(0))


def _boxes(df: DataFrame, prefix: str, *more: str) -> DataFrame:
    return df.select("doc_id", "page", *(F.col(c).alias(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")), *more)


def blocks_of_spans(spans: DataFrame) -> DataFrame:
    """spans: doc_id, page, block, line, span, text, size, color, bold. One row a block with text: joined text, size and color of most characters, share of bold ones, lines.

    Sizes are rounded to a tenth; of equal weights the one met first wins; blank spans weigh nothing; a block
    without a character has no row.
    """
    keys = ["doc_id", "page", "block"]
    rows = spans.where("text <> ''").withColumns({"n": F.length(T.strip(F.col("text"))), "size": F.bround("size", 1), "at": F.struct("line", "span")})

    def mode(column: str) -> DataFrame:
        weights = rows.groupBy(*keys, column).agg(F.sum("n").alias("w"), F.min("at").alias("at"))
        top = Window.partitionBy(*keys).orderBy(F.desc("w"), "at")
        return weights.withColumn("place", F.row_number().over(top)).where("place = 1").select(*keys, column)

    lines = rows.groupBy(*keys, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda x: x["text"]), "").alias("said"), F.sum("n").alias("n"), F.sum(F.when(F.col("bold"), F.col("n")).otherwise(0)).alias("heavy"))  # a line's spans
    lines = lines.withColumn("said", T.strip(F.col("said"))).where("said <> ''")
    whole = F.transform(F.array_sort(F.collect_list(F.struct("line", "said"))), lambda x: x["said"])  # a block's lines
    out = lines.groupBy(*keys).agg(whole.alias("all"), (F.sum("heavy") / F.sum("n")).alias("bold"))
    out = out.select(*keys, T.join_lines(F.col("all")).alias("text"), "bold", F.size("all").alias("lines"))
    return out.join(mode("size"), keys).join(mode("color"), keys)


def clean_tables(tables: DataFrame) -> DataFrame:
    """rows ARRAY<ARRAY<STRING>>: cells with single spaces (null as empty), without blank rows; only tables of two rows and two columns or more."""
    tidy = F.transform("rows", lambda row: F.transform(row, lambda c: T.strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))))
    rows = tables.withColumn("rows", F.filter(tidy, lambda row: F.exists(row, lambda c: c != "")))
    return rows.where((F.size("rows") >= 2) & (F.array_max(F.transform("rows", F.size)) >= 2))


def outside_tables(items: DataFrame, tables: DataFrame, share: float = 0.5) -> DataFrame:
    """Items (doc_id, page, x0..y1) of which no table covers more than the share; items without area stay."""
    hit = items.join(_boxes(tables, "t_"), ["doc_id", "page"]).where((area() > 0) & (overlap("", "t_") > share * area()))
    return items.join(hit.select("doc_id", "page", "block").distinct(), ["doc_id", "page", "block"], "left_anti")


def figure_candidates(drawn: DataFrame, tables: DataFrame, width: int = 600, height: int = 800) -> DataFrame:
    """Drawn boxes, clipped to the page, of 40 by 40 points or more and between 0.8 % and 92 % of the page, that no table covers by half."""
    clipped = drawn.withColumns({"x0": F.greatest("x0", F.lit(0)), "y0": F.greatest("y0", F.lit(0)), "x1": F.least("x1", F.lit(width)), "y1": F.least("y1", F.lit(height))})
    page = width * height
    large = clipped.where((F.col("x1") - F.col("x0") >= 40) & (F.col("y1") - F.col("y0") >= 40) & (area() >= 0.008 * page) & (area() <= 0.92 * page))
    return outside_tables(large, tables)


def closure(boxes: list[list[float]]) -> list[list[float]]:
    """Boxes united until none intersects another (shared edges don't count), by (y0, x0).

    Uniting grows a box, so the result is more than connected components; it doesn't depend on the order.
    """
    left, done = [list(b) for b in boxes], []
    while left:
        box, grown = left.pop(), True
        while grown:
            grown = False
            for group in (left, done):
                for other in [o for o in group if o[0] < box[2] and box[0] < o[2] and o[1] < box[3] and box[1] < o[3]]:
                    group.remove(other)
                    box = [min(box[0], other[0]), min(box[1], other[1]), max(box[2], other[2]), max(box[3], other[3])]
                    grown = True
        done.append(box)
    return sorted(done, key=lambda b: (b[1], b[0]))


def united_figures(boxes: DataFrame) -> DataFrame:
    """doc_id, page, figure, x0..y1: the closure of each page's boxes, numbered by (y0, x0). Spark has no fixpoint within a group, so a page's boxes go to Python in Arrow batches."""
    packed = boxes.groupBy("doc_id", "page").agg(F.collect_list(F.array(*(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")))).alias("boxes"))  # a page's boxes

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(d, p, i, *b) for d, p, page in zip(f.doc_id, f.page, f.boxes, strict=True) for i, b in enumerate(closure([[*x] for x in page]))]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "figure", "x0", "y0", "x1", "y1"])

    return packed.mapInPandas(run, "doc_id long, page int, figure int, x0 double, y0 double, x1 double, y1 double")


def scan_pages(pages: DataFrame, texts: DataFrame, tables: DataFrame, images: DataFrame) -> DataFrame:
    """pages: doc_id, page, x0..y1. Pages that have an image, no text and no table, each as one figure with the text "scan"."""
    key = ["doc_id", "page"]
    bare = pages.join(texts.select(*key), key, "left_anti").join(tables.select(*key), key, "left_anti").join(images.select(*key), key, "left_semi")
    return bare.withColumns({"kind": F.lit("figure"), "text": F.lit("scan")})


def scanned_estimate(pages: DataFrame) -> DataFrame:
    """pages: doc_id, page, scanned. doc_id, pages, scanned_pages: estimated from about 40 evenly spaced pages of each document."""
    total = F.count("*").over(Window.partitionBy("doc_id"))
    rows = pages.withColumn("total", total).withColumn("stride", F.greatest(F.lit(1), F.floor(F.col("total") / 40)))
    got = rows.where("(page - 1) % stride = 0").groupBy("doc_id", "total").agg(F.count_if(F.col("scanned")).alias("hits"), F.count("*").alias("n"))
    return got.select("doc_id", F.col("total").alias("pages"), F.bround(F.col("hits") * F.col("total") / F.col("n")).cast("long").alias("scanned_pages"))


def mark_labels(blocks: DataFrame, figures: DataFrame, share: float = 0.8) -> DataFrame:
    """Text blocks with kind "label" where a figure of their page holds more than the share of them."""
    inside = blocks.where("kind <> 'figure'").join(_boxes(figures, "f_"), ["doc_id", "page"]).where(overlap("", "f_") > share * F.greatest(area(), F.lit(1e-6)))
    inside = inside.select("doc_id", "block", F.lit(True).alias("inside_")).distinct()
    return blocks.join(inside, ["doc_id", "block"], "left").withColumn("kind", F.when(F.col("inside_"), "label").otherwise(F.col("kind"))).drop("inside_")


def label_owners(labels: DataFrame, figures: DataFrame) -> DataFrame:
    """doc_id, label, figure: for each label the figure of its page that shares most area with it, if that is over half of the label; on ties the first figure."""
    met = labels.select("doc_id", "page", F.col("block").alias("label"), *(F.col(c) for c in ("x0", "y0", "x1", "y1"))).join(_boxes(figures, "f_", F.col("block").alias("figure")), ["doc_id", "page"])
    met = met.withColumns({"shared": overlap("", "f_"), "own": F.greatest(area(), F.lit(1e-6))})
    best = met.groupBy("doc_id", "label").agg(F.max(F.struct("shared", (-F.col("figure")).alias("less"), "own")).alias("one"))
    return best.where("one.shared > 0.5 * one.own").select("doc_id", "label", (-F.col("one.less")).alias("figure"))


def room_below(blocks: DataFrame, height: int = 800) -> DataFrame:
    """blocks with limit: the y to which a block may grow down, two points above the highest block below it that overlaps it in x, or 4 % above the page's end; never above its own end.

    One pass a page: obstacles are packed once and searched in place.
    """
    page = Window.partitionBy("doc_id", "page")
    others = F.collect_list(F.struct("x0", "x1", "y0")).over(page)  # a page's blocks
    below = F.filter("others_", lambda o: (o["x0"] < F.col("x1") - 2) & (o["x1"] > F.col("x0") + 2) & (o["y0"] >= F.col("y1") - 1))
    nearest = F.array_min(F.transform(below, lambda o: o["y0"].cast("double") - 2))
    end = F.lit(height * 0.96)
    return blocks.withColumn("others_", others).withColumn("limit", F.greatest(F.col("y1").cast("double"), F.least(end, F.coalesce(nearest, end)))).drop("others_")


def common_size(spans: DataFrame, default: float = 9.0) -> DataFrame:
    """doc_id, block, size: the size of most spans that aren't blank, the smallest on ties; the default where there is none."""
    told = spans.withColumn("size", F.when(T.strip(F.col("text")) != "", F.col("size")))
    counts = told.groupBy("doc_id", "block", "size").agg(F.count("size").alias("n"))
    best = counts.groupBy("doc_id", "block").agg(F.max_by("size", F.struct("n", (-F.col("size")).alias("less"))).alias("size"))
    return best.withColumn("size", F.coalesce("size", F.lit(default)))
