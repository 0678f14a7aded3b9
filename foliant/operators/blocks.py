"""Ordered-block operators: each works within a document, on its block order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T

def in_order():
    return Window.partitionBy("doc_id").orderBy("block")


def before():
    return in_order().rowsBetween(Window.unboundedPreceding, -1)


def up_to():
    return in_order().rowsBetween(Window.unboundedPreceding, 0)


def line_blocks(docs: DataFrame) -> DataFrame:
    """A block for each line of a document that isn't empty. Kind, level, page and layout, which plain text lacks, follow from doc_id and block."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block", "text")).where("text <> ''")
    m = (F.col("doc_id") * 7 + F.col("block") * 3) % 10
    kind = F.when(m == 0, "heading").when(m == 1, "list").when(m == 2, "figure").when(m == 3, "note").when(m == 4, "label").otherwise("para")
    spot = (F.col("doc_id") * 13 + F.col("block") * 29) % 100
    return rows.withColumns({
        "kind": kind, "level": F.when(kind == "heading", (1 + (F.col("doc_id") + F.col("block")) % 3).cast("int")).otherwise(0), "page": (1 + F.floor(F.col("block") / 4)).cast("int"),
        "size": (8 + (F.col("doc_id") * 3 + F.col("block")) % 6).cast("int"), "x0": F.when(spot % 2 == 0, 50).otherwise(310).cast("int"), "y0": (40 + spot * 7).cast("int"), "width": F.when(spot % 5 == 0, 480).otherwise(230).cast("int"),
        "lines": (1 + F.floor(F.length("text") / 90)).cast("int"), "bold": ((F.col("doc_id") * 5 + F.col("block") * 11) % 10 / 10).cast("double"),
    }).withColumns({"x1": (F.col("x0") + F.col("width")).cast("int"), "y1": (F.col("y0") + 12 * F.col("lines")).cast("int")})


def previous_context(blocks: DataFrame, most: int = 600) -> DataFrame:
    """The end of the last paragraph or list before a paragraph, list or note."""
    last = F.last(F.when(F.col("kind").isin("para", "list"), F.right("text", F.lit(most))), ignorenulls=True).over(before())
    return blocks.withColumn("previous", F.coalesce(F.when(F.col("kind").isin("para", "list", "note"), last), F.lit("")))


def section_path(blocks: DataFrame, levels: int = 4) -> DataFrame:
    """Titles of the open headings above a block; a heading closes those of its level and deeper, and isn't in its own path. A heading of level 0 counts as one of level 1."""
    own_level = F.when(F.col("kind") == "heading", F.greatest(F.coalesce("level", F.lit(1)), F.lit(1))).otherwise(0)
    own = F.struct(F.col("block").alias("at"), F.col("text").alias("title"))
    out = blocks.withColumns({f"h{k}": F.last(F.when(own_level == k, own), ignorenulls=True).over(before()) for k in range(1, levels + 1)})
    # an open heading comes after the last one of every smaller level, and of a heading's own level and deeper none is open
    titles, newest = [], F.lit(-1)
    for k in range(1, levels + 1):
        at = F.coalesce(F.col(f"h{k}.at"), F.lit(-1))
        shown = (at > newest) & ((own_level == 0) | (own_level > k))
        titles.append(F.when(shown, F.col(f"h{k}.title")))
        newest = F.greatest(newest, at)
    return out.withColumn("section", F.concat_ws(" > ", *titles)).drop(*(f"h{k}" for k in range(1, levels + 1)))


def merge_continuations(blocks: DataFrame) -> DataFrame:
    """Paragraphs cut by a column or page, joined: the earlier doesn't end a sentence, the later starts in lower case; figures and labels between don't matter."""
    main = blocks.where(~F.col("kind").isin("figure", "label"))
    joins = (F.col("kind") == "para") & (F.lag("kind").over(in_order()) == "para") & ~F.lag("text").over(in_order()).rlike(T.TERMINAL) & F.col("text").rlike(r"^\p{Ll}")
    grouped = main.withColumn("start", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("start").over(up_to()))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"])

    def add(out: Column, part: Column) -> Column:
        return F.when(out.isNull(), part).when(out.rlike(r"\p{L}-$"), F.concat(F.substring(out, F.lit(1), F.length(out) - 1), part)).otherwise(F.concat(out, F.lit(" "), part))

    merged = grouped.groupBy("doc_id", "run").agg(F.min("block").alias("block"), F.min_by("kind", "block").alias("kind"), F.min_by("page", "block").alias("page"), F.min_by("level", "block").alias("level"), parts.alias("parts"))
    merged = merged.select("doc_id", "block", "kind", "page", "level", F.aggregate("parts", F.lit(None).cast("string"), add).alias("text"), F.size("parts").alias("n_parts"))
    rest = blocks.where(F.col("kind").isin("figure", "label")).select("doc_id", "block", "kind", "page", "level", "text", F.lit(1).alias("n_parts"))
    return merged.unionByName(rest)


def segment_ids(blocks: DataFrame) -> DataFrame:
    """Dense numbers of the blocks that are translated."""
    return blocks.where("kind <> 'figure'").withColumn("id", F.row_number().over(in_order()) - 1)


def first_mention(mentions: DataFrame, blocks: DataFrame, bilingual: bool = True) -> DataFrame:
    """mentions: doc_id, block, term, ambiguous if there are such terms. Whether a term wasn't met since the last heading of level 1 or 2.

    Labels and cells read but don't mark; an ambiguous term is never first, and none is if the text isn't bilingual.
    """
    ambiguous = F.col("ambiguous") if "ambiguous" in mentions.columns else F.lit(False)
    opens = (F.col("kind") == "heading") & (F.coalesce("level", F.lit(1)) <= 2)
    epochs = blocks.withColumn("epoch", F.sum(F.when(opens, 1).otherwise(0)).over(up_to())).select("doc_id", "block", "kind", "epoch")
    rows = mentions.join(epochs, ["doc_id", "block"])
    marks = ~F.col("kind").isin("label", "cell", "table") & ~ambiguous
    seen = F.max(F.when(marks, 1)).over(Window.partitionBy("doc_id", "epoch", "term").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("first", seen.isNull() & ~ambiguous & F.lit(bilingual))


def reading_order(blocks: DataFrame, page_width: int = 600) -> DataFrame:
    """Rank of a block on its page: blocks as wide as the page part it into bands, read left column, then right; a page without a right column goes by y, x."""
    page = Window.partitionBy("doc_id", "page")
    half = page_width / 2
    wide = (F.col("width") > page_width * 0.55) | ((F.col("x0") < half - 10) & (F.col("x0") + F.col("width") > half + 10))
    right = ~wide & (F.col("x0") >= half)
    rows = blocks.withColumns({"wide": wide, "two": F.max(right.cast("int")).over(page) == 1})
    band = F.sum(F.col("wide").cast("int")).over(page.orderBy("y0").rangeBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("band", F.when(~F.col("wide"), band).otherwise(F.row_number().over(Window.partitionBy("doc_id", "page", "wide").orderBy("y0", "block")) - 1))
    key = [F.when(F.col("two"), F.col("band")).otherwise(0), F.when(F.col("two"), F.col("wide").cast("int")).otherwise(0), F.when(F.col("two") & ~F.col("wide"), (F.col("x0") >= half).cast("int")).otherwise(0), F.when(F.col("two"), F.col("y0")).otherwise(F.bround("y0")), F.when(~F.col("two"), F.col("x0")).otherwise(0), F.col("block")]
    return rows.withColumn("place", F.row_number().over(page.orderBy(*key)))


def body_size(blocks: DataFrame) -> DataFrame:
    """The size of most characters of a document; of equal ones that met first."""
    sums = blocks.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("weight"), F.min("block").alias("first"))
    return sums.groupBy("doc_id").agg(F.max_by("size", F.struct("weight", -F.col("first"))).alias("body"))


def sized(blocks: DataFrame) -> DataFrame:
    """Blocks with body, the document's body size (10 where no block has text), in one exchange by document."""
    doc = Window.partitionBy("doc_id")
    weighed = blocks.withColumns({"weight_": F.sum(F.length("text")).over(Window.partitionBy("doc_id", "size")), "first_": F.min("block").over(Window.partitionBy("doc_id", "size"))})
    best = F.max(F.struct("weight_", (-F.col("first_")).alias("f_"), F.col("size").alias("s_"))).over(doc)
    return weighed.withColumn("body", F.coalesce(best["s_"].cast("double"), F.lit(10.0))).drop("weight_", "first_")


def _heading_candidate() -> Column:
    return (F.col("size") >= 1.15 * F.col("body")) & (F.length("text") < 200) & (F.col("lines") <= 4)


def heading_levels(blocks: DataFrame) -> DataFrame:
    """The three largest heading sizes of a document as levels; a heading's block has up to four lines."""
    large = sized(blocks).where(_heading_candidate()).select("doc_id", "size").distinct()
    return large.withColumn("level", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("size")))).where("level <= 3")


def classify(blocks: DataFrame) -> DataFrame:
    """Kind, level and text of each block by the first rule that fits: a heading by size, a caption, a bold short heading, a list, a note, a paragraph.

    Line breaks become spaces but in lists, whose items lose their bullets, and in bold headings.
    """
    doc, n, text = Window.partitionBy("doc_id"), F.length("text"), F.col("text")
    sizes = F.slice(F.sort_array(F.collect_set(F.when(_heading_candidate(), F.col("size"))).over(doc), asc=False), 1, 3)  # a document's sizes
    rows = sized(blocks.drop("kind", "level")).withColumn("sizes_", sizes)
    place = F.array_position("sizes_", F.col("size"))
    ended = F.regexp_replace(text, ":+$", "").rlike(T.TERMINAL)
    rule = F.when((place > 0) & (n < 200), "heading").when(text.rlike(T.CAPTION), "caption").when((F.col("bold") > 0.8) & (n < 100) & (F.col("lines") <= 2) & ~ended, "bold")
    rule = rule.when(text.rlike(f"^[{T.BULLETS}] "), "list").when((F.col("size") < 0.85 * F.col("body")) & (n < 400), "note").otherwise("para")
    items = F.transform(F.split("text", "\n"), lambda x: T.strip(F.regexp_replace(x, rf"^[{T.BULLETS}]\s*", "")))
    body = F.when(F.col("rule_") == "list", F.array_join(F.filter(items, lambda x: x != ""), "\n")).when(F.col("rule_") == "bold", text).otherwise(F.replace(text, F.lit("\n"), F.lit(" ")))
    level = F.when(F.col("rule_") == "heading", place.cast("int")).when(F.col("rule_") == "bold", F.least(F.lit(4), F.size("sizes_") + 1)).otherwise(0)
    rows = rows.withColumn("rule_", rule).withColumns({"kind": F.when(F.col("rule_") == "bold", "heading").otherwise(F.col("rule_")), "level": level, "text": body})
    return rows.drop("rule_", "sizes_")


def in_margin(height: int = 800, share: float = 0.08) -> Column:
    """Whether a block begins in the top or ends in the bottom share of a page."""
    return (F.col("y0") < height * share) | (F.col("y1") > height * (1 - share))


def sample_pages(selected: Column, total: Column) -> Column:
    """Pages by which repeated margin lines are found: about 30 of the sorted selected ones, those up to six around the first, and about 12 of all."""
    stride = F.greatest(F.lit(1), F.floor(F.size(selected) / 30).cast("int"))
    spread = F.filter(selected, lambda p, i: i % stride == 0)
    first = F.get(selected, F.lit(0))
    around = F.filter(F.sequence(first - 6, first + 6), lambda p: (p >= 1) & (p <= total))
    whole = F.sequence(F.lit(1), total, F.greatest(F.lit(1), F.floor(total / 12).cast("int")))
    return F.when(F.size(selected) > 0, F.array_sort(F.array_union(F.array_union(spread, around), whole))).otherwise(F.array().cast("array<int>"))


def repeated_lines(lines: DataFrame, n_pages: DataFrame, share: float = 0.3) -> DataFrame:
    """lines: book, page, text, of the margins of sampled pages. Texts, digits alike, that stand on 3 pages and on the given share of them at least; none in a book of under 3."""
    keys = lines.where(F.length("text") < 120).select("book", "page", F.trim(F.regexp_replace(F.lower("text"), r"\d+", "#")).alias("line")).where("line <> ''")
    counts = keys.groupBy("book", "line").agg(F.count_distinct("page").alias("pages"))
    return counts.join(n_pages, "book").where((F.col("n") >= 3) & (F.col("pages") >= F.greatest(F.lit(3), F.floor(F.col("n") * share))))


def toc_ranges(toc: DataFrame, page_count: int) -> DataFrame:
    """toc: doc_id, pos, level, start. Last page of each entry: before the next entry of its level or above that starts no earlier.

    Two ordered windows, no self join: later entries are packed once a document and searched in place.
    """
    later = F.collect_list(F.struct("level", "start")).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(1, Window.unboundedFollowing))  # an outline's entries
    hit = F.get(F.filter("later_", lambda e: (e["level"] <= F.col("level")) & (e["start"] >= F.col("start"))), F.lit(0))["start"]
    rows = toc.withColumn("later_", later).withColumn("next", hit)
    return rows.withColumn("end", F.when(F.col("next").isNull(), F.lit(page_count)).otherwise(F.greatest(F.col("start"), F.col("next") - 1))).drop("later_")


def figure_parts(figures: DataFrame, chunks: DataFrame) -> DataFrame:
    """The first chunk that reaches a figure's page, else the last one. chunks: doc_id, part, last_page, pages ascending with part.

    A forward as-of join as one ordered window over both: each figure takes the next chunk in page order.
    """
    rows = figures.select("doc_id", "block", "page", F.lit(None).cast("long").alias("part")).unionByName(chunks.select("doc_id", F.lit(None).cast("int").alias("block"), F.col("last_page").alias("page"), F.col("part").cast("long").alias("part")))
    order = Window.partitionBy("doc_id").orderBy("page", F.col("part").isNotNull(), "part")
    reached = F.first("part", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    last = F.max("part").over(Window.partitionBy("doc_id"))
    return rows.withColumns({"reached_": reached, "last_": last}).where("block is not null and last_ is not null").select("doc_id", "block", "page", F.coalesce("reached_", "last_").alias("part"))


def batch_release(blocks: DataFrame, size: int = 2) -> DataFrame:
    """Step at which each page batch is let out: in order, once all its segments are done; done order is by text length, then block."""
    rows = blocks.withColumns({"batch": F.floor((F.col("page") - 1) / size).cast("int"), "done": F.row_number().over(Window.partitionBy("doc_id").orderBy(F.length("text"), "block"))})
    needs = rows.groupBy("doc_id", "batch").agg(F.max("done").alias("needs"), F.count("*").alias("segments"))
    return needs.withColumn("step", F.max("needs").over(Window.partitionBy("doc_id").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)))


def runs_of_pages(pages: DataFrame) -> DataFrame:
    """Runs of consecutive pages: doc_id, first, last."""
    island = F.col("page") - F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    return pages.distinct().withColumn("island", island).groupBy("doc_id", "island").agg(F.min("page").alias("first"), F.max("page").alias("last")).drop("island")
