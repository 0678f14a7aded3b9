"""Scalar text functions as Columns; all but nfc() stay inside the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F

# Fixed values that results depend on: word lists, patterns, prompt and message texts.
STOPWORDS = ["the", "of", "and", "with", "is", "are", "was", "were", "which", "that", "this", "these", "to", "in", "for", "by", "from", "be", "has", "have", "can", "may"]
UNITS = ["mm", "cm", "dm", "km", "nm", "µm", "um", "ml", "dl", "mg", "kg", "µg", "ug", "ng", "ms", "hz", "khz", "mhz", "mmhg", "kpa", "mol", "mmol", "iu"]
PLURALS = [("us", "i"), ("um", "a"), ("on", "a"), ("is", "es"), ("a", "ae"), ("ex", "ices"), ("ix", "ices")]
CAPTION = r"^(?i:fig\.?|figure|table|box|chart|plate)\s*[\dIVX]+[\d.\-–A-Za-z]*[.:]?(\s+[A-Z(\d]|\s*$)"
TERMINAL = r"[.!?:;…”\")\]]\s*$"
PAGE_NUMBER = r"(?i)^(page\s*)?[\divxlcdm]{1,6}$"
REFERENCE = r"(?U)\b(?:Fig\.|Figure|Table)\s+(\d+(?:[.\-–]\d+)*[A-Za-z]?)"
TERMS = "array<struct<en:string,vi:string,status:string,ambiguous:boolean>>"
BULLETS = "•●○◦▪■□▸►‣–*·\uf0b7\uf0a7"
EMPTY = "Bản dịch rỗng"
NUMBERS_GONE = "Thiếu số liệu: "
SAME = "Chưa được dịch (giống hệt bản gốc)"
ENGLISH_LEFT = "Còn sót nhiều câu tiếng Anh"
SHORT = "Bản dịch ngắn bất thường (%d%% độ dài bản gốc) — có thể bỏ sót ý"
LONG = "Bản dịch dài bất thường (%d%%) — có thể thêm nội dung"
REFERENCE_GONE = "Thiếu tham chiếu hình/bảng "
TERM_UNUSED = "Không dùng thuật ngữ chuẩn: "
HINTS = {
    "heading": "This is a section heading. Translate it concisely as a heading.",
    "caption": "This is a figure or table caption.",
    "list": "This is a bulleted list. Keep exactly one output line per input line, in the same order.",
    "cell": "This is a single table cell. Translate it briefly; keep numbers and symbols unchanged.",
    "note": "This is a side note or footnote.",
    "label": "This is a short label printed inside a figure. Translate it as briefly as possible.",
}
#: Letters that upper() gives several letters for, and the one letter that takes the place of each: itself where there is none.
_MANY = "".join(c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1)
_ONE = "".join("ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in _MANY)


def upper(text: Column) -> Column:
    """Capitals letter by letter (ß becomes ẞ, not SS), so that lower case gives the same letters back."""
    pieces = F.regexp_extract_all(text, F.lit(f"[{_MANY}]|[^{_MANY}]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"^[{_MANY}]"), F.translate(p, _MANY, _ONE)).otherwise(F.upper(p))), "")


def numbers(text: Column) -> Column:
    """Distinct numbers, a decimal comma as a point, sorted."""
    found = F.regexp_extract_all(text, F.lit(r"(?U)\d+(?:[.,]\d+)*"), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit(".")))))


def missing_numbers(source: Column, target: Column, most: int = 5) -> Column:
    """Numbers of the source that the target lacks, longest first, then by value."""
    gone = F.array_except(numbers(source), numbers(target))
    ranked = F.array_sort(F.transform(gone, lambda n: F.struct((-F.length(n)).alias("k"), n.alias("n"))))
    return F.slice(F.transform(ranked, lambda x: x["n"]), 1, most)


def join_lines(lines: Column) -> Column:
    """Lines of a block as one text: words split by a hyphen at a line's end are joined, bullet lines start anew."""

    def add(out: Column, line: Column) -> Column:
        hyphen = out.rlike(r"\p{L}-$") & line.rlike(r"^\p{Ll}")
        return F.when(out.isNull(), line).when(hyphen, F.concat(F.substring(out, F.lit(1), F.length(out) - 1), line)).when(line.rlike(f"^[{BULLETS}] "), F.concat(out, F.lit("\n"), line)).otherwise(F.concat(out, F.lit(" "), line))

    return strip(F.regexp_replace(F.aggregate(lines, F.lit(None).cast("string"), add), "[ \t]+", " "))


def fix_references(text: Column) -> Column:
    """English figure and table references with a number in Vietnamese; NFC."""
    text = F.regexp_replace(text, r"(?U)\b(?:Fig\.|Figure)\s+(?=\d)", "Hình ")
    return nfc(F.regexp_replace(text, r"(?U)\bTable\s+(?=\d)", "Bảng "))


def clean_output(text: Column) -> Column:
    """Model output without thoughts, tags, code fence, label and wrapping quotes, in that order."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?is)<think>.*?</think>", "")
    text = F.regexp_replace(text, r"(?i)</?(SOURCE|CONTEXT|TERMS|TRANSLATION)>", "")
    text = strip(text)
    text = F.when(text.startswith("```"), strip(F.regexp_replace(text, r"^```\w*\n?|```$", ""))).otherwise(text)
    text = F.regexp_replace(text, r"(?iu)^\s*(bản dịch|translation|dịch|vietnamese)\s*:\s*", "")
    quoted = (F.length(text) >= 2) & (F.left(text, F.lit(1)) == F.right(text, F.lit(1))) & F.left(text, F.lit(1)).isin('"', "'", "“", "”")
    return F.when(quoted, strip(F.substring(text, F.lit(2), F.length(text) - 2))).otherwise(text)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def plural_forms(word: Column) -> Column:
    """Plurals of a word, common and Latin or Greek ones, sorted."""
    forms = [F.concat(word, F.lit("s")), F.when(word.rlike("(s|x|z|ch|sh)$"), F.concat(word, F.lit("es"))), F.when(word.rlike("[^aeiou]y$"), F.concat(F.substring(word, F.lit(1), F.length(word) - 1), F.lit("ies")))]
    forms += [F.when(word.endswith(a) & (F.length(word) > len(a) + 2), F.concat(F.substring(word, F.lit(1), F.length(word) - len(a)), F.lit(b))) for a, b in PLURALS]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*forms))))


def worth_listing(text: Column) -> Column:
    """Whether a word of two letters or more isn't a unit."""
    words = F.regexp_extract_all(text, F.lit(r"(?U)[^\W\d_]{2,}"), F.lit(0))
    return F.exists(words, lambda w: ~F.lower(w).isin(UNITS))


def safe_name(name: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"^[ .]+|[ .]+$", "")
    return F.when(out == "", F.lit("tai-lieu")).otherwise(out)


def duration(seconds: Column) -> Column:
    s = seconds.cast("long")
    m, h = F.floor(s / 60), F.floor(s / 3600)
    return F.when(s < 60, F.concat(s.cast("string"), F.lit(" giây"))).when(m < 60, F.concat(m.cast("string"), F.lit(" phút "), (s % 60).cast("string"), F.lit(" giây"))).otherwise(F.concat(h.cast("string"), F.lit(" giờ "), (m % 60).cast("string"), F.lit(" phút")))


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts with unit separators between."""
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def term_lines(terms: Column) -> Column:
    """A line for each term of a prompt: an ambiguous one with its note, one met first with its English form. terms: structs with en, vi, ambiguous, note, first."""

    def line(t: Column) -> Column:
        pair = F.concat(F.lit("- "), t["en"], F.lit(" -> "), t["vi"])
        noted = F.when(F.coalesce(t["note"], F.lit("")) != "", F.concat(pair, F.lit(" (only if this meaning fits: "), t["note"], F.lit(")"))).otherwise(F.concat(pair, F.lit(" (if this meaning fits)")))
        return F.when(t["ambiguous"], noted).when(t["first"], F.concat(pair, F.lit(" ("), t["en"], F.lit(")"))).otherwise(pair)

    return F.array_join(F.transform(terms, line), "\n")


def prompt(text: Column, kind: Column, section: Column, previous: Column, terms: Column | None = None) -> Column:
    """The prompt of one segment; absent parts leave no blank."""
    context = F.concat_ws("\n", F.when(section != "", F.concat(F.lit("Section: "), section)), F.when(previous != "", F.concat(F.lit("Previous paragraph: "), previous)))
    hint = F.lit(None).cast("string")
    for k, v in HINTS.items():
        hint = F.when(kind == k, F.lit(v)).otherwise(hint)
    told = [] if terms is None else [F.when(F.size(terms) > 0, F.concat(F.lit("<TERMS>\n"), term_lines(terms), F.lit("\n</TERMS>")))]
    return F.concat_ws("\n\n", F.when(context != "", F.concat(F.lit("<CONTEXT>\n"), context, F.lit("\n</CONTEXT>"))), *told, hint, F.concat(F.lit("<SOURCE>\n"), text, F.lit("\n</SOURCE>")))


def percent(ratio: Column) -> Column:
    """A whole percentage, halves to even."""
    return F.bround(ratio * 100).cast("int")


def residual_english(target: Column) -> Column:
    """Whether three stop words or more, outside parentheses, make over 12 % of the words."""
    words = F.regexp_extract_all(F.regexp_replace(target, r"\([^)]*\)", " "), F.lit("[A-Za-z]+"), F.lit(0))
    english = F.size(F.filter(words, lambda w: F.lower(w).isin(STOPWORDS)))
    total = F.greatest(F.lit(1), F.size(F.filter(F.split(target, r"(?U)\s+"), lambda w: w != "")))
    return (english >= 3) & (english / total > 0.12)


def flags(source: Column, target: Column, kind: Column, required_terms: Column | None = None) -> Column:
    """Rule-based review flags of a translated segment, in order. required_terms: an array of TERMS; approved ones that aren't ambiguous must be used.

    Order: numbers, untranslated or English left, length, a flag for each reference that is gone, unused terms.
    An empty target has that flag alone; a cell of under four characters has none.
    """
    gone = missing_numbers(source, target)
    ratio = F.length(target) / F.length(source)
    same = (strip(target) == strip(source)) & source.rlike("[a-z]{3,}")
    sized = kind.isin("para", "list", "note") & (F.length(source) > 60)
    length = F.when(sized & (ratio < 0.55), F.format_string(SHORT, percent(ratio))).when(sized & (ratio > 2.6), F.format_string(LONG, percent(ratio)))
    out = F.array_compact(F.array(F.when(F.size(gone) > 0, F.concat(F.lit(NUMBERS_GONE), F.array_join(gone, ", "))), F.when(same, F.lit(SAME)).when(residual_english(target), F.lit(ENGLISH_LEFT)), length))
    references = F.filter(F.regexp_extract_all(source, F.lit(REFERENCE), F.lit(1)), lambda r: ~F.contains(target, r))
    out = F.concat(out, F.transform(references, lambda r: F.concat(F.lit(REFERENCE_GONE), r)))
    if required_terms is not None:
        binding = F.filter(F.coalesce(required_terms.cast(TERMS), F.array().cast(TERMS)), lambda t: (t["status"] == "approved") & ~F.coalesce(t["ambiguous"], F.lit(False)))
        # a Python function can't stand in a lambda: target and terms are normalised as one text
        normed = F.split(F.lower(nfc(F.concat_ws("\x1f", target, F.transform(binding, lambda t: F.coalesce(t["vi"], F.lit("")))))), "\x1f")
        zipped = F.zip_with(binding, F.slice(normed, F.lit(2), F.size(binding)), lambda t, v: F.struct(t["en"].alias("en"), t["vi"].alias("vi"), v.alias("normed")))
        targets = F.array_repeat(F.get(normed, F.lit(0)), F.size(binding))
        told = F.zip_with(zipped, targets, lambda z, t: F.struct(z["en"].alias("en"), z["vi"].alias("vi"), F.contains(t, z["normed"]).alias("used")))
        unused = F.filter(told, lambda z: ~z["used"])
        out = F.concat(out, F.transform(unused, lambda z: F.concat(F.lit(TERM_UNUSED), z["en"], F.lit(" → "), z["vi"])))
    return F.when(strip(target) == "", F.array(F.lit(EMPTY))).when((kind == "cell") & (F.length(source) < 4), F.array().cast("array<string>")).otherwise(out)


def label_key(text: Column) -> Column:
    """Lower case with runs of other signs than letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def pair_line(en: Column, vi: Column) -> Column:
    """"en → vi", or en alone where there is no other vi."""
    return F.when((F.coalesce(vi, F.lit("")) != "") & (label_key(vi) != label_key(en)), F.concat(en, F.lit(" → "), vi)).otherwise(en)


def escape_cell(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def color_hex(color: Column) -> Column:
    return F.concat(F.lit("#"), F.lpad(F.lower(F.hex(color.bitwiseAND(0xFFFFFF))), 6, "0"))


def placed_html(text: Column, kind: Column, size: Column, color: Column, bold: Column) -> Column:
    """A placed piece of text as a styled element; text should be in NFC."""
    body = text
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\n", "<br>")):
        body = F.replace(body, F.lit(sign), F.lit(name))
    style = F.concat(F.format_string("font-size: %.2fpx; line-height: ", size.cast("double")), F.when(kind.isin("heading", "label", "cell"), "1.15").otherwise("1.22"), F.lit("; color: "), color_hex(color), F.lit("; text-align: "), F.when(kind == "para", "justify").otherwise("left"), F.lit(";"), F.when(bold, " font-weight: bold;").otherwise(""), F.when(kind == "caption", " font-style: italic;").otherwise(""))
    return F.concat(F.lit('<div style="'), style, F.lit('">'), body, F.lit("</div>"))


def slug(text: Column) -> Column:
    """ASCII letters and digits in lower case with hyphens between, 60 signs at most. Decomposition isn't built in: Arrow batches."""

    @F.pandas_udf("string")
    def ascii_only(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKD", t).replace("đ", "d").replace("Đ", "D").encode("ascii", "ignore").decode(), na_action="ignore")

    out = F.left(F.lower(F.regexp_replace(F.regexp_replace(ascii_only(text), "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")), F.lit(60))
    return F.when(out == "", F.lit("tai-lieu")).otherwise(out)


def nfc(text: Column) -> Column:
    """Unicode NFC; null stays null. Spark has no built-in for it, so Arrow batches go to Python."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    return run(text)
