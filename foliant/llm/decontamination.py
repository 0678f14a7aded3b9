"""Benchmark decontamination by canonical templates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, fresh, frugal, mix, prefix_sums, presence, present, signed, span_hash
from .tokens import Tokens, runs, tag

#: Words of a template window, and the share of an item's windows that a document must hold.
WINDOW, COVERAGE = 5, 0.8
#: Written units that follow numbers.
UNITS = "mm cm dm m km in ft yd mi mg g kg t lb oz ml cl dl l s sec ms min h hr hrs hz khz mhz ghz w kw mw kwh v mv a ma j kj cal kcal n pa kpa bar k c f eur usd gbp percent pct dollars euros pounds cents metres meters miles litres liters grams hours minutes seconds days weeks months years".split()
_NUMBER, _NAME, _UNIT = np.uint64(1), np.uint64(2), np.uint64(3)
_NO_ID = -(1 << 63)


class Templates:
    """Words of texts with typed placeholders for numbers, names and units, and windows over them."""

    def __init__(self, texts: list[str], window: int):
        t = self.tokens = Tokens(texts)
        self.window, self.value = window, t.word
        digit = np.concatenate([[0], np.cumsum(t.folded == 0x30)])
        number = digit[t.end] > digit[t.start]
        raw = t.points[t.start]
        capital = (raw != t.folded[t.start]) & ~number
        # the last sign before a word that isn't white space or an opening mark
        solid = ~np.isin(t.points, np.array([32, 9, 13, 34, 39, 40, 91, 0xA0, 0xAB, 0x201C, 0x2018], np.uint32))
        last = np.maximum.accumulate(np.where(solid, np.arange(len(t.points)), -1))
        before = np.where(t.start > 0, last[np.maximum(t.start - 1, 0)], -1)
        opens = (before < t.bounds[t.doc]) | np.isin(t.points[np.maximum(before, 0)], np.array([33, 46, 58, 63, 10, 0xBF, 0xA1], np.uint32))
        follows = np.concatenate([[False], number[:-1]]) & (np.diff(t.doc, prepend=-1) == 0) if len(number) else number
        unit = follows & np.isin(t.word, Templates.units())
        self.kind = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(capital & ~opens, _NAME, np.uint64(0))))
        # a number's own digits tell its value, which the folded word doesn't
        places = np.flatnonzero(number)
        if len(places):
            self.value = self.value.copy()
            self.value[places] = span_hash(prefix_sums(t.points), t.start[places], t.end[places])
        code = np.where(self.kind > 0, self.kind, t.word | np.uint64(8))
        # a capital that opens a sentence may be a name: its windows are told both ways
        maybe = capital & opens
        self.kinds = [self.kind, np.where(maybe, _NAME, self.kind)]
        sums = [prefix_sums(code), prefix_sums(np.where(maybe, _NAME, code))]
        n = max(0, len(code) - window + 1)
        at = np.arange(n)
        at = at[t.doc[at] == t.doc[at + window - 1]] if n else at
        span = np.full(len(at), window)
        # a line of fewer words than a window is one window
        count = np.bincount(t.line, minlength=len(t.line_end))
        first = np.cumsum(count) - count
        short = np.flatnonzero((count > 0) & (count < window))
        at, span = np.concatenate([at, first[short]]), np.concatenate([span, count[short]])
        seen = np.concatenate([[0], np.cumsum(maybe)])
        twice = np.flatnonzero(seen[at + span] > seen[at]) if len(at) else at
        self.at, self.span = np.concatenate([at, at[twice]]), np.concatenate([span, span[twice]])
        self.way = np.repeat([0, 1], [len(at), len(twice)])
        whole = [span_hash(sums[w], self.at[self.way == w], (self.at + self.span)[self.way == w]) for w in (0, 1)]
        self.hash = mix(np.concatenate(whole) + self.span.astype(np.uint64))
        begins = np.searchsorted(t.doc, np.arange(len(texts)))
        self.place = self.at - begins[t.doc[self.at]] if len(self.at) else self.at
        self.words = np.bincount(t.doc, minlength=len(texts))

    @staticmethod
    def units() -> np.ndarray:
        return Tokens(UNITS).word

    def rows(self, which: np.ndarray) -> list[pa.Array]:
        """Window hash, place, and the values in its slots."""
        slots = []
        for i, n, way in zip(self.at[which].tolist(), self.span[which].tolist(), self.way[which].tolist(), strict=True):
            slots.append(signed(self.value[i : i + n][self.kinds[way][i : i + n] > 0]))
        return [pa.array(signed(self.hash[which])), pa.array(self.place[which].astype(np.int32)), pa.array(slots, pa.list_(pa.int64()))]


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, tag, item_id, matched, windows, coverage, same_values for each document that holds an item.

    Words are canonical when numbers, capitalised words within a sentence, and units after numbers are typed
    placeholders; a capitalised word that opens a sentence counts as a word and as a name. Windows of canonical
    words are hash-joined; those of one document, item and offset between the two belong together and count if
    their slots are consistent: of the values that the document has for a value of the item, the one met most
    (over half of the times) holds, and windows with another are left out. A pair is a leak if the windows left
    hold the given share of the item's. same_values tells verbatim copies from re-parameterised ones.

    An item of fewer words than a window matches a line that has no other words. Null and wordless texts, null
    item ids and empty tables match nothing; a null doc_id is kept as null; rows of one doc_id are told apart by
    tag, the CRC of the text; equal rows are one. Texts are taken whole, and other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "templates")

    def item_windows(batches):
        for b in batches:
            ids, texts = b.column("item_id").to_numpy(zero_copy_only=False), b.column("text").to_pylist()
            for i, j in runs(texts):
                t = Templates(texts[i:j], window)
                # of an item as long as a window its windows, of a shorter one the line that it is
                every = np.flatnonzero((t.span == window) | (t.words[t.tokens.doc[t.at]] == t.span)) if len(t.at) else t.at
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][t.tokens.doc[t.at[every]]]), *t.rows(every)], ["item_id", "window", "at", "slots"])

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null and item_id is not null").distinct()
    items = scratch.table(items.mapInArrow(frugal(item_windows), "item_id long, window long, at int, slots array<long>"), "items")
    known = presence(items.select("window").distinct(), "window")

    def doc_windows(batches):
        for b in batches:
            ids, texts = b.column("id").to_numpy(zero_copy_only=False), b.column("text").to_pylist()
            for i, j in runs(texts):
                t = Templates(texts[i:j], window)
                which = np.flatnonzero(present(known.value, t.hash))
                if not len(which):
                    continue
                doc = t.tokens.doc[t.at[which]]
                tags = np.array([tag(x) for x in texts[i:j]], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][doc]), pa.array(tags[doc]), *t.rows(which)], ["id", "tag", "window", "doc_at", "doc_slots"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), "text").where("text is not null")
    found = rows.mapInArrow(frugal(doc_windows), "id long, tag long, window long, doc_at int, doc_slots array<long>").distinct()
    totals = items.groupBy("item_id").agg(F.count_distinct("at").alias("windows"))
    pairs = F.transform(F.arrays_zip(F.col("slots").alias("i"), F.col("doc_slots").alias("d")), lambda p: F.struct(p["i"].alias("i"), p["d"].alias("d")))
    met = F.collect_set(F.struct("at", pairs.alias("pairs")))  # at most an item's windows, two ways each
    lined = found.join(items, "window").groupBy("id", "tag", "item_id", (F.col("doc_at") - F.col("at")).alias("shift")).agg(met.alias("met"))
    lined = lined.withColumn("all", F.flatten(F.transform("met", lambda m: m["pairs"])))

    def holds(p):
        alike = F.filter("all", lambda q: q["i"] == p["i"])
        return 2 * F.size(F.filter(alike, lambda q: q["d"] == p["d"])) > F.size(alike)

    lined = lined.withColumn("met", F.filter("met", lambda m: F.forall(m["pairs"], holds))).where(F.size("met") > 0)
    lined = lined.withColumns({"at": F.transform("met", lambda m: m["at"]), "pairs": F.flatten(F.transform("met", lambda m: m["pairs"]))})
    same = F.forall("pairs", lambda p: p["i"] == p["d"])
    got = lined.groupBy("id", "tag", "item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("matched"), F.min(same).alias("same_values"))
    out = got.join(totals, "item_id").where(F.col("matched") >= coverage * F.col("windows"))
    return out.select(F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"), "tag", "item_id", F.col("matched").cast("long").alias("matched"), "windows", (F.col("matched") / F.col("windows")).alias("coverage"), "same_values")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no item; see leaks. Of rows of one doc_id only those whose text holds one go."""
    id_, tag_ = fresh(docs, "id", "tag")
    bad = leaks(docs.select("doc_id", "text"), benchmark).select(F.coalesce("doc_id", F.lit(_NO_ID)).alias(id_), F.col("tag").alias(tag_)).distinct()
    keyed = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), tag_: F.crc32(F.coalesce("text", F.lit("")).cast("binary"))})
    return keyed.join(bad, [id_, tag_], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
