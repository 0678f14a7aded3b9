"""Exact substring deduplication over a prefix-free parse."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import BITMAP_BITS, INVERSE, MULTIPLIER, Scratch, bit_set, frugal, mix, powers, presence, present, signed, slices, span_hash, utf8, window_minima

#: Length of strings that count as repeats, and of the rolling hash that cuts phrases.
LENGTH, TRIGGER = 100, 32
#: Starts of a piece of a phrase.
PIECE = 8
#: Bytes parsed at once; the base of the second hash.
STEP, SECOND = 1 << 19, 0xC2B2AE3D27D4EB4F
_SECOND_INVERSE = pow(SECOND, -1, 1 << 64)
_NO_ID = -(1 << 63)


@dataclass
class Units:
    """Runs of starts, the trigger each belongs to, and the hashes of its group and (two, 128 bits in all) of itself."""

    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    place: np.ndarray
    group: np.ndarray
    unit: np.ndarray
    check: np.ndarray

    def take(self, at: np.ndarray) -> Units:
        return Units(*(x[at] for x in (self.doc, self.first, self.last, self.place, self.group, self.unit, self.check)))


_TABLE = mix(np.arange(1, 257, dtype=np.uint64))


class Parse:
    """Phrases of a run of texts: maximal runs of starts whose length-byte strings have the same trigger.

    A string's trigger is the place of the least rolling hash in it (rightmost on ties), so it depends on
    the string alone, every string has one, and equal strings have it at the same place. A phrase is the
    text from its first start to the end of its last string: no phrase's strings go on past it, which makes
    the parse prefix-free in that equal phrases hold equal strings and unequal strings lie in unequal phrases.
    """

    def __init__(self, column: pa.Array, ids: np.ndarray, tags: np.ndarray, length: int, trigger: int):
        data, self.bounds = utf8(column)
        self.ids, self.tags, self.length, n = ids, tags, length, len(data)
        self.sums, none = np.zeros(n + 1, np.uint64), np.zeros(0, np.int64)
        spread = _TABLE[data]
        np.cumsum(spread * powers(MULTIPLIER, n), out=self.sums[1:])
        self.sums2 = np.zeros(n + 1, np.uint64)
        np.cumsum(np.multiply(spread, powers(SECOND, n), out=spread), out=self.sums2[1:])
        self.first = self.last = self.doc = self.place = none
        self.gram = self.phrase = self.check = none.view(np.uint64)
        if n < length:
            return
        rolling = (self.sums[trigger:] - self.sums[:-trigger]) * powers(INVERSE, n - trigger + 1)
        chosen = window_minima((rolling * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)).astype(np.uint32), length - trigger + 1)
        doc = np.repeat(np.arange(len(ids)), np.diff(self.bounds))
        inside = np.zeros(len(chosen), bool)
        inside[doc[: len(chosen)] == doc[length - 1 :]] = True
        new = np.ones(len(chosen), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (doc[1 : len(chosen)] != doc[: len(chosen) - 1]) | (inside[1:] != inside[:-1])
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(chosen)) - 1
        keep = inside[start]
        self.first, self.last = start[keep], end[keep]
        self.doc, self.place = doc[self.first], chosen[self.first]
        self.gram = mix(rolling[self.place])
        self.phrase = mix(self.span(self.first, self.last + length) ^ self.gram)
        self.check = self.second(self.first, self.last + length)
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((tags, ids))] = np.arange(len(ids))
        self.rank = rank

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return span_hash(self.sums, start, end)

    def second(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums2[end] - self.sums2[start]) * powers(_SECOND_INVERSE, len(self.sums2))[start])

    def phrases(self) -> Units:
        return Units(self.doc, self.first, self.last, self.place, self.gram, self.phrase, self.check)

    def pieces(self, u: Units) -> Units:
        """Starts of phrases by their distance to the trigger, PIECE at a time; the group is what all strings of such a piece have in common."""
        most, least = (u.place - u.first) // PIECE, (u.place - u.last) // PIECE
        n = most - least + 1
        of = np.repeat(np.arange(len(n)), n)
        far = np.repeat(most, n) - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        place = u.place[of]
        first, last = np.maximum(u.first[of], place - far * PIECE - PIECE + 1), np.minimum(u.last[of], place - far * PIECE)
        core = self.span(place - far * PIECE, place - far * PIECE - PIECE + 1 + self.length)
        return Units(u.doc[of], first, last, place, mix(core + far.astype(np.uint64)), self.span(first, last + self.length), self.second(first, last + self.length))

    def strings(self, u: Units) -> Units:
        n = u.last - u.first + 1
        of = np.repeat(np.arange(len(n)), n)
        start = u.first[of] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        end = start + self.length
        return Units(u.doc[of], start, start, u.place[of], np.zeros(len(start), np.uint64), self.span(start, end), self.second(start, end))

    def rows(self, u: Units) -> pa.RecordBatch:
        """The first of equal units, with hashes; the later ones as bare runs of starts."""
        order = np.lexsort((u.first, self.rank[u.doc]))
        u = u.take(order)
        same = np.lexsort((np.arange(len(order)), u.check, u.unit))
        one = np.ones(len(order), bool)
        one[same[1:]] = (u.unit[same[1:]] != u.unit[same[:-1]]) | (u.check[same[1:]] != u.check[same[:-1]])
        lone, later = u.take(np.flatnonzero(one)), u.take(np.flatnonzero(~one))
        new = np.ones(len(later.doc), bool)
        new[1:] = (later.doc[1:] != later.doc[:-1]) | (later.first[1:] > later.last[:-1] + 1)
        start = np.flatnonzero(new)
        last = later.last[np.append(start[1:], len(new)) - 1] if len(new) else later.last
        doc = np.concatenate([lone.doc, later.doc[start]])
        base, n = self.bounds[doc], len(start)
        first, last = np.concatenate([lone.first, later.first[start]]), np.concatenate([lone.last, last])
        none = pa.nulls(n, pa.int64())
        hashes = [pa.concat_arrays([pa.array(signed(x)), none]) for x in (lone.group, lone.unit, lone.check)]
        return pa.RecordBatch.from_arrays([*hashes, pa.array(self.ids[doc]), pa.array(self.tags[doc]), pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32))], _NAMES)


#: Slot of a place in the corpus; _slot_column says the same to SQL. No product leaves 63 bits.
def _slots(ids: np.ndarray, tags: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.mod(np.mod(ids, 1 << 24) * 2654435761 + np.mod(tags, 1 << 16) * 9973 + first * 40503, 1 << BITMAP_BITS)


def _slot_column():
    return F.pmod(F.pmod("id", F.lit(1 << 24)) * 2654435761 + F.pmod("tag", F.lit(1 << 16)) * 9973 + F.col("first").cast("long") * 40503, F.lit(1 << BITMAP_BITS))


def _parses(batches: Iterator[pa.RecordBatch], length: int, trigger: int) -> Iterator[Parse]:
    for b in batches:
        text = b.column("text")
        ids, tags = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "tag"))
        for i, j in slices(text, STEP):
            yield Parse(text[i:j], ids[i:j], tags[i:j], length, trigger)


_NAMES = ["group", "unit", "check", "id", "tag", "first", "last"]
_ROWS = "group long, unit long, check long, id long, tag long, first int, last int"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty), id (doc_id, null as smallest) and tag, which tells unlike texts of one doc_id apart."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"))
    return rows.withColumn("tag", F.crc32(F.col("text").cast("binary")))


def repeats(rows: DataFrame, length: int = LENGTH, trigger: int = TRIGGER) -> DataFrame:
    """id, tag, first, last: runs of starts whose length-byte string also starts earlier in the corpus.

    Three levels of units, each a dictionary with its first place in corpus order: phrases, pieces of
    phrases, strings. At each level all but the first of equal units repeat. A unit that came first can hold
    repeating strings only if an unlike unit shares its group (a phrase's trigger hash, the bytes that all
    strings of a piece have in common); only such units are looked at on the next level. What to look at is
    kept as a bitmap of fixed size; what a bitmap lets through besides costs time only. Each task first
    settles what repeats within it, so a hot unit sends one row a step and task.
    """
    scratch = Scratch(rows.sparkSession, "substrings")
    rows = rows.select("id", "tag", "text")

    def triggers(batches):
        for p in _parses(batches, length, trigger):
            if len(p.gram):
                grams, n = np.unique(p.gram, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(grams)), pa.array(np.minimum(n, 2).astype(np.int8))], ["gram", "n"])

    seen = rows.mapInArrow(frugal(triggers), "gram long, n byte").groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram")
    marks = [presence(scratch.table(seen, "seen"), "gram", None)]
    out = None
    for level in range(3):

        def units(batches, marks=tuple(marks), level=level):
            for p in _parses(batches, length, trigger):
                if not len(p.gram):
                    continue
                u = p.phrases()
                u = u.take(np.flatnonzero(present(marks[0].value, u.group)))
                for step, cut in zip(range(level), (p.pieces, p.strings), strict=False):
                    slots = _slots(p.ids[u.doc], p.tags[u.doc], u.first - p.bounds[u.doc])
                    u = cut(u.take(np.flatnonzero(bit_set(marks[step + 1].value, slots))))
                if len(u.doc):
                    yield p.rows(u)

        found = scratch.table(rows.mapInArrow(frugal(units), _ROWS), "units")
        units_ = ["group", "unit", "check"]
        firsts = found.where("unit is not null").groupBy(*units_).agg(F.min(F.struct("id", "tag", "first")).alias("one"), F.count("*").alias("n"))
        firsts = scratch.table(firsts, "firsts")
        # a unit met once needs no join
        later = found.where("unit is not null").join(firsts.where("n > 1").select(*units_, "one").hint("shuffle_hash"), units_).where(F.struct("id", "tag", "first") != F.col("one"))
        told = scratch.table(found.where("unit is null").select("id", "tag", "first", "last").union(later.select("id", "tag", "first", "last")), "told")
        if level < 2:
            mixed = firsts.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
            marks.append(presence(firsts.join(mixed, "group", "left_semi").select("one.*"), _slot_column()))
        scratch.drop(found, firsts)
        out = told if out is None else out.union(told)
    return out


def covered(firsts: list[int], lasts: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the strings that start there."""
    out: list[list[int]] = []
    for a, b in sorted(zip(firsts, lasts, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, b) for a, b in out]


def strip_repeats(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept of every row.

    A byte goes if a length-byte string over it also starts earlier: in a smaller doc_id or earlier in the
    same text. A null text is empty; a null doc_id is smaller than all. Rows of one doc_id with unlike texts
    are in order of the texts' CRC; fully equal rows are one document, told twice. Extra columns are ignored.
    """
    rows = keyed(docs)
    runs = repeats(rows, length, trigger)
    spans = runs.groupBy("id", "tag").agg(F.collect_list(F.struct("first", "last")).alias("runs"))  # at most a text's length
    joined = rows.join(spans.hint("shuffle_hash"), ["id", "tag"], "left").select("doc_id", "text", "runs")

    def strip(batches):
        for b in batches:
            out = []
            for doc, text, runs in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("runs"), strict=True):
                data, spans = text.encode(), []
                if runs.is_valid:
                    spans = covered(runs.values.field("first").to_pylist(), runs.values.field("last").to_pylist(), length)
                ends = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[a:z] for a, z in zip(ends[::2], ends[1::2], strict=True))
                out.append((doc, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 6, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(frugal(strip), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
