"""Document fingerprints by winnowing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import frugal, mix, neighbour_partitions, powers, ranges, window_minima

#: A run of GRAM + WINDOW - 1 equal letters and digits always shares a fingerprint. A text with fewer grams than a
#: window is one window.
GRAM, WINDOW = 8, 16
_BASE = 0xD6E8FEB86659FD93
_fold: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """For code points under 2**16 their lower-case letter or digit, else 0."""
    if not _fold:
        _fold.append(np.array([ord(low) if chr(i).isalnum() and len(low := chr(i).lower()) == 1 else i if chr(i).isalnum() else 0 for i in range(1 << 16)], np.uint32))
    return _fold[0]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def winnow(text: str | None, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen 64-bit gram hashes and the code point positions where the grams start.

    Grams run over letters and digits in lower case; other code points are skipped, and positions refer to
    the text as given. Of every window of consecutive grams the smallest hash is kept, the rightmost on
    ties; a text with fewer grams than a window is one window. A text of fewer letters and digits than a gram
    has one fingerprint of what it has (its code points if none is a letter or digit); an empty or null text
    has none.
    """
    points = code_points(text or "")
    table = fold_table()
    kept = table[np.minimum(points, 0xFFFF)]
    kept = np.where(points > 0xFFFF, points, kept)
    places = np.flatnonzero(kept)
    symbols = kept[places]
    if not len(symbols):
        places, symbols = np.arange(len(points)), points
    if not len(symbols):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    symbols = symbols.astype(np.uint64)
    if len(symbols) < gram:
        whole = (symbols * powers(_BASE, len(symbols))[::-1]).sum(dtype=np.uint64)
        return mix(np.array([whole + np.uint64(len(symbols))])), places[:1]
    hashes, span = symbols, 1  # doubling: the hash of 2s symbols is that of s symbols times base**s plus the next
    while span < gram:
        step = min(span, gram - span)
        hashes = hashes[: len(hashes) - step] * np.uint64(pow(_BASE, step, 1 << 64)) + (hashes[step:] if step == span else _gram(symbols, step)[span:][: len(hashes) - step])
        span += step
    hashes = mix(hashes)
    chosen = window_minima((hashes >> np.uint64(32)).astype(np.uint32), min(window, len(hashes)))
    chosen = chosen[np.flatnonzero(np.diff(chosen, prepend=-1))]
    return hashes[chosen], places[chosen]


def _gram(symbols: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(0, len(symbols) - n + 1), np.uint64)
    for i in range(n):
        out = out * np.uint64(_BASE) + symbols[i : i + len(out)]
    return out


def encode(hashes: np.ndarray, places: np.ndarray) -> str:
    """16 hex digits for each fingerprint: 8 of its hash, 8 of its position."""
    pairs = np.empty((len(hashes), 2), ">u4")
    pairs[:, 0], pairs[:, 1] = hashes >> np.uint64(32), places
    return pairs.tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sorted sets of fingerprints; of two empty ones 1."""
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def edited_text(text: str, following: str) -> str:
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, hashes, positions of each row's whole text. Rows pass alone; no shuffle."""

    def run(batches):
        for b in batches:
            got = [winnow(t, gram, window) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([g[0].view(np.int64) for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.int64()))], ["doc_id", "hashes", "positions"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(run), "doc_id long, hashes array<long>, positions array<long>")


def neighbour_report(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edit with the next document's beginning.

    Next is by ascending doc_id, after the last the first; of rows with equal doc_id by a hash of the text, so
    that a key that many rows share is dealt out too. A null doc_id comes first, a null text is empty. A single
    document is its own next one; an empty table has no row. Columns other than doc_id and text are ignored. A
    long text is taken whole. One shuffle of the texts by key range; only a range's first rows go twice.
    """
    text, order = F.coalesce("text", F.lit("")), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).bitwiseXOR(F.lit(-(1 << 63)))
    key = F.concat(F.lpad(F.hex(order), 16, "0"), F.lpad(F.hex(F.xxhash64(text)), 16, "0"))  # as text in the order of the numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), key.alias("key_"))
    dealt = neighbour_partitions(rows, "key_", ranges(docs.sparkSession), wrap=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, out = None, []

        def known(text):
            hashes, places = winnow(text, gram, window)
            return text, hashes, places, np.unique(hashes)

        def report(doc, now, following):
            text, hashes, places, own = now
            edited = edited_text(text, following[0])
            e_hashes, e_places = (hashes, places) if edited == text else winnow(edited, gram, window)
            return doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), encode(hashes, places), encode(e_hashes, e_places), likeness(own, np.unique(e_hashes)), likeness(own, following[3])

        def ordered():
            """Own rows by key, then the first row after them; a range's earlier neighbour isn't needed."""
            for b in batches:
                for doc, text, role in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "role_")), strict=True):
                    if role >= 0:
                        yield doc, text, role

        size = 0
        for doc, text, role in ordered():
            now = known(text)
            if before is not None:
                out.append(report(*before, now))
                size += len(out[-1][3]) + len(out[-1][4])
            before = (doc, now) if role == 0 else None
            if size > 8 << 20:
                yield _batch(out)
                out, size = [], 0
            if role > 0:
                break
        if out:
            yield _batch(out)

    return dealt.select("doc_id", "text", "key_", "role_").mapInArrow(frugal(run), ", ".join(f"{n} {t}" for n, t, _ in _COLUMNS))


_COLUMNS = [("doc_id", "long", pa.int64()), ("n_chars", "long", pa.int64()), ("edited_sha256", "string", pa.string()), ("fingerprint", "string", pa.string()), ("edited_fingerprint", "string", pa.string()), ("near_edited", "double", pa.float64()), ("near_next", "double", pa.float64())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, _, t) in zip(zip(*rows, strict=True), _COLUMNS, strict=True)], [n for n, _, _ in _COLUMNS])
