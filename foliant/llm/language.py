"""Language spans: script ranges narrow the candidates, Viterbi labels the words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import frugal

from .toxicity import learnable

#: Hashed letter trigrams, smoothing, the cost of changing language between words, words a Viterbi block.
BUCKETS, SMOOTH, SWITCH, BLOCK = 1 << 15, 0.5, 12.0, 64
#: Code points a step handles at once.
STEP = 1 << 21
#: Moves between labels that Viterbi holds at once (a byte each).
CELLS = 1 << 25
#: A script is a language's if so large a share of its training letters is in it.
SCRIPT_SHARE = 0.001
#: First code point of each script range, and the script that starts there.
RANGES = [(0x00, "Latin"), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x900, "Indic"), (0xE00, "Thai"), (0xE80, "Lao"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Common"), (0x2C60, "Latin"), (0x2C80, "Greek"), (0x2DE0, "Cyrillic"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x31A0, "Han"), (0x31F0, "Kana"), (0x3200, "Han"), (0xA000, "Other"), (0xA720, "Latin"), (0xA800, "Indic"), (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE30, "Common"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0x10000, "Other"), (0x20000, "Han")]
SCRIPTS = sorted({s for _, s in RANGES})
_STARTS = np.array([a for a, _ in RANGES], np.uint32)
_OF = np.array([SCRIPTS.index(s) for _, s in RANGES], np.int8)
_tables: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """For code points under 2**16 the lower-case letter, 0 for what isn't a letter."""
    if not _tables:
        _tables.append(np.array([(ord(c.lower()) if len(c.lower()) == 1 else i) if (c := chr(i)).isalpha() else 0 for i in range(1 << 16)], np.uint32))
    return _tables[0]


@dataclass
class Words:
    """Words of a run of texts: runs of letters. row, first letter's script and trigram buckets of each."""

    row: np.ndarray
    length: np.ndarray
    script: np.ndarray
    start: np.ndarray  # of each word in grams
    grams: np.ndarray


def words(texts: list[str]) -> Words:
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    points = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _fold()[np.minimum(points, 0xFFFF)]
    high = np.flatnonzero(points > 0xFFFF)
    if len(high):
        letters[high] = [p if chr(p).isalpha() else 0 for p in points[high].tolist()]
    inside = letters > 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    a = letters.astype(np.uint64)
    before, after = np.concatenate([[0], a[:-1]]).astype(np.uint64), np.concatenate([a[1:], [0]]).astype(np.uint64)
    mixed = (before * np.uint64(0x9E3779B97F4A7C15) + a) * np.uint64(0xBF58476D1CE4E5B9) + after
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    grams = (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32)[inside]
    length = end - start
    script = _OF[np.searchsorted(_STARTS, points[start], side="right") - 1] if len(start) else np.zeros(0, np.int8)
    return Words(np.searchsorted(bounds, start, side="right") - 1, length, script, np.cumsum(length) - length, grams)


def viterbi(scores: np.ndarray, row: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word: words x labels scores, words of a row stand together, changing label costs switch.

    Rows are cut into blocks. All blocks go forward side by side from every label they could begin with;
    block totals are then chained along each row, and all blocks go back side by side.
    """
    n, k = scores.shape
    if not n:
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.diff(row, prepend=row[0] - 1))
    sizes = np.diff(np.append(first, n))
    per = -(-sizes // BLOCK)
    block_first = np.cumsum(per) - per
    inrow = np.arange(n) - np.repeat(first, sizes)
    block = np.repeat(block_first, sizes) + inrow // BLOCK
    total = int(per.sum())
    table = np.zeros((BLOCK, total, k), np.float32)  # words past a row's end score 0 for all labels: nothing changes there
    table[inrow % BLOCK, block] = scores
    chunk = max(1, CELLS // (BLOCK * k * k))  # blocks whose moves are held at once; of more the moves are found again on the way back
    value, held = np.empty((total, k, k), np.float32), None
    for at in range(0, total, chunk):
        value[at : at + chunk], *held = _forward(table[:, at : at + chunk], switch)
    begin, end = np.empty(total, np.int64), np.empty(total, np.int64)
    comes = np.empty((total, k), np.int64)  # best label before the block for each label at its end
    reached = np.zeros((len(first), k), np.float32)
    depth = int(per.max())
    for j in range(depth):
        rows = np.flatnonzero(per > j)
        b = block_first[rows] + j
        sums = reached[rows][:, :, None] + value[b]
        comes[b] = sums.argmax(1)
        reached[rows] = sums.max(1)
    last = reached.argmax(1)
    for j in reversed(range(depth)):
        rows = np.flatnonzero(per > j)
        b = block_first[rows] + j
        end[b] = last[rows]
        begin[b] = comes[b, last[rows]]
        last[rows] = begin[b]
    labels = np.empty((BLOCK, total), np.int64)
    for at in range(0, total, chunk):
        part = slice(at, at + chunk)
        moved, source = held if total <= chunk else _forward(table[:, part], switch)[1:]
        now, first_label = end[part].copy(), begin[part]
        every = np.arange(len(now))
        for t in reversed(range(BLOCK)):
            labels[t, part] = now
            now = np.where(moved[t, every, first_label, now], source[t, every, first_label], now)
    return labels[inrow % BLOCK, block]


def _forward(table: np.ndarray, switch: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of blocks side by side, from each label that they could begin with: values at the end by label, whether a label was entered by a switch at each step, and from where."""
    _, total, k = table.shape
    value = np.full((total, k, k), -1e30, np.float32)  # from label, now label
    value[:, np.arange(k), np.arange(k)] = 0
    moved, source = np.empty((BLOCK, total, k, k), bool), np.empty((BLOCK, total, k), np.int16)
    for t in range(BLOCK):
        best = value.argmax(2)
        top = np.take_along_axis(value, best[:, :, None], 2) - np.float32(switch)
        moved[t], source[t] = top > value, best
        value = np.maximum(value, top) + table[t][:, None, :]
    return value, moved, source


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages, log probabilities
    allowed: np.ndarray  # scripts x languages

    def spans(self, texts: list[str]):
        """Words, the label of each, and word scores."""
        w = words(texts)
        if not len(w.row) or not self.languages:
            return w, np.zeros(len(w.row), np.int64), np.zeros((len(w.row), len(self.languages)), np.float32)
        per = np.add.reduceat(self.weights[w.grams], w.start, axis=0)
        fits = self.allowed[w.script]
        fits |= ~fits.any(1, keepdims=True)
        per = np.where(fits, per - per.max(1, keepdims=True), np.float32(-50)).clip(-50, 0).astype(np.float32)
        return w, viterbi(per, w.row), per

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[int]]:
        """Language of most letters, its share of the letters, and language spans, for each text."""
        w, label, _ = self.spans(texts)
        k = max(1, len(self.languages))
        letters = np.bincount(w.row * k + label, w.length, len(texts) * k).reshape(-1, k)
        change = np.ones(len(w.row), bool)
        change[1:] = (np.diff(label) != 0) | (np.diff(w.row) != 0)
        spans = np.bincount(w.row[change], minlength=len(texts))
        total = letters.sum(1)
        best = letters.argmax(1)
        share = letters.max(1) / np.maximum(total, 1)
        return [self.languages[b] if t and self.languages else "und" for b, t in zip(best, total, strict=True)], share.tolist(), spans.tolist()


def steps(texts: list[str]):
    """Texts in runs of about STEP code points, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > STEP:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def fit(docs: DataFrame) -> Model:
    """Trigram and script counts of all rows with a language and a doc_id that may be learned from. The driver gets BUCKETS sums a language."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learnable()).select("lang", "text")

    def count(batches):
        for b in batches:
            langs, texts = np.array(b.column("lang").to_pylist(), object), b.column("text").to_pylist()
            sums: dict[str, np.ndarray] = {}
            for i, j in steps(texts):
                w = words(texts[i:j])
                for lang in set(langs[i:j]):
                    mine = np.repeat(langs[i:j][w.row] == lang, w.length)
                    got = np.bincount(w.grams[mine], minlength=BUCKETS)
                    scripts = np.bincount(np.repeat(w.script, w.length)[mine], minlength=len(SCRIPTS))
                    sums[lang] = sums.get(lang, 0) + np.concatenate([got, scripts])
            for lang, s in sums.items():
                at = np.flatnonzero(s)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(s[at], pa.int64())], ["lang", "slot", "n"])

    got = rows.mapInArrow(frugal(count), "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(got["lang"].unique())
    table = np.zeros((BUCKETS + len(SCRIPTS), max(1, len(languages))))
    if languages:
        table[got["slot"].to_numpy(), [languages.index(x) for x in got["lang"]]] = got["n"]
    grams, scripts = table[:BUCKETS] + SMOOTH, table[BUCKETS:]
    return Model(languages, np.log(grams / grams.sum(0)).astype(np.float32), scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(0)))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans of every row, from its whole text alone.

    und if the text is null or has no letter, or nothing could be learned. score is the share of letters in
    spans of the predicted language; ties go to the first language by name. A null doc_id isn't held out nor
    learned from. Extra columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(~learnable(), F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        for b in batches:
            texts, out = b.column("text").to_pylist(), ([], [], [])
            for i, j in steps(texts):
                for whole, part in zip(out, model.value.predict(texts[i:j]), strict=True):
                    whole += part
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.int64())], ["doc_id", "held_out", "lang_pred", "score", "n_spans"])

    return rows.mapInArrow(frugal(run), "doc_id long, held_out boolean, lang_pred string, score double, n_spans long")
