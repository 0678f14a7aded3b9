"""Fuzzy line deduplication: SimHash, pigeonhole blocks and bottom-three sketches, verified by edit similarity."""

from __future__ import annotations

import math
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, components, fresh, frugal, gathered, mix, powers, presence, present, ranges, signed
from .jaccard import nearest_pairs
from .tokens import Tokens, runs, tag

#: Words that a line must have to count; edit similarity of duplicates.
LEAST_WORDS, SIMILARITY = 1, 0.8
#: Blocks of 16 bits of a SimHash. A key joins two: signatures that differ in up to BLOCKS - 2 bits always share one.
BLOCKS = 4
PAIRS = [*combinations(range(BLOCKS), 2)]
#: Signatures of alike lines differ in fewer of their 128 bits: word pairs give unlike lines 64 on average (deviation 6), and lines with a
#: fifth of their words replaced 38 (deviation 5). Lines of under SHORT characters are verified however far they are.
FAR, SHORT = 54, 60
#: Sketches of a line, each its three least words under a hash of its own, and the bytes of a sketch.
#: A word's hash is divided by its length squared, so that long words, which are rare, are mostly chosen.
BANDS, WIDTH = 14, 6
#: Lines of up to so many words have the line without each of its words in place of the first sketches, and the whole line.
FEW = 6
#: Words that a walk over two lines looks ahead; characters beyond which q-grams are counted before edits.
REACH, LONG = 6, 4000
#: Lines of a group of a bucket; two groups meet in a tile.
TILE = 256
#: Columns after which it is seen whether an edit distance can still be small enough; more, where a column is long.
LOOK = 32
#: Bytes of a key when shared keys are found; keys that agree in so many only let more lines pass.
KEY_BYTES = 5
_NO_ID = -(1 << 63)
#: Words whose bits are counted in 8-bit lanes.
_LANE = 255
#: The eight bits of a byte, each in an 8-bit lane.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


class Lines:
    """Countable lines of a run of texts: hash and length of the normalised line, and if signed its SimHash (two words) and sketches.

    Lines of equal hash within the run are signed once: at holds the places of the first of each, count how many they are.
    """

    def __init__(self, texts: list[str], least_words: int = LEAST_WORDS, sign: bool = True):
        t = self.tokens = Tokens(texts)
        count = np.bincount(t.line, minlength=len(t.line_end))
        self.line = np.flatnonzero(count >= max(1, least_words))
        mine = count[t.line] >= max(1, least_words)
        word, owner = t.word[mine], t.line[mine]
        self.hash, self.sim, self.more, self.count = np.zeros(len(self.line), np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.size, self.at, self.bands = np.zeros(len(self.line), np.int64), np.zeros(0, np.int64), np.zeros((0, BANDS), np.uint64)
        if not len(self.line):
            return
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        size = np.diff(np.append(first, len(owner)))
        place = np.arange(len(owner)) - np.repeat(first, size)
        self.hash = mix(np.add.reduceat(word * powers(0xD1B54A32D192ED03, int(size.max()))[place], first))
        if not sign:
            return
        length = (t.end - t.start)[mine]
        self.size = np.add.reduceat(length + 1, first) - 1
        _, at, count = np.unique(self.hash, return_index=True, return_counts=True)
        one = np.zeros(len(first), np.int64)
        one[at] = count
        self.at = np.flatnonzero(one)
        self.count, one = one[self.at], one > 0
        keep = np.repeat(one, size)
        word, length, size, place = word[keep], length[keep], size[one], place[keep]
        first = np.cumsum(size) - size
        pair = _pairs(word, first, size)
        self.sim, self.more = _simhash(pair, first, size, place), _simhash(mix(pair ^ np.uint64(0x5851F42D4C957F2D)), first, size, place)
        self.bands = _sketches(word, length, first, size, place)


def _pairs(word: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words, the last one's with the line's first: common words alone make unlike lines near."""
    following = np.append(word[1:], np.uint64(0))
    following[first + size - 1] = word[first]
    return mix(word * np.uint64(3) + following)


def _simhash(word: np.ndarray, first: np.ndarray, size: np.ndarray, place: np.ndarray) -> np.ndarray:
    part = np.flatnonzero(place % _LANE == 0)
    lanes, sums, counts = word.view(np.uint8).reshape(-1, 8), np.zeros(len(word) + 1, np.uint64), np.empty((len(part), 8), np.uint64)
    at, spread = np.empty(len(word), np.intp), np.empty(len(word), np.uint64)
    for k in range(8):  # lanes overflow in a sum over all words, but the difference of two sums is that of the words between
        at[:] = lanes[:, k]
        np.cumsum(_SPREAD.take(at, out=spread, mode="clip"), out=sums[1:])
        counts[:, k] = np.diff(sums[np.append(part, len(word))])
    ones = counts.view(np.uint8).astype(np.int32)
    if len(part) > len(first):
        ones = np.add.reduceat(ones, np.searchsorted(part, first), axis=0)
    return np.packbits(2 * ones > size[:, None], axis=1).view(np.uint64).ravel()


def _sketches(word: np.ndarray, length: np.ndarray, first: np.ndarray, size: np.ndarray, place: np.ndarray) -> np.ndarray:
    """BANDS hashes a line: of its three least words under each of as many hash functions; the same words in any order give the same."""
    line, inverse = np.repeat(np.arange(len(first)), size), (1 / length.astype(np.float32) ** 2).astype(np.float32)
    low, high = word.astype(np.uint32), (word >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first), BANDS), np.uint64)
    u, v, value, same = np.empty_like(low), np.empty_like(low), np.empty_like(inverse), np.empty(len(low), bool)
    bits, none = value.view(np.int32), np.float32(np.inf).view(np.int32)  # positive floats are in the order of their bits
    for k in range(BANDS):
        np.bitwise_xor(low, np.uint32(0x9E3779B1 * (k + 1) & 0xFFFFFFFF), out=u)
        u *= np.uint32(0x85EBCA6B)
        u ^= np.right_shift(u, np.uint32(15), out=v)
        u += np.multiply(high, np.uint32(2 * k + 1), out=v)
        u *= np.uint32(0xC2B2AE35)
        u ^= np.right_shift(u, np.uint32(16), out=v)
        u |= np.uint32(1)
        np.multiply(u.astype(np.float32), inverse, out=value)
        key = np.full(len(first), k, np.uint64)
        for r in range(3):
            least = np.minimum.reduceat(bits, first)
            key = mix(key * np.uint64(31) + least.view(np.uint32).astype(np.uint64))
            if r < 2:
                np.copyto(bits, none, where=np.equal(bits, np.repeat(least, size), out=same))
        out[:, k] = key
    short = np.flatnonzero(size <= FEW)
    if len(short):  # as sums of word hashes, so that a word left out and a word replaced agree
        mine = np.flatnonzero((size <= FEW)[line])
        total = np.add.reduceat(mix(word), first)
        chars = np.add.reduceat(length, first)
        rest = total[line[mine]] - mix(word[mine])
        allowed = (2 * length[mine] <= chars[line[mine]]) & (size[line[mine]] > 1)  # the word left out is half of the line at most
        out[line[mine[allowed]], place[mine[allowed]]] = mix(rest[allowed] + np.uint64(0xFEED))
        out[short, FEW] = mix(total[short] + np.uint64(0xFEED))
    return out


def block_keys(sim: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """A key for each pair of blocks of each SimHash and for each sketch. A short line's keys without a word may stand in any place, so they bear no place."""
    blocks = [(sim >> np.uint64(16 * i)) & np.uint64(0xFFFF) for i in range(BLOCKS)]
    pairs = [mix((blocks[i] << np.uint64(16) | blocks[j]) + np.uint64((k + 1) << 40)) for k, (i, j) in enumerate(PAIRS)]
    return np.column_stack([*pairs, mix(bands.ravel() & np.uint64((1 << 8 * WIDTH) - 1)).reshape(bands.shape)])


#: A signed line as it travels, many in one binary value: hash, a place, length, SimHash, the low WIDTH bytes of each sketch, and whether
#: its run of texts holds it more than once.
_SIGNED = np.dtype([("line", "<i8"), ("slot", "<i8"), ("size", "<i8"), ("sim", "<u8"), ("more", "<u8"), ("bands", "u1", (BANDS, WIDTH)), ("again", "?")])


def _records(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), _SIGNED)


def _keys(records: np.ndarray) -> np.ndarray:
    bands = np.zeros((len(records), BANDS, 8), np.uint8)
    bands[:, :, :WIDTH] = records["bands"]
    return block_keys(np.ascontiguousarray(records["sim"]), bands.view(np.uint64).reshape(len(records), BANDS))


def _parts(hashes: np.ndarray, n: int) -> np.ndarray:
    """The range, of n equal ones, that each hash is in."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _classes(found: DataFrame) -> DataFrame:
    """signs, again: every line once, as records; and the hashes of lines that stand more than once."""
    n_parts = ranges(found.sparkSession)

    def run(batches):
        held = np.zeros(0, np.int64)  # a range's lines, as many as its share of them
        for b in batches:
            records = _records(b.column("signs"))
            line, at, n = np.unique(records["line"], return_index=True, return_counts=True)
            place = np.searchsorted(held, line)
            known = held[np.minimum(place, len(held) - 1)] == line if len(held) else np.zeros(len(line), bool)
            again = np.union1d(line[known | (n > 1)], records["line"][records["again"]])
            held = np.insert(held, place[~known], line[~known])
            yield pa.RecordBatch.from_arrays([pa.array([records[at[~known]].tobytes()], pa.binary()), pa.array([again.tobytes()], pa.binary())], ["signs", "again"])

    return found.where("part is not null").select("part", "signs").repartitionById(n_parts, "part").mapInArrow(frugal(run), "signs binary, again binary")


def distance(a: str, b: str, most: int | None = None) -> int:
    """Edit distance: common ends are cut off, the rest goes a bit-parallel column at a time. Beyond most, if given, most + 1."""
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    a, b = a[n:], b[n:]
    n = 0
    while n < min(len(a), len(b)) and a[-1 - n] == b[-1 - n]:
        n += 1
    a, b = a[: len(a) - n], b[: len(b) - n]
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, score, look = full, 0, len(a), max(LOOK, len(a) >> 5)
    for done, c in enumerate(b):
        if most is not None and done and done % look == 0 and _least(plus, minus, len(a), done, len(b)) > most:
            return most + 1
        hit = where.get(c, 0)
        vertical = hit | minus
        across = (((hit & plus) + plus) ^ plus) | hit
        up = minus | ~(across | plus) & full
        down = plus & across
        score += bool(up & top) - bool(down & top)
        up = (up << 1 | 1) & full
        down = down << 1 & full
        plus = down | ~(vertical | up) & full
        minus = up & vertical
    return score


def _least(plus: int, minus: int, height: int, done: int, width: int) -> int:
    """Least edit distance that a column, given by its steps up and down, still allows."""
    up, down = (np.unpackbits(np.frombuffer(x.to_bytes(height // 8 + 1, "little"), np.uint8), bitorder="little")[:height].astype(np.int32) for x in (plus, minus))
    column = np.concatenate([[done], done + np.cumsum(up - down)])
    return int((column + np.abs(height - np.arange(height + 1) - (width - done))).min())


def walk(p: list[str], q: list[str], most: int) -> bool:
    """Whether one pass over the words of two lines finds an edit script of at most so many characters. False proves nothing."""
    i = j = cost = 0
    m, n = len(p), len(q)
    while i < m and j < n:
        if p[i] == q[j]:
            i, j = i + 1, j + 1
            continue
        for d, e in _AHEAD:
            if i + d < m and j + e < n and p[i + d] == q[j + e] and p[i + d + 1 : i + d + 2] == q[j + e + 1 : j + e + 2]:
                break
        else:
            d, e = m - i, n - j
        cost += max(sum(map(len, p[i : i + d])) + d, sum(map(len, q[j : j + e])) + e)
        if cost > most:
            return False
        i, j = i + d, j + e
    return cost + max(sum(map(len, p[i:])) + len(p) - i, sum(map(len, q[j:])) + len(q) - j) <= most


#: Words left out of both lines, few first.
_AHEAD = [(d, s - d) for s in range(1, 2 * REACH + 1) for d in range(max(0, s - REACH), min(s, REACH) + 1)]


def alike(a: str, b: str, least: float = SIMILARITY) -> bool:
    """Whether at most 1 - least of the longer text is edited. Cheap bounds decide most pairs: length, a walk over the words, q-grams of long lines."""
    longer = max(len(a), len(b))
    most = longer - math.ceil(least * longer - 1e-9)
    if longer - min(len(a), len(b)) > most:
        return False
    if walk(a.split(" "), b.split(" "), most):
        return True
    for q in (1, 3) if longer > LONG else ():  # an edit changes q of the q-grams at most
        m, n = (Counter(zip(*(x[i:] for i in range(q)), strict=False)) for x in (a, b))
        if (m & n).total() < longer - q + 1 - q * most:
            return False
    return distance(a, b, most) <= most


def alike_rows(p: list[str], q: list[str], least: float = SIMILARITY, walked: bool = True) -> np.ndarray:
    """alike() of many pairs; walked: a walk over the words comes first, which spares most alike pairs the rest.

    Pairs of like length go side by side, a bit-parallel column of them all at a time; where there are few, one by one.
    """
    out, sizes = np.zeros(len(p), bool), np.array([[len(x) for x in p], [len(x) for x in q]], np.int64).reshape(2, -1)
    longer = sizes.max(0, initial=0)
    most = longer - np.ceil(least * longer - 1e-9).astype(np.int64)
    left = longer - sizes.min(0, initial=1 << 40) <= most
    for i in np.flatnonzero(left & (longer > LONG)):
        out[i] = alike(p[i], q[i], least)
    left &= longer <= LONG
    if walked:
        for i in np.flatnonzero(left):
            out[i] = walk(p[i].split(" "), q[i].split(" "), int(most[i]))
        left &= ~out
    words = np.maximum(1, (sizes[0] + 63) >> 6)
    step = np.left_shift(1, np.maximum(0, np.frexp(words - 1)[1] - 2))  # 1 to 4, then two sizes to each doubling
    words = -(-words // step) * step
    order = np.flatnonzero(left)
    order = order[np.lexsort((longer[order], words[order]))]
    for same in np.split(order, np.flatnonzero(np.diff(words[order])) + 1):
        for k in range(0, len(same), _ASIDE):
            at = same[k : k + _ASIDE]
            if len(at) < _FEWER:
                out[at] = [distance(p[i], q[i], int(most[i])) <= most[i] for i in at]
            else:
                out[at] = _within([p[i] for i in at], [q[i] for i in at], most[at])
    return out


#: Pairs that are verified side by side, at most and at least.
_ASIDE, _FEWER = 1024, 12
#: Bytes of pairs that are verified together.
_TOGETHER = 16 << 20


def _within(p: list[str], q: list[str], most: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair is at most so many.

    Each p is filled up to whole words of 64 rows. A word is one column behind the word above, so that all words of all pairs
    take a step at once. Only the words within most of the diagonal are kept: those above count as growing by one a column,
    those below by one a row, which changes no distance of at most most. A pair is left out as soon as no row of its
    columns allows so few edits.
    """
    n, size, width = len(p), np.array([len(x) for x in p], np.int64), np.array([len(x) for x in q], np.int64)
    ok, reach = (width == 0) & (size <= most), int(most.max(initial=0))
    points = np.frombuffer("".join([*p, *q]).encode("utf-32-le", "surrogatepass"), np.uint32)
    signs = np.flatnonzero(np.bincount(points))
    codes = np.searchsorted(signs, points)
    split, words = int(size.sum()), max(1, (int(size.max(initial=0)) + 63) >> 6)
    row = np.repeat(np.arange(n), size)
    place = np.arange(split) - np.repeat(np.cumsum(size) - size, size)
    # a sign's places in a text, 64 a word; the last sign stands nowhere
    key = ((place >> 6) * n + row) * (len(signs) + 1) + codes[:split]
    masks = np.zeros(words * n * (len(signs) + 1), np.uint64)
    np.bitwise_or.at(masks, key, np.uint64(1) << (place & 63).astype(np.uint64))
    text = np.full((int(width.max(initial=0)) + words, n), len(signs), np.int64)
    column = np.arange(len(points) - split) - np.repeat(np.cumsum(width) - width, width)
    text[column, np.repeat(np.arange(n), width)] = codes[split:]
    text += np.arange(n) * (len(signs) + 1)
    base = (np.arange(words) * (n * (len(signs) + 1)))[:, None]
    final = np.maximum(0, size - 1) >> 6  # the word of the last row, and the step that ends its last column
    finish = width + final - 1
    live = np.flatnonzero((width > 0) & (np.abs(size - width) <= most))
    ends = np.bincount(finish[live], minlength=len(text)) > 0
    one, high, low, top = np.uint64(1), np.uint64(63), 0, 0  # words low to top - 1 are kept
    text, plus, minus = text[:, live], np.full((words, len(live)), ~np.uint64(0)), np.zeros((words, len(live)), np.uint64)
    score = np.zeros((words, len(live)), np.int64)  # of the last row of each word
    up, down = (np.zeros((words + 1, len(live)), np.uint64) for _ in range(2))  # from the word above, a step ago
    for t in range(int(finish[live].max(initial=-1)) + 1):
        while top < words and t - top >= max(0, 64 * top - reach - 1):
            score[top] = 64 if top == 0 else score[top - 1] - up[top].astype(np.int64) + down[top].astype(np.int64) + 64
            top += 1
        while low < top - 1 and (t - low - reach) >> 6 > low:
            low += 1
        up[low], down[low] = one, 0
        hit = masks.take(text[t - top + 1 : t - low + 1][::-1] + base[low:top])
        v, m, over, under = plus[low:top], minus[low:top], up[low:top], down[low:top]
        vertical = hit | m
        hit |= under
        across = hit & v
        across += v
        across ^= v
        across |= hit
        rise = across | v
        np.invert(rise, out=rise)
        rise |= m
        fall = np.bitwise_and(across, v, out=across)
        shifted, sunk = rise << one, fall << one
        shifted |= over
        sunk |= under
        np.bitwise_and(shifted, vertical, out=m)
        vertical |= shifted
        np.invert(vertical, out=vertical)
        np.bitwise_or(sunk, vertical, out=v)
        rise >>= high
        fall >>= high
        up[low + 1 : top + 1], down[low + 1 : top + 1] = rise, fall
        score[low:top] += (rise - fall).view(np.int64)
        if ends[t]:
            done = np.flatnonzero(finish[live] == t)
            last = final[live[done]]
            beyond = 64 * last[:, None] + np.arange(64) >= size[live[done], None]
            steps = [(np.unpackbits(x[last, done][:, None].view(np.uint8), axis=1, bitorder="little") * beyond).sum(1, dtype=np.int64) for x in (plus, minus)]
            ok[live[done]] = score[last, done] - steps[0] + steps[1] <= most[live[done]]
        if (t + 1) % LOOK == 0:
            # after every eight rows the distance, less what the rows between, and one column more or less, may save
            rises, falls = (np.bitwise_count(x[low:top, :, None].view(np.uint8)).astype(np.int32) for x in (plus, minus))
            below = np.cumsum((rises - falls)[:, :, ::-1], axis=2)[:, :, ::-1]
            word = np.arange(low, top)
            ahead = size[live] - width[live] + (t + 1 - word - 64 * word)[:, None]  # rows left less columns left
            bound = np.minimum((score[low:top, :, None] - below + np.abs(ahead[:, :, None] - np.arange(0, 64, 8))).min((0, 2)), score[top - 1] + np.abs(ahead[-1] - 64))
            keep = np.flatnonzero((finish[live] > t) & (bound - 18 <= most[live]))
            if not len(keep):
                return ok
            if len(keep) < 0.9 * len(live):
                live, text = live[keep], text[:, keep]
                plus, minus, score, up, down = (x[:, keep] for x in (plus, minus, score, up, down))
    return ok


def _slots(ids: np.ndarray, tags: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """A hash of a line's place."""
    return mix(mix(ids.astype(np.int64).view(np.uint64) + np.uint64(1)) ^ mix(tags.astype(np.uint64) << np.uint64(32) | numbers.astype(np.uint64)))


def _repeated(classes: DataFrame) -> DataFrame:
    """line: the lines that stand more than once; some are told several times."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(b.column("again").to_pylist()), np.int64))], ["line"])

    return classes.select("again").mapInArrow(frugal(run), "line long")


def _shared(classes: DataFrame) -> DataFrame:
    """key: the leading bytes of keys that two lines have. Keys travel packed, a range of keys to a task."""
    n_parts = ranges(classes.sparkSession)

    def packed(batches):
        for b in batches:
            keys = np.sort(_keys(_records(b.column("signs"))), axis=None)
            cuts = np.searchsorted((keys >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32), np.arange(n_parts + 1))
            lead = keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
            held = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array([lead[cuts[k] : cuts[k + 1]].tobytes() for k in held], pa.binary())], ["part", "keys"])

    def run(batches):
        held, seen = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for b in batches:  # a range's unlike keys and those met twice, as many as its share of the lines
            wide = np.frombuffer(b"".join(b.column("keys").to_pylist()), np.uint8).reshape(-1, KEY_BYTES)
            keys = np.zeros((len(wide), 8), np.uint8)
            keys[:, :KEY_BYTES] = wide
            keys = np.sort(np.concatenate([held, keys.view(">u8").ravel().astype(np.uint64)]))
            again = keys[1:] == keys[:-1]
            seen = np.union1d(seen, keys[1:][again])
            held = keys[np.concatenate([[True], ~again])] if len(keys) else keys
        yield pa.RecordBatch.from_arrays([pa.array(signed(seen))], ["key"])

    return classes.select("signs").mapInArrow(frugal(packed), "part int, keys binary").repartitionById(n_parts, "part").mapInArrow(frugal(run), "key long")


def _fits(a: str, b: str, similarity: float) -> Column:
    """Whether lines of these sizes can be alike."""
    return F.least(a, b) >= similarity * F.greatest(a, b)


def _near(a: str, b: str) -> Column:
    return (_far(a, b) <= FAR) | (F.least(f"{a}_size", f"{b}_size") < SHORT)


def _far(a: str, b: str) -> Column:
    """In how many bits the signatures a_sim, a_more and b_sim, b_more differ."""
    return F.bit_count(F.col(f"{a}_sim").bitwiseXOR(F.col(f"{b}_sim"))) + F.bit_count(F.col(f"{a}_more").bitwiseXOR(F.col(f"{b}_more")))


def _tiles(crowded: DataFrame, labels: DataFrame) -> DataFrame:
    """key, lo, hi, own, line, component: the members of buckets of more than one component, dealt into tiles.

    crowded: members of buckets of three or more, with the bucket's first line, which has met all others. Only
    lines outside its component look for partners. The lines that look and the others are dealt into groups of
    about TILE, and each group of those that look meets every group in a tile of its own: no task holds more of
    a hot bucket than two groups. A bucket of up to TILE lines is one tile.
    """
    mains = labels.select(F.col("line").alias("first"), F.col("component").alias("main"))
    placed = crowded.select("key", "line", "first").join(labels.hint("shuffle_hash"), "line", "left").join(mains.hint("shuffle_hash"), "first", "left")
    placed = placed.where("line <> first").select("key", "line", F.coalesce("component", "line").alias("component"), F.coalesce("main", "first").alias("main"))
    looks, groups = F.col("component") != F.col("main"), lambda n: F.ceil(n / TILE).cast("int")
    sizes = placed.groupBy("key").agg(F.count("*").alias("n"), F.count_if(looks).alias("looking")).where("looking > 0 and n > 1")
    whole = F.col("n") <= TILE
    sizes = sizes.select("key", F.when(whole, 1).otherwise(groups(F.col("looking"))).alias("low"), F.when(whole, 0).otherwise(groups(F.col("n") - F.col("looking"))).alias("rest"))
    deal = lambda n: F.pmod(F.xxhash64("line"), F.greatest(n, F.lit(1))).cast("int")
    dealt = placed.join(sizes, "key").withColumn("own", F.when(looks | (F.col("rest") == 0), deal(F.col("low"))).otherwise(F.col("low") + deal(F.col("rest"))))
    last = F.when(F.col("own") < F.col("low"), F.col("low") + F.col("rest")).otherwise(F.col("low")) - 1
    dealt = dealt.withColumn("met", F.explode(F.sequence(F.lit(0), last)))
    return dealt.select("key", F.least("own", "met").alias("lo"), F.greatest("own", "met").alias("hi"), "own", "line", "component")


def _met(bucket: np.ndarray, fits) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within a tile (ascending numbers) that fits(i, j) leaves."""
    start = np.flatnonzero(np.diff(bucket, prepend=-1))
    size = np.diff(np.append(start, len(bucket)))
    got = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def offsets(rows, most):
        for k in range(1, most):
            i, j = rows[:-k], rows[k:]
            same = bucket[i] == bucket[j]
            i, j = i[same], j[same]
            ok = fits(i, j)
            got.append((i[ok], j[ok]))

    small = np.repeat(size <= _SMALL, size)
    offsets(np.flatnonzero(small), min(_SMALL, len(bucket)))
    for first, n in zip(start[size > _SMALL], size[size > _SMALL], strict=True):
        offsets(np.arange(first, first + n), n)
    return np.concatenate([i for i, _ in got]), np.concatenate([j for _, j in got])


#: Lines of a tile up to which tiles are searched together.
_SMALL = 32


def _tile_edges(tiles: DataFrame, similarity: float) -> DataFrame:
    """a, b: alike lines of one tile and unlike components, as many as join all components that alike lines of the tile join.

    A pair is tried in the least of the buckets that both are in: first of each line the nearest by SimHash of each other
    component, then all still apart. Pairs are made and verified where the tile is, so only links leave it.
    """

    def run(batches):
        def done(t):
            key, lo, hi, own, line, component, size, sim, more = (t.column(c).to_numpy() for c in ("key", "lo", "hi", "own", "line", "component", "size", "sim", "more"))
            new = (np.diff(key, prepend=key[0]) != 0) | (np.diff(lo, prepend=lo[0]) != 0) | (np.diff(hi, prepend=hi[0]) != 0)
            sim, more, short = sim.view(np.uint64), more.view(np.uint64), size < SHORT

            def far(i, j):
                return np.bitwise_count(sim[i] ^ sim[j]).astype(np.int64) + np.bitwise_count(more[i] ^ more[j])

            def fits(i, j):
                ok = (component[i] != component[j]) & ((lo[i] == hi[i]) | (own[i] != own[j])) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]))
                at = np.flatnonzero(ok)
                ok[at] = short[i[at]] | short[j[at]] | (far(i[at], j[at]) <= FAR)
                return ok

            i, j = _met(np.cumsum(new), fits)
            keys, words = t.column("keys").combine_chunks(), t.column("words").combine_chunks()
            sets = {k: frozenset(keys[k].as_py()) for k in np.union1d(i, j).tolist()}
            least = np.array([min(sets[x] & sets[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
            i, j = i[least == key[i]], j[least == key[i]]
            _, where = np.unique(np.column_stack([np.minimum(line[i], line[j]), np.maximum(line[i], line[j])]), axis=0, return_index=True)
            i, j = i[where], j[where]
            _, at = np.unique(component, return_inverse=True)
            edges = []
            for nearest in (True, False):
                now = nearest_pairs(i, j, -far(i, j), at) if nearest else np.arange(len(i))
                for part in np.split(now, range(_PAIRS, len(now), _PAIRS)):
                    a, b = i[part], j[part]
                    ok = alike_rows(words.take(pa.array(a)).to_pylist(), words.take(pa.array(b)).to_pylist(), similarity, False)
                    edges.append((line[a[ok]], line[b[ok]]))
                    at = _joined(at, a[ok], b[ok])
                if nearest:
                    left = np.ones(len(i), bool)
                    left[now] = False
                    left &= at[i] != at[j]
                    i, j = i[left], j[left]
            a, b = (np.concatenate([e[k] for e in edges]) for k in range(2))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        held = None
        for b in gathered(batches, _TOGETHER):
            now = pa.Table.from_batches([b])
            held = now if held is None else pa.concat_tables([held, now])
            last = np.ones(len(held), bool)
            for c in ("key", "lo", "hi"):
                at = held.column(c).to_numpy()
                last &= at == at[-1]
            cut = 0 if last.all() else len(last) - int(np.argmin(last[::-1]))
            if cut:  # the last tile may go on
                yield done(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and len(held):
            yield done(held)

    return tiles.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(frugal(run), "a long, b long")


#: Pairs of texts that are taken together.
_PAIRS = 1 << 13


def _joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (numbers from 0) of rows, those of the rows a and b made one pair by pair."""
    to = np.arange(labels.max(initial=-1) + 1)

    def root(x):
        while to[x] != x:
            to[x] = x = to[to[x]]
        return x

    for x, y in zip(labels[a].tolist(), labels[b].tolist(), strict=True):
        x, y = root(x), root(y)
        to[max(x, y)] = min(x, y)
    while (to[to] != to).any():
        to = to[to]
    return to[labels]


def duplicate_lines(docs: DataFrame, least_words: int = LEAST_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """id, tag, number of every line that repeats an earlier one, exactly after normalising or nearly.

    Connected lines are a group; its earliest line by doc_id, tag and number stays. Lines that share a key are
    a bucket. Every line of a bucket is verified against its first line, so a group of near copies gives a
    pair a line; then each line against the nearest of each other component of its bucket, and then all that
    are still apart, tile by tile of a bucket. Lines of unlike length, and longer ones whose signatures are over FAR bits apart, aren't tried.
    So any two lines that share a key, are that near and alike end in one group.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))

    def signed_lines(batches):
        for b in batches:
            texts, ids = b.column("text").to_pylist(), b.column("id").to_numpy(zero_copy_only=False)
            for i, j in runs(texts):
                x = Lines(texts[i:j], least_words)
                tags, doc = np.array([tag(s) for s in texts[i:j]], np.int64), x.tokens.line_doc[x.line]
                number = x.tokens.line_number[x.line].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][doc]), pa.array(tags[doc]), pa.array(number), pa.array(signed(x.hash)), *(pa.nulls(len(doc), t) for t in (pa.int32(), pa.binary()))], names)
                at, n = x.at, len(x.at)
                records = np.empty(n, _SIGNED)
                records["line"], records["slot"], records["size"] = signed(x.hash[at]), signed(_slots(ids[i:j][doc[at]], tags[doc[at]], number[at])), x.size[at]
                records["sim"], records["more"], records["again"] = x.sim, x.more, x.count > 1
                records["bands"] = np.ascontiguousarray(x.bands).view(np.uint8).reshape(n, BANDS, 8)[:, :, :WIDTH]
                part = _parts(x.hash[at], n_parts)
                order = np.argsort(part, kind="stable")
                records, cuts = records[order], np.searchsorted(part[order], np.arange(n_parts + 1))
                held = np.flatnonzero(np.diff(cuts))
                blobs = pa.array([records[cuts[k] : cuts[k + 1]].tobytes() for k in held], pa.binary())
                nulls = (pa.nulls(len(held), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64()))
                yield pa.RecordBatch.from_arrays([*nulls, pa.array(held.astype(np.int32)), blobs], names)

    names, n_parts = ["id", "tag", "number", "line", "part", "signs"], ranges(docs.sparkSession)
    both = scratch.table(rows.mapInArrow(frugal(signed_lines), "id long, tag long, number int, line long, part int, signs binary"), "found")
    found = both.where("part is null").select("id", "tag", "number", "line")
    classes = scratch.table(_classes(both), "classes")
    told_again = scratch.table(_repeated(classes), "again")
    shared = presence(scratch.table(_shared(classes), "shared"), "key", None)

    def sharing(batches):
        for b in batches:
            records = _records(b.column("signs"))
            keys = _keys(records)
            at, k = np.nonzero(present(shared.value, keys.ravel()).reshape(keys.shape))
            own = (np.ascontiguousarray(records[c][at]).view(np.int64) for c in ("line", "size", "sim", "more"))
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys[at, k])), *(pa.array(c) for c in own)], ["key", "line", "size", "sim", "more"])

    members = scratch.table(classes.select("signs").mapInArrow(frugal(sharing), "key long, line long, size long, sim long, more long"), "members")
    buckets = scratch.table(members.groupBy("key").agg(F.min("line").alias("first"), F.count("*").alias("n")).where("n > 1"), "buckets")
    leaders = members.join(buckets.hint("shuffle_hash"), "key")
    crowded = scratch.table(leaders.where("n > 2").select("key", "line", "size", "sim", "more", "first"), "crowded")
    star = leaders.where("line <> first").select("line", "first", F.col("size").alias("a_size"), F.col("sim").alias("a_sim"), F.col("more").alias("a_more")).distinct()
    firsts = leaders.where("line = first").select("first", *(F.col(c).alias(f"b_{c}") for c in ("size", "sim", "more"))).dropDuplicates(["first"])
    star = star.join(firsts.hint("shuffle_hash"), "first").where(_fits("a_size", "b_size", similarity) & _near("a", "b"))
    near = scratch.table(star.select(F.least("line", "first").alias("a"), F.greatest("line", "first").alias("b")).distinct(), "near")
    scratch.drop(members)
    speaking = presence(near.select(F.col("a").alias("line")).union(near.select("b")).union(crowded.select("line")), "line", None)

    def placing(batches):
        for b in batches:
            records = _records(b.column("signs"))
            yield pa.RecordBatch.from_arrays([pa.array(records["slot"][present(speaking.value, records["line"].view(np.uint64))])], ["slot"])

    wanted = presence(scratch.table(classes.select("signs").mapInArrow(frugal(placing), "slot long"), "places"), "slot", None)
    scratch.drop(classes)

    def spoken(batches):
        for b in batches:
            texts, ids = b.column("text").to_pylist(), b.column("id").to_numpy(zero_copy_only=False)
            for i, j in runs(texts):
                split = [s.split("\n") for s in texts[i:j]]
                n = np.array([len(x) for x in split])
                doc = np.repeat(np.arange(len(n)), n)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                tags = np.array([tag(s) for s in texts[i:j]], np.int64)
                at = np.flatnonzero(present(wanted.value, _slots(ids[i:j][doc], tags[doc], number)))
                x = Lines([split[d][k] for d, k in zip(doc[at].tolist(), number[at].tolist(), strict=True)], least_words, False)
                folded = x.tokens.line_texts()
                yield pa.RecordBatch.from_arrays([pa.array(signed(x.hash)), pa.array([folded[k] for k in x.line], pa.string())], ["line", "words"])

    words = scratch.table(rows.mapInArrow(frugal(spoken), "line long, words string").groupBy("line").agg(F.first("words").alias("words")), "words")

    def verified(batches):
        for b in gathered(batches, _TOGETHER):
            ok = alike_rows(b.column("p").to_pylist(), b.column("q").to_pylist(), similarity)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    def alike_pairs(near):
        told = presence(near.select(F.explode(F.array("a", "b")).alias("line")), "line", None)

        def needed(batches):
            for b in batches:
                yield b.filter(pa.array(present(told.value, b.column("line").to_numpy(zero_copy_only=False).view(np.uint64))))

        spoke = words.mapInArrow(frugal(needed), words.schema)
        one, other = (spoke.select(F.col("line").alias(c), F.col("words").alias(w)) for c, w in ("ap", "bq"))
        return scratch.table(near.join(one, "a").join(other, "b").select("a", "b", "p", "q").mapInArrow(frugal(verified), "a long, b long"), "edges")

    edges = alike_pairs(near)
    labels = components(scratch, edges).withColumnRenamed("node", "line")
    told = crowded.groupBy("line").agg(F.collect_set("key").alias("keys"), *(F.first(c).alias(c) for c in ("size", "sim", "more")))  # at most a line's keys
    tiles = scratch.table(_tiles(crowded, labels), "tiles")
    told = told.join(tiles.select("line").distinct().hint("shuffle_hash"), "line", "left_semi").join(words.hint("shuffle_hash"), "line")
    edges = edges.union(scratch.table(_tile_edges(tiles.join(told.hint("shuffle_hash"), "line"), similarity), "edges"))
    scratch.drop(words, crowded, tiles)
    labels = components(scratch, edges).withColumnRenamed("node", "line")
    linked = scratch.table(told_again.union(labels.select(F.explode(F.array("line", "component")))), "linked")
    grouping = presence(linked, "line", None)

    def needed_places(batches):
        for b in batches:
            yield b.filter(pa.array(present(grouping.value, b.column("line").to_numpy(zero_copy_only=False).view(np.uint64))))

    found = scratch.table(found.mapInArrow(frugal(needed_places), found.schema), "places")  # all lines of groups of two or more, and some others
    scratch.drop(both, told_again, linked)
    place, own = F.struct("id", "tag", "number"), F.coalesce("component", "line").alias("component")
    earliest = found.groupBy("line").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    grouped = scratch.table(earliest.join(labels.hint("shuffle_hash"), "line", "left").select("line", own, "id", "n"), "grouped")
    least = grouped.groupBy("component").agg(F.min("id").alias("least"), F.sum("n").alias("lines")).where("lines > 1")
    least = scratch.table(least, "least")
    stays = scratch.table(grouped.select("line", "component").join(least.hint("shuffle_hash"), "component").select("line", "component", "least"), "stays")
    scratch.drop(grouped, least)
    placed = found.join(stays.hint("shuffle_hash"), "line")
    first = scratch.table(placed.where("id = least").groupBy("component").agg(F.min(place).alias("stays")), "first")  # of the least doc_id the first line
    later = placed.join(first.hint("shuffle_hash"), "component").where(place != F.col("stays"))
    later = scratch.table(later.select("id", "tag", "number"), "later")
    scratch.drop(found, stays, first)
    return later


def strip_lines(docs: DataFrame, least_words: int = LEAST_WORDS, similarity: float = SIMILARITY, counts: tuple[str, str] | None = None) -> DataFrame:
    """The rows of docs, all columns, without lines that repeat; counts names columns for lines and removed lines.

    Lines end at a line feed. A normalised line is its words (runs of letters and digits) in lower case with
    digits alike; lines of fewer than least_words words, and those without a word, always stay. A null text
    stays null and has no line. A null doc_id sorts first, rows of one doc_id by the CRC of their texts; fully
    equal rows are one document told twice and lose the same lines. A text may become empty; no row is
    dropped. A line of any length is compared whole. An empty table gives an empty one, and columns of docs
    may have any names.
    """
    id_, tag_, numbers_ = fresh(docs, "id", "tag", "numbers")
    drops = duplicate_lines(docs.select("doc_id", "text"), least_words, similarity).groupBy(F.col("id").alias(id_), F.col("tag").alias(tag_)).agg(F.collect_set("number").alias(numbers_))  # at most a text's lines
    key, crc = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    joined = docs.withColumns({id_: key, tag_: crc}).join(drops.hint("shuffle_hash"), [id_, tag_], "left")
    lines = F.split("text", "\n")
    kept = F.when(F.col(numbers_).isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(numbers_, i)), "\n"))
    more = [] if counts is None else [F.coalesce(F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).alias(counts[0]), F.coalesce(F.size(numbers_), F.lit(0)).alias(counts[1])]
    return joined.select(*(kept.alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns), *more)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of every row; see strip_lines."""
    out = strip_lines(docs.select("doc_id", "text"), counts=("n_lines", "n_removed"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
