"""N-gram Jaccard self-join with count-vector R-trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .common import Scratch, components, fresh, frugal, mix, prefix_sums, presence, present, signed, slices, span_hash, utf8

WORDS, PERCENT = 4, 85
_NO_ID = -(1 << 63)
#: Bytes handled at once; coordinates of a count vector; children of a tree node; members of a bucket that look for partners together.
STEP, COORDINATES, FANOUT, BLOCK = 1 << 18, 128, 16, 1024
#: Coordinates that bound pairs twice more before whole sets are sent for each pair: the few first, as a pair takes its vectors along;
#: pairs bounded at once.
MIDDLE, FINE, AT_ONCE = 512, 4096, 256
#: Sets smaller than 2**SINGLES have a group for each token; larger ones SPREAD groups for each of the size class's greatest size.
SINGLES, SPREAD = 4, 0.3


class Sets:
    """Distinct shingles of a run of texts: doc (ascending) and hash of each, and n, sig for each text."""

    def __init__(self, column: pa.Array, words: int):
        data, bounds = utf8(column)
        rows = len(bounds) - 1
        self.doc, self.hash = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        self.n, self.sig = np.zeros(rows, np.int64), np.zeros(rows, np.uint64)
        if not len(data):
            return
        low = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        opens = np.zeros(len(data) + 1, bool)
        opens[bounds] = True
        before = np.concatenate([[False], inside[:-1]])
        start = np.flatnonzero(inside & (~before | opens[:-1]))
        after = np.concatenate([inside[1:], [False]])
        end = np.flatnonzero(inside & (~after | opens[1:])) + 1
        word = span_hash(prefix_sums(low), start, end)
        doc = np.searchsorted(bounds, start, side="right") - 1
        count = np.bincount(doc, minlength=rows)
        first = np.cumsum(count) - count
        size = np.where(count >= words, count - words + 1, (count > 0).astype(np.int64))
        self_doc = np.repeat(np.arange(rows), size)
        at = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        hashes = np.zeros(len(at), np.uint64)
        for i in range(words):
            here = count[self_doc] > i
            hashes[here] = hashes[here] * np.uint64(0xC2B2AE3D27D4EB4F) + word[at[here] + i] + np.uint64(1)
        hashes = mix(hashes)
        order = np.lexsort((hashes, self_doc))
        self_doc, hashes = self_doc[order], hashes[order]
        keep = np.ones(len(order), bool)
        keep[1:] = (hashes[1:] != hashes[:-1]) | (self_doc[1:] != self_doc[:-1])
        self.doc, self.hash = self_doc[keep], hashes[keep]
        self.n = np.bincount(self.doc, minlength=rows)
        self.first = np.cumsum(self.n) - self.n
        full = np.flatnonzero(self.n)
        self.sig[full] = mix(np.add.reduceat(mix(self.hash ^ np.uint64(0xA5A5A5A5A5A5A5A5)), self.first[full]) + self.n[full].astype(np.uint64))

    def distinct(self) -> np.ndarray:
        """Rows with the first of each signature, without empty sets."""
        full = np.flatnonzero(self.n)
        _, at = np.unique(self.sig[full], return_index=True)
        return full[np.sort(at)]

    def keys(self, rows: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row and key of the groups that stand for each row, and the rows that fill fewer groups than the guarantee takes.

        Tokens are hashed into as many groups as the size class has. Sets that link differ in at most d
        tokens, hence in at most d groups; so of the first d + 1 groups that aren't empty, of whichever set
        has the smaller d, one is equal in both. A key hashes a group's whole content. Sets near their
        class's upper end also go to the next class.
        """
        t = percent / 100
        power = np.floor(np.log2(np.maximum(self.n, 1))).astype(np.int64)
        power += (1 << (power + 1)) <= self.n
        power -= (1 << power) > np.maximum(self.n, 1)
        out_rows, out_keys, odd = [], [], np.zeros(0, np.int64)
        for step in (0, 1):
            mine = rows if not step else rows[self.n[rows] >= t * 2.0 ** (power[rows] + 1)]
            if not len(mine):
                continue
            size = self.n[mine]
            at = np.repeat(self.first[mine] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            which = np.repeat(np.arange(len(mine)), size)
            h = self.hash[at]
            scheme = power[mine] + step
            groups = np.where(scheme < SINGLES, 1 << 20, np.maximum(8, (SPREAD * 2.0 ** (scheme + 1)).astype(np.int64))).astype(np.uint64)
            group = (h % groups[which]).astype(np.int64)
            order = np.lexsort((group, which))
            which, group, h = which[order], group[order], h[order]
            new = np.ones(len(which), bool)
            new[1:] = (which[1:] != which[:-1]) | (group[1:] != group[:-1])
            start = np.flatnonzero(new)
            content = np.add.reduceat(mix(h + np.uint64(0x51ED270B)), start)
            owner, group = which[start], group[start]
            per = np.bincount(owner, minlength=len(mine))
            place = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
            most = ((size + np.floor(size / t + 1e-9)) * (1 - t) / (1 + t) + 1e-9).astype(np.int64)
            keep = place <= most[owner]
            if not step:
                odd = mine[per <= most]
            owner = owner[keep]
            out_rows.append(mine[owner])
            out_keys.append(mix(content[keep] + mix((group[keep] * 64 + scheme[owner]).astype(np.uint64))))
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *out_rows]), np.concatenate([none.view(np.uint64), *out_keys]), odd

    def least(self, rows: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and key of each row's least tokens: sets that link have one of them in common, however few groups they fill."""
        size = self.n[rows]
        take = size - -(-percent * size // 100) + 1  # linked sets share percent of the larger one's tokens or more
        which = np.repeat(np.arange(len(rows)), take)
        at = np.repeat(self.first[rows] - (np.cumsum(take) - take), take) + np.arange(take.sum())
        return rows[which], mix(self.hash[at] ^ np.uint64(0x0DD0DD))


def _sets(batches: Iterator[pa.RecordBatch], words: int, text: str = "text") -> Iterator[tuple[pa.RecordBatch, Sets]]:
    for b in batches:
        for i, j in slices(b.column(text), STEP):
            part = b.slice(i, j - i)
            yield part, Sets(part.column(text), words)


def pack(hashes: np.ndarray, coordinates: int = COORDINATES) -> bytes:
    """The count vector of a set: half a byte a coordinate, where a count needs more one byte, else four."""
    counts = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % coordinates, minlength=coordinates)
    most = counts.max()
    if most < 16:
        return (counts[::2] | counts[1::2] << 4).astype(np.uint8).tobytes()
    return counts.astype(np.uint8 if most < 256 else np.uint32).tobytes()


def unpack(column: pa.Array, coordinates: int = COORDINATES) -> np.ndarray:
    """The count vectors of pack(), a row each."""
    packed = column.to_pylist()
    size, out = np.array([len(x) for x in packed], np.int64), np.zeros((len(packed), coordinates), np.int64)
    for width, kind in ((coordinates // 2, np.uint8), (coordinates, np.uint8), (4 * coordinates, np.uint32)):
        at = np.flatnonzero(size == width)
        some = np.frombuffer(b"".join(packed[i] for i in at), kind)
        if width < coordinates:
            some = np.column_stack([some & 15, some >> 4])
        out[at] = some.reshape(-1, coordinates)
    return out


def least_overlap(a, b, percent: int):
    """Least intersection of linked sets of these sizes: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


class CountTree:
    """A packed R-tree over count vectors. A node keeps the largest count in each coordinate and the smallest set size below it."""

    def __init__(self, points: np.ndarray):
        self.points, self.sizes = points, points.sum(1)
        self.order = np.lexsort((*points.T[:3], self.sizes))
        self.levels = []
        high, low = points[self.order], self.sizes[self.order]
        while True:
            at = np.arange(0, len(high), FANOUT)
            high, low = np.maximum.reduceat(high, at, axis=0), np.minimum.reduceat(low, at)
            self.levels.append((high, low))
            if len(high) <= FANOUT:
                break

    def query(self, point: np.ndarray, percent: int) -> np.ndarray:
        """Points whose summed coordinate minima with this one reach the least overlap."""
        size, nodes = point.sum(), None
        for high, low in reversed(self.levels):
            nodes = np.arange(len(high)) if nodes is None else self._below(nodes, len(high))
            nodes = nodes[np.minimum(high[nodes], point).sum(1) >= least_overlap(size, low[nodes], percent)]
        at = self.order[self._below(nodes, len(self.order))]
        return at[np.minimum(self.points[at], point).sum(1) >= least_overlap(size, self.sizes[at], percent)]

    @staticmethod
    def _below(nodes: np.ndarray, n: int) -> np.ndarray:
        below = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        return below[below < n]


def block_pairs(points: np.ndarray, looks: np.ndarray, component: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of unlike components, one of which looks, that the bound leaves; the tree holds those that look."""
    own = np.flatnonzero(looks)
    tree = CountTree(points[own])
    for i in range(len(points)):
        j = own[tree.query(points[i], percent)]
        j = j[(component[j] != component[i]) & (~looks[i] | (j > i))]
        if len(j):
            yield np.full(len(j), i), j


def leaf_pairs(bucket: np.ndarray, points: np.ndarray, looks: np.ndarray, component: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for many buckets of at most FANOUT rows at once: a tree of one leaf, whose entries are bounded one after the other."""
    total = points.sum(1)
    for k in range(1, min(FANOUT, len(bucket))):
        i = np.flatnonzero((bucket[k:] == bucket[:-k]) & (looks[k:] | looks[:-k]) & (component[k:] != component[:-k]))
        i = i[np.minimum(points[i], points[i + k]).sum(1) >= least_overlap(total[i], total[i + k], percent)]
        yield i, i + k


def nearest_pairs(i: np.ndarray, j: np.ndarray, near: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Places of the pairs that are the nearest of either row with the other's component."""
    keep = np.zeros(len(i), bool)
    for one, other in ((i, j), (j, i)):
        order = np.lexsort((-near, component[other], one))
        first = np.ones(len(order), bool)
        first[1:] = (one[order[1:]] != one[order[:-1]]) | (component[other[order[1:]]] != component[other[order[:-1]]])
        keep[order[first]] = True
    return np.flatnonzero(keep)


def bucket_pairs(members: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """a, b, near for pairs of a bucket in unlike components that the count bound leaves; members: key, block, looks, sig, component, counts.

    A bucket's rows that look for partners are dealt into blocks of BLOCK; each block meets all of its bucket.
    nearest: of the pairs of a row with a component only the one with the greatest bound; a block that held more
    also gives a row with its key alone.
    """

    def run(batches):
        held = None

        def done(rows):
            key, block, sig, component, looks, points = rows
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
            bucket, start = np.cumsum(new), np.flatnonzero(new)
            size = np.diff(np.append(start, len(key)))
            small = np.repeat(size <= FANOUT, size)
            at = np.flatnonzero(small)
            got = [(at[i], at[j]) for i, j in leaf_pairs(bucket[at], points[at], looks[at], component[at], percent)]
            for first, n in zip(start[size > FANOUT], size[size > FANOUT], strict=True):
                part = slice(first, first + n)
                got += [(i + first, j + first) for i, j in block_pairs(points[part], looks[part], component[part], percent)]
            i, j = (np.concatenate([g[c] for g in got]).astype(np.int64) if got else np.zeros(0, np.int64) for c in range(2))
            near, left = np.minimum(points[i], points[j]).sum(1), key[:0]
            if nearest and len(i):
                keep = nearest_pairs(i, j, near, component)
                out = np.ones(len(i), bool)
                out[keep] = False
                left = np.unique(key[i[out]])
                i, j, near = i[keep], j[keep], near[keep]
            ends, none = [np.minimum(sig[i], sig[j]), np.maximum(sig[i], sig[j]), near.astype(np.int64)], pa.nulls(len(left), pa.int64())
            return pa.RecordBatch.from_arrays([*(pa.concat_arrays([pa.array(c), none]) for c in ends), pa.concat_arrays([pa.nulls(len(i), pa.int64()), pa.array(left)])], ["a", "b", "near", "key"])

        for b in batches:
            now = [b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "block", "sig", "component", "looks")]
            now.append(unpack(b.column("counts")))
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(held[0]):
                continue
            same = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:  # the last block may go on
                yield done([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held is not None and len(held[0]):
            yield done(held)

    dealt = members.repartition("key", "block").sortWithinPartitions("key", "block")
    return dealt.mapInArrow(frugal(run), "a long, b long, near long, key long")


def among(sets: DataFrame, sigs: DataFrame) -> DataFrame:
    """The sets whose sig a row of sigs has, and few others: a filter of fixed size ahead of a join."""
    wanted = presence(sigs, "sig")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(present(wanted.value, b.column("sig").to_numpy(zero_copy_only=False).view(np.uint64))))

    return sets.mapInArrow(frugal(run), sets.schema)


def _arrays(column: pa.Array, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def bounded(pairs: DataFrame, vectors: DataFrame, percent: int, coordinates: int = COORDINATES) -> DataFrame:
    """The pairs a, b whose count vectors' summed minima reach the least overlap."""

    def run(batches):
        for batch in (b.slice(i, AT_ONCE) for b in batches for i in range(0, len(b), AT_ONCE)):
            one, other = (unpack(batch.column(c), coordinates) for c in ("x", "y"))
            yield batch.select(["a", "b"]).filter(pa.array(np.minimum(one, other).sum(1) >= least_overlap(one.sum(1), other.sum(1), percent)))

    one, other = (vectors.select(F.col("sig").alias(c), F.col("counts").alias(v)) for c, v in ("ax", "by"))
    return pairs.select("a", "b").join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(frugal(run), "a long, b long")


def overlapping(one: DataFrame, other: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b of one (a, b, a_tokens) and other (b, b_tokens) whose whole sets link."""

    def run(batches):
        for batch in batches:
            p, q = _arrays(batch.column("a_tokens"), np.uint64), _arrays(batch.column("b_tokens"), np.uint64)
            ok = np.zeros(len(p), bool)
            for i in range(len(p)):
                whole = np.sort(np.concatenate([p[i], q[i]]))
                common = int((whole[1:] == whole[:-1]).sum())
                ok[i] = 100 * common >= percent * (len(whole) - common)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return one.join(other.hint("merge"), "b").select("a", "b", "a_tokens", "b_tokens").mapInArrow(frugal(run), "a long, b long")


def _linked(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n, sig, component of every row: shingles, signature of their set, and the component, null without a shingle.

    Texts of equal sets are one class. Classes that share a key are a bucket. First each class is tried with
    one other: of the members that share most keys over all in its buckets the one that it meets most often.
    Then count-vector R-trees search each bucket for pairs of classes in unlike components: of each row the
    nearest of each other component, and then all that are still apart. The count bound decides on every pair,
    and what it leaves is verified on the whole sets (64 bits a shingle). So no link between components is lost,
    and a group of copies gives no more rows than it has members. A null or empty text has no shingle and is
    linked with nothing; rows of one doc_id are rows of their own; a null doc_id counts only where its component
    has no other. Extra columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def key_counts(batches):
        for _, s in _sets(batches, words):
            _, keys, odd = s.keys(s.distinct(), percent)
            keys, n = np.unique(keys, return_counts=True)
            kinds = [(keys, np.minimum(n, 2))]
            if len(odd):  # counted apart
                keys = np.unique(s.least(odd, percent)[1])
                kinds.append((keys, np.zeros(len(keys), np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate([k for k, _ in kinds]))), pa.array(np.concatenate([c for _, c in kinds]).astype(np.int8))], ["key", "n"])

    counts = rows.select("text").mapInArrow(frugal(key_counts), "key long, n byte").groupBy("key").agg(F.sum("n").alias("n")).where("n <> 1")
    counts = scratch.table(counts, "counts")
    shared = presence(counts.where("n > 1"), "key", None)
    odd = counts.where("n = 0")
    odd = None if odd.isEmpty() else presence(odd, "key", None)

    def signatures(batches):
        for part, s in _sets(batches, words):
            own = s.distinct()
            owner, keys, _ = s.keys(own, percent)
            at = present(shared.value, keys)
            owner, keys = owner[at], keys[at]
            if odd is not None and len(own):
                few, more = s.least(own, percent)
                at = present(odd.value, more)
                owner, keys = np.concatenate([owner, few[at]]), np.concatenate([keys, more[at]])
            counts = [None] * len(part)
            for i in np.unique(owner).tolist():
                counts[i] = pack(s.hash[s.first[i] : s.first[i] + s.n[i]])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s.n, pa.int64()), pa.array(signed(s.sig)), pa.nulls(len(part), pa.int64()), pa.array(counts, pa.binary())], names)
            none = [pa.nulls(len(keys), kind) for kind in (pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([none[0], pa.array(s.n[owner], pa.int64()), pa.array(signed(s.sig[owner])), pa.array(signed(keys)), none[1]], names)

    names = ["doc_id", "n", "sig", "key", "counts"]
    told = scratch.table(rows.mapInArrow(frugal(signatures), "doc_id long, n long, sig long, key long, counts binary"), "signatures")
    scratch.drop(counts)
    everyone = scratch.table(told.where("key is not null").select("key", "sig", "n").distinct(), "members")
    sizes = scratch.table(everyone.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    members = scratch.table(everyone.join(sizes, "key"), "members")
    scratch.drop(everyone, sizes)
    weight = scratch.table(members.groupBy("sig").agg(F.sum("size").alias("weight")), "weight")
    centre = members.join(weight, "sig").groupBy("key").agg(F.max(F.struct("weight", "sig", "n")).alias("centre")).select("key", F.col("centre.sig").alias("b"), F.col("centre.n").alias("b_n"))
    centre = scratch.table(centre, "centre")
    fits = 100 * F.least("n", "b_n") >= percent * F.greatest("n", "b_n")
    stars = members.join(centre, "key").where((F.col("sig") != F.col("b")) & fits).groupBy(F.col("sig").alias("a"), "b").agg(F.count("*").alias("n"))
    stars = scratch.table(stars.groupBy("a").agg(F.max(F.struct("n", "b")).alias("best")).select("a", F.col("best.b").alias("b")), "stars")
    scratch.drop(centre)
    # of rows with equal sets one is enough; rows of one doc_id and those that the bitmap lets pass are told apart by sig
    firsts = told.where("key is null and n > 0").groupBy("sig").agg(F.coalesce(F.min("doc_id"), F.lit(0)).alias("doc_id")).join(weight, "sig", "left_semi")
    firsts = scratch.table(firsts, "firsts")

    def fetch(sigs: DataFrame, fine: bool) -> DataFrame:
        """sig and its whole set as tokens, if fine also its count vectors of MIDDLE and FINE coordinates, of the given sigs and some others."""
        told_by = firsts.join(sigs, "sig", "left_semi")
        wanted = presence(scratch.table(told_by.select(F.col("sig").bitwiseXOR(F.shiftleft("doc_id", 40)).alias("key")), "wanted"), "key", None)

        def run(batches):
            for part, s in _sets(batches, words):
                mine = np.flatnonzero(s.n)
                ids = pc.fill_null(part.column("doc_id"), 0).to_numpy(zero_copy_only=False).view(np.uint64)
                mine = mine[present(wanted.value, s.sig[mine] ^ (ids[mine] << np.uint64(40)))]
                parts = [s.hash[s.first[i] : s.first[i] + s.n[i]] for i in mine]
                counts = [pa.array([pack(p, c) if fine else None for p in parts], pa.binary()) for c in (MIDDLE, FINE)]
                yield pa.RecordBatch.from_arrays([pa.array(signed(s.sig[mine])), pa.array([p.tobytes() for p in parts], pa.binary()), *counts], ["sig", "tokens", "middle", "fine"])

        return rows.mapInArrow(frugal(run), "sig long, tokens binary, middle binary, fine binary").dropDuplicates(["sig"])

    def whole_vectors(whole: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        """sig, counts of the sets in pairs: only what is left goes on to longer vectors."""
        return among(whole.select("sig", F.col(name).alias("counts")), pairs.select(F.explode(F.array("a", "b")).alias("sig")))

    def verified(pairs: DataFrame, many: bool) -> DataFrame:
        """The pairs that link, a table; a in one pair each, or in many: then finer vectors bound the pairs before whole sets go with each."""
        both = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
        fetched = fetch(both, many)
        if many:
            whole = scratch.table(fetched, "whole")
            for name, coordinates in (("middle", MIDDLE), ("fine", FINE)):
                pairs = scratch.table(bounded(pairs, whole_vectors(whole, pairs, name), percent, coordinates), "close")
            fetched = among(whole.select("sig", "tokens"), pairs.select(F.explode(F.array("a", "b")).alias("sig")))
        sets = fetched.select("sig", "tokens").join(pairs.select(F.col("a").alias("sig"), "b"), "sig", "left")
        sets = scratch.table(sets, "sets")  # dealt by sig once
        if many:
            scratch.drop(whole)
        spokes = sets.where("b is not null").select(F.col("sig").alias("a"), "b", F.col("tokens").alias("a_tokens"))
        centres = among(sets.select("sig", "tokens"), pairs.select(F.col("b").alias("sig"))).dropDuplicates(["sig"]).select(F.col("sig").alias("b"), F.col("tokens").alias("b_tokens"))
        found = scratch.table(overlapping(spokes, centres, percent), "edges")
        scratch.drop(sets)
        return found

    vectors = told.where("counts is not null").select("sig", "counts").dropDuplicates(["sig"]).join(weight, "sig", "left_semi")
    vectors = scratch.table(vectors, "vectors")
    edges = verified(scratch.table(bounded(stars, vectors, percent), "near"), False)

    def labelled(edges):
        return components(scratch, edges).withColumnRenamed("node", "sig")

    def apart(members: DataFrame, labels: DataFrame, nearest: bool) -> DataFrame:
        """a, b, near of classes that share a bucket and no component, as far as the bound leaves them, and the keys of buckets that held more."""
        placed = scratch.table(members.join(labels, "sig", "left").select("key", "sig", F.coalesce("component", "sig").alias("component")), "placed")
        parts = placed.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("size")).where("main.n < size")
        mixed = scratch.table(parts.select("key", F.col("main.component").alias("main"), F.ceil((F.col("size") - F.col("main.n")) / BLOCK).cast("int").alias("blocks")), "mixed")
        own = F.when(F.col("component") != F.col("main"), F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
        looking = placed.join(mixed, "key").withColumn("own", own).join(vectors, "sig")
        looking = looking.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", "block", "sig", "component", "counts", F.coalesce(F.col("own") == F.col("block"), F.lit(False)).alias("looks"))
        pairs = scratch.table(bucket_pairs(looking, percent, nearest).groupBy("a", "b", "key").agg(F.max("near").alias("near")), "pairs")
        scratch.drop(placed, mixed)
        return pairs

    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    searched = members
    for nearest in (True, False):
        pairs = apart(searched, labelled(edges), nearest)
        new = scratch.table(pairs.where("key is null").select("a", "b").join(tried, ["a", "b"], "left_anti"), "new")
        if not new.isEmpty():
            edges, tried = edges.union(verified(new, True)), tried.union(new)
        # a bucket that gave all of its pairs has nothing left to find, as components only grow
        left = pairs.where("key is not null").select("key").distinct()
        if left.isEmpty():
            break
        searched = members.join(left, "key", "left_semi")
    labels = labelled(edges)
    scratch.drop(members, vectors)
    texts = told.where("key is null").select("doc_id", "n", "sig")
    texts = texts.join(labels, "sig", "left").withColumn("component", F.when(F.col("n") > 0, F.coalesce("component", "sig")))
    texts = scratch.table(texts, "texts")
    scratch.drop(told)
    return texts


def link_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; see _linked."""
    texts, scratch = _linked(docs, words, percent), Scratch(docs.sparkSession, "least")
    least = scratch.table(texts.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("least")), "least")
    out = texts.where("n > 0").join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    return out.union(texts.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, words: int = WORDS + 1, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, without all but one row of each component; rows without a shingle all stay.

    A component keeps the row of its smallest doc_id, a null doc_id only if it has no other; of rows that share
    that doc_id the one with the smallest set signature, and any one of those with the same set. Rows are told
    apart by doc_id and signature, so a row never goes for the sake of another row of its doc_id.
    """
    scratch = Scratch(docs.sparkSession, "keep")
    id_, sig_ = fresh(docs, "id", "sig")
    texts = _linked(docs.select("doc_id", "text"), words, percent).where("n > 0")
    texts = texts.groupBy(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "sig", "component").agg(F.count("*").alias("rows"))
    texts = scratch.table(texts, "texts")
    stays = scratch.table(texts.groupBy("component").agg(F.min(F.struct("no_id", "id", "sig")).alias("stays"), F.count("*").alias("n")).where("n > 1"), "stays")
    gone = texts.join(stays, "component").where((F.col("id") != F.col("stays.id")) | (F.col("sig") != F.col("stays.sig"))).select("id", "sig")
    gone = scratch.table(gone, "gone")
    # only rows that may go or stand more than once are dealt out; the others stay where they are
    doubtful = gone.union(texts.where("rows > 1").select("id", "sig")).select(F.col("sig").bitwiseXOR(F.shiftleft("id", 40)).alias("key"))
    doubt = presence(scratch.table(doubtful, "doubtful"), "key", None)
    text, key = (next(c for c in docs.columns if c.lower() == name) for name in ("text", "doc_id"))

    def marked(doubted: bool):
        def run(batches):
            for part, s in _sets(batches, words, text):
                ids = pc.fill_null(part.column(key).cast(pa.int64()), _NO_ID).to_numpy(zero_copy_only=False).view(np.uint64)
                mine = pa.array(np.flatnonzero(((s.n > 0) & present(doubt.value, s.sig ^ (ids << np.uint64(40)))) == doubted))
                kept = part.take(mine)
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(signed(s.sig)).take(mine)], [*part.schema.names, sig_])

        return docs.mapInArrow(frugal(run), T.StructType([*docs.schema.fields, T.StructField(sig_, T.LongType())]))

    columns = [F.col(f"`{c}`") for c in docs.columns]
    looked_at = marked(True).withColumn(id_, F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)))
    kept = looked_at.join(gone.select(F.col("id").alias(id_), F.col("sig").alias(sig_)).hint("shuffle_hash"), [id_, sig_], "left_anti").dropDuplicates([id_, sig_])
    return marked(False).select(*columns).unionAll(kept.select(*columns))
