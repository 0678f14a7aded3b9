"""Harmonic packing of token sequences."""

from __future__ import annotations

import base64
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import frugal

#: Tokens of a sequence; room in a full bin below which it is padded rather than topped up; the id that ends a document.
CAPACITY, LEAST_ROOM, END_ID = 1024, 16, 0
#: Where pieces between single spaces aren't the pre-tokenizer's own pieces.
_RUNS = re.compile(r"\s\s\s|\s\s\Z")
_KNOWN_MOST = 100_000


class Encoder:
    """Token ids as little-endian unsigned 32-bit words. vocabulary is a byte-level BPE rank file; specials are strings with an id of their own.

    A text is parted at its specials first. A single space begins a pre-token in this family of tokenizers, so
    the rest is cut before single spaces and each piece is encoded once; texts with longer runs of white space
    are encoded as they are.
    """

    def __init__(self, vocabulary: str, pattern: str, specials: dict[str, int] | None = None):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}
        self.specials = {k: v.to_bytes(4, "little") for k, v in (specials or {}).items()}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def plain(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.bpe.encode_ordinary(text))

    def __call__(self, text: str) -> bytes:
        if self.parts is None or not any(k in text for k in self.specials):
            return self.ordinary(text)
        return b"".join(self.specials.get(p) or self.ordinary(p) for p in self.parts.split(text))

    def ordinary(self, text: str) -> bytes:
        if not text:
            return b""
        if _RUNS.search(text):
            return self.plain(text)
        known, out = self.known, []
        head, *rest = text.split(" ")
        if head:
            out.append(self.plain(head))
        for piece in rest:
            ids = known.get(piece)
            if ids is None:
                if len(known) >= _KNOWN_MOST:
                    known.clear()
                ids = self.plain(" " + piece)
                if len(piece) < 64:
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)


class Bins:
    """Open bins of one worker, one a class. Class k holds lengths over C/(k+1) and up to C/k, k pieces a bin.

    A document of a sequence or more gives whole sequences first; what is left, or a shorter document, goes
    uncut to its class. A class's bin with its k pieces is full; the room that they leave is topped up with the
    beginning of the next documents, which are cut for it only.
    """

    def __init__(self, worker: int, capacity: int = CAPACITY, least: int = LEAST_ROOM):
        self.capacity, self.least, self.open, self.next = capacity, least, {}, worker << 33
        self.rows: list[tuple] = []
        self.full: list[tuple] = []  # a bin with its k pieces that still has room
        self.room = 0

    def seal(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, zlib.crc32(ids), total, self.next, offset))
            offset += n
        self.next += 1

    def add(self, doc, ids: bytes) -> None:
        """All ids of a document."""
        total, at = len(ids) // 4, 0
        if self.room:
            at = min(self.room, total)
            self.full.append((doc, 0, ids[: 4 * at], total))
            self.room -= at
            if not self.room:
                self.seal(self.full)
        while total - at >= self.capacity:
            self.seal([(doc, at, ids[4 * at : 4 * (at + self.capacity)], total)])
            at += self.capacity
        if at == total:
            return
        k = self.capacity // (total - at)
        bin_ = self.open.setdefault(k, [])
        bin_.append((doc, at, ids[4 * at :], total))
        if len(bin_) == k:  # only now, so that there is one bin with room at most
            self.room = self.capacity - sum(len(p[2]) // 4 for p in bin_)
            if self.room < self.least:
                self.room = 0
                self.seal(bin_)
            else:
                self.full = bin_
            self.open[k] = []

    def close(self) -> None:
        """What is left in open bins, under one bin a class, is laid end to end and cut at whole sequences, then at powers of two."""
        left = [*(self.full if self.room else []), *(p for k in sorted(self.open) for p in self.open[k])]
        room = sum(len(p[2]) // 4 for p in left)
        sizes = [self.capacity] * (room // self.capacity) + [1 << i for i in reversed(range(self.capacity.bit_length())) if room % self.capacity >> i & 1]
        left.reverse()
        for size in sizes:
            taken = []
            while size:
                doc, start, ids, total = left.pop()
                n = min(size, len(ids) // 4)
                taken.append((doc, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    left.append((doc, start + n, ids[4 * n :], total))
                size -= n
            self.seal(taken)


_COLUMNS = [("doc_id", "long", pa.int64()), ("start", "long", pa.int64()), ("length", "long", pa.int64()), ("ids_crc32", "long", pa.int64()), ("doc_tokens", "long", pa.int64()), ("sequence_id", "long", pa.int64()), ("offset", "long", pa.int64())]


def pack(docs: DataFrame, vocabulary: str, pattern: str, specials: dict[str, int] | None = None, capacity: int = CAPACITY, least: int = LEAST_ROOM) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each worker packs its own input partition, so nothing is shuffled and a hot source is as cheap as any.
    A null or empty text is the end id alone; rows with equal or null doc_id are packed as rows of their own.
    Extra columns are ignored; an empty table has no piece. A long text is encoded whole. capacity must be a
    power of two. sequence_id holds the partition's number in its upper bits, so a task run again gives the
    same rows.
    """

    def run(batches):
        from pyspark import TaskContext

        encode, bins, end = Encoder(vocabulary, pattern, specials), Bins(TaskContext.get().partitionId(), capacity, least), END_ID.to_bytes(4, "little")

        def done():
            columns = zip(*bins.rows, strict=True) if bins.rows else [()] * len(_COLUMNS)
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, _, t) in zip(columns, _COLUMNS, strict=True)], [n for n, _, _ in _COLUMNS])
            bins.rows = []
            return out

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                bins.add(doc, encode(text or "") + end)
                if len(bins.rows) > 50_000:
                    yield done()
        bins.close()
        yield done()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), ", ".join(f"{n} {t}" for n, t, _ in _COLUMNS))
