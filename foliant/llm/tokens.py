"""Words and lines of a run of texts as arrays."""

from __future__ import annotations

import zlib

import numpy as np

from .common import mix, prefix_sums, span_hash

_tables: list[np.ndarray] = []


def _table() -> np.ndarray:
    """For code points under 2**16 the lower-case letter, 0x30 for a digit, 0 for anything else."""
    if not _tables:
        out = np.zeros(1 << 16, np.uint32)
        for i in range(1 << 16):
            c = chr(i)
            if c.isalpha():
                out[i] = ord(c.lower()) if len(c.lower()) == 1 else i
            elif c.isdigit():
                out[i] = 0x30
        _tables.append(out)
    return _tables[0]


class Tokens:
    """Texts laid end to end, each ended by a line feed. Words are runs of letters and digits; digits are alike."""

    def __init__(self, texts: list[str]):
        whole = "\n".join([*texts, ""])
        self.points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        folded = _table()[np.minimum(self.points, 0xFFFF)]
        high = np.flatnonzero(self.points > 0xFFFF)
        if len(high):
            folded[high] = [p if chr(p).isalnum() else 0 for p in self.points[high].tolist()]
        self.folded = folded
        letter = np.zeros(len(folded) + 2, bool)
        np.greater(folded, 0, out=letter[1:-1])
        edge = np.flatnonzero(letter[1:] != letter[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        self.word = span_hash(prefix_sums(folded), self.start, self.end)
        self.doc = np.searchsorted(self.bounds, self.start, side="right") - 1
        feeds = np.flatnonzero(self.points == 10)
        self.line_start = np.concatenate([[0], feeds + 1])[:-1]
        self.line_end = feeds
        self.line = np.searchsorted(feeds, self.start)
        self.line_doc = np.searchsorted(self.bounds, self.line_start, side="right") - 1
        first = np.searchsorted(self.line_doc, np.arange(len(texts)))
        self.line_number = np.arange(len(feeds)) - first[self.line_doc]

    def text(self, start: int, end: int) -> str:
        """Folded text of a stretch: words with single spaces."""
        part = np.where(self.folded[start:end] > 0, self.folded[start:end], 32).astype(np.uint32)
        return " ".join(part.tobytes().decode("utf-32-le", "surrogatepass").split())

    def line_texts(self) -> list[str]:
        """text() of every line."""
        whole = np.where(self.folded > 0, self.folded, 32).astype(np.uint32)
        whole[self.line_end] = 10
        return [" ".join(s.split()) for s in whole.tobytes().decode("utf-32-le", "surrogatepass").split("\n")[:-1]]


def tag(text: str) -> int:
    """Tells unlike texts of one doc_id apart; crc32() in SQL gives the same."""
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def runs(texts: list[str], most: int = 1 << 19):
    """Index ranges of texts of so many code points together, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


__all__ = ["Tokens", "mix", "runs", "tag"]
