"""Fuzzy line dedup against brute force: every pair of lines by edit distance."""

import random

import numpy as np
import pytest

from foliant.llm import lines
from foliant.llm.tokens import Tokens

R = random.Random(21)
WORDS = ["".join(R.choice("abcdefghiklmnoprstuvw") for _ in range(R.randint(2, 9))) for _ in range(900)]
SCHEMA = "doc_id long, text string"


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def folded(line):
    t = Tokens([line])
    return t.text(0, len(t.points) - 1)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def brute(rows):
    """Place of every line that the operator may remove, if it misses no pair."""
    places = [(i, k, folded(line)) for i, t in rows for k, line in enumerate((t or "").split("\n"))]
    places = sorted(p for p in places if p[2])
    label = list(range(len(places)))
    for i in range(len(places)):
        for j in range(i):
            a, b = places[i][2], places[j][2]
            if a == b or min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and lines.distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return {places[i][:2] for i in range(len(places)) if label[i] != i}


def removed(spark, rows):
    got = lines.duplicate_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    return {(r.id, r.number) for r in got}


def test_edit_distance():
    for _ in range(400):
        a, b = ("".join(R.choice("abc") for _ in range(R.randint(0, 12))) for _ in range(2))
        assert lines.distance(a, b) == plain_distance(a, b)
    for _ in range(200):
        a = prose(R.randint(5, 40))
        b = "".join(c if R.random() > R.choice((0.02, 0.2, 0.6)) else R.choice("abc ") for c in a)
        whole, most = lines.distance(a, b), len(a) // 5
        assert (lines.distance(a, b, most) <= most) == (whole <= most)


def test_alike_is_edit_similarity():
    accepted = 0
    for _ in range(300):
        a = [R.choice(WORDS) for _ in range(R.randint(2, 40))]
        b = list(a)
        for _ in range(R.randint(0, 8)):
            k = R.randrange(len(b))
            b[k : k + R.randint(0, 1)] = [R.choice(WORDS)] * R.randint(0, 1)
            b = b or ["x"]
        p, q = " ".join(a), " ".join(b)
        most = int(0.2 * max(len(p), len(q)) + 1e-9)
        close = lines.distance(p, q) <= most
        assert lines.alike(p, q) == close
        if lines.walk(a, b, most):
            accepted += 1
            assert close
    assert accepted > 50


def test_near_signatures_share_a_key():
    """Signatures that differ in up to two bits always share two blocks."""
    sim = np.random.default_rng(3).integers(0, 1 << 63, 1).astype(np.uint64)
    none = np.zeros((1, 0), np.uint64)
    for flips in range(lines.BLOCKS - 1):
        other = sim.copy()
        for k in R.sample(range(64), flips):
            other ^= np.uint64(1 << k)
        assert np.intersect1d(lines.block_keys(sim, none), lines.block_keys(other, none)).size


@pytest.mark.parametrize("n,changed", [(5, 1), (8, 1), (8, 2), (12, 1), (12, 2), (12, 3), (20, 1), (20, 3), (30, 3), (50, 1), (50, 3), (50, 8)])
def test_recall(n, changed):
    """Of pairs of edit similarity 0.8 nine in ten or more share a key and are near enough to be verified."""
    pairs = []
    while len(pairs) < 200:
        a = prose(n).split()
        b = list(a)
        for k in R.sample(range(n), changed):
            b[k] = R.choice(WORDS)
        p, q = " ".join(a), " ".join(b)
        if p != q and lines.distance(p, q) <= 0.2 * max(len(p), len(q)):
            pairs.append((p, q))
    found = 0
    for p, q in pairs:
        one, two = lines.Lines([p]), lines.Lines([q])
        far = int(np.bitwise_count(one.sim ^ two.sim)[0]) + int(np.bitwise_count(one.more ^ two.more)[0])
        near = far <= lines.FAR or min(len(p), len(q)) < lines.SHORT
        found += near and bool(np.intersect1d(lines.block_keys(one.sim, one.bands), lines.block_keys(two.sim, two.bands)).size)
    assert found >= 0.9 * len(pairs)


def test_against_brute_force(spark):
    rows = []
    for i in range(60):
        text = [prose(R.choice((1, 2, 3, 4, 6, 9, 15, 40))) for _ in range(5)]
        if i > 5:
            for _ in range(3):  # copies of earlier lines, some edited
                words = R.choice(rows[R.randrange(i)][1].split("\n")).split()
                for _ in range(R.choice((0, 0, 1, len(words) // 12))):
                    words[R.randrange(len(words))] = R.choice(WORDS)
                text.insert(R.randrange(len(text)), " ".join(words))
        rows.append((i, "\n".join(text)))
    want, got = brute(rows), removed(spark, rows)
    assert not got - want
    assert len(want) > 100 and len(got) >= 0.95 * len(want)


def test_hot_bucket_of_near_copies(spark):
    """A group in which the first line is like some only, and others only like each other."""
    base = prose(30).split()
    rows = []
    for i in range(90):
        words = list(base)
        for k in range(i // 6):
            words[k] = WORDS[(31 * i + k) % 900] if k == i % 7 else WORDS[k]
        rows.append((i, " ".join(words)))
    want, got = brute(rows), removed(spark, rows)
    assert not got - want and len(got) >= len(want) - 2


def test_whole_rows(spark):
    """Nulls, repeated rows, short and empty lines, clashing names, a very long text."""
    base = prose(200)
    near = base.replace(base.split()[5], "changed", 1)
    long = "\n".join(prose(12) for _ in range(3000))
    rows = [(1, f"{base}\nshort line\n{prose(20)}", 77), (2, f"{base.upper()}!\nshort line", 88), (3, f"{prose(25)}\n{near}", 1), (4, None, 2), (5, "", 3), (6, "--\n--\n\nPage 7", 4), (6, "--\n--\n\nPage 7", 4), (7, "Page 12\n--", 5), (None, "Page 3", 6), (8, long, 7), (9, long, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id long").selectExpr("doc_id", "text", "id as id_", "id", "1 as numbers_", "2 as TAG", "'k' as `a.b`", "3 as component")
    out = lines.strip_lines(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text) for r in out.collect() if r.doc_id not in (8, 9))
    assert got[0] == (0, "Page 3") and got[1] == (1, rows[0][1]) and got[2] == (2, "") and got[3] == (3, rows[2][1].split("\n")[0])
    assert got[4:] == [(4, None), (5, ""), (6, "--\n--\n"), (6, "--\n--\n"), (7, "--")]
    assert sorted(r.id_ for r in out.collect()) == [1, 2, 3, 4, 4, 5, 6, 7, 8, 77, 88]
    by = {r.doc_id: r.text for r in out.collect()}
    assert by[9] == "" and len(by[8]) > 0.98 * len(long)
    assert lines.report(docs.limit(0)).count() == 0


def test_side_by_side():
    """Edit distances of many pairs at once, about the edges of words of 64 rows and of the band."""
    for size in (1, 20, 63, 64, 65, 129, 400):
        p, q = [], []
        for _ in range(60):
            a = "".join(R.choice("abc d") for _ in range(max(0, size + R.randint(-size // 3, size // 3))))
            rate = R.choice((0, 0.05, 0.15, 0.2, 0.3, 0.8))
            p.append(a)
            q.append("".join(c if R.random() > rate else R.choice(("", "x", c + "y")) for c in a))
        most = np.array([R.choice((1, 2, 3)) * max(len(a), len(b)) // 10 for a, b in zip(p, q, strict=True)])
        want = [lines.distance(a, b) <= m for a, b, m in zip(p, q, most, strict=True)]
        assert lines._within(p, q, most).tolist() == want
        alike = [lines.alike(a, b) for a, b in zip(p, q, strict=True)]
        assert lines.alike_rows(p, q).tolist() == lines.alike_rows(p, q, walked=False).tolist() == alike


def test_common_passage(spark, monkeypatch):
    """Lines that share a passage and are unlike otherwise: one bucket of many components. No table grows with its pairs, and links within it are found."""
    passage, rows = prose(30), []
    for i in range(330):
        rows.append((i, f"{prose(17)} {passage}"))
    for i in range(330, 360):  # like one of them, edited in other words
        words = rows[R.randrange(330)][1].split()
        words[R.randrange(17)] = R.choice(WORDS)
        rows.append((i, " ".join(words)))
    counts, table = [], lines.Scratch.table

    def counted(self, df, name="t"):
        out = table(self, df, name)
        counts.append((out.count(), name))
        return out

    monkeypatch.setattr(lines.Scratch, "table", counted)
    want, got = brute(rows), removed(spark, rows)
    assert got == want and len(want) >= 30
    assert max(counts)[0] < 60 * len(rows)


def test_few_long_pairs_side_by_side(monkeypatch):
    """Sixty pairs of lines of some 1500 characters are verified together, not one by one; the answers are those of one by one."""
    p = [prose(240) for _ in range(60)]
    q = ["".join(c if R.random() > 0.3 * i / 60 else "x" for c in a) for i, a in enumerate(p)]
    want = [lines.distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9) for a, b in zip(p, q, strict=True)]
    calls, one = [], lines.distance
    monkeypatch.setattr(lines, "distance", lambda *a: calls.append(a) or one(*a))
    assert lines.alike_rows(p, q, walked=False).tolist() == want and 5 < sum(want) < 55
    assert len(calls) < 15


def test_signed_lines_travel_packed(spark, monkeypatch):
    """No table of signed lines has a row a line; lines told twice in one text, or in two, go."""
    told = [prose(8) for _ in range(400)]
    rows = [(1, "\n".join(told + told[:5])), (2, "\n".join([told[7], prose(9)]))]
    counts, table = {}, lines.Scratch.table

    def counted(self, df, name="t"):
        out = table(self, df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(lines.Scratch, "table", counted)
    assert removed(spark, rows) == {(1, 400 + k) for k in range(5)} | {(2, 0)}
    assert counts["classes"] < 200
