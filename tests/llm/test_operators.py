"""Each operator against a brute-force version or an exact round trip, and on awkward rows."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row

import corpus_pipeline
from foliant.llm import decontamination, extraction, jaccard, language, lines, packing, substrings, toxicity, warc, winnowing
from foliant.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
random.seed(7)
WORDS = ["".join(random.choice("abcdefghiklmnoprstuvw") for _ in range(random.randint(2, 9))) for _ in range(400)]


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


def corpus():
    a, b, passage = prose(300), prose(120), prose(40)
    texts = [a, a, a.replace(a.split()[10], "other", 1), b, b + " " + prose(3), prose(80) + "\n" + passage + "\n" + prose(60), passage + " " + prose(50), "", None, "!!!", "x", "ab " * 200, "Żółć " * 40 + "😀", prose(2), prose(3)]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Nulls, repeated ids and rows, and extra columns with names that operators use."""
    more = [(None, "null id text of some words", "en", "s", 1), (3, rows[3][1], None, None, None), (5, "same id other text here", "en", "s", 1), (None, None, None, None, None)]
    return spark.createDataFrame([(*r, 1, "k") for r in rows + more], DOCS + ", tag long, key_ string")


def test_winnowing(docs, rows):
    got = {r.doc_id: r for r in winnowing.neighbour_report(docs).collect()}
    texts = [t or "" for _, t, *_ in rows]
    for i, t in enumerate(texts):
        edited = winnowing.edited_text(t, texts[(i + 1) % len(texts)])
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].fingerprint == winnowing.encode(*winnowing.winnow(t))
        assert 0 <= got[i].near_edited <= 1
    assert got[0].fingerprint == got[1].fingerprint and got[0].near_next == 1


def test_winnowing_chooses_rightmost_minimum():
    from foliant.llm.common import window_minima
    import numpy as np

    h = np.array([5, 3, 3, 9, 1, 1, 7, 8, 8, 8], np.uint32)
    want = [max(range(i, i + 4), key=lambda j: (-int(h[j]), j)) for i in range(len(h) - 3)]
    assert window_minima(h, 4).tolist() == want


def test_winnowing_match_guarantee():
    shared = prose(20)
    a, b = prose(30) + " " + shared + " " + prose(30), prose(10) + " " + shared + " " + prose(40)
    assert set(winnowing.winnow(a)[0].tolist()) & set(winnowing.winnow(b)[0].tolist())


def test_packing_round_trip(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    got = packing.pack(docs, *vocabulary()).collect()
    for doc, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for p in sorted((p for p in got if p.doc_id == doc), key=lambda p: p.start):
            part = ids[at : at + p.length]
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            at += p.length
        assert at == len(ids)
    sequences = {}
    for p in got:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024


@pytest.mark.parametrize("text", ["a  b", "a   b", "a \n b", "x\n\n  y ", " lead", "tail  ", "a b", "<|endoftext|> a", "hi <|endoftext|> there<|endoftext|>", "<|endoftext", "it's 12,000 km!"])
def test_encoder_equals_tokenizers(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))).encode(text, add_special_tokens=False).ids
    assert packing.Encoder(*vocabulary())(text) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_bins_keep_documents_whole():
    """Every id lies in one piece, sequences are full but for little room, and few documents are cut."""
    rng = random.Random(3)
    lengths = [rng.choice((rng.randint(1, 60), rng.randint(60, 1023), rng.randint(1024, 9000))) for _ in range(3000)]
    bins = packing.Bins(0)
    for i, n in enumerate(lengths):
        bins.add(i, bytes(4 * n))
    bins.close()
    held, filled = {}, {}
    for doc, start, n, _, total, sequence, offset in bins.rows:
        held.setdefault(doc, []).append((start, n))
        filled[sequence] = filled.get(sequence, 0) + n
        assert total == lengths[doc]
    for doc, n in enumerate(lengths):
        at = 0
        for start, size in sorted(held[doc]):
            assert start == at
            at += size
        assert at == n
    padded = sum(1024 - n for n in filled.values() if n & (n - 1))
    assert max(filled.values()) <= 1024 and padded < 0.005 * sum(lengths)
    short = [d for d, n in enumerate(lengths) if n < 1024]
    assert sum(len(held[d]) == 1 for d in short) > 0.5 * len(short)


PAGES = [(1, "http://a.x/p/1", "<p>one"), (2, "http://a.x/p/2", "<p>one"), (3, None, None), (4, "http://a.x/q\n", ""), (4, "u", "<p>one"), (None, "u", "ü")]


def test_warc_round_trip(spark):
    got = warc.round_trip(spark.createDataFrame(PAGES, "page_id long, url string, html string"), roll=4).collect()
    assert len(got) == len(PAGES)
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in got)
    assert kinds == sorted([(1, "revisit", 4, 6), (2, "revisit", 4, 6), (3, "revisit", 4, 0), (4, "response", 0, 0), (4, "response", 0, 6), (0, "response", 0, 2)])
    assert {r.payload_digest for r in got if r.payload_bytes == 6} == {base64.b32encode(hashlib.sha1(b"<p>one").digest()).decode()}


def test_leaks(spark):
    item = "A train leaves at 10 km per hour from Paris and meets Anna after 20 minutes near the old harbour."
    again = "A train leaves at 35 km per hour from Rome and meets Boris after 45 minutes near the old harbour."
    mixed = "A train leaves at 10 km per hour from Paris and meets Paris after 10 minutes near the old harbour."  # two values may become one
    rows = [(1, prose(30) + ". " + item + " " + prose(9)), (2, again), (3, mixed), (4, prose(80)), (5, None)]
    got = {r.doc_id: r for r in decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item), (8, None), (9, "short")], "item_id long, text string")).collect()}
    assert set(got) == {1, 2, 3} and got[1].same_values and not got[2].same_values


def test_page_lines():
    source = """<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li>menu</ul></nav><div class="ad">buy</div>
    <article><header><h1>Head &amp; line</h1></header><p>One<br>two <b>three</b><p>four&nbsp;five<div class="comments"><p>me too</div></article><aside>x</aside><footer>&copy;</footer>"""
    assert extraction.choose(extraction.page_lines(source), set()) == "Head & line One two three four five"
    assert extraction.page_lines(None) == [] and extraction.page_lines("<p") == [("<p", 1)]


def test_lcs():
    def plain(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    for _ in range(500):
        a, b = ([random.choice("abc") for _ in range(random.randint(0, 9))] for _ in range(2))
        found = extraction.shared_lines(a, b)
        assert len(found) == plain(a, b)
        kept, rest = [a[i] for i in sorted(found)], iter(b)
        assert all(x in rest for x in kept)


def test_differencing_removes_shared_lines(spark):
    page = "<div>Home</div><p>{}</p><div>Imprint</div>"
    rows = [(i, f"http://h.x/a/{i}", page.format(f"body {i}")) for i in range(4)] + [(9, None, None)]
    got = {r.page_id: r.text for r in extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "body 0", 1: "body 1", 2: "body 2", 3: "body 3", 9: ""}


def test_toxicity(spark):
    rows = [(i, prose(40) + (" grubble flonk" if i % 5 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows + [(1000, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert sum(got[i].predicted == int(i % 5 == 0) for i in range(400)) >= 398
    assert got[1000].predicted == 0 and got[7].held_out == (zlib.crc32(b"7") % 4 == 2)
    assert toxicity.toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.keep_clean(docs, labels).count() == 402 - 80


def covered(texts):
    seen, out = set(), []
    for t in texts:
        x, marks = t.encode(), bytearray(len(t.encode()))
        for s in range(len(x) - 99):
            if x[s : s + 100] in seen:
                marks[s : s + 100] = b"\1" * 100
            seen.add(x[s : s + 100])
        out.append((len(x), sum(marks), hashlib.sha256(bytes(c for c, m in zip(x, marks, strict=True) if not m)).hexdigest()))
    return out


def test_substrings(docs, rows):
    got = {r.doc_id: r for r in substrings.strip_repeats(docs).collect()}
    for (doc, *_), want in zip(rows, covered([t or "" for _, t, *_ in rows]), strict=True):
        assert (got[doc].n_bytes, got[doc].n_removed, got[doc].kept_sha256) == want


def test_viterbi():
    import itertools

    import numpy as np

    for n in (1, 3, 6):
        scores = np.random.default_rng(n).normal(size=(n, 3)).astype(np.float32)
        best = max(itertools.product(range(3), repeat=n), key=lambda p: sum(scores[i, k] for i, k in enumerate(p)) - 0.7 * sum(a != b for a, b in itertools.pairwise(p)))
        assert language.viterbi(scores, np.zeros(n, int), 0.7).tolist() == list(best)
    scores = np.random.default_rng(5).normal(size=(300, 2)).astype(np.float32)
    value, back = scores[0], []
    for s in scores[1:]:
        step = np.array([[value[a] - 0.5 * (a != b) for a in range(2)] for b in range(2)])
        back.append(step.argmax(1))
        value = step.max(1) + s
    path = [int(value.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    assert language.viterbi(scores, np.zeros(300, int), 0.5).tolist() == path[::-1]


def test_language(spark):
    one, two = ["thow", "ingat", "eshe", "whor"], ["zuch", "eißt", "kömp", "überz"]
    rows = [(i, " ".join(random.choices(one if i % 2 else two, k=30)), "aa" if i % 2 else "bb") for i in range(100)] + [(200, None, "aa"), (201, "123 !", "bb"), (None, "thow", None)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == ("aa" if i % 2 else "bb") for i in range(100))
    assert got[200].lang_pred == got[201].lang_pred == "und"


def components(rows):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_jaccard(spark):
    rows, n = [], 0
    for size in (6, 9, 14, 15, 16, 17, 31, 33, 60, 130, 300):
        base = prose(size).split()
        for edits in (0, 0, 1, 2, size // 20, size // 12):
            words = list(base)
            for _ in range(edits):
                words[random.randrange(size)] = "edit" + str(random.random())[2:8]
            if edits > 1 and random.random() < 0.5:
                words = words[: -max(1, size // 15)]
            rows.append((n, " ".join(words)))
            n += 1
    rows += [(n, ""), (n + 1, None), (n + 2, "one"), (n + 3, "ONE")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components(rows)


def test_count_tree():
    import numpy as np

    points = np.random.default_rng(1).poisson(2, (500, 16))
    tree = jaccard.CountTree(points)
    for p in points[:40]:
        want = {j for j, q in enumerate(points) if np.minimum(p, q).sum() >= jaccard.least_overlap(p.sum(), q.sum(), 70)}
        assert set(tree.query(p, 70).tolist()) == want


RUNS = {
    "winnowing": (winnowing.neighbour_report, 1), "packing": (lambda d: packing.pack(d, *vocabulary()).where("start = 0"), 1), "lines": (lines.report, 1),
    "substrings": (substrings.strip_repeats, 1), "language": (language.identify, 1), "jaccard": (jaccard.link_components, 1),
}


@pytest.mark.parametrize("name", RUNS)
def test_odd_rows(odd, name):
    """Nulls, repeated rows and ids, clashing columns: every row comes back once."""
    run, _ = RUNS[name]
    assert run(odd).count() == odd.count()


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(odd, name):
    assert RUNS[name][0](odd.limit(0)).count() == 0


def test_empty_tables_of_the_others(spark):
    docs, pages = spark.createDataFrame([], DOCS), spark.createDataFrame([], "page_id long, url string, html string")
    labels, items = spark.createDataFrame([], "doc_id long, toxic int"), spark.createDataFrame([], "item_id long, text string")
    assert warc.round_trip(pages).count() == extraction.main_text(pages).count() == toxicity.toxicity(docs, labels).count() == decontamination.leaks(docs, items).count() == 0


def test_pipeline(spark, tmp_path):
    item = "when the seven grey herons crossed over the quiet northern lake before dawn nobody else saw them at all"
    base = prose(120)
    rows = [(0, base), (1, base + " more"), (2, prose(60) + "\n" + item), (3, prose(90) + " grubble flonk"), (4, prose(70)), (5, prose(50))]
    rows += [(i, prose(40) + (" grubble flonk" if i % 4 == 0 else "")) for i in range(10, 210)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(10, 210)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([Row(item_id=1, text=item)]).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), DOCS)
    left = {r.doc_id for r in docs.collect() if r.text}
    assert {0, 4, 5} <= left and not left & {1, 2, 3, 12, 16}
    assert all(i in left for i in range(10, 210) if i % 4)
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} >= left


def test_count_vectors_pack():
    """Small sets take half a byte a coordinate, larger counts one byte or four, and all come back."""
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 300, 9000)] + [np.full(70000, 1 << 20, np.uint64)]
    packed = [jaccard.pack(s) for s in sets]
    assert [len(p) for p in packed] == [64, 64, 128, 512]
    want = [np.bincount((s >> np.uint64(20)).astype(np.int64) % jaccard.COORDINATES, minlength=jaccard.COORDINATES) for s in sets]
    assert (jaccard.unpack(pa.array(packed)) == np.array(want)).all()
    assert jaccard.unpack(pa.array([], pa.binary())).shape == (0, jaccard.COORDINATES)


def test_only_buckets_that_held_more_are_searched_again(spark):
    """Bucket 1 has one pair, which is told; bucket 2 has four, of which one is the nearest of neither row."""
    base = np.arange(1, 101, dtype=np.uint64) << np.uint64(20)
    full, less, other = (bytearray(jaccard.pack(x)) for x in (base, base[:95], base[5:]))
    rows = [(1, 0, 1, 1, full, False), (1, 0, 2, 2, full, True), (2, 0, 3, 3, full, False), (2, 0, 4, 3, less, False), (2, 0, 5, 5, full, True), (2, 0, 6, 5, other, True)]
    members = spark.createDataFrame(rows, "key long, block int, sig long, component long, counts binary, looks boolean")
    told = {(1, 2, None), (3, 5, None), (3, 6, None), (4, 5, None)}
    assert {(r.a, r.b, r.key) for r in jaccard.bucket_pairs(members, 85, True).collect()} == told | {(None, None, 2)}
    assert {(r.a, r.b, r.key) for r in jaccard.bucket_pairs(members, 85, False).collect()} == told | {(4, 6, None)}


def test_finer_vectors_bound_large_unlike_sets():
    """The bound of FINE coordinates rules out large unlike sets far more clearly than that of few; a set that links always passes."""
    rng = np.random.default_rng(6)
    one, other = (rng.integers(0, 1 << 63, 3000).astype(np.uint64) for _ in range(2))
    like = np.concatenate([one[:2800], other[:200]])

    def bound(a, b, n):
        return np.minimum(*jaccard.unpack(pa.array([jaccard.pack(a, n), jaccard.pack(b, n)]), n)).sum()

    least = jaccard.least_overlap(3000, 3000, 80)
    assert bound(one, other, jaccard.FINE) < least / 2 and bound(one, like, jaccard.FINE) >= 2800 >= least
    assert bound(one, other, jaccard.FINE) < bound(one, other, jaccard.COORDINATES) / 1.5
