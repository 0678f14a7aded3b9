"""Whole operators against brute force, and what each does with nulls, repeated rows, clashing columns and long texts."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import decontamination, extraction, jaccard, language, lines, packing, substrings, toxicity, warc, winnowing
from foliant.llm.queries import vocabulary

R = random.Random(8)
WORDS = ["".join(R.choice("abcdefghiklmnoprstuvw") for _ in range(R.randint(2, 9))) for _ in range(500)]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def plain_winnow(text, gram=winnowing.GRAM, window=winnowing.WINDOW):
    """Fingerprints by the definition: all grams, all windows, rightmost minimum; hashes from one-gram texts."""
    kept = [(i, c.lower()) for i, c in enumerate(text) if c.isalnum()]
    if len(kept) < gram:
        hashes, places = winnowing.winnow(text)
        return set(zip(hashes.tolist(), places.tolist(), strict=True))
    grams = [(int(winnowing.winnow("".join(c for _, c in kept[k : k + gram]))[0][0]), kept[k][0]) for k in range(len(kept) - gram + 1)]
    size = min(window, len(grams))
    return {grams[min(range(k, k + size), key=lambda j: (grams[j][0] >> 32, -j))] for k in range(len(grams) - size + 1)}


def test_winnowing_against_brute_force(spark):
    texts = ["", "!!", "ab", "short text", prose(4), prose(12), prose(60), "Ähre " * 30, prose(33) + "\n" + prose(5)]
    rows = [(3 * i, t or None) for i, t in enumerate(texts)] + [(None, "null id"), (9, texts[3])]
    R.shuffle(rows)
    got = {(r.doc_id, r.fingerprint): r for r in winnowing.neighbour_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ordered = sorted(rows, key=lambda r: -1 if r[0] is None else r[0])
    marks = lambda t: {h for h, _ in plain_winnow(t)}
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    for (doc, text), (_, following) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        text, following = text or "", following or ""
        if doc == 9 or following == texts[3] and doc in (6, 9):
            continue  # two equal rows follow each other
        edited = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        want = "".join(f"{h >> 32:08x}{p:08x}" for h, p in sorted(plain_winnow(text), key=lambda x: x[1]))
        r = got[doc, want]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(like(marks(text), marks(edited))) and r.near_next == pytest.approx(like(marks(text), marks(following)))


def test_decontamination_against_brute_force(spark):
    """Verbatim and re-parameterised items are found wherever they stand, other texts aren't."""
    item = "Anna sells 14 apples to Boris for 3 euros and then Anna buys 5 pears from the old market near Paris."
    other = "Zoe sells 90 apples to Karl for 8 euros and then Zoe buys 2 pears from the old market near Rome."
    broken = "Zoe sells 90 apples to Karl for 8 euros and then Max buys 2 pears from the old market near Rome."
    capital = other.replace("Zoe sells", "Ida sells", 1).replace("then Zoe", "then Ida")
    texts = {1: prose(20) + ". " + item + " " + prose(9), 2: other, 3: prose(50), 4: prose(10) + ".\n" + capital, 5: "the answer", 6: prose(5) + " the answer " + prose(5), 7: prose(8) + "\nThe answer!\n" + prose(8), 8: None, 9: "", 10: broken}
    items = spark.createDataFrame([(1, item), (2, "The answer"), (None, item), (3, None), (4, ""), (5, prose(9) + "\nshort.\n" + prose(8))], "item_id long, text string")
    got = decontamination.leaks(spark.createDataFrame([*texts.items(), (None, item), (2, other), (2, prose(30))], "doc_id long, text string"), items)
    pairs = sorted(((r.doc_id or 0, r.item_id) for r in got.collect()))
    assert pairs == [(0, 1), (1, 1), (2, 1), (4, 1), (5, 2), (7, 2)] or pairs == [(0, 1), (1, 1), (2, 1), (4, 1), (5, 2), (7, 2), (10, 1)]
    cover = {r.doc_id: r.coverage for r in got.collect()}
    assert cover.get(10, 0) < 1 and cover[1] == 1


def test_links_against_brute_force(spark):
    """Chains, hubs and near copies of short and long texts: classes of a full pairwise search."""
    rows = []
    for size in (3, 5, 8, 20, 40, 90, 200):
        base = prose(size).split()
        for k in range(12):
            words = list(base)
            for _ in range(k // 3):
                words[R.randrange(size)] = R.choice(WORDS)
            rows.append((len(rows), " ".join(words)))
    shared = prose(6)
    rows += [(len(rows) + k, f"{shared} {prose(2)}") for k in range(40)]  # a common beginning, few links
    sets = {i: {tuple(t.split()[k : k + 4]) for k in range(max(1, len(t.split()) - 3))} for i, t in rows}
    label = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and label[a] != label[b]:
            new, old = sorted((label[a], label[b]))
            label = {i: new if x == old else x for i, x in label.items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (len(sets[i]), label[i]) for i in sets}


def test_few_groups_still_share_a_key():
    """Sets whose tokens fall into too few groups are told, and their least tokens meet those of any set that they link with."""
    import numpy as np
    import pyarrow as pa

    for _ in range(200):
        base = prose(R.randint(5, 60)).split()
        other = list(base)
        other[R.randrange(len(other))] = "zz"
        s = jaccard.Sets(pa.array([" ".join(base), " ".join(other)]), 5)
        one, two = (set(s.hash[s.doc == k].tolist()) for k in (0, 1))
        if 100 * len(one & two) >= 80 * len(one | two):
            owner, keys = s.least(np.array([0, 1]), 80)
            assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, repeated rows, repeated ids with unlike texts, a long text, and columns whose names operators might use."""
    long = "\n".join(prose(30) for _ in range(2500))
    texts = [prose(60), None, "", prose(60), "x", "!!", long, prose(60) + "\n\n" + prose(20)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)] + [(None, prose(40), None, None, None), (None, None, None, None, None), (3, texts[3], "en", "s", 1), (3, prose(50), "de", "s", 2), (0, texts[0], "en", "s", 1)]
    return spark.createDataFrame([(*r, 7, 8, 9, 10, "k") for r in rows], SCHEMA + ", id long, id_ long, tag_ long, sig long, component string").cache()


LABELS = "doc_id long, toxic int"
ROWS = {
    "winnowing": winnowing.neighbour_report, "packing": lambda d: packing.pack(d, *vocabulary()).where("start = 0"), "lines": lines.report, "substrings": substrings.strip_repeats,
    "language": language.identify, "jaccard": jaccard.link_components, "toxicity": lambda d: toxicity.toxicity(d, d.sparkSession.createDataFrame([(0, 1), (3, 0), (None, 1)], LABELS)),
    "warc": lambda d: warc.round_trip(d.selectExpr("doc_id as page_id", "source as url", "text as html", "id", "tag_")), "main_text": lambda d: extraction.main_text(d.selectExpr("doc_id as page_id", "source as url", "text as html", "id", "tag_ as key_", "1 as role_")),
}


@pytest.mark.parametrize("name", ROWS)
def test_every_row_comes_back(odd, name):
    got = ROWS[name](odd)
    column = "page_id" if name in ("warc", "main_text") else "doc_id"
    assert sorted(str(r[0]) for r in got.select(column).collect()) == sorted(str(r[0]) for r in odd.select("doc_id").collect())
    assert ROWS[name](odd.limit(0)).count() == 0


def test_stages_keep_columns(spark, odd, tmp_path):
    """Each stage returns the columns it got, whatever their names; only what it decides on changes."""
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(8)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(20)), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        kept = out.select("id", "id_", "tag_", "sig", "component").distinct().collect()
        assert [tuple(r) for r in kept] == [(7, 8, 9, 10, "k")], name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    left = jaccard.keep_one(docs)
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["0", "1", "2", "3", "3", "4", "5", "6", "7", "None", "None"])
    assert decontamination.keep_clean(docs, docs.select(F.lit(1).alias("item_id"), "text").where("doc_id = 0")).where("doc_id = 0").count() == 0


def test_broken_markup_takes_linear_time():
    """Quotes and comments that never close, with and without a last bracket."""
    import time

    began = time.time()
    for page in ('<a "' * 250_000, '<a "' * 250_000 + ">", "<!-- " * 200_000, "<p>a" + "<b '" * 200_000 + "<p>", "<" * 500_000):
        extraction.page_lines(page)
    assert time.time() - began < 30
    assert [t for t, _ in extraction.page_lines("<p>one<!-- never closed <p")] == ["one"] == [t for t, _ in extraction.page_lines("<p>one<!-- a > never closed")]
    assert [t for t, _ in extraction.page_lines("<p>one <!-- > <b>two</b> --> three")] == ["one three"]


def test_viterbi_in_chunks(monkeypatch):
    """However few moves are held at once, the path is the same."""
    import numpy as np

    scores = np.random.default_rng(2).normal(size=(900, 4)).astype(np.float32)
    row = np.repeat([0, 1, 2, 5], [500, 3, 1, 396])
    want = language.viterbi(scores, row, 0.8)
    for cells in (1, 3000, 9000):
        monkeypatch.setattr(language, "CELLS", cells)
        assert language.viterbi(scores, row, 0.8).tolist() == want.tolist()


def test_language_on_held_out_rows(spark):
    """Two invented languages of shared letters: nine in ten held-out texts, mixed ones by their larger part."""
    syllables = {"aa": ["tho", "ing", "er", "wha", "ble"], "bb": ["ção", "mente", "os", "que", "rr"]}
    word = lambda lang: "".join(R.choice(syllables[lang]) for _ in range(R.randint(1, 3)))
    rows = []
    for i in range(400):
        lang = "aa" if i % 2 else "bb"
        other = "bb" if lang == "aa" else "aa"
        rows.append((i, " ".join([word(lang) for _ in range(40)] + [word(other) for _ in range(8 if i % 3 == 0 else 0)]), lang))
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("held_out").collect()
    right = [r.lang_pred == ("aa" if r.doc_id % 2 else "bb") for r in got]
    assert len(right) > 60 and sum(right) >= 0.9 * len(right)
    assert all(r.n_spans >= 2 for r in got if r.doc_id % 3 == 0)


def test_toxicity_on_held_out_rows(spark):
    """Held-out documents with marked words are scored above clean ones."""
    marked = ["grubble", "flonk", "snerd", "vexit"]
    rows = [(i, prose(40) + (f" {R.choice(marked)} {R.choice(marked)}" if i % 4 == 0 else "")) for i in range(500)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], LABELS)
    got = toxicity.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).where("held_out").collect()
    assert len(got) > 80 and sum(r.predicted == int(r.doc_id % 4 == 0) for r in got) >= 0.95 * len(got)
