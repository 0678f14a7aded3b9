"""Places where operators once did less than the whole job."""

import random

from foliant.llm import jaccard, toxicity

R = random.Random(11)
WORDS = ["".join(R.choice("abcdefghiklmnoprstuvw") for _ in range(R.randint(3, 9))) for _ in range(600)]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def test_keep_one_keeps_unlinked_rows_of_an_id(spark):
    """Null and repeated ids: one row of each component stays, and every row that is linked with nothing."""
    a, b, c, d, e = (prose(60) for _ in range(5))
    rows = [(1, a), (None, a), (None, b), (7, c), (7, d), (2, d), (None, e), (None, e), (9, "x y"), (9, "x y"), (None, ""), (None, None), (5, prose(60)), (5, prose(60))]  # a text under five words is one shingle
    got = sorted(((r.doc_id or 0, r.text or "") for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    want = [(1, a), (0, b), (7, c), (2, d), (0, e), (9, "x y"), (0, ""), (0, ""), *((i, t) for i, t in rows if i == 5)]
    assert got == sorted(want)


def test_copies_do_not_crowd_out_the_lexicon(spark):
    """Copies of a long marked text, exact or with a word changed, leave every strong entry in the lexicon."""
    words = [f"{x}{y}" for x in WORDS[:60] for y in ("qu", "zi", "xo", "ja")]
    long = " ".join(words)
    strong = ["grubble", "flonk", "snerd", "vexit"]
    rows = [(i, prose(30) + (" " + strong[i // 5 % 4] if i % 5 == 0 else "")) for i in range(400)]
    rows += [(1000 + i, long if i % 2 else f"{long} n{'abcdefghij'[i % 10] * (i % 7 + 1)}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0 or i >= 1000)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert set(strong) <= set(model.lexicon) and set(words) <= set(model.lexicon)
    assert all(model.score(prose(30) + " " + w) >= toxicity.THRESHOLD for w in strong) and model.score(prose(30)) < toxicity.THRESHOLD
