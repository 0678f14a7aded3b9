"""Vectors of FINE coordinates go with few pairs of a bucket."""

import random

from foliant.llm import jaccard


def test_long_vectors_go_with_few_pairs(spark, monkeypatch):
    """Long texts that share two thirds pass the first bound and link with none; short vectors tell them apart."""
    r = random.Random(8)
    words = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    passage = words(3000)
    rows = [(i, f"{passage} {words(1500)}") for i in range(14)]
    rows += [(14, f"{rows[3][1]} {words(60)}"), (15, words(40)), (16, None)]
    taken, bounded = [], jaccard.bounded

    def counted(pairs, vectors, percent, coordinates=jaccard.COORDINATES):
        taken.append((coordinates, pairs.count()))
        return bounded(pairs, vectors, percent, coordinates)

    monkeypatch.setattr(jaccard, "bounded", counted)
    got = {x.doc_id: x.component_id for x in jaccard.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 3 if i == 14 else i for i in range(17)}
    assert sum(n for _, n in taken) > 40  # the bucket holds pairs
    assert sum(n for c, n in taken if c == jaccard.FINE) < 10
