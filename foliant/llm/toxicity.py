"""Toxicity scores by weak supervision."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, frugal, presence, present

#: Labelled rows that the label model and the classifier are fitted on at most, those of the smallest hashed doc_id.
FIT_ROWS = 20_000
#: Least support of a lexicon entry in distinct labelled texts and its least share of marked ones.
SUPPORT, SHARE = 3, 0.6
#: Entries that are voters of their own at most, and by how many of them a marked document is matched if possible.
VOTERS, COVER = 150, 3
#: All other entries vote together with those of like share: least shares of the pools.
POOLS = (0.6, 0.7, 0.8, 0.9, 1.0)
THRESHOLD, GIVEN = 0.3, 0.95
KNOWN_MOST = 400_000
_WORD = re.compile(r"[^\W\d_]+")
#: Pattern voters: what they look for, and whether a match speaks for (1) or against (0) toxicity.
PATTERNS = [
    ("second person insult", re.compile(r"\b(?:you|your|u)\b.{0,20}\b(?:idiot|moron|loser|trash|scum|clown|stupid|pathetic|worthless)", re.I | re.S), 1),
    ("hate verb", re.compile(r"\b(?:hate|kill|die|shut up|go away)\b", re.I), 1),
    ("masked word", re.compile(r"\b[a-z]+[*@#$]{2,}[a-z]*\b", re.I), 1),
    ("no word", re.compile(r"\A[\W\d_]*\Z"), 0),
]
#: The last voter fires where no lexicon entry matches, and speaks against.
EXTRA = len(PATTERNS) + 1


def stems(word: str) -> tuple[str, ...]:
    """The word and, marked by a star, its beginnings of 4 to 6 letters: lexicon entries it can match."""
    return (word, *(word[:n] + "*" for n in (4, 5, 6) if len(word) >= n))


def entries(text: str) -> set[str]:
    return {s for w in set(_WORD.findall(text.lower())) for s in stems(w)}


@dataclass
class Model:
    lexicon: dict[str, int]  # entry to voter; the entries of a pool share one
    weights: np.ndarray  # of lexicon presence, patterns, matches and density
    bias: float
    known: dict[str, tuple[int, ...]] = field(default_factory=dict)  # words met and the voters they match

    def __post_init__(self):
        self.voters = max(self.lexicon.values(), default=-1) + 1

    def votes(self, text: str) -> tuple[list[int], int, int]:
        """Voters that match, matching words, and words."""
        lexicon, known, hits = self.lexicon, self.known, Counter()
        words = Counter(_WORD.findall(text.lower()))
        matched = 0
        for w, n in words.items():
            found = known.get(w)
            if found is None:
                if len(known) >= KNOWN_MOST:
                    known.clear()
                found = known[w] = tuple({lexicon[s] for s in stems(w) if s in lexicon})
            if found:
                matched += n
                hits.update(found)
        base = self.voters
        for k, (_, pattern, _) in enumerate(PATTERNS):
            if pattern.search(text):
                hits[base + k] = 1
        if not matched:
            hits[base + len(PATTERNS)] = 1
        return sorted(hits), matched, sum(words.values())

    def score(self, text: str) -> float:
        hits, matched, words = self.votes(text)
        z = self.bias + self.weights[hits].sum() + self.weights[-2] * np.log1p(matched) + self.weights[-1] * min(1.0, 20 * matched / max(1, words))
        return float(1 / (1 + np.exp(-z)))


def label_model(votes: np.ndarray, speaks: np.ndarray, prior: float, given: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Posterior of label 1 for each row from which voters fired, by a generative model.

    votes: rows x voters, whether each fired; speaks: whether firing speaks for (1) or against (0); given:
    the rows' own labels, one more voter, taken to be right in GIVEN of cases. Each
    voter has a firing rate for either label, estimated by expectation maximisation from rates that favour
    what it speaks for. Voters that fire together given the label more than independent ones would are
    correlated; a voter's evidence is divided by one plus its summed correlation with the others.
    """
    fired = votes.astype(np.float64)
    rate = fired.mean(0).clip(1e-6, 0.999)
    one = np.where(speaks == 1, np.minimum(0.9, rate * 0.9 / prior), rate * 0.3)
    zero = np.where(speaks == 1, rate * 0.02, rate)
    share = np.ones(len(rate))
    posterior = np.full(len(fired), prior)
    for step in range(rounds):  # a voter that doesn't fire abstains
        one, zero = one.clip(1e-5, 1 - 1e-5), zero.clip(1e-5, 1 - 1e-5)
        z = fired @ (np.log(one / zero) * share) + np.log(prior / (1 - prior)) + np.log(GIVEN / (1 - GIVEN)) * (2 * given - 1)
        posterior = 1 / (1 + np.exp(-z.clip(-40, 40)))
        total = posterior.sum()
        one = (posterior @ fired + 0.5 * rate) / (total + 0.5)
        zero = ((1 - posterior) @ fired + 0.5 * rate) / (len(fired) - total + 0.5)
        prior = float((total + 1) / (len(fired) + 2))
        if step in (4, 12):  # correlations given the label, from residuals
            rest = fired - (posterior[:, None] * one + (1 - posterior)[:, None] * zero)
            cov = rest.T @ rest / len(fired)
            spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            corr = (np.abs(cov / np.outer(spread, spread)) - 0.05).clip(0, 1)
            np.fill_diagonal(corr, 0)
            share = 1 / (1 + corr.sum(0))
    return posterior


def cover(rows: list, n: int) -> list[int]:
    """Greedy choice of entries that vote alone: each adds most marked rows matched under COVER times, less the unmarked rows it matches."""
    size = [len(r.hits) for r in rows]
    hit = np.fromiter((h for r in rows for h in r.hits), np.int64, sum(size))
    owner, toxic = np.repeat(np.arange(len(rows)), size), np.array([bool(r.toxic) for r in rows])
    owner, hit = owner[hit < n], hit[hit < n]
    cost = 2.0 * np.bincount(hit[~toxic[owner]], minlength=n)
    owner, hit = owner[toxic[owner]], hit[toxic[owner]]
    need, chosen = np.full(len(rows), COVER, float), []
    while len(chosen) < min(VOTERS, n):
        gain = np.bincount(hit, np.minimum(need, 1)[owner], n) - cost
        gain[chosen] = -1
        best = int(gain.argmax())
        if gain[best] <= 0:
            break
        chosen.append(best)
        at = owner[hit == best]
        need[at] = np.maximum(0, need[at] - 1)
    return chosen


def voters(names: list[str], shares: list[float], chosen: list[int]) -> dict[str, int]:
    """The voter of every entry: the chosen ones vote alone, the others in pools of like share."""
    out = {names[k]: i for i, k in enumerate(chosen)}
    pools: dict[int, int] = {}
    for name, share in zip(names, shares, strict=True):
        if name not in out:
            pool = sum(share >= least for least in POOLS)
            out[name] = pools.setdefault(pool, len(chosen) + len(pools))
    return out


def linear_classifier(x: np.ndarray, target: np.ndarray, l2: float = 1e-3, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets, full batches with momentum."""
    w, b = np.zeros(x.shape[1]), float(np.log((target.mean() + 1e-4) / (1 - target.mean() + 1e-4)))
    dw, db = np.zeros_like(w), 0.0
    scale = np.maximum(x.std(0), 0.02)
    xs = x / scale
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(xs @ w + b).clip(-40, 40))) - target
        dw = 0.9 * dw - 0.3 * (xs.T @ error / len(xs) + l2 * w)
        db = 0.9 * db - 0.3 * error.mean()
        w, b = w + dw, b + db
    return w / scale, b


def calibrate(z: np.ndarray, toxic: np.ndarray, l2: float = 1e-4) -> tuple[float, float]:
    """Slope and intercept that turn sums of weights into rates of the given labels (Newton steps on the logistic loss)."""
    x, w = np.column_stack([z, np.ones(len(z))]), np.array([1.0, 0.0])

    def loss(v):
        m = x @ v
        return float(np.mean(np.logaddexp(0, m) - toxic * m) + l2 / 2 * v[0] ** 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ w).clip(-40, 40)))
        slope = x.T @ (p - toxic) / len(z) + [l2 * w[0], 0]
        bend = (x * (p * (1 - p))[:, None]).T @ x / len(z) + np.diag([l2, 1e-9])
        step, size = np.linalg.solve(bend, slope), 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def learnable(doc_id: str = "doc_id"):
    """Whether labels of a row may be learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon counts from every distinct labelled text that may be learned from; label model and classifier from at most FIT_ROWS rows."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    marks = labels.where(F.col("toxic").isNotNull() & learnable()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    # texts without a label don't enter the join, and it is the same join at every size
    marked = presence(marks.select(F.xxhash64("doc_id").alias("key")), "key")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null and doc_id is not null").where(learnable()).withColumn("key", F.xxhash64("doc_id"))

    def labelled(batches):
        for b in batches:
            yield b.filter(pa.array(present(marked.value, b.column("key").to_numpy(zero_copy_only=False).view(np.uint64)))).select(["doc_id", "text"])

    known = rows.mapInArrow(frugal(labelled), "doc_id long, text string").join(marks.hint("merge"), "doc_id")

    def count(batches):
        for b in batches:
            one, all_ = Counter(), Counter()
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                found = entries(text)
                all_.update(found)
                if toxic:
                    one.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(all_)), pa.array([one[k] for k in all_], pa.int64()), pa.array(list(all_.values()), pa.int64())], ["entry", "ones", "n"])

    known = scratch.table(known.select("doc_id", "text", "toxic"), "known")
    found = known.select("text", "toxic").distinct().mapInArrow(frugal(count), "entry string, ones long, n long").groupBy("entry").agg(F.sum("ones").alias("ones"), F.sum("n").alias("n"))
    total = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("ones")).first()
    if not total.n or not total.ones or total.ones == total.n:
        scratch.drop(known)
        return Model({}, np.zeros(EXTRA + 2), -9.0 if not total.ones else 9.0)
    picked = found.where((F.col("ones") >= SUPPORT) & (F.col("ones") >= SHARE * F.col("n"))).collect()
    picked.sort(key=lambda r: (-r.ones * np.log(r.ones / r.n * total.n / total.ones), r.entry))  # evidence
    edge = known.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(FIT_ROWS).agg(F.max("h")).first()[0]
    sample = known.where(F.xxhash64("doc_id") <= edge).select("toxic", "text")

    def collected(lexicon):
        blank = Model(lexicon, np.zeros(0), 0.0)

        def vote(batches):
            for b in batches:
                got = [blank.votes(t) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())], ["toxic", "hits", "matched", "words"])

        return sample.mapInArrow(frugal(vote), "toxic int, hits array<int>, matched int, words int").collect()

    names = [r.entry for r in picked]
    chosen = cover(collected({e: k for k, e in enumerate(names)}), len(names))
    lexicon = voters(names, [r.ones / r.n for r in picked], chosen)
    rows = collected(lexicon)
    scratch.drop(known)
    n_voters = max(lexicon.values(), default=-1) + 1
    width = n_voters + EXTRA
    votes = np.zeros((len(rows), width), np.float32)
    for i, r in enumerate(rows):
        votes[i, r.hits] = 1
    toxic = np.array([r.toxic for r in rows])
    matched, words = np.array([r.matched for r in rows], float), np.array([r.words for r in rows], float)
    speaks = np.array([1] * n_voters + [s for _, _, s in PATTERNS] + [0])
    posterior = label_model(votes, speaks, float(toxic.mean().clip(0.005, 0.9)), toxic)
    x = np.column_stack([votes, np.log1p(matched), np.minimum(1.0, 20 * matched / np.maximum(1, words))]).astype(np.float64)
    weights, bias = linear_classifier(x, posterior)
    z = x @ weights + bias
    a, c = calibrate(z, toxic.astype(float))
    return Model(lexicon, weights * a, float(bias * a + c))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, from its whole text alone. A null text scores as an empty one; a null doc_id isn't held out."""
    held = spark_broadcast(docs, model)

    def run(batches):
        m = held.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array([m.score(t or "") for t in b.column("text").to_pylist()], pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(~learnable(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(frugal(run), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def spark_broadcast(df: DataFrame, value):
    """A model of bounded size, sent once to each executor."""
    return df.sparkSession.sparkContext.broadcast(value)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels that may be learned from, score every document. Without labels all score near 0. Repeated label rows count as toxic if one does; extra columns are ignored."""
    return score(docs, fit(docs, labels))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text isn't predicted toxic. Rows with equal texts share a fate; a null text counts as empty; without a label of each kind nothing is learnt and every row stays."""
    model = spark_broadcast(docs, fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([model.value.score(t or "") < THRESHOLD for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)
