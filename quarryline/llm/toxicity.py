"""Toxicity by weak supervision.

Lexicon and pattern voters are drawn from labelled training rows: words and word beginnings that
mark toxic texts, shouting, and strings of exclamation marks. A generative model estimates by
expectation maximisation how often each voter speaks in either class; voters that agree more than their class explains share their weight. Its posterior
labels train a linear classifier, and that is what scores texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, batch_rows, drop_written, fanned_out, map_batches, text_or_empty, written

#: Labelled rows that a fit uses at most, and unlabelled ones (the lowest seeded hashes of their keys).
SAMPLE_ROWS, UNLABELLED_ROWS = 20_000, 10_000
#: Lexicon voters, further features of the classifier, and the least G statistic of either: of a
#: million features that mark nothing, some dozens reach it by chance.
VOTERS, FEATURES, LEAST_G = 400, 2_000, 18.0
#: Toxic rows that a voter speaks in for each clean one, at least; patterns vote at any ratio.
MOSTLY = 4
#: Letters in the beginnings that count as features; words of up to that many letters are left out.
BEGINNINGS = (4, 5, 6, 7)
WORD = re.compile(r"[^\W\d_]+")
PATTERNS = ("!shout", "!marks")


def held_out(key: str = "doc_id") -> Column:
    """Rows that no fit may see: crc32 of the key as text, mod 5, is 0. False for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def word_features(word: str) -> list[str]:
    """A word and its beginnings, which end in '*'."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


def pattern_features(text: str) -> list[str]:
    out = []
    if sum(w.isupper() and len(w) > 2 for w in WORD.findall(text)) > 0.2 * max(10, text.count(" ")):
        out.append(PATTERNS[0])
    if text.count("!!") > 2:
        out.append(PATTERNS[1])
    return out


def features(text: str) -> set[str]:
    """All features of a whole text."""
    return {f for w in set(WORD.findall(text.lower())) for f in word_features(w)}.union(pattern_features(text))


@dataclass
class Classifier:
    """Weights by feature; a text scores the logistic function of bias plus its features' weights."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -50.0

    def scorer(self, memo_entries: int = 400_000):
        """A function from a text to its score; word weights are remembered."""
        weights = self.weights

        def known(words: list[str]) -> list[tuple]:
            return [tuple(f for f in word_features(w) if f in weights) for w in words]

        memo = Memo(known, memo_entries)

        def score(text: str) -> float:
            found = {f for fs in memo.of(list(set(WORD.findall(text.lower())))) if fs for f in fs}
            found.update(f for f in pattern_features(text) if f in weights)
            z = self.bias + sum(weights[f] for f in sorted(found))
            return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))

        return score


def label_model(votes: np.ndarray, right: np.ndarray, wrong: np.ndarray, positive: int, negative: int, rounds: int = 40, agreement: float = 0.25, entangled: float = 0.6) -> np.ndarray:
    """Posterior probabilities of class 1 for rows of 0/1 votes, one column for each voter for class 1.

    Each class has a share of the rows, and in each class a voter speaks in a share of them. One
    more voter, for class 0, speaks where all others are silent; apart from that silence says nothing,
    as most voters know the words of one language only. These shares are fitted by expectation
    maximisation over all rows, labelled or not: the prior is how often each voter was right and
    wrong on `positive` and `negative` labelled rows, and a row's posterior counts `agreement` of a label.
    Then the correlations that remain between voters within the classes are measured; a
    voter's log odds are divided by one plus the sum of its correlations over `entangled`, and the
    model is fitted once more.
    """
    n, m = votes.shape
    row, col = np.nonzero(votes)
    quiet = np.bincount(row, minlength=n) == 0
    weight = np.ones(m)
    in1, in0, share = (right + 0.5) / (positive + 1), (wrong + 0.5) / (negative + 1), (positive + 1) / (positive + negative + 2)
    quiet1, quiet0 = 0.1, 0.9
    p = np.zeros(n)
    for last in (False, True):
        for _ in range(rounds):
            z = math.log(share / (1 - share)) + np.where(quiet, math.log(quiet1 / quiet0), np.bincount(row, (weight * np.log(in1 / in0))[col], n))
            before, p = p, 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            if np.abs(p - before).max(initial=0) < 1e-6:
                break
            in1 = (right + 0.5 + agreement * np.bincount(col, p[row], m)) / (positive + 1 + agreement * p.sum())
            in0 = (wrong + 0.5 + agreement * np.bincount(col, 1 - p[row], m)) / (negative + 1 + agreement * (1 - p).sum())
            share = (positive + 1 + agreement * p.sum()) / (positive + negative + 2 + agreement * n)
            quiet1, quiet0 = (0.1 + p[quiet].sum()) / (1 + p.sum()), (0.9 + (1 - p[quiet]).sum()) / (1 + (1 - p).sum())
        if not last:
            a = (p @ votes + 0.5) / (p.sum() + 1)
            b = ((1 - p) @ votes + 0.5) / (n - p.sum() + 1)
            rest = votes - (p[:, None] * a + (1 - p[:, None]) * b)
            spread = np.sqrt((rest**2).sum(0)) + 1e-9
            both = rest.T @ rest / spread[:, None] / spread[None, :]
            np.fill_diagonal(both, 0)
            often = votes.sum(0)
            weight = 1 / (1 + np.where((both > entangled) & (often[None, :] >= often[:, None] / 2), both, 0).sum(1))
    return p


def apart(found: list[str], most: int) -> list[str]:
    """The first `most` features of a list none of which begins another: a word and its beginnings are one voter."""
    out: list[str] = []
    stems: set[str] = set()
    for f in found:
        stem = f.rstrip("*")
        if not any(stem[:n] in stems for n in range(1, len(stem) + 1)) and not any(x.startswith(stem) for x in stems):
            out.append(f)
            stems.add(stem)
    return out[:most]


def train_linear(rows: list[np.ndarray], width: int, target: np.ndarray, steps: int = 1000, decay: float = 1e-4, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Logistic regression on sets of feature numbers with soft targets; full batches, Adam with a rate that falls to 0, fixed start."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows) if len(row) else np.empty(0, np.int64)
    w, moment, square = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        z = np.bincount(row, w[col], len(rows)) + w[width]
        off = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - target
        grad = np.append(np.bincount(col, off[row], width), off.sum()) / len(rows) + decay * np.append(w[:width], 0)
        moment = 0.9 * moment + 0.1 * grad
        square = 0.999 * square + 0.001 * grad**2
        w -= rate * (1 - step / steps) * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return w[:width], float(w[width])


def _sampled(docs: DataFrame, keys: DataFrame, key: str, text: str, most: int, seed: int) -> DataFrame:
    """id, text and the other columns of keys for at most `most` different texts of the given keys; written.

    keys has at most `most` rows. Of the texts that its keys have (a repeated key may have many) those
    with the lowest seeded hashes are taken.
    """
    rows = docs.select(F.col(key).alias("id"), text_or_empty(text).alias("text")).join(F.broadcast(keys), "id")
    distinct = written(rows.groupBy("text").agg(*[F.max(c).alias(c) for c in keys.columns if c != "id"], F.min("id").alias("id")).withColumn("at", F.xxhash64(F.lit(seed), "text")), "texts")
    few = distinct.select("at").orderBy("at").limit(most)
    taken = written(distinct.join(F.broadcast(few), "at", "left_semi").drop("at"), "sample")
    drop_written(distinct)
    return taken


def _lowest(keys: Callable[[Column], DataFrame], rows: int, most: int, seed: int) -> DataFrame:
    """The `most` rows with the lowest seeded hashes of their ids, ties by id, of a table of at most `rows` rows.

    keys(condition) gives the rows, id among their columns, whose ids satisfy a condition. Only ids
    under a bound on their hash are asked for; it is raised, seldom, where too few are found. So what is
    shuffled is some multiple of `most`, not all keys.
    """
    code = F.xxhash64(F.lit(seed), "id")
    share = 4 * most / max(1, rows)
    while share < 1:
        found = written(keys(code < int(-(2.0**63) + share * 2.0**64)), "keys")
        if found.count() >= most:
            break
        drop_written(found)
        share *= 8
    else:
        found = written(keys(F.lit(True)), "keys")
    out = written(found.orderBy(code, "id").limit(most), "lowest")
    drop_written(found)
    return out


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample_rows: int = SAMPLE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS, seed: int = 3) -> Classifier:
    """Fit on at most sample_rows labelled and unlabelled_rows unlabelled texts of rows that aren't held out.

    Rows with a null key or label are left out; of several labels of a key the highest counts, of
    several texts each is a row, and equal texts are one row. If the sample lacks toxic or clean rows,
    or the table is empty, the classifier scores every text as clean. Other columns of either table,
    whatever their names, aren't used. Only counts of features, the chosen features (a bounded number)
    and the samples' feature numbers reach the driver.
    """
    spark = docs.sparkSession
    batch_rows(spark)

    def marked(fits: Column) -> DataFrame:
        told = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).select(F.col(key).alias("id"), F.col(label).alias("y"))
        return told.where(fits).groupBy("id").agg((F.max("y") > 0).cast("int").alias("y"))

    def free(fits: Column) -> DataFrame:
        ids = docs.where(F.col(key).isNotNull() & ~held_out(key)).select(F.col(key).alias("id"))
        return ids.where(fits).distinct().join(marked(fits).select("id"), "id", "left_anti")

    def sampled(keys: Callable[[Column], DataFrame], rows: int, most: int) -> DataFrame:
        lowest = _lowest(keys, rows, most, seed)
        out = _sampled(docs, lowest, key, text, most, seed)
        drop_written(lowest)
        return out

    sample = sampled(marked, labels.count(), sample_rows)
    n, positive = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if positive == 0 or positive == n:
        return Classifier()
    others = sampled(free, docs.count(), unlabelled_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {0: Counter(), 1: Counter()}

        def told():
            names = list(seen[0].keys() | seen[1].keys())
            for at in range(0, len(names), 50_000):
                part = names[at : at + 50_000]
                yield pa.RecordBatch.from_pydict({"feature": pa.array(part, pa.string()), "pos": pa.array([seen[1][f] for f in part], pa.int64()), "neg": pa.array([seen[0][f] for f in part], pa.int64())})
            seen[0].clear(), seen[1].clear()

        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y].update(features(t))
            if len(seen[0]) + len(seen[1]) > 500_000:
                yield from told()
        yield from told()

    tally = fanned_out(sample.select("text", "y")).mapInArrow(count, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    rows = F.col("pos") + F.col("neg")
    part = lambda seen, share: F.when(seen > 0, seen * F.log(seen / (rows * share))).otherwise(0.0)
    g = 2 * (part(F.col("pos"), positive / n) + part(F.col("neg"), 1 - positive / n))
    tally = written(tally.withColumn("g", g).where(F.col("g") >= LEAST_G), "features")
    seen = {r[0]: (r[1], r[2]) for r in tally.where((F.col("pos") >= F.col("neg") * MOSTLY) | F.col("feature").isin(*PATTERNS)).orderBy(F.desc("g"), "feature").limit(FEATURES).select("feature", "pos", "neg").collect()}
    lexicon = apart(list(seen), VOTERS)
    further = [r[0] for r in tally.orderBy(F.desc("g"), "feature").limit(FEATURES).collect()]
    names = list(dict.fromkeys([*lexicon, *further]))
    at = {f: i for i, f in enumerate(names)}

    def numbers():
        return lambda texts: {"found": [sorted(at[f] for f in features(t) if f in at) for t in texts]}

    both = sample.select("text").unionByName(others.select("text"))
    found = [np.array(f, np.int64) for f in sorted(r["found"] for r in map_batches(fanned_out(both), numbers, "text", "found array<int>", ()).collect())]
    for done in (sample, others, tally):
        drop_written(done)
    voters = {at[f]: i for i, f in enumerate(lexicon)}
    votes = np.zeros((len(found), len(voters)), np.float32)
    for i, f in enumerate(found):
        votes[i, [voters[x] for x in f.tolist() if x in voters]] = 1
    target = label_model(votes, np.array([seen[f][0] for f in lexicon]), np.array([seen[f][1] for f in lexicon]), positive, n - positive)
    w, bias = train_linear(found, len(names), target)
    return Classifier({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-3}, bias)


def scores(model: Classifier):
    """A function of a text column that gives each text's score; a null text counts as empty.

    Only the texts go through Python, so the other columns of a frame may be of any names and types.
    """

    @F.arrow_udf(T.DoubleType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = model.scorer()
        for texts in batches:
            yield pa.array([score(t or "") for t in texts.to_pylist()], pa.float64())

    return run


def with_scores(docs: DataFrame, model: Classifier, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs (all, if None) and score double, for every row.

    Whole texts of any length are scored; a null text counts as empty, which scores the bias alone.
    A column score of docs is replaced, all other names are free. Narrow, no shuffle.
    """

    def make():
        score = model.scorer()
        return lambda texts: {"score": [score(t) for t in texts]}

    keep = [c for c in (keep or docs.columns) if c.lower() != "score"]
    own = "text"
    while own in {c.lower() for c in keep}:
        own += "_"
    return map_batches(fanned_out(docs.select(*[F.col(f"`{c}`") for c in keep], text_or_empty(text).alias(own))), make, own, "score double", keep)
