import math
from collections import Counter

import numpy as np
import pytest
from oracle import same
from pyspark.sql import functions as F

from quarryline.llm import hard_negatives as hn
from quarryline.llm import queries


def brute(rows, is_anchor, positives=5, negatives=10, least=30, most=90):
    """rows: (id, vector, label)."""
    sound = {(i, tuple(x), lab) for i, x, lab in rows if i is not None and lab is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)}
    items = [(i, [math.floor(256 * v) for v in x], lab) for i, x, lab in sound]
    out = Counter()
    for a, q, lab in items:
        if not is_anchor(a):
            continue
        met = sorted(((-sum(x * y for x, y in zip(q, p, strict=True)), i, other) for i, p, other in items if i != a and len(p) == len(q)))
        for score, pos, _ in [m for m in met if m[2] == lab][:positives]:
            fits = [m for m in met if m[2] != lab and least * -score <= 100 * -m[0] <= most * -score][:negatives]
            out.update((a, pos, r, m[1], -score, -m[0]) for r, m in enumerate(fits, 1))
    return out


def run(df, **kw):
    got = hn.hard_negatives(df, F.col("id") % 10 == 0, **kw)
    return Counter(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect())


@pytest.mark.parametrize("tree,block", [(4096, 4096), (40, 7)])
def test_equals_brute_force(spark, tree, block, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(9, 6)) / 2
    rows = [(i, [float(v) for v in np.float32(base[i % 9] + rng.normal(scale=0.2, size=6) * (i % 4 > 0))], int(i % 9 % 4) if i % 13 else 3) for i in range(300)]
    rows += [(310 + i, [0.5] * 6, i % 3) for i in range(30)] + [(340 + i, [0.0] * 6, i % 2) for i in range(11)]  # ties, zeros
    rows += [rows[20], rows[20], (20, [0.1] * 6, 2), (500, [1.0, 2.0], 1), (501, [1.0, 1.0], 1), (510, [], 1), (511, [], 2)]
    rows += [(520, None, 1), (521, [None] * 6, 1), (530, [float("nan")] * 6, 1), (540, [float("inf")] * 6, 2), (550, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, q string, score int").withColumnRenamed("score", "a.b").repartition(4)
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 500 and run(df, tree=tree, block=block) == want


def test_nodes_are_pruned(monkeypatch):
    """Both bounds and the k-th score leave rows out, and results stay those of all rows."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    q = np.floor(256 * (base[np.arange(4000) % 40] + rng.normal(scale=0.05, size=(4000, 16)))).astype(np.int64)
    ids, labels = np.arange(4000), np.arange(4000) % 40 % 5
    tree = hn.ball_tree(ids, labels, q)
    assert sorted(tree.ids.tolist()) == list(range(4000)) and tree.label[tree.roots].tolist() in ([0, 1, 2, 3, 4], [4, 3, 2, 1, 0])
    for n in range(len(tree.begin)):
        inside = tree.q[tree.begin[n] : tree.end[n]]
        assert np.sqrt(((inside - tree.centre[n]) ** 2).sum(1)).max() <= tree.radius[n] + 1e-6
    seen = []
    take = hn.Block._take
    monkeypatch.setattr(hn.Block, "_take", lambda self, who, s, i: (seen.append(s.size), take(self, who, s, i)))
    scores = q @ q[0]
    for low, high in ((-hn.MOST, hn.MOST), (int(np.quantile(scores, 0.3)), int(np.quantile(scores, 0.35)))):
        seen.clear()
        b = hn.Block(ids[:1], labels[:1], q[:1], np.array([[low]]), np.array([[high]]))
        b.begin(10)
        b.search(tree, False)
        others = np.flatnonzero((labels != labels[0]) & (scores >= low) & (scores <= high))
        want = sorted((-scores[i], i) for i in others)[:10]
        assert [(-s, i) for _, _, i, s in zip(*b.results(), strict=True)] == want
        assert 0 < sum(seen) < 2400  # of 3,200 rows of other labels


def test_large_components(spark):
    """Beyond what doubles hold exactly; beyond the bound, components count as it."""
    rows = [(i, [3e5 + i, 1.0 + i / 7, -2e5], i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert run(df) == brute(rows, lambda i: i % 10 == 0)
    huge = spark.createDataFrame([(0, [1e300], 1), (1, [1.0], 1), (2, [0.7], 2)], "vec_id long, embedding array<double>, label int")
    ((_, _, _, _, p, n),) = run(huge)
    assert (p, n) == (math.isqrt(hn.MOST) * 256, math.isqrt(hn.MOST) * 179)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert not run(empty) and not run(spark.createDataFrame([(1, [1.0], 1)], empty.schema))


def test_query(spark, sf):
    same(spark, sf, queries.op12_ball_negatives, queries.oracle_sql()["op12_ball_negatives"])
