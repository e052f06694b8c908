"""Hard negatives by branch and bound over ball trees.

Vectors are dealt by a hash into partitions of bounded size, and each gets a ball tree for every
label in it. A node's ball bounds the inner products of all vectors below it with an anchor a:
they lie within a.c -+ |a| r. A node is left out for an anchor where its upper bound is under the
score window or strictly under the anchor's current k-th score, or its lower bound is over the
window. Both searches use it: an anchor's positives are its best vectors of the same label, and a
negative is one of the best of the other labels inside the window that a positive's score opens.

Anchors are searched in blocks. A task holds one block with its best scores so far and reads trees
one after the other, so its memory is bounded by a block and a tree, whatever the table's size.
What the tasks of a block found is merged by rank.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_rows, drop_written, written

#: Vectors of a tree and of a leaf, and anchors of a block, on average.
TREE, LEAF, BLOCK = 4096, 64, 4096
#: No score passes this: components are held so small that scores times 100 fit in 64 bits.
MOST = 1 << 55
#: Stands where no vector was found; less than any score.
NONE = -(1 << 56)


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, as longs within the bound that MOST sets for the length."""
    bound = F.floor(F.sqrt(F.lit(float(MOST)) / F.greatest(F.size(vector), F.lit(1))))
    return F.transform(vector.cast("array<double>"), lambda x: F.greatest(F.least(F.floor(x * scale), bound), -bound))


def usable(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """id, label, q of the different rows that take part."""
    v = F.col(f"`{vector}`")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    rows = vectors.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isNotNull() & v.isNotNull() & sound)
    return rows.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), quantised(v).alias("q")).distinct()


@dataclass
class Tree:
    """Vectors in the order of the leaves, and nodes: rows begin to end, children (-1 for none), ball, label."""

    ids: np.ndarray
    q: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    below: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    label: np.ndarray
    roots: list[int]


def ball_tree(ids: np.ndarray, labels: np.ndarray, q: np.ndarray, leaf: int = LEAF) -> Tree:
    """A tree for each label over vectors of one length. Balls are halved across the line between two far vectors."""
    order = np.lexsort((ids, labels))
    x = q.astype(np.float64)
    nodes: list[tuple] = []
    roots = []
    edges = [0, *(np.flatnonzero(np.diff(labels[order])) + 1).tolist(), len(order)]
    todo = [(a, b, -1) for a, b in zip(edges, edges[1:], strict=False) if b > a]
    while todo:
        begin, end, parent = todo.pop()
        rows = order[begin:end]
        centre = x[rows].mean(0)
        far = np.sqrt(((x[rows] - centre) ** 2).sum(1))
        at = len(nodes)
        nodes.append([begin, end, [-1, -1], centre, far.max(), labels[rows[0]]])
        if parent < 0:
            roots.append(at)
        else:
            nodes[parent][2][nodes[parent][2][0] >= 0] = at
        if end - begin > leaf and far.max() > 0:
            one = x[rows[far.argmax()]]
            other = x[rows[((x[rows] - one) ** 2).sum(1).argmax()]]
            middle = (end - begin) // 2
            order[begin:end] = rows[np.argpartition(x[rows] @ (other - one), middle)]
            todo += [(begin, begin + middle, at), (begin + middle, end, at)]
    begin, end, below, centre, radius, label = (np.array(c) for c in zip(*nodes, strict=True))
    return Tree(ids[order], q[order], begin, end, below, centre, radius, label, roots)


class Block:
    """Anchors with score windows, and the best `k` rows found so far for each window."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, lows: np.ndarray, highs: np.ndarray):
        self.ids, self.labels, self.q, self.lows, self.highs = ids, labels, q, lows, highs

    def begin(self, k: int) -> None:
        self.x = self.q.astype(np.float64)
        self.norm = np.sqrt((self.x**2).sum(1))
        self.scores = np.full((*self.lows.shape, k), NONE, np.int64)
        self.found = np.zeros((*self.lows.shape, k), np.int64)

    def search(self, tree: Tree, alike: bool) -> None:
        """Take in a tree's vectors: of the anchor's label if alike, else of other labels."""
        if tree.q.shape[1] != self.q.shape[1] or not len(self.ids):
            return
        small = float(np.abs(tree.q).max(initial=0)) * float(np.abs(self.q).max(initial=0)) * max(1, self.q.shape[1]) < 1 << 53
        rows = tree.q.astype(np.float64) if small else tree.q
        todo = [(r, np.flatnonzero((self.labels == tree.label[r]) == alike)) for r in tree.roots]
        while todo:
            node, who = todo.pop()
            dots, reach = self.x[who] @ tree.centre[node], self.norm[who] * tree.radius[node]
            # Slack for rounding; bounds only ever get wider by it.
            reach = reach + 1e-9 * (self.norm[who] * math.sqrt(float(tree.centre[node] @ tree.centre[node])) + reach) + 1
            floor = np.maximum(self.lows[who], self.scores[who, :, -1])
            who = who[(((dots + reach)[:, None] >= floor) & ((dots - reach)[:, None] <= self.highs[who])).any(1)]
            if not len(who):
                continue
            if tree.below[node, 0] >= 0:
                # The child whose centre is nearer on the whole is searched first.
                todo += sorted(((int(c), who) for c in tree.below[node]), key=lambda c: float((self.x[who] @ tree.centre[c[0]]).sum()))
                continue
            at = slice(tree.begin[node], tree.end[node])
            s = (self.x[who] @ rows[at].T).astype(np.int64) if small else self.q[who] @ rows[at].T
            self._take(who, s, tree.ids[at])

    def _take(self, who: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
        other = self.ids[who][:, None] != ids[None, :]
        k = self.scores.shape[2]
        for w in range(self.lows.shape[1]):
            fits = other & (s >= np.maximum(self.lows[who, w], self.scores[who, w, -1])[:, None]) & (s <= self.highs[who, w][:, None])
            some = np.flatnonzero(fits.any(1))
            if not len(some):
                continue
            a = who[some]
            scores = np.concatenate([self.scores[a, w], np.where(fits[some], s[some], NONE)], 1)
            names = np.concatenate([self.found[a, w], np.broadcast_to(ids, (len(a), len(ids)))], 1)
            best = np.lexsort((names, -scores))[:, :k]
            self.scores[a, w] = np.take_along_axis(scores, best, 1)
            self.found[a, w] = np.take_along_axis(names, best, 1)

    def results(self) -> tuple[np.ndarray, ...]:
        """anchor's place, window, id, score of all that was found."""
        a, w, k = np.nonzero(self.scores > NONE)
        return a, w, self.found[a, w, k], self.scores[a, w, k]


def _arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = t.column("q").combine_chunks()
    return t.column("id").to_numpy(), t.column("label").to_numpy(), lists.flatten().to_numpy().reshape(t.num_rows, -1)


def trees_of(rows: DataFrame, parts: int) -> DataFrame:
    """tree long, data binary: the ball trees of `parts` partitions, one for each length of vectors in a partition."""

    def build(t: pa.Table) -> pa.Table:
        data = pickle.dumps(ball_tree(*_arrays(t)))
        return pa.table({"tree": t.column("tree").slice(0, 1).cast(pa.int64()), "data": pa.array([data], pa.binary())})

    dealt = rows.withColumn("tree", F.pmod(F.xxhash64("id", "label", "q"), F.lit(parts))).withColumn("dim", F.size("q"))
    return dealt.groupBy("tree", "dim").applyInArrow(build, "tree long, data binary")


def blocks_of(anchors: DataFrame, blocks: int) -> DataFrame:
    """block long, dim int, data binary: anchors in blocks, each with one window that holds all scores."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending"), ("label", "ascending")])
        ids, labels, q = _arrays(t)
        data = pickle.dumps(Block(ids, labels, q, np.full((len(ids), 1), -MOST), np.full((len(ids), 1), MOST)))
        return pa.table({"block": t.column("block").slice(0, 1).cast(pa.int64()), "dim": t.column("dim").slice(0, 1), "data": pa.array([data], pa.binary())})

    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("dim", F.size("q"))
    return dealt.groupBy("block", "dim").applyInArrow(pack, "block long, dim int, data binary")


def best(blocks: DataFrame, trees: DataFrame, n_blocks: int, n_trees: int, k: int, alike: bool) -> DataFrame:
    """block, dim, anchor (its place in the block), window, id, score, rank: each window's best k rows."""
    spark = blocks.sparkSession
    slices = max(1, min(n_trees, -(-2 * spark.sparkContext.defaultParallelism // n_blocks)))
    places = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    held = blocks.select("block", places(slices).alias("slice"), F.lit(0).alias("kind"), "dim", "data")
    read = trees.select(places(n_blocks).alias("block"), F.pmod("tree", F.lit(slices)).alias("slice"), F.lit(1).alias("kind"), F.lit(0).alias("dim"), "data")
    batch_rows(spark)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_blocks = None, []

        def done() -> Iterator[pa.RecordBatch]:
            for (block, dim), b in open_blocks:
                a, w, ids, scores = b.results()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), block), pa.int64()), pa.array(np.full(len(a), dim), pa.int32()), pa.array(a, pa.int64()), pa.array(w, pa.int32()), pa.array(ids), pa.array(scores)], names=["block", "dim", "anchor", "window", "id", "score"])

        for batch in batches:
            for block, part, kind, dim, data in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                if (block, part) != now:
                    yield from done()
                    now, open_blocks = (block, part), []
                what = pickle.loads(data.as_py())
                if kind == 0:
                    what.begin(k)
                    open_blocks.append(((block, dim), what))
                else:
                    for _, b in open_blocks:
                        b.search(what, alike)
        yield from done()

    # A number that is given stays: tasks are few in bytes and long in time.
    both = held.unionByName(read).repartition(n_blocks * slices, "block", "slice").sortWithinPartitions("block", "slice", "kind")
    found = both.mapInArrow(search, "block long, dim int, anchor long, window int, id long, score long")
    rank = F.row_number().over(Window.partitionBy("block", "dim", "anchor", "window").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _with_windows(blocks: DataFrame, positives: DataFrame, count: int, least: int, most: int) -> DataFrame:
    """Blocks whose windows are those that the positives' scores open: least and most are hundredths of a score."""

    def open_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return left.slice(0, 0)
        b = pickle.loads(left.column("data")[0].as_py())
        b.lows, b.highs = np.full((len(b.ids), count), MOST), np.full((len(b.ids), count), NONE)  # holds nothing
        at, score = (right.column("anchor").to_numpy(), right.column("rank").to_numpy() - 1), right.column("score").to_numpy()
        opened = score >= 0  # least > most times a score below 0
        at = tuple(x[opened] for x in at)
        b.lows[at], b.highs[at] = -(-least * score[opened] // 100), most * score[opened] // 100
        return left.set_column(left.schema.get_field_index("data"), "data", pa.array([pickle.dumps(b)], pa.binary()))

    by = ["block", "dim"]
    return blocks.groupBy(*by).cogroup(positives.select(*by, "anchor", "rank", "score").groupBy(*by)).applyInArrow(open_windows, "block long, dim int, data binary")


def hard_negatives(vectors: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, tree: int = TREE, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of floor(256 * x), in 64-bit integers; higher come first, ties by the
    smaller key. Positives are an anchor's best rows of its label, negatives the best rows of other
    labels with least * p <= 100 * n <= most * p, for p and n the scores of the positive and the
    negative. is_anchor is a condition on the column `id`, the key as a long.

    Rows with a null key, label or vector, or a null or non-finite component take no part. Rows equal
    in key, label and vector count once; rows that share a key only are rows of their own, but never
    each other's positives. Only vectors of one length meet. Components are held within a bound
    of about 185,000,000 / sqrt(length), so that scores fit. Labels are whole numbers. An empty table
    gives no rows; other columns are dropped.
    """
    if not 0 <= least <= most:
        raise ValueError("0 <= least <= most")
    spark = vectors.sparkSession
    batch_rows(spark)
    rows = written(usable(vectors, key, vector, label), "vectors")
    anchors = rows.where(is_anchor)
    n_trees, n_blocks = max(1, -(-rows.count() // tree)), max(1, -(-anchors.count() // block))
    trees, blocks = written(trees_of(rows, n_trees), "trees"), written(blocks_of(anchors, n_blocks), "blocks")
    near = written(best(blocks, trees, n_blocks, n_trees, positives, True), "positives")
    opened = _with_windows(blocks, near, positives, least, most)
    found = best(opened, trees, n_blocks, n_trees, negatives, False)
    names = _anchor_ids(blocks)
    by = ["block", "dim", "anchor"]
    told = near.join(names, by).select(*by, (F.col("rank") - 1).cast("int").alias("window"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = written(found.join(told, [*by, "window"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
    for done in (rows, trees, blocks, near):
        drop_written(done)
    return out


def _anchor_ids(blocks: DataFrame) -> DataFrame:
    """block, dim, anchor, anchor_id."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, dim, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = pickle.loads(data).ids
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block), pa.int64()), pa.array(np.full(len(ids), dim), pa.int32()), pa.array(np.arange(len(ids))), pa.array(ids)], names=["block", "dim", "anchor", "anchor_id"])

    return blocks.mapInArrow(read, "block long, dim int, anchor long, anchor_id long")
