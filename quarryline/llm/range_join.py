"""Exact range join of vectors by cosine, inside groups of equal labels.

Unit vectors at cosine c are at distance r = sqrt(2 - 2c). Pivots cut each group into cells: a
vector is native to the pivot nearest to it. By the triangle inequality a vector with a partner
in pivot q's cell is no farther than r from that cell, so no farther than r from the plane
between its own pivot p and q; its distance to that plane is (|x-q|^2 - |x-p|^2) / (2 |p-q|).
It is replicated into just the cells for which this is at most r. Cells then join on their own:
natives with all that the cell holds. A cell with more vectors than a block holds is dealt out as
pairs of blocks, so no task gets more than two blocks.

Every group with two different vectors gets pivots, at most the square root of its size; how many
is decided by what a sample of the group says that copies and comparisons will cost. All sizes of
tasks follow from the square root of the group, and nothing but sums reaches the driver. Equal
vectors become one with a count first.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, dealt, drop_written, join_hot, written
from .components import components

#: Vectors that one side of a join task holds: 2048 vectors of 64 doubles are 1 MB.
BLOCK = 2048
#: Vectors that are compared with pivots in one task, at least, and entries of a table of vectors and pivots (32 MB).
CHUNK, CELLS = 1024, 1 << 22
#: Comparisons of two vectors that cost as much as to move one to another task.
MOVE = 1000
#: Slack on bounds, for rounding; links themselves are decided without it.
SLACK = 1e-9


def usable(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """id, label, digest, dim, x (doubles, little-endian), norm of all rows; digest is null for rows that can have no links.

    Vectors are scaled by a power of two, which is exact, so that no norm overflows or vanishes.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    batch_rows(vectors.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"digest": [], "dim": [], "x": [], "norm": []}
            known = zip(batch.column(0).is_valid().to_pylist(), batch.column(1).is_valid().to_pylist(), strict=True)
            for (has_id, has_label), v in zip(known, batch.column(2), strict=True):
                x = np.empty(0)
                if has_id and has_label and v.is_valid and v.values.null_count == 0:
                    x = v.values.to_numpy()
                most = np.abs(x).max(initial=0.0)
                if not 0 < most < math.inf:  # false for nan
                    x, raw = np.empty(0), None
                else:
                    x = np.ldexp(x, -math.frexp(most)[1]) + 0.0  # -0.0 becomes 0.0
                    raw = x.astype("<f8").tobytes()
                out["digest"].append(raw and hashlib.blake2b(raw, digest_size=16).digest())
                out["x"].append(raw)
                out["dim"].append(len(x))
                out["norm"].append(math.sqrt(x @ x))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out["digest"], pa.binary()), pa.array(out["dim"], pa.int32()), pa.array(out["x"], pa.binary()), pa.array(out["norm"])], names=["id", "label", *out])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(read, f"id long, label {kind}, digest binary, dim int, x binary, norm double")


def _units(task: pa.Table) -> np.ndarray:
    """The vectors of a task's rows, scaled to length 1."""
    x = np.frombuffer(b"".join(task.column("x").to_pylist()), "<f8").reshape(task.num_rows, -1)
    return x / task.column("norm").to_numpy()[:, None]


def cells_of(units: np.ndarray, pivots: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of the vectors in turn: the nearest pivot of each, and a table of the cells that each must be in.

    A slice is so large that its table has CELLS entries, whatever the number of pivots.
    """
    for at in range(0, len(units), max(1, CELLS // len(pivots))):
        part = units[at : at + max(1, CELLS // len(pivots))]
        dots = part @ pivots.T
        own = dots.argmax(1)
        # The distance to the plane between two pivots times the distance of the pivots is half the difference of the dot products' doubles.
        inside = dots[np.arange(len(part)), own][:, None] - dots
        gap = pivots[own] @ pivots.T
        np.subtract(2, 2 * gap, out=gap)
        np.sqrt(np.maximum(gap, 1e-18, out=gap), out=gap)
        inside = inside <= radius * gap
        inside[np.arange(len(part)), own] = True
        yield own, inside


def pivots_of(sample: np.ndarray, n: int, radius: float) -> np.ndarray:
    """Pivots for a group of n vectors, chosen from a sample: each next one is the farthest from those before.

    Tried are 2, 4, 8, ... of them, up to the square root of n; taken are those with which the
    sample's copies and comparisons would cost least. A vector of a cell that fills several blocks is
    copied to as many tasks.
    """
    most = max(2, math.isqrt(n))
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < most:
        at = int(near.argmin())
        if near[at] > 1 - 1e-6:  # all that is left lies on a pivot
            break
        chosen.append(at)
        near = np.maximum(near, sample @ sample[at])
    best, cost = sample[chosen[:1]], math.inf
    count = 2
    while count < 2 * len(chosen):
        pivots = sample[chosen[:count]]
        natives, members = np.zeros(len(pivots)), np.zeros(len(pivots))
        for own, inside in cells_of(sample, pivots, radius):
            natives += np.bincount(own, minlength=len(pivots))
            members += inside.sum(0)
        natives, members = natives * n / len(sample), members * n / len(sample)
        total = float(natives @ members) + MOVE * float(members @ np.maximum(1, members / BLOCK))
        if total < cost:
            best, cost = pivots, total
        count *= 2
    return best


def _placed(nodes: DataFrame, radius: float, seed: int) -> DataFrame:
    """Every node once for each cell that it must be in: group, cell, native, g, node, w, x, norm."""
    root = F.ceil(F.sqrt("n"))
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("n"), F.min("g").alias("first"))
    sizes = written(sizes.select("*", F.monotonically_increasing_id().alias("group"), F.ceil(F.col("n") / F.greatest(F.lit(CHUNK), 4 * root)).cast("int").alias("chunks")), "groups")
    rows = written(join_hot(nodes, sizes, ["label", "dim"], "n", nodes.count()).drop("label", "dim"), "grouped")
    # About 4 * sqrt(n) vectors of each group, drawn by a hash.
    drawn = F.pmod(F.xxhash64(F.lit(seed), "g"), F.lit(1 << 30)) < 4 * root / F.col("n") * (1 << 30)

    def choose(task: pa.Table) -> pa.Table:
        pivots = pivots_of(_units(task), task.column("n")[0].as_py(), radius)
        return pa.table({"group": task.column("group").slice(0, 1), "pivots": pa.array([pivots.tobytes()], pa.binary())})

    pivots = written(dealt(rows.where(drawn | (F.col("g") == F.col("first"))).select("group", "n", "x", "norm"), ["group"], choose, "group long, pivots binary"), "pivots")
    kept = ["group", "g", "node", "w", "x", "norm"]
    of_chunk = sizes.select("group", "chunks").join(pivots, "group").select("group", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "pivots")
    chunked = rows.select(*kept, F.pmod(F.xxhash64(F.lit(seed + 2), "g"), F.col("chunks")).cast("int").alias("chunk"))

    def place(task: pa.Table) -> pa.Table:
        has = task.column("pivots").is_valid().to_numpy()
        chosen = np.frombuffer(task.column("pivots")[int(has.argmax())].as_py())
        task = task.filter(pa.array(~has)).select(kept)
        if not task.num_rows:
            return task.append_column("cell", pa.array([], pa.int32())).append_column("native", pa.array([], pa.bool_()))
        units = _units(task)
        out, first = [], 0
        for own, inside in cells_of(units, chosen.reshape(-1, units.shape[1]), radius):
            row, cell = np.nonzero(inside)
            out.append(task.take(pa.array(row + first)).append_column("cell", pa.array(cell.astype(np.int32))).append_column("native", pa.array(own[row] == cell)))
            first += len(own)
        return pa.concat_tables(out)

    both = chunked.unionByName(of_chunk, allowMissingColumns=True)
    placed = written(dealt(both, ["group", "chunk"], place, "group long, g long, node long, w long, x binary, norm double, cell int, native boolean"), "cells")
    for done in (rows, pivots, sizes):
        drop_written(done)
    return placed


def near_links(nodes: DataFrame, cosine: float, seed: int = 7, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Counts of links of every linked node, and links that connect the same nodes as all links do.

    nodes: label, dim, g (its number), node (its name), w (the vectors that are equal to it), x, norm.
    Returns (g, n_links), where a partner counts w, and (a, b) of names. Links within a task are
    reduced to a spanning forest before they are returned, as the number of links of a group of
    near copies is the square of its size.
    """
    radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK
    placed = _placed(nodes, radius, seed)
    cell = ["group", "cell"]
    sizes = written(placed.groupBy(*cell).agg(F.count("*").alias("n")), "sizes")
    split = join_hot(placed, sizes, cell, "n", placed.count()).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    split = split.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "g"), F.col("blocks")).cast("int"))
    # A pair of blocks (i, j), i <= j, is one task; a vector of block k goes to the pairs that hold k.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tasks = split.withColumn("o", other).select(*cell, F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "g", "node", "w", "x", "norm", "native")

    def join(task: pa.Table) -> pa.Table:
        g, names, w = (task.column(c).to_numpy() for c in ("g", "node", "w"))
        native, norm, blocks = task.column("native").to_numpy(), task.column("norm").to_numpy(), task.column("block").to_numpy()
        x = np.frombuffer(b"".join(task.column("x").to_pylist()), "<f8").reshape(len(g), -1)
        first = task.column("i")[0].as_py()
        left = np.flatnonzero(blocks == first)
        counts = np.zeros(len(g), np.int64)
        tree = np.arange(len(g))
        links: list[tuple[int, int]] = []

        def meet(a: np.ndarray, b: np.ndarray, back: bool) -> None:
            """Count a's partners in b (and, if back, b's in a) and join their trees."""
            for a in np.array_split(a, max(1, -(-len(a) // 256))):
                hit = (x[a] @ x[b].T) / (norm[a][:, None] * norm[b][None, :]) >= cosine
                hit &= g[a][:, None] != g[b][None, :]
                counts[a] += hit @ w[b]
                if back:
                    counts[b] += np.where(native[b], w[a] @ hit, 0)
                for r in np.flatnonzero(hit.any(1)):
                    i, partners = int(a[r]), b[hit[r]]
                    for t in np.unique(tree[partners]):
                        if t != tree[i]:
                            links.append((i, int(partners[tree[partners] == t][0])))
                            tree[tree == t] = tree[i]

        # Natives count all partners in their cell, replicas none: their own cells do that.
        if task.column("j")[0].as_py() == first:
            meet(left[native[left]], left, back=False)
        else:
            right = np.flatnonzero(blocks != first)
            meet(left[native[left]], right, back=True)
            meet(right[native[right]], left[~native[left]], back=False)
        told = np.flatnonzero(counts)
        ends = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": np.concatenate([g[told], names[ends[:, 0]]]), "b": np.concatenate([g[told], names[ends[:, 1]]]), "n": np.concatenate([counts[told], np.zeros(len(ends), np.int64)])})

    found = written(dealt(tasks, [*cell, "i", "j"], join, "a long, b long, n long"), "found")
    drop_written(placed)
    drop_written(sizes)
    return found.where("n > 0").groupBy(F.col("a").alias("g")).agg(F.sum("n").alias("n_links")), found.where("n = 0").select("a", "b")


def near_vectors(vectors: DataFrame, cosine: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label", block: int = BLOCK) -> DataFrame:
    """One row per row of vectors: key, n_links long, component_id long, kept boolean (its key is its component's smallest).

    Only rows with equal labels and vectors of equal length are compared. Rows with null keys, labels,
    vectors or components, non-finite components or length zero have no links: 0 and their own key; a
    null key is kept. A row that repeats another in key, label and vector counts once and gets the
    same result; a key with several different vectors has a row for each, which count as vectors of
    their own and are of one component. An empty table gives no rows. Other columns are dropped.
    """
    on = ["label", "digest"]
    rows = written(usable(vectors, key, vector, label).withColumn("row", F.monotonically_increasing_id()), "vectors")
    sound = rows.where("digest is not null")
    each = sound.groupBy("id", *on).agg(F.min("row").alias("row"), F.count("*").alias("rows"))
    same = written(each.groupBy(*on).agg(F.min("row").alias("g"), F.min("id").alias("node"), F.count("*").alias("w"), F.sum("rows").alias("rows")), "distinct")
    nodes = written(same.select("g", "node", "w").join(sound.select(F.col("row").alias("g"), "label", "dim", "x", "norm"), "g"), "nodes")
    counts, links = near_links(nodes, cosine, block=block)
    # Keys with several vectors connect them.
    several = each.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    held = each.select("id", *on).join(several, "id").join(same.select(*on, "node"), on).select("id", F.col("node").alias("a"))
    chained = held.join(held.groupBy("id").agg(F.min("a").alias("b")), "id").select("a", "b")
    parts = components(links.unionByName(chained)).withColumnRenamed("component", "part")
    known = written(same.join(counts, "g", "left").join(parts, "node", "left").select(*on, "rows", (F.coalesce("n_links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("part", "node").alias("part")), "known")
    for done in (nodes, same, counts, parts):
        drop_written(done)
    component = F.coalesce("part", "id")
    out = join_hot(rows.select("id", *on), known, on, "rows", rows.count(), "left")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
