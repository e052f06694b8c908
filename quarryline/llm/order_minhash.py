"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A sketch draws, by one seeded hash, the `length` smallest of a text's k-mers of words (each
labelled with its occurrence number, so repeats count) and keeps them in text order; equal
sketches thus speak for equal words in equal order, which is what edit similarity measures.
Texts that share one of `sketches` such draws are candidates. A candidate pair is linked if the
edit distance of the two word sequences, aligned within a band, is at most (1 - similarity) of
the longer one. K-mers are so short and draws so many that pairs at that very border meet in a
draw; short texts, of whose k-mers a few edits spare none, have draws of single words besides.

Groups never become pairs. Equal word sequences are one node. In each bucket of equal sketches
all nodes are aligned with the smallest one; what that links is one component. Only buckets that
still hold several components are looked at again, in tasks of two bounded blocks: there, nodes
of different components are aligned unless their word histograms (one edit moves a histogram by 2
at most) prove them apart, and a link ends the comparison of its two components.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, drop_written, fanned_out, join_hot, map_batches, text_or_empty, written
from .components import components

#: Words in a k-mer, least similarity, k-mers in a sketch, sketches, and nodes in a block.
K, SIMILARITY, LENGTH, SKETCHES, BLOCK = 2, 0.8, 3, 48, 256
#: Texts of so many words at most have so many draws of single words besides.
SHORT, SHORT_SKETCHES = 50, 16
#: Bins of the coarse and the fine word histograms.
BINS = 256, 4096
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_codes(text: str) -> np.ndarray:
    """A 32-bit code for each word: what stands between ASCII white space, in lower case."""
    return np.fromiter(map(zlib.crc32, text.lower().encode().split()), np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=8)
def _seeds(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64)


def kmers(codes: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the k-mers in text order and their occurrence numbers; a shorter text is one k-mer."""
    if not len(codes):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    k = min(k, len(codes))
    n = len(codes) - k + 1
    grams = np.full(n, np.uint64(k))
    for i in range(k):
        grams = _mixed(grams * _ODD + codes[i : i + n].astype(np.uint64))
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    at = np.arange(n)
    occurrence = np.empty(n, np.uint64)
    occurrence[order] = (at - np.maximum.accumulate(np.where(fresh, at, 0))).astype(np.uint64)
    return grams, occurrence


def sketch(codes: np.ndarray, k: int = K, length: int = LENGTH, sketches: int = SKETCHES, seed: int = 1) -> np.ndarray:
    """One 64-bit value for each draw; none for a text without words."""
    grams, occurrence = kmers(codes, k)
    n = len(grams)
    if not n:
        return np.empty(0, np.int64)
    seeds = _seeds(sketches, seed)
    base = _mixed(grams + occurrence * _ODD)
    ranks = _mixed(base[None, :] ^ seeds[:, None])
    take = min(length, n)
    drawn = np.sort(np.argpartition(ranks, take - 1, axis=1)[:, :take], axis=1) if take < n else np.tile(np.arange(n), (sketches, 1))
    out = seeds.copy()
    for i in range(take):
        out = _mixed(out * _ODD + grams[drawn[:, i]])
    return out.view(np.int64)


def all_draws(codes: np.ndarray, k: int = K, length: int = LENGTH, sketches: int = SKETCHES, seed: int = 1) -> np.ndarray:
    """The sketch of a text, followed by that of its single words if it is short."""
    own = sketch(codes, k, length, sketches, seed)
    return np.concatenate([own, sketch(codes, 1, length, SHORT_SKETCHES, seed + 1)]) if len(codes) <= SHORT else own


def banded_distance(a: np.ndarray, b: np.ndarray, most: int, near: bool = True) -> int:
    """Edit distance of two sequences, or most + 1 if it is larger.

    Bit-parallel over a band of 2 * most + 1 diagonals that moves down by one with each element
    of the longer sequence: an integer holds the band's vertical differences of one column.
    near: try narrow bands first, which pays for near copies.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    n = len(a)
    same = np.flatnonzero(a != b[:n])
    head = int(same[0]) if len(same) else n
    a, b = a[head:], b[head:]
    n = len(a)
    same = np.flatnonzero(a[::-1] != b[len(b) - n :][::-1]) if n else same
    tail = int(same[0]) if n and len(same) else n
    a, b = a[: n - tail], b[: len(b) - tail]
    if not len(a):
        return len(b)
    if most == 0:
        return 1
    width = min(most, max(len(b) - len(a), 8)) if near else most
    while True:
        got = _band(a.tolist(), b.tolist(), width)
        if got <= width or width == most:
            return min(got, most + 1)
        width = most if width >= 32 else min(most, 32)


def _band(a: list[int], b: list[int], most: int) -> int:
    """Edit distance if at most `most`, else some larger number; len(a) <= len(b) <= len(a) + most."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << (i + most)  # bit most + i: row i, as column 0's band begins at row -most
    size = 2 * most + 1
    mask = (1 << size) - 1
    # Bit i of column j's band is row j - most + i. Above row 0 all is filled up so that the
    # differences there are +1, as in the first column.
    up = mask & ~((1 << most) - 1)
    down, distance = 0, 0
    rows = len(a)
    for j, x in enumerate(b):
        match = (where.get(x, 0) >> j) & mask
        d0 = ((((match & up) + up) ^ up) | match | down) & mask
        right_up = (down | ~(d0 | up)) & mask
        right_down = d0 & up
        # Follow the diagonal to the last row, then that row.
        if j < rows:
            distance += not d0 >> most & 1
        else:
            bit = most - (j - rows) - 1
            distance += (right_up >> bit & 1) - (right_down >> bit & 1)
        slid = d0 >> 1
        up = (right_down | ~(slid | right_up)) & mask
        down = slid & right_up
    return distance


def allowed(n: int, m: int, similarity: float) -> int:
    """The most edits that two sequences of n and m words may differ by."""
    return int((1 - similarity) * max(n, m) + 1e-9)


def linked(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY, near: bool = True) -> bool:
    most = allowed(len(a), len(b), similarity)
    return banded_distance(a, b, most, near) <= most


def histograms(texts: list[np.ndarray], bins: int) -> np.ndarray:
    return np.array([np.bincount(t % bins, minlength=bins) for t in texts], np.int32).reshape(-1, bins)


def settled(task: pa.Table, draws: np.ndarray, turn: int, similarity: float) -> np.ndarray:
    """Links between components within one task, as many as connect them, as pairs of their labels.

    A pair of nodes is compared only in the task of the first draw that they share, and aligned only
    if neither coarse nor fine word histograms prove it apart: one edit moves them by 2 at most.
    """
    ids, home = task.column("node").to_numpy(), task.column("part").to_numpy()
    parts = home.copy()
    texts = [np.frombuffer(c, np.uint32) for c in task.column("codes").to_pylist()]
    lengths = np.array([len(t) for t in texts])
    coarse, fine = histograms(texts, BINS[0]), None
    found = []
    for i in range(len(ids)):
        rest = slice(i + 1, None)
        most = ((1 - similarity) * np.maximum(lengths[i], lengths[rest]) + 1e-9).astype(np.int64)
        possible = (parts[rest] != parts[i]) & (np.abs(lengths[rest] - lengths[i]) <= most)
        possible &= np.argmax(draws[rest] == draws[i], axis=1) == turn
        js = np.flatnonzero(possible)
        if len(js):
            js = js[np.abs(coarse[i + 1 + js] - coarse[i]).sum(1) <= 2 * most[js]]
        if len(js):
            fine = histograms(texts, BINS[1]) if fine is None else fine
            js = js[np.abs(fine[i + 1 + js] - fine[i]).sum(1) <= 2 * most[js]]
        for j in (js + i + 1).tolist():
            if parts[i] != parts[j] and linked(texts[i], texts[j], similarity, near=False):
                found.append((home[i], home[j]))
                parts[parts == parts[j]] = parts[i]
    return np.array(found, np.int64).reshape(-1, 2)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, k: int = K, length: int = LENGTH, sketches: int = SKETCHES, seed: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: key, class_id (the smallest key of its class), kept (true for one row of each class, with that key).

    Classes are the components of links. Texts with equal words in equal order are of one class,
    texts without words too; a null text counts as empty. Rows with a null key are compared with
    nothing: class_id is null and they are kept. Each row counts by its own text, so rows that share
    a key are of one class only if their texts are. Texts of any length are compared whole. An empty
    table gives no rows. Other columns, whatever their names, are dropped.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), text_or_empty(text).alias("text"))
    out = _classed(_prepared(rows.where("id is not null"), k, length, sketches, seed), similarity, seed)
    alone = rows.where("id is null").select("id", F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"))
    return out.select("id", "class_id", "kept").unionByName(alone).withColumnRenamed("id", key)


def text_hash(text: str = "text"):
    """A 256-bit hash of a text; a null text counts as empty."""
    return F.unhex(F.sha2(text_or_empty(text), 256))


def kept_texts(docs: DataFrame, similarity: float = SIMILARITY, k: int = K, length: int = LENGTH, sketches: int = SKETCHES, seed: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and text_hash of the row that stays of each class, as near_duplicates keeps it. Rows with a null key are left out."""
    rows = docs.select(F.col(key).cast("long").alias("id"), text_hash(text).alias("text_hash"), text_or_empty(text).alias("text"))
    out = _classed(_prepared(rows.where("id is not null"), k, length, sketches, seed, keep=("text_hash",)), similarity, seed, keep=("text_hash",))
    return out.where("kept").select(F.col("id").alias(key), "text_hash")


def _prepared(rows: DataFrame, k: int, length: int, sketches: int, seed: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns keep, seq (a hash of the words), codes, drawn and row (a number of its own) of each row of id, keep and text; written."""

    def make():
        def apply(texts):
            out = {"seq": [], "codes": [], "drawn": []}
            for t in texts:
                codes = word_codes(t)
                out["codes"].append(codes.tobytes())
                out["seq"].append(hashlib.blake2b(b" ".join(t.lower().encode().split()), digest_size=16).digest())
                out["drawn"].append(all_draws(codes, k, length, sketches, seed).tolist())
            return out

        return apply

    made = map_batches(fanned_out(rows), make, "text", "seq binary, codes binary, drawn array<long>", ("id", *keep))
    return written(made.withColumn("row", F.monotonically_increasing_id()), "sketches")


def _stars(shared: DataFrame, codes: DataFrame, similarity: float) -> DataFrame:
    """Links a, b of nodes with the smallest node of a bucket that they are in; shared: bucket, node, lead, n (nodes of the bucket).

    A task holds one lead and a block of the nodes that it is compared with.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    pairs = shared.where("node <> lead").groupBy("lead", "node").agg(F.max("n").alias("n"))
    pairs = pairs.select("lead", "node", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    leads = pairs.select("lead", "blocks", "block").distinct().withColumn("node", F.col("lead"))
    rows = pairs.unionByName(leads).join(codes.select("node", "codes"), "node")

    def verify(task: pa.Table) -> pa.Table:
        lead = task.column("lead")[0].as_py()
        texts = {i: np.frombuffer(c, np.uint32) for i, c in zip(task.column("node").to_pylist(), task.column("codes").to_pylist(), strict=True)}
        hit = [i for i, t in texts.items() if i != lead and linked(texts[lead], t, similarity)]
        return pa.table({"a": pa.array(hit, pa.int64()), "b": pa.array([lead] * len(hit), pa.int64())})

    return dealt(rows, ["lead", "blocks", "block"], verify, "a long, b long")


def _between(shared: DataFrame, label: DataFrame, codes: DataFrame, similarity: float, seed: int) -> DataFrame:
    """Links a, b between the components of label, from buckets that hold nodes of several; written."""
    labelled = shared.select("bucket", "node").join(label, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("part"))
    mixed = written(labelled.groupBy("bucket").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("bucket", "n"), "mixed")
    open_rows = written(join_hot(labelled, mixed, "bucket", "n", shared.count()).select("bucket", "node", "part"), "open")
    total = open_rows.count()
    sizes = written(open_rows.groupBy("bucket", "part").agg(F.count("*").alias("n")), "sizes")
    # A component that fills blocks has blocks of its own, which aren't compared with each other.
    large = F.col("n") >= BLOCK
    small = sizes.groupBy("bucket").agg(F.coalesce(F.sum(F.when(~large, F.col("n"))), F.lit(0)).alias("rest"))
    spread = written(sizes.join(small, "bucket").select("bucket", "part", "n", F.when(large, F.col("part")).alias("own"), F.ceil(F.when(large, F.col("n")).otherwise(F.col("rest")) / BLOCK).cast("int").alias("blocks")), "spread")
    block = F.pmod(F.xxhash64(F.lit(seed), "node"), F.col("blocks")).cast("int")
    placed = join_hot(open_rows, spread, ["bucket", "part"], "n", total).select("bucket", "node", "part", F.struct("own", block.alias("block")).alias("unit"))
    units = spread.select("bucket", "own", "blocks").distinct().select("bucket", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).select("bucket", F.struct("own", "block").alias("unit"))
    left, right = units.select("bucket", F.col("unit").alias("i")), units.select("bucket", F.col("unit").alias("j"))
    apart = F.col("i.own").isNull() | F.col("j.own").isNull() | (F.col("i.own") != F.col("j.own"))
    tasks = left.join(right, "bucket").where((F.col("i") <= F.col("j")) & apart).select("bucket", F.xxhash64("i", "j").alias("task"), F.explode(F.array_distinct(F.array("i", "j"))).alias("unit"))
    work = tasks.join(placed, ["bucket", "unit"]).select("bucket", "task", "node", "part").join(codes, "node")

    def settle(task: pa.Table) -> pa.Table:
        bucket = task.column("bucket")[0].as_py()
        rows = task.column("drawn").to_pylist()
        most = max(map(len, rows))
        # The filler comes last, so it is no pair's first shared draw.
        draws = np.array([d + [0] * (most - len(d)) for d in rows], np.int64)
        turn = int(np.argmax((draws == bucket).any(0)))
        return pa.table(dict(zip("ab", settled(task, draws, turn, similarity).T, strict=True)))

    more = written(dealt(work.select("bucket", "task", "node", "part", "codes", "drawn"), ["bucket", "task"], settle, "a long, b long"), "more")
    for done in (mixed, open_rows, sizes, spread):
        drop_written(done)
    return more


def _classed(prepared: DataFrame, similarity: float, seed: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns keep, class_id (the smallest id of the class) and kept of each prepared row."""
    total = prepared.count()
    # A node is the first row of each sequence of words.
    members = written(prepared.groupBy("seq").agg(F.min("row").alias("node"), F.count("*").alias("n")), "members")
    drawn = prepared.select(F.col("row").alias("node"), "drawn").join(members.select("node"), "node", "left_semi")
    drawn = written(drawn.select("node", F.explode(F.array_distinct("drawn")).alias("bucket")), "buckets")
    leads = written(drawn.groupBy("bucket").agg(F.min("node").alias("lead"), F.max("node").alias("last"), F.count("*").alias("n")).where("lead < last").select("bucket", "lead", "n"), "leads")
    shared = written(join_hot(drawn, leads, "bucket", "n", drawn.count()), "shared")
    for done in (drawn, leads):
        drop_written(done)
    involved = shared.select("node").distinct()
    codes = written(prepared.select(F.col("row").alias("node"), "codes", "drawn").join(involved, "node", "left_semi"), "codes")

    star = written(_stars(shared, codes, similarity), "star")
    label = components(star)
    more = _between(shared, label, codes, similarity, seed)
    for done in (star, shared, codes):
        drop_written(done)
    # Components of components; what has no further links keeps its label.
    joined = components(more).select(F.col("node").alias("component"), F.col("component").alias("class"))
    drop_written(more)
    sizes = label.groupBy("component").agg(F.count("*").alias("n")).unionByName(joined.select("component", F.lit(0).cast("long").alias("n"))).groupBy("component").agg(F.sum("n").alias("n"))
    of_part = written(sizes.join(joined, "component", "left").select("component", "n", F.coalesce("class", "component").alias("class")), "parts")
    named = join_hot(label, of_part, "component", "n", label.count()).select("node", "class")
    # Nodes without a label are components of one node, which a later link may have joined.
    single = joined.select(F.col("component").alias("node"), "class").join(named.select("node"), "node", "left_anti")
    of_text = written(members.join(named.unionByName(single), "node", "left").select("seq", "n", F.coalesce("class", "node").alias("class")), "texts")
    rows = written(join_hot(prepared.select("id", "row", "seq", *keep), of_text, "seq", "n", total).select("id", "row", "class", *keep), "classes")
    best = written(rows.groupBy("class").agg(F.min(F.struct("id", "row")).alias("best"), F.count("*").alias("n")), "best")
    for done in (prepared, members, of_part, of_text, label, joined):
        drop_written(done)
    return join_hot(rows, best, "class", "n", total).select("id", *keep, F.col("best.id").alias("class_id"), (F.col("best.row") == F.col("row")).alias("kept"))
