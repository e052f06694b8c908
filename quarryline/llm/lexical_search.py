"""Ranked lexical search over a clustered index.

Recursive graph bisection orders the documents: its upper halvings are fitted on a bounded sample
and send every document to a cluster; clusters are cut into pieces that fit a task, and each piece is
bisected further over its own documents. Runs of the order are shards. A shard holds its own
dictionary and postings with each posting's part of the score, and, for each term, the most that a
document of the shard gets from it. The sum of these is a bound on the scores of a shard.

A search visits shards by that bound, the best first, in waves that grow, and stops for an item
when no shard left has a bound as high as the item's k-th score; a bound equal to it is visited,
as ties go by the documents' own keys, which the shards keep. So results are those of all documents.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bisection import Router, fit_router, ordered
from .common import batch_rows, dealt, drop_written, fanned_out, written

#: Documents of a shard, and bytes of the documents of a piece.
SHARD, PIECE_BYTES = 1024, 8 << 20
#: Documents on which the upper halvings are fitted, about, the bytes that one of them may have, and how many halvings at most.
SAMPLE, SAMPLE_BYTES, DEPTH = 4096, 100_000, 7
#: Shards of the first wave, and how much larger each next one is.
WAVE, GROWTH = 1, 8
#: Items that are searched in one pass over a shard, on average, and shards that a filter may name.
ITEMS, NAMED = 64, 2000
#: A letter or digit of ASCII, or any byte beyond it, is part of a term; only A-Z become lower case.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TERMS).split()


@dataclass(frozen=True)
class LexicalIndex:
    """shards: shard, doc_ids, terms, counts, most (one for each term), starts, docs, impacts. documents, tokens: of all."""

    shards: DataFrame
    documents: int
    tokens: int


def _router(texts: DataFrame, rows: int, shard: int) -> Router:
    depth = min(DEPTH, max(0, math.ceil(math.log2(max(1, rows) / (4 * shard)))))
    if not depth:
        return Router({}, np.zeros((0, 1), np.float32), 0)
    drawn = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / rows) * (1 << 30))
    sample = texts.where((F.octet_length("text") <= SAMPLE_BYTES) & drawn).limit(2 * SAMPLE).collect()
    return fit_router([list(dict.fromkeys(words_of(bytes(r["text"])))) for r in sample], depth)


def _bags(texts: DataFrame, router: Router) -> DataFrame:
    """key, n, terms (different ones, joined by spaces), tfs, cluster of every document with a term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], defaultdict(list)
            for i, text in enumerate(batch.column(1)):
                words = words_of(text.as_py())
                if not words:
                    continue
                bag = Counter(words)
                keys.append(i)
                out["n"].append(len(words))
                out["terms"].append(b" ".join(bag))
                out["tfs"].append(np.fromiter(bag.values(), "<u4", len(bag)).tobytes())
                out["cluster"].append(router.cluster(list(bag)) if router.depth else 0)
            kinds = {"n": pa.int64(), "terms": pa.binary(), "tfs": pa.binary(), "cluster": pa.int32()}
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int32())), *(pa.array(out[c], k) for c, k in kinds.items())], names=["key", *kinds])

    return fanned_out(texts).mapInArrow(count, "key long, n long, terms binary, tfs binary, cluster int")


def shards_of(t: pa.Table, documents: int, tokens: int, shard: int) -> pa.Table:
    """The shards of one piece (rows of _bags), as rows of the index without a number."""
    words = b" ".join(t.column("terms").to_pylist()).split(b" ")
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    terms = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    names = np.array(list(numbers), object)
    tfs = [np.frombuffer(x, "<u4") for x in t.column("tfs").to_pylist()]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in tfs])]).astype(np.int64)
    tf = np.concatenate(tfs).astype(np.int64)
    # Python's integers: 75 * n * documents can pass 64 bits.
    m = np.array([100 - 75 + 75 * n * documents // tokens for n in t.column("n").to_pylist()])
    impacts = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, np.diff(starts)))
    order = ordered(np.arange(t.num_rows), starts, terms, shard)
    keys, rows = t.column("key").combine_chunks(), defaultdict(list)
    for begin in range(0, len(order), shard):
        docs = order[begin : begin + shard]
        n = starts[docs + 1] - starts[docs]
        at = np.repeat(starts[docs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        by_term = np.argsort(terms[at], kind="stable")
        own, first, counts = np.unique(terms[at][by_term], return_index=True, return_counts=True)
        gains = impacts[at][by_term]
        rows["doc_ids"].append(keys.take(pa.array(docs)).to_pylist())
        rows["terms"].append(names[own].tolist())
        rows["counts"].append(counts)
        rows["most"].append(np.maximum.reduceat(gains, first))
        rows["docs"].append(np.repeat(np.arange(len(docs)), n)[by_term].astype("<u4").tobytes())
        rows["impacts"].append(gains.astype("<u4").tobytes())
    kinds = {"doc_ids": pa.list_(pa.int64()), "terms": pa.list_(pa.binary()), "counts": pa.list_(pa.int64()), "most": pa.list_(pa.int64()), "docs": pa.binary(), "impacts": pa.binary()}
    return pa.table({c: pa.array(rows[c], k) for c, k in kinds.items()})


def lexical_index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard: int = SHARD, piece_bytes: int = PIECE_BYTES) -> LexicalIndex:
    """An index of all documents, as a table in the shared folder.

    Documents without a term (null, empty, or punctuation only) aren't part of it. Rows that repeat
    a key are documents of their own; those with a null key count, too. Other columns are dropped.
    """
    batch_rows(docs.sparkSession)
    texts = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("binary").alias("text"))
    bags = written(_bags(texts, _router(texts, texts.count(), shard)), "bags")
    # At most 2^DEPTH rows.
    clusters = bags.groupBy("cluster").agg(F.count("*").alias("d"), F.sum("n").alias("n"), F.sum(F.octet_length("terms") + F.octet_length("tfs")).alias("bytes")).collect()
    documents, tokens = sum(r["d"] for r in clusters), sum(r["n"] for r in clusters)
    pieces = docs.sparkSession.createDataFrame([(r["cluster"], -(-r["bytes"] // piece_bytes)) for r in clusters], "cluster int, pieces long")
    parted = bags.join(F.broadcast(pieces), "cluster").withColumn("piece", F.pmod(F.xxhash64(F.monotonically_increasing_id()), "pieces")).drop("pieces")
    schema = "doc_ids array<long>, terms array<binary>, counts array<long>, most array<long>, docs binary, impacts binary"
    shards = dealt(parted, ["cluster", "piece"], lambda t: shards_of(t, documents, tokens, shard), schema)
    out = written(shards.withColumn("shard", F.monotonically_increasing_id()), "shards")
    drop_written(bags)
    return LexicalIndex(out, documents, tokens)


def _queries(items: DataFrame, key: str, text: str) -> DataFrame:
    """item (a number), item_id, term, repeats: one row for each different term of an item."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [Counter(words_of(x)) for x in batch.column(1).to_pylist()]
            rows = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in (batch.column(0), batch.column(2))), pa.array([w for b in bags for w in b], pa.binary()), pa.array([n for b in bags for n in b.values()], pa.int64())], names=["item_id", "item", "term", "repeats"])

    different = items.select(F.col(f"`{key}`").cast("long").alias("item_id"), F.col(f"`{text}`").cast("binary").alias("text")).distinct()
    return different.withColumn("item", F.monotonically_increasing_id()).mapInArrow(split, "item_id long, item long, term binary, repeats long")


def _score(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, terms, counts, docs, impacts, asked in zip(*(batch.column(c) for c in ("doc_ids", "terms", "counts", "docs", "impacts", "asked")), strict=True):
                at = {t: i for i, t in enumerate(terms.as_py())}
                ends = np.concatenate([[0], np.cumsum(counts.values.to_numpy())])
                docs, impacts = (np.frombuffer(x.as_buffer(), "<u4").astype(np.int64) for x in (docs, impacts))
                names = ids.values
                unnamed = names.is_null().to_numpy(zero_copy_only=False)
                order = np.where(unnamed, 0, names.fill_null(0).to_numpy())
                items, found, scores = [], [], []
                for q in asked.as_py():
                    total = np.zeros(len(names), np.int64)
                    for term, weight in zip(q["terms"], q["weights"], strict=True):
                        i = at.get(term)
                        if i is not None:
                            part = slice(ends[i], ends[i + 1])
                            total[docs[part]] += weight * impacts[part]
                    fits = np.flatnonzero(total >= max(1, q["kth"]))
                    best = fits[np.lexsort((order[fits], unnamed[fits], -total[fits]))[:k]]
                    items += [q["item"]] * len(best)
                    found += best.tolist()
                    scores += total[best].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), names.take(pa.array(found, pa.int64())), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])

    return run


def search(index: LexicalIndex, items: DataFrame, k: int = 10, key: str = "item_id", text: str = "text", wave: int = WAVE, growth: int = GROWTH) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0, ties by ascending key.

    Documents without a key come after others of their score. Items without a term have no rows;
    rows that repeat an item's key and text count once, and those that share the key only are items
    of their own. An empty index or table of items gives no rows.
    """
    spark = items.sparkSession
    batch_rows(spark)
    terms = written(_queries(items, key, text), "terms")
    each = index.shards.select("shard", F.explode(F.arrays_zip("terms", "counts", "most")).alias("t")).select("shard", F.col("t.terms").alias("term"), F.col("t.counts").alias("df"), F.col("t.most").alias("most"))
    known = written(each.join(terms.select("term").distinct(), "term", "left_semi"), "known")
    rare = F.floor(1000 * F.log((F.lit(2.0 * index.documents) + 2) / (2 * F.sum("df") + 1)))
    weighed = written(terms.join(known.groupBy("term").agg(rare.alias("w")), "term").select("item", "item_id", "term", (F.col("repeats") * F.col("w")).alias("weight")), "weighed")
    bounds = known.join(weighed, "term").groupBy("item", "shard").agg(F.sum(F.col("weight") * F.col("most")).alias("bound")).where("bound > 0")
    turn = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "shard"))
    turns = written(bounds.withColumn("turn", turn), "turns")
    blocks = max(1, -(-weighed.select("item").distinct().count() // ITEMS))
    queries = written(weighed.groupBy("item").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights")), "queries")
    best = written(spark.createDataFrame([], "item long, doc_id long, score long"), "best")
    by_rank = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    done = 0
    while True:
        kth = best.groupBy("item").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
        # Turns go by falling bounds, so once none of an item's wave is open, none after it is.
        open_ = turns.where(F.col("turn").between(done + 1, done + wave)).join(kth, "item", "left").withColumn("kth", F.coalesce("kth", F.lit(0))).where("bound >= kth")
        todo = written(open_.select("item", "shard", "kth"), "wave")
        if todo.isEmpty():
            break
        asked = todo.join(queries, "item").groupBy("shard", F.pmod("item", F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("item", "terms", "weights", "kth")).alias("asked"))
        named = [r[0] for r in todo.select("shard").distinct().limit(NAMED + 1).collect()]
        read = index.shards if len(named) > NAMED else index.shards.where(F.col("shard").isin(named))
        found = read.drop("most").join(asked, "shard").mapInArrow(_score(k), "item long, doc_id long, score long")
        new = written(best.unionByName(found).withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k).drop("rank"), "best")
        drop_written(best), drop_written(todo)
        best, done, wave = new, done + wave, wave * growth
    names = weighed.select("item", "item_id").distinct()
    out = written(best.withColumn("rank", F.row_number().over(by_rank)).join(names, "item").select("item_id", "rank", "doc_id", "score"), "ranked")
    for gone in (terms, known, weighed, turns, queries, best):
        drop_written(gone)
    return out


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """search() over an index of docs that is deleted afterwards."""
    index = lexical_index(docs)
    out = search(index, items, k)
    drop_written(index.shards)
    return out
