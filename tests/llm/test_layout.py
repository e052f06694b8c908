import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarryline.llm.packing import boundaries, packed, write_batches
from quarryline.llm.queries import op6_packing, op7_sharding
from quarryline.llm.sharding import fisher_yates, numbers, write_shards


def padding(histogram, uppers):
    return sum(c * (min(u for u in uppers if u >= n) - n) for n, c in histogram)


@pytest.mark.parametrize("seed", range(25))
def test_boundaries_are_optimal(seed):
    draw = random.Random(seed)
    histogram = sorted((n, draw.randint(1, 9)) for n in draw.sample(range(40), draw.randint(1, 9)))
    lengths = [n for n, _ in histogram]
    for k in range(1, 6):
        best = min(padding(histogram, [*c, lengths[-1]]) for c in itertools.combinations(lengths[:-1], min(k - 1, len(lengths) - 1)))
        got = boundaries(histogram, k)
        assert len(got) <= k and padding(histogram, got) == best


WORDS = public_tokenizers.path("word_bpe_49k.json")


def least_padding(lengths, buckets):
    """By the plain recurrence over sorted lengths."""
    h = sorted(Counter(lengths).items())
    rows, tokens = [0, *itertools.accumulate(c for _, c in h)], [0, *itertools.accumulate(n * c for n, c in h)]
    best = [0] + [float("inf")] * len(h)
    for _ in range(buckets):
        best = [0, *(min(best[i] + h[j][0] * (rows[j + 1] - rows[i]) - (tokens[j + 1] - tokens[i]) for i in range(j + 1)) for j in range(len(h)))]
    return best[-1]


def check_batches(rows, texts, buckets, budget):
    """rows: packed(); texts: (key, text) of the input."""
    library = Tokenizer.from_file(WORDS)
    ids = [[*library.encode(t or "", add_special_tokens=False).ids, 2] for _, t in texts]
    want = Counter((k, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (k, _), x in zip(texts, ids, strict=True))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    assert sum(r["padded"] - r["n_tokens"] for r in rows) == least_padding(list(map(len, ids)), buckets)
    batches = {}
    for r in rows:
        assert r["padded"] >= r["n_tokens"]
        batches.setdefault(r["batch"], []).append(r)
    assert sorted(batches) == list(range(len(batches)))
    for b in batches.values():
        assert len({(r["bucket"], r["padded"]) for r in b}) == 1 and sorted(r["slot"] for r in b) == list(range(len(b)))
        assert len(b) == 1 or len(b) * b[0]["padded"] <= budget


def test_packed(spark):
    draw = random.Random(3)
    texts = [(i if i % 50 else None, " ".join(draw.choices(["one", "two", "seven.", "é"], k=draw.choice([3, 5, 8, 40, draw.randint(0, 300)])))) for i in range(500)]
    texts += [(1, "word " * 5000), (1, ""), (2, None), (2, None)]
    df = spark.createDataFrame([(*t, 1, "x") for t in texts], "doc_id long, text string, bucket int, ids string").repartition(5)
    check_batches(packed(df, WORDS, 2, buckets=4, budget=1000).collect(), texts, 4, 1000)
    assert packed(df.limit(0), WORDS, 2).count() == 0
    for b in write_batches(df.repartition(1), WORDS, 2, 7, 4, 1000).collect():
        rows = np.frombuffer(b["ids"], "<u2").reshape(len(b["keys"]), b["padded"])
        assert all((r[n:] == 7).all() and r[n - 1] == 2 for r, n in zip(rows, b["lengths"], strict=True))


def test_full_batches(spark):
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text")).coalesce(1)
    rows = packed(df, WORDS, 2, budget=40).collect()
    assert Counter(Counter(r["batch"] for r in rows).values()) == {10: 100}


def test_packing_query(spark, sf):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check_batches(op6_packing(spark, sf).collect(), texts, 16, 65_536)


@pytest.mark.parametrize("n,shards", [(0, 4), (1, 4), (103, 10), (103, 1)])
def test_shards(spark, n, shards):
    rows = [(i if i % 10 else None, None if i % 7 == 0 else f"t{i}" * (i % 5 * 40), 0) for i in range(n)] + ([(5, "t5", 0)] * 3 if n else [])
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    out = write_shards(df, shards, bucket_bytes=2000).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((a, b) for a, b, _ in rows)
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    again = write_shards(df, shards, bucket_bytes=2000).collect()
    place = lambda x: sorted((r["shard"], r["slot"], str(r["doc_id"]), str(r["text"])) for r in x)
    assert place(out) == place(again)


def test_shuffle_is_native(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    out = write_shards(df, 40)
    ids = [r["doc_id"] for r in out.orderBy("shard", "slot").collect()]
    assert ids != sorted(ids) and sorted(ids) == sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_fisher_yates(spark):
    def plain(n, hashes):
        a = list(range(n))
        for i in range(n - 1, 0, -1):
            j = hashes[i] % (i + 1)
            a[i], a[j] = a[j], a[i]
        return a

    h = F.transform(F.sequence(F.lit(0), "n"), lambda i: F.xxhash64(F.lit(5), "n", i))
    df = spark.createDataFrame([(n,) for n in (1, 2, 3, 50, 300)], "n int").withColumn("p", numbers(fisher_yates(F.col("n"), F.lit(5), F.col("n")), F.col("n"))).withColumn("h", h)
    for r in df.collect():
        assert r["p"] == plain(r["n"], r["h"])


def test_shards_of_equal_rows_and_clashing_names(spark):
    many = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(1).alias("bucket"), F.lit(2).alias("_order"), F.lit(3).alias("a.b"))
    long = spark.createDataFrame([(1, "é" * 3_000_000, 1, 2, 3)], many.schema)
    out = write_shards(many.unionByName(long), 7)
    assert out.columns == [*many.columns, "slot", "shard"]
    assert out.where("bucket = 1 and _order = 2 and `a.b` = 3").count() == 20_001 and out.where("length(text) = 3000000").count() == 1
    by = out.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert {r["n"] for r in by} <= {2857, 2858} and all(r["d"] == r["n"] == r["m"] + 1 for r in by) and len(by) == 7


def test_sharding_query(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op7_sharding(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    slots = {}
    for r in got:
        text = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 16, zlib.crc32(text), "rows", None)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(slots) == list(range(40)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
