import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from oracle import same

from quarryline.llm import bisection, queries
from quarryline.llm import lexical_search as ls

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERMS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """docs: (key, text); items: (item, text)."""
    bags = [(key, Counter(terms(t))) for key, t in docs if terms(t)]
    total, df = sum(sum(b.values()) for _, b in bags), Counter(t for _, b in bags for t in b)
    out = Counter()
    for item, text in set(items):
        scored = []
        for key, b in bags:
            m = 25 + 75 * sum(b.values()) * len(bags) // total
            s = sum(math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t in terms(text) if b[t])
            if s > 0:
                scored.append((-s, key is None, key or 0, key))
        out.update((item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1))
    return out


def test_words():
    text = "Ab-c1 É_é\x00\x7fx  y z [A]{b}~!"
    assert [w.decode() for w in ls.words_of(text.encode())] == terms(text) and ls.words_of(None) == []


def make(draw, n):
    topics = [[f"w{t}x{i}" for i in range(30)] for t in range(8)]
    return " ".join(draw.choices(draw.choice(topics), k=n) + draw.choices(["the", "of", "É", "Und"], k=n // 2))


def spread(spark, docs):
    return spark.createDataFrame([(k, t, 1, "x") for k, t in docs], "doc_id long, text string, shard int, terms string").withColumnRenamed("terms", "a.b").repartition(5)


@pytest.mark.parametrize("shard,piece_bytes", [(1024, 8 << 20), (8, 4000)])
def test_equals_brute_force(spark, shard, piece_bytes):
    draw = random.Random(shard)
    docs = [(i, make(draw, draw.choice([1, 5, 40, 200]))) for i in range(400)]
    docs += [(1000 + i, "same words here") for i in range(25)] + [(7, "same words here"), (None, "same words here"), (None, "w1x1"), (2000, None), (2001, ""), (2002, " ,.-"), (2003, "w2x2 " * 50_000)]
    items = [(i, make(draw, 12)) for i in range(40)] + [(50, "same here"), (51, None), (52, "unheard"), (53, ""), (54, "w1x1 w1x1 the"), (54, "w1x1 w1x1 the"), (54, "w3x3"), (55, "W2X2")]
    asked = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    index = ls.lexical_index(spread(spark, docs), shard=shard, piece_bytes=piece_bytes)
    got = ls.search(index, asked)
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect()) == brute(docs, items)
    assert index.documents == sum(bool(terms(t)) for _, t in docs)
    if shard == 8:  # pieces were bisected, and waves end before all shards were seen
        assert index.shards.count() > 40
        visited = []
        was, ls.written = ls.written, lambda df, tag: (lambda out: (visited.append(out.count()) if tag == "wave" else None, out)[1])(was(df, tag))
        try:
            ls.search(index, asked.where("item_id < 40"), k=1)
        finally:
            ls.written = was
        assert visited[-1] == 0 and sum(visited) < 0.8 * 40 * index.shards.count()


def test_ties_go_by_key(spark):
    docs = [(i, "alpha beta") for i in range(50, 0, -1)]
    got = ls.search(ls.lexical_index(spread(spark, docs + [(99, "gamma")]), shard=4), spark.createDataFrame([(1, "alpha")], "item_id long, text string"))
    assert [r["doc_id"] for r in got.orderBy("rank").collect()] == list(range(1, 11))


def test_empty_tables(spark):
    docs, items = spread(spark, [(1, "a"), (2, None)]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ls.ranked(docs, items.limit(0)).count() == 0 and ls.ranked(docs.limit(0), items).count() == 0
    assert ls.ranked(docs.where("doc_id = 2"), items).count() == 0
    assert ls.ranked(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_bisection_brings_like_documents_together():
    draw = random.Random(3)
    topic = [draw.randrange(8) for _ in range(512)]
    bags = [sorted({t * 50 + draw.randrange(50) for _ in range(25)} | {400 + draw.randrange(20) for _ in range(5)}) for t in topic]
    starts = np.cumsum([0, *map(len, bags)])
    order = bisection.ordered(np.arange(512), starts, np.array([x for b in bags for x in b]), 16)
    assert sorted(order.tolist()) == list(range(512))
    runs = [Counter(topic[d] for d in order[i : i + 64]).most_common(1)[0][1] for i in range(0, 512, 64)]
    assert sum(runs) > 0.8 * 512
    router = bisection.fit_router([[b"%d" % x for x in b] for b in bags[:256]], 3)
    sent = [router.cluster([b"%d" % x for x in b]) for b in bags]
    by = {t: Counter(c for c, x in zip(sent[256:], topic[256:], strict=True) if x == t) for t in range(8)}
    assert sum(c.most_common(1)[0][1] for c in by.values()) > 0.75 * 256 and max(sent) < 8
    assert router.cluster([]) < 8 and router.cluster([b"new"]) < 8


def test_query(spark, sf):
    same(spark, sf, queries.op13_cluster_search, queries.oracle_sql()["op13_cluster_search"])
