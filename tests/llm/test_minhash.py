import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import order_minhash as om


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    draw = random.Random(1)
    for _ in range(800):
        a = [draw.randint(0, draw.choice([2, 5, 50])) for _ in range(draw.randint(0, 30))]
        b = list(a)
        for _ in range(draw.randint(0, 8)):
            i = draw.randint(0, max(0, len(b) - 1))
            kind = draw.randint(0, 2)
            if kind == 0:
                b.insert(i, draw.randint(0, 5))
            elif b and kind == 1:
                b.pop(i)
            elif b:
                b[i] = draw.randint(0, 5)
        most = draw.randint(0, 12)
        assert om.banded_distance(np.array(a, np.uint32), np.array(b, np.uint32), most) == min(distance(a, b), most + 1)


def test_occurrences_count():
    grams, occurrence = om.kmers(om.word_codes("a b c d e a b c d e a b c d e"))
    assert len(set(grams.tolist())) == 5 and sorted(occurrence.tolist()).count(2) == 1


def test_order_counts():
    words = [f"w{i}" for i in range(40)]
    one = om.sketch(om.word_codes(" ".join(words)))
    other = om.sketch(om.word_codes(" ".join(words[20:] + words[:20])))
    assert (one == om.sketch(om.word_codes(" ".join(words)))).all() and (one == other).mean() < 0.7


def brute(rows):
    """Class by id: components of exact words, and of edit similarity >= 0.8 of any two texts."""
    words = {i: (t or "").lower().encode().split() for i, t in rows if i is not None}
    root = {i: i for i in words}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(words)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = words[i], words[j]
            most = om.allowed(len(a), len(b), 0.8)
            if find(i) != find(j) and abs(len(a) - len(b)) <= most and distance(a, b) <= most:
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i in ids}


def corpus(groups=6, copies=12, seed=2):
    draw = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    out = []
    for g in range(groups):
        base = [f"g{g}w{draw.randint(0, 200)}" for _ in range(60)] + passage
        for _ in range(copies):
            t = list(base)
            for _ in range(draw.randint(0, 3)):
                t[draw.randrange(len(t))] = f"x{draw.randint(0, 10**6)}"
            out.append(" ".join(t))
    out += [out[0], out[0].upper(), "", None, "  ", "short text", "Short  text"]
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("block", [128, 4])
def test_classes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(om, "BLOCK", block)
    rows = corpus()
    df = spark.createDataFrame([*rows, (None, "short text")], "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("codes", F.lit(1))
    got = om.near_duplicates(df).collect()
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == brute(rows)
    assert all(r["kept"] == (r["class_id"] is None or r["class_id"] == r["doc_id"]) for r in got)


def edited(draw, words, rate):
    """words with so many of them replaced, at random places."""
    out = list(words)
    for i in draw.sample(range(len(out)), int(rate * len(out) + 1e-9)):
        out[i] = f"x{draw.randint(0, 10**9)}"
    return out


@pytest.mark.parametrize("rate, least", [(0.08, 1.0), (0.1, 1.0), (0.15, 1.0), (0.2, 0.95)])
def test_recall_at_the_link_rule(rate, least):
    draw = random.Random(5)
    for n in (5, 10, 20, 50, 60, 200, 1000):
        met = 0
        for _ in range(100):
            a = [f"w{draw.randint(0, 10**9)}" for _ in range(n)]
            one, other = (om.all_draws(om.word_codes(" ".join(t))) for t in (a, edited(draw, a, rate)))
            met += bool((one == other).any())
        assert met >= least * 100, n


def test_edited_texts_are_linked(spark):
    draw = random.Random(6)
    rows, want = [], {}
    for g in range(200):
        n = draw.choice([9, 20, 45, 55, 120, 300])
        a = [f"w{draw.randint(0, 10**9)}" for _ in range(n)]
        rows += [(2 * g, " ".join(a)), (2 * g + 1, " ".join(edited(draw, a, draw.uniform(0.08, 0.15))))]
        want |= {2 * g: 2 * g, 2 * g + 1: 2 * g}
    got = om.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want


def test_copies_down_to_the_border(spark):
    # Similarities from 0.8 to 1 by all kinds of edits, for texts of 8 to 1000 words.
    draw = random.Random(8)
    rows, pairs = [], []
    for g in range(300):
        n = draw.choice([8, 12, 25, 50, 51, 80, 200, 1000])
        a = [f"w{draw.randint(0, 10**9)}" for _ in range(n)]
        b = list(a)
        for _ in range(draw.randint(0, om.allowed(n, n, 0.8))):
            at, kind = draw.randrange(len(b)), draw.randrange(3)
            b[at : at + (kind != 0)] = [f"y{draw.randint(0, 10**9)}"] * (kind != 1)
        if distance(a, b) <= om.allowed(len(a), len(b), 0.8):
            rows += [(2 * g, " ".join(a)), (2 * g + 1, " ".join(b))]
            pairs.append(2 * g)
    got = {r["doc_id"]: r["class_id"] for r in om.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i + 1] == i for i in pairs) >= 0.97 * len(pairs) and all(got[i] == i for i in pairs)


def test_long_text_of_one_word(spark):
    rows = [(1, "a " * 200_000), (2, "a " * 199_000), (3, "a " * 90_000), (4, "x" * 2_000_000)]
    got = {r["doc_id"]: r["class_id"] for r in om.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_short_texts_beside_longer_ones(spark):
    # Short ones have more draws; all three share the block tasks of one passage.
    draw = random.Random(7)
    base = [f"w{i}" for i in range(52)]
    rows = [(i, " ".join(edited(draw, base[: draw.choice([44, 48, 50, 51, 52])], 0.12))) for i in range(40)]
    got = om.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute(rows)


def test_task_finds_the_links_that_connect():
    import pyarrow as pa

    rows = [(i, t) for i, t in corpus(2, 8) if t and len(t) > 50]
    codes = [om.word_codes(t) for _, t in rows]
    draws = np.zeros((len(rows), 3), np.int64)  # all share every draw: the first one's task has the pairs
    task = pa.table({"node": [i for i, _ in rows], "part": [i for i, _ in rows], "codes": [c.tobytes() for c in codes]})
    assert len(om.settled(task, draws, 1, 0.8)) == 0
    links = om.settled(task, draws, 0, 0.8)
    want = brute(rows)
    assert len(links) == len(rows) - len(set(want.values())) and all(want[a] == want[b] for a, b in links)
    grouped = task.set_column(1, "part", pa.array([want[i] for i, _ in rows]))
    assert len(om.settled(grouped, draws, 0, 0.8)) == 0


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "q r s t u v")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["class_id"], r["kept"]) for r in om.near_duplicates(df).collect())
    assert got == [(1, 1, False), (1, 1, True), (2, 1, False), (2, 2, True)]
    assert om.near_duplicates(df.limit(0)).count() == 0


def test_pipeline_keeps_other_texts_of_a_doc_id(spark):
    import corpus_pipeline

    words = [[f"t{t}w{i}" for i in range(30)] for t in range(4)]
    one, two, three, four = (" ".join(w) for w in words)
    near = " ".join([*words[1][:29], "other"])
    rows = [(1, one, "a"), (2, one, "a"), (2, two, "a"), (3, two, "a"), (3, near, "a"), (3, three, "b"), (3, three, "a"), (4, near, "a"), (5, four, "a"), (None, one, "a"), (None, one, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [tuple(r) for r in corpus_pipeline.near_duplicate(spark, docs, "").collect()]
    want = [(1, one, "a"), (2, two, "a"), (3, three, "a"), (5, four, "a"), (None, one, "a"), (None, one, "a")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r["class_id"] for r in om.near_duplicates(df).collect()}
    codes = {r["doc_id"]: om.word_codes(r["text"]) for r in df.collect()}
    root = {i: i for i in codes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(codes)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if abs(len(codes[i]) - len(codes[j])) <= om.allowed(len(codes[i]), len(codes[j]), 0.8) and find(i) != find(j) and om.linked(codes[i], codes[j]):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    assert got == {i: find(i) for i in ids}
