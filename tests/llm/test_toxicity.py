import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quarryline.llm import toxicity as tox
from quarryline.llm.queries import op9_toxicity


def corpus(n=600):
    draw = random.Random(5)
    plain = [f"{a}{b}" for a in ("mel", "tor", "sun", "kal", "pim") for b in ("a", "en", "ig", "or", "usta", "ery")]
    bad = ["vilexa", "vilexon", "grubbit", "snarfle"]
    docs, labels = [], []
    for i in range(n):
        words = draw.choices(plain, k=draw.randint(5, 60)) + [f"u{draw.choice('bcdfg')}{draw.choice(plain)}{draw.choice(plain)}"]
        y = i % 6 == 0
        if y:
            words += draw.choices(bad, k=draw.randint(1, 3))
        draw.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(y)))
    return docs, labels


def test_learns_and_generalises(spark):
    docs, labels = corpus()
    d = spark.createDataFrame([*docs, (9001, ""), (9002, None), (None, "vilexa")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    l = spark.createDataFrame([*labels, (None, 1), (3, None), (0, 1)], "doc_id long, toxic int")  # noqa: E741
    model = tox.fit(d, l)
    got = {r["doc_id"]: r["score"] for r in tox.with_scores(d, model).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, y in held]) > 0.97
    assert got[9001] == got[9002] < 0.5


def test_names_may_clash_and_rows_repeat(spark):
    docs, labels = corpus(200)
    text = "vilexa " * 50_000
    d = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in [*docs, *docs[:50], (7, "other text of 7"), (None, None), (3, text)]], "doc_id long, text string, _text int, text_ string, `a.b` int")
    l = spark.createDataFrame([(*r, "z") for r in [*labels, *labels]], "doc_id long, toxic int, text string")  # noqa: E741
    out = tox.with_scores(d, tox.fit(d, l))
    assert out.columns == [*d.columns, "score"] and out.where("_text = 1 and text_ = 'x' and `a.b` = 2").count() == 253
    assert out.where(F.length("text") > 100_000).first()["score"] > 0.5


def test_sample_is_bounded(spark):
    # One key with very many texts doesn't bring them all.
    rows = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    keys = spark.createDataFrame([(1, 1)], "id long, y int")
    got = tox._sampled(rows, keys, "doc_id", "text", 20, 3)
    assert got.count() == 20 and got.columns == ["text", "y", "id"]


def test_lowest_hashes_need_no_shuffle_of_all_keys(spark):
    asked = []

    def keys(fits):
        asked.append(ids.where(fits))
        return asked[-1]

    for n in (0, 50, 30_000):
        ids = spark.range(n)
        code = F.xxhash64(F.lit(3), "id")
        want = [r[0] for r in ids.orderBy(code, "id").limit(100).collect()]
        asked.clear()
        assert [r[0] for r in tox._lowest(keys, n, 100, 3).collect()] == want
        assert len(asked) == 1 and (n < 1000 or asked[0].count() < 600)
    # Where most of the keys aren't there, the bound is raised until enough are.
    ids = spark.range(30_000).where("id % 100 = 0")
    asked.clear()
    assert [r[0] for r in tox._lowest(keys, 30_000, 100, 3).collect()] == [r[0] for r in ids.orderBy(code, "id").limit(100).collect()] and len(asked) > 1


def test_label_model_nears_the_true_posterior():
    # Independent voters for class 1 and one that copies another; few labels, many unlabelled rows.
    rng = np.random.default_rng(1)
    n = 60_000
    y = rng.random(n) < 0.15
    fires = [(0.12, 0.002), (0.1, 0.001), (0.1, 0.05), (0.08, 0.0005)]
    votes = np.stack([np.where(y, rng.random(n) < a, rng.random(n) < b) for a, b in fires], 1)
    votes = np.concatenate([votes, votes[:, 2:3]], 1).astype(np.float32)
    few = slice(0, 3000)
    right, wrong = (votes[few] * y[few, None]).sum(0), (votes[few] * ~y[few, None]).sum(0)
    p = tox.label_model(votes, right, wrong, int(y[few].sum()), int((~y[few]).sum()))
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    sure = 0
    for k in range(len(patterns)):
        true = y[which == k].mean()  # by brute force over all rows with these votes
        if counts[k] > 50 and abs(true - 0.5) > 0.2:
            assert (p[which == k][0] > 0.5) == (true > 0.5), (patterns[k], true, p[which == k][0])
            sure += 1
    assert sure >= 5


def test_train_linear_finds_the_group_means():
    rows = [np.array([0])] * 30 + [np.array([], np.int64)] * 70
    target = np.array([0.9] * 30 + [0.2] * 70)
    w, bias = tox.train_linear(rows, 1, target)
    assert abs(1 / (1 + np.exp(-bias)) - 0.2) < 0.01 and abs(1 / (1 + np.exp(-bias - w[0])) - 0.9) < 0.01


def test_voters_are_apart():
    assert tox.apart(["vile*", "vilexa", "grub", "vil", "snar*", "grubbit"], 2) == ["vile*", "grub"]


def test_one_class_or_none(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    for rows in ([], [(1, 0), (2, 0)], [(1, 1)]):
        model = tox.fit(d, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert [r["score"] < 0.5 for r in tox.with_scores(d, model).collect()] == [True, True]
    assert tox.with_scores(d.limit(0), model).count() == 0


def test_held_out_rows_teach_nothing(spark):
    docs, labels = corpus(200)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (tox.fit(d, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flip))
    assert a == b


def plain_score(model, text):
    """From the weights alone: every word and each of its beginnings of 4 to 7 letters, once a text."""
    words = {w for w in re.findall(r"[^\W\d_]+", text.lower())}
    found = words | {w[:n] + "*" for w in words for n in (4, 5, 6, 7) if len(w) > n}
    shouted = [w for w in re.findall(r"[^\W\d_]+", text) if w.isupper() and len(w) > 2]
    found |= {"!shout"} if len(shouted) > 0.2 * max(10, text.count(" ")) else set()
    found |= {"!marks"} if text.count("!!") > 2 else set()
    return 1 / (1 + math.exp(-model.bias - sum(w for f, w in model.weights.items() if f in found)))


def test_query_equals_the_weights(spark, sf):
    """Every row's score, computed anew from the classifier; held_out by zlib."""
    sf = sf.replace("sf0.001", "sf0.01")  # the smallest table is too small to learn from
    out = op9_toxicity(spark, sf)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = tox.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = out.collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts) and len(model.weights) > 5
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert abs(r["score"] - plain_score(model, texts[r["doc_id"]])) < 1e-9 and r["predicted"] == int(r["score"] >= 0.5)


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    previous = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, previous, sf)
        assert now.columns == docs.columns
        ids = {r[0] for r in now.select("doc_id").collect()}
        assert ids <= {r[0] for r in previous.select("doc_id").collect()}
        previous = now
    assert corpus_pipeline.run(spark, sf).count() == len(ids)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "token=abcdef1 x", "en", "s", 15)], docs.schema)
    out = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, sf)
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()} == {(None, None, None), (1, "", 0), (2, "[secret] x", 10)}


def test_pipeline_keeps_every_column(spark, sf, tmp_path):
    """Columns that clash with what the stages use inside, dotted ones, maps and arrays, with repeated rows."""
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("doc_id long, text string, lang string, source string, n_chars long, score double, `a.b` string, row string, record int, m map<string,array<int>>, n int, text_hash binary, id string, value int, `_base` string, c0 int, at struct<x: int, `y.z`: string>")
    draw = random.Random(2)
    texts = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(30)) for _ in range(6)]
    rows = [(i, t, "en", "s", len(t), i / 7, f"d{i}", f"r{i}", i, {"k": [i, None], "z": None}, i, bytearray([i]), f"i{i}", i, f"b{i}", i, (i, f"y{i}")) for i, t in enumerate(texts)]
    rows.append((6, texts[0] + " more", *rows[0][2:]))
    rows += [rows[1], rows[1], (*rows[1][:5], -1.0, *rows[1][6:]), (7, "password=hunter22 x", *rows[2][2:]), (None, None, *[None] * 15), (None, texts[0], *rows[3][2:])]
    docs = spark.createDataFrame(rows, schema)
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf)
        assert now.schema.names == schema.names and [f.dataType for f in now.schema] == [f.dataType for f in schema], name
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
    plain = lambda r: tuple(sorted(v.items()) if isinstance(v, dict) else v for v in r)
    got, given = [plain(r) for r in now.collect()], [plain(r) for r in docs.collect()]
    assert sorted(str(r[0]) for r in got) == ["0", "1", "2", "3", "4", "5", "7", "None", "None"]
    # Each row is one of those given, in all that no stage is to change.
    same = {tuple(map(str, r[:1] + r[2:4] + r[5:])) for r in given}
    assert {tuple(map(str, r[:1] + r[2:4] + r[5:])) for r in got} <= same
    assert {r[0]: (r[1], r[4]) for r in got if r[0] == 7} == {7: ("[secret] x", 10)}
    last = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    assert last.count() == 9


def test_pipeline_of_other_columns(spark, sf):
    """Without n_chars, and with no column besides the key and the text."""
    docs = spark.createDataFrame([(1, "a b"), (2, "token=abcdef1 x"), (2, "token=abcdef1 x")], "doc_id long, text string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text"]
    assert sorted(map(tuple, docs.collect())) == [(1, "a b"), (2, "[secret] x")]


def test_pipeline_of_empty_tables(spark, sf, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_equal_plain_versions(spark, sf):
    from quarryline.llm import order_minhash as om
    from quarryline.llm.queries import op5_secrets

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    score = tox.fit(docs, spark.read.parquet(f"{sf}/labels.parquet")).scorer()
    clean = {i for i, t in texts.items() if score(t) < 0.5}
    assert {r["doc_id"] for r in corpus_pipeline.toxicity(spark, docs, sf).collect()} == clean
    # The smallest id of each component of links, by comparing all pairs.
    codes = {i: om.word_codes(t) for i, t in sorted(texts.items())}
    root = {i: i for i in codes}
    find = lambda i: i if root[i] == i else find(root[i])
    for i in codes:
        for j in codes:
            if i < j and abs(len(codes[i]) - len(codes[j])) <= om.allowed(len(codes[i]), len(codes[j]), 0.8) and find(i) != find(j) and om.linked(codes[i], codes[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicate(spark, docs, sf).collect()} == {i for i in root if find(i) == i}
    spans = {r["doc_id"]: r["spans"] for r in op5_secrets(spark, sf).collect()}
    for r in corpus_pipeline.secrets(spark, docs, sf).collect():
        want, at = "", 0
        for _, start, end in (s.split(":") for s in spans[r["doc_id"]].split(",") if s):
            if int(start) >= at:
                want += texts[r["doc_id"]][at : int(start)] + "[secret]"
            at = max(at, int(end))
        assert r["text"] == want + texts[r["doc_id"]][at:] and r["n_chars"] == len(r["text"])


def test_pipeline_does_not_depend_on_partitions(spark, sf):
    def kept():
        return sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, sf).collect())

    one = kept()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert kept() == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
