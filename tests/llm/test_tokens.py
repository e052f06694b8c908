import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from quarryline.llm.piece_bpe import PieceBpe, piece_digests, piece_round_trip
from quarryline.llm.token_counts import UnigramCounter, token_counts, vocabulary
from quarryline.llm import chunks
from quarryline.llm.chunks import BatchEncoder, chunks_are_exact
from quarryline.llm.token_files import read_token_files, token_digests, write_token_files

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n", "  a  b\n\n c", "▁▁▁x", "é́ 𝒳𝒴 日本語 \x00\t", "a" * 300, "aaaa bbbb" * 30, "      " * 5, "Foo,bar. don't it's I'LL x.'s  á,b", "Σας. ΣΑΣ, foo:\"bar\"", "\x1cq\x85z k 12,3", "token " * 50_000]


@pytest.fixture(scope="module")
def texts(spark, sf):
    return [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ODD


def docs(spark, texts):
    return spark.createDataFrame([*((i, t, 0) for i, t in enumerate(texts)), (None, "x", 1), (3, None, 1), (3, "again", 1)], "doc_id long, text string, n_tokens int")


def test_piece_bpe_equals_library(texts):
    own = PieceBpe(PIECES)
    assert [own.encode(t) for t in texts] == own.library.encode(texts, num_threads=1)


def test_piece_memo_forgets(texts):
    own = PieceBpe(PIECES, memo_entries=50)
    assert [own.encode(t) for t in texts[:40]] == own.library.encode(texts[:40])
    assert len(own.memo.young) < 2_000


def test_unigram_equals_library(texts):
    import sentencepiece
    from tokenizers import Tokenizer, models, normalizers

    counter = UnigramCounter(vocabulary(PIECES))
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    whole = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]
    t = Tokenizer(models.Unigram(whole, 0, True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    assert [counter.count(x)[1] for x in texts] == [len(t.encode(x).ids) for x in texts]
    # Control and byte pieces are text like any other where they are spelled out.
    assert counter.count("<s>")[1] > 1 and counter.count("<0x41>")[1] > 1


def test_unigram_ties():
    counter = UnigramCounter([("▁", 0.0), ("a", -1.0), ("aa", -2.0), ("aaa", -3.0)])
    assert counter.count("aaaa") == (-4.0, 3)  # ▁, then of equal scores the earliest start of the last piece


@pytest.mark.parametrize("exact, at_once", [(True, 4 << 20), (True, 3000), (False, 4 << 20)])
def test_chunks_equal_whole_texts(texts, monkeypatch, exact, at_once):
    monkeypatch.setattr(chunks, "SLICE", at_once)
    e = BatchEncoder(WORDS)
    assert e.exact
    e.exact = exact
    more = [*texts, "H\u0331 T\u0308a J\u030c I\u0307 K\u212a", "a.<|ENDOFTEXT|>.b", "", "x\x0by\x0cz\u00a0w\u2003v", "A&&&B%C c$$$,", "\u0301a", "ǅ ẞ ß İ"]
    ids, ends = e.encode(pa.array(more))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [x.ids for x in e.library.encode_batch(more, add_special_tokens=False)]
    sliced = pa.array(["skipped", *more[:40]]).slice(1)
    ids, ends = e.encode(sliced)
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [x.ids for x in e.library.encode_batch(more[:40], add_special_tokens=False)]


def test_words_are_encoded_without_special_tokens_between(monkeypatch):
    e = BatchEncoder(WORDS)
    plain = ["word", "über", "ৎ", "日本語", "ςΣ", "ᄒ" + "ᅡ" + "ᆫ", "ǅ", "a" * 300]  # letters alone; the sixth is composed
    odd = ["don't", "x1", "İ", "İstanbul", "কি", "...", "a.b", "</w>", "²"]  # some are letters that the rules take apart
    want = {c: e.whole([c])[0].tobytes() for c in plain + odd}
    given = []
    whole = e.whole
    monkeypatch.setattr(e, "whole", lambda texts: given.extend(texts) or whole(texts))
    assert e.chunks(plain) == [want[c] for c in plain] and given == [" ".join(plain)]
    for mixed in (odd, [*odd, *plain], [plain[0], *odd, plain[0]], []):
        assert e.chunks(mixed) == [want[c] for c in mixed]
    e.last = None
    assert e.chunks([*plain, *odd]) == [want[c] for c in (*plain, *odd)]


def test_batches_are_gathered_within_the_slice(monkeypatch):
    monkeypatch.setattr(chunks, "SLICE", 400)
    sizes = [10, 0, 100, 150, 1000, 1, 1, 390]
    batches = [pa.record_batch({"k": [i], "t": ["x" * n]}) for i, n in enumerate(sizes)]
    got = list(chunks.gathered(iter(batches), 1))
    assert [b.column(0).to_pylist() for b in got] == [[0, 1, 2, 3], [4], [5, 6], [7]] and list(chunks.gathered(iter(()), 1)) == []
    assert pa.Table.from_batches(got) == pa.Table.from_batches(batches)


def test_chunks_of_other_tokenizers_are_refused(texts):
    e = BatchEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not e.exact and not chunks_are_exact({"added_tokens": []})
    ids, ends = e.encode(pa.array(texts[:20]))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [x.ids for x in e.library.encode_batch(texts[:20], add_special_tokens=False)]


def test_special_tokens_as_the_plain_call(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORDS)
    held = ["one<|endoftext|> two", "<|startoftext|>a b<|endoftext|>", "it's.<|endoftext|>,'s <|endof text|>", "<|ENDOFTEXT|> Foo<|startoftext|>\n\n b", "e<|endoftext|>\u0301 x"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in held]
    assert want[0] == [637, 49407, 1237]
    df = spark.createDataFrame(list(enumerate(held)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in read_token_files(spark, write_token_files(df, WORDS, 2)).collect()}
    assert [got[i] for i in range(len(held))] == [[*w, 2] for w in want]


def test_token_files(spark, texts):
    df = docs(spark, texts)
    files = write_token_files(df, WORDS, 2)
    e = BatchEncoder(WORDS)
    want = []
    rows = sorted(df.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    digests = token_digests(spark, files).collect()
    assert len(digests) == len(rows)
    total = 0
    for d in sorted(digests, key=lambda r: r["start"]):
        assert d["start"] == total
        total += d["n_tokens"]
    for r in rows:
        ids = [x for x in e.library.encode(r["text"] or "", add_special_tokens=False).ids] + [2]
        want.append((r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    key = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    assert sorted(((d["doc_id"], d["n_tokens"], d["ids_crc32"]) for d in digests), key=key) == sorted(want, key=key)
    assert [d["doc_id"] for d in sorted(digests, key=lambda r: r["start"])] == [r["doc_id"] for r in rows]
    assert read_token_files(spark, files).where("doc_id = 0").first()["ids"] == [x for x in e.library.encode(texts[0], add_special_tokens=False).ids] + [2]


def test_frames(spark, texts):
    df = docs(spark, texts[-14:])
    assert token_counts(df, PIECES).count() == piece_digests(df, PIECES).count() == 17
    back = {r["doc_id"]: r["decoded"] for r in piece_round_trip(df, PIECES).where("doc_id < 3").collect()}
    own = PieceBpe(PIECES)
    assert back == {i: own.library.decode(own.library.encode(t)) for i, t in enumerate(texts[-14:][:3])}


def test_piece_digests(spark, texts):
    import hashlib

    own = PieceBpe(PIECES)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for t in texts:
        ids = own.library.encode(t)
        want.append((len(ids), sha(",".join(map(str, ids))), sha(own.library.decode(ids))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in piece_digests(df, PIECES).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_counts_query_equals_a_plain_search(spark, sf):
    """Every row of op1: the best score by the plain recurrence over all prefixes, the count by the tokenizers library."""
    import sentencepiece
    from tokenizers import Tokenizer, models, normalizers

    from quarryline.llm.queries import op1_token_counts

    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_tokens"], r["score"]) for r in op1_token_counts(spark, sf).collect()}
    assert got.keys() == rows.keys()
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    t = Tokenizer(models.Unigram([(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], 0, True))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    assert {k: n for k, (n, _) in got.items()} == {k: len(t.encode(x).ids) for k, x in rows.items()}
    pieces = dict(vocabulary(PIECES))
    longest = max(map(len, pieces))
    least = min(pieces.values()) - 10  # of a character that no piece is
    for k in sorted(rows, key=lambda k: len(rows[k]))[: len(rows) // 2]:
        text = "▁" + rows[k].replace(" ", "▁") if rows[k] else ""
        best = [0.0] + [-float("inf")] * len(text)
        for end in range(1, len(text) + 1):
            for begin in range(max(0, end - longest), end):
                score = pieces.get(text[begin:end])
                if score is None and end - begin == 1:
                    score = least
                if score is not None:
                    best[end] = max(best[end], best[begin] + score)
        assert abs(got[k][1] - best[-1]) < 1e-9 * max(1, abs(best[-1])), k


def test_files_query_equals_the_library(spark, sf):
    """Every row of op4, with ids of a tokenizer loaded anew."""
    from tokenizers import Tokenizer

    from quarryline.llm.queries import op4_token_files

    library = Tokenizer.from_file(WORDS)
    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want, start = [], 0
    for k, text in rows:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in op4_token_files(spark, sf).collect()) == want


def test_empty(spark):
    df = docs(spark, []).limit(0)
    assert token_counts(df, PIECES).count() == piece_digests(df, PIECES).count() == 0
    assert token_digests(spark, write_token_files(df, WORDS, 2)).count() == 0
