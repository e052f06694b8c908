import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryline.llm import ogg


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


@given(st.binary(max_size=300))
def test_crc(data):
    assert ogg.page_crc(data) == slow_crc(data)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 200_000), st.integers(0, 255))
def test_round_trip(n, fill):
    payload = ogg.padded(bytes((fill + i * i) & 255 for i in range(n)))
    sound = ogg.read_sound(ogg.write_ogg(payload))
    assert sound.samples == payload and sound.stamps[-1] == len(payload) / ogg.RATE


@pytest.mark.parametrize("n", [255, 510, 255 * 255, 255 * 255 + 1, 200_000])
def test_packets_over_pages(n):
    w = ogg._StreamWriter(9)
    data = b"".join([*w.pages(b"head", 0, first=True), *w.pages(b"x" * n, n, last=True)])
    stream = ogg.read_ogg(data)[9]
    assert [len(p) for p in stream.packets] == [4, n] and stream.granules[-1] == n


def test_streams_are_kept_apart():
    streams = ogg.read_ogg(ogg.write_ogg(b"ab" * 32, serials=(77, 5)))
    assert sorted(streams) == [5, 77]


@pytest.mark.parametrize("at", [0, 5, 22, 30, 60, -1])
def test_damage_is_found(at):
    data = bytearray(ogg.write_ogg(b"q" * 64))
    data[at] ^= 1
    with pytest.raises((ogg.OggError, struct.error)):
        ogg.read_sound(bytes(data))


def test_cut_short():
    data = ogg.write_ogg(b"q" * 64)
    for n in (0, 10, len(data) // 2, len(data) - 1):
        with pytest.raises(ogg.OggError):
            ogg.read_ogg(data[:n])


def test_columns(spark):
    df = spark.createDataFrame([(1, "a", b"1"), (2, "a", None), (None, None, None), (3, "é" * 100_000, None)], "doc_id long, text string, media binary")
    rows = ogg.media_features(ogg.with_media(df), keep=("doc_id", "n_bytes")).collect()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["media_sha256"] == by[2]["media_sha256"] and by[None]["payload_bytes"] == 64 and by[3]["n_bytes"] == 200_000 and by[3]["payload_bytes"] == 200_000
    assert all(r["error"] is None for r in rows)
    bad = ogg.media_features(df.select("doc_id", "media")).collect()
    assert all(r["error"] and r["feature"] is None for r in bad)
    assert ogg.media_features(ogg.with_media(df.limit(0))).count() == 0


def test_query_digests(spark, sf):
    import hashlib
    import zlib

    from quarryline.llm.queries import op2_ogg_media

    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op2_ogg_media(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        raw = texts[r["doc_id"]]
        payload = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
        stored = ogg.write_ogg(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert f"us={len(payload) * 1_000_000 // 8000}" in r["feature"]
