import pytest
from hypothesis import given
from hypothesis import strategies as st

from quarryline.schemas import PAGES
from quarryline.sources.encoding import decoded, decoded_pages, encoding_of

BENGALI, FRENCH, JAPANESE = "<h1>বই সংক্ষেপ</h1>", "<h1>déjà “vu” – 5 €</h1>", "<h1>日本語のページ</h1>"


@pytest.mark.parametrize(
    "body,charset,want",
    [
        (BENGALI.encode(), None, BENGALI),  # without any label
        (FRENCH.encode("cp1252"), None, FRENCH),
        (FRENCH.encode("cp1252"), "ISO-8859-1", FRENCH),  # what servers call Latin-1
        (b"<h1>\xe9</h1>", "us-ascii", "<h1>é</h1>"),
        (BENGALI.encode("utf-16"), None, BENGALI),  # marked
        (b"\xfe\xff" + BENGALI.encode("utf-16-be"), "iso-8859-1", BENGALI),
        (b"\xef\xbb\xbf" + BENGALI.encode(), "windows-1252", BENGALI),
        (b'<meta charset="shift_jis">' + JAPANESE.encode("shift_jis"), None, '<meta charset="shift_jis">' + JAPANESE),
        (b"<META http-equiv=Content-Type content='text/html; charset=EUC-JP'>" + JAPANESE.encode("euc_jp"), None, "<META http-equiv=Content-Type content='text/html; charset=EUC-JP'>" + JAPANESE),
        (b'<meta charset="koi8-r">' + "Привет".encode("koi8-r"), "", '<meta charset="koi8-r">Привет'),
        (b'<meta charset="koi8-r">' + BENGALI.encode(), "utf-8", '<meta charset="koi8-r">' + BENGALI),  # the server's word counts
        (b'<!-- <meta charset="koi8-r"> -->' + BENGALI.encode(), None, '<!-- <meta charset="koi8-r"> -->' + BENGALI),
        (b'<meta charset="utf-16">' + BENGALI.encode(), None, '<meta charset="utf-16">' + BENGALI),
        (b'<meta charset="no-such">' + BENGALI.encode(), "x-unknown", '<meta charset="no-such">' + BENGALI),
        (b" " * 2000 + b'<meta charset="koi8-r">' + BENGALI.encode(), None, " " * 2000 + '<meta charset="koi8-r">' + BENGALI),  # too far down
        (BENGALI.encode(), "hex", BENGALI),  # no encoding of text
        (b"a\xffb", "utf-8", "a�b"),
        (b"", None, ""),
    ],
)
def test_goldens(body, charset, want):
    assert decoded(body, charset) == want


@given(st.binary(max_size=60), st.sampled_from([None, "", "utf-8", "utf-16", "utf-32", "utf-7", "idna", "punycode", "big5", "latin-1", "cp037", "undefined", "unicode_escape", "rot13", "\x00", "é"]))
def test_never_raises(body, charset):
    assert isinstance(decoded(body, charset), str) and encoding_of(body, charset)


def test_three_pages_without_a_header(spark):
    rows = [(1, "u", BENGALI.encode(), None), (2, "u", b'<meta charset="euc-jp">' + JAPANESE.encode("euc_jp"), None), (3, "u", FRENCH.encode("cp1252"), None), (4, "u", FRENCH.encode("cp1252"), "latin1"), (5, "u", None, None)]
    df = spark.createDataFrame([(k, u, None if b is None else bytearray(b), c) for k, u, b, c in rows], "page_id long, url string, body binary, charset string")
    out = decoded_pages(df)
    assert out.columns == PAGES.names
    assert {r["page_id"]: r["html"] for r in out.collect()} == {1: BENGALI, 2: '<meta charset="euc-jp">' + JAPANESE, 3: FRENCH, 4: FRENCH, 5: None}
    assert decoded_pages(df.drop("charset").withColumn("body_specs", df["body"])).where("page_id = 1").first()["html_specs"] == BENGALI
