import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarryline.functions import scalars as S
from quarryline.operators import dispatch

CASES = [
    (S.parse_price, "৳ 1,250.50 Tk", 1250.5),
    (S.parse_price, "", 0.0),
    (S.parse_price, None, 0.0),
    (S.parse_price, "৳ ১২০", 120.0),
    (S.parse_price, "a, 300", 0.0),
    (lambda c: S.parse_price(c, currency=()), "1,250.50", 1250.5),
    (lambda c: S.parse_price(c, currency=()), "৳ 1,250.50 Tk", 1250.5),
    (lambda c: S.parse_price(c, currency=()), "Tk5", 5.0),
    (lambda c: S.parse_price(c, currency=()), "1Tk2", 1.0),  # with the sign taken out it is 12
    (S.parse_price, "1Tk2", 12.0),
    (lambda c: S.parse_price(c, currency=()), ", 3", 0.0),
    (lambda c: S.parse_price(c, currency=()), None, 0.0),
    (S.price, None, None),
    (S.price, "x", 0.0),
    (S.first_price, "free", None),
    (S.first_price, "৳1,250.00", 1250.0),
    (S.first_decimal, "৳1,250.00", 1.0),
    (S.first_decimal, "Wt. 300 g", None),
    (S.digits_and_dots, "Tk. 250.00", None),
    (S.digits_and_dots, "250.00 ৳", 250.0),
    (S.whole_int, "1,000", None),
    (S.whole_int, " 12 ", 12),
    (S.first_int, "only ৩ left", 3),
    (S.page_count, "no digits", None),
    (S.strip, "  a b \n", "a b"),
    (lambda c: S.json_field(c, "image"), '{"image": ["a"]}', '["a"]'),
    (lambda c: S.json_field(c, "image"), "{bad", None),
    (lambda c: S.image_from_query(c, "https://pbs.com.bd"), "/i?url=a%252Bb", "a+b"),
    (lambda c: S.image_from_query(c, "https://pbs.com.bd"), "/i?url=a%2Bb", "a+b"),
    (lambda c: S.image_from_query(c, "https://pbs.com.bd"), "/i?url=", None),
    (lambda c: S.image_from_query(c, "https://pbs.com.bd"), "/i?url=100%", "100%"),
    (lambda c: S.absolute_url(c, "https://s"), "//a/b", "https://a/b"),
    (lambda c: S.absolute_url(c, "https://s"), "", None),
    (lambda c: dispatch.domain_label(c), "www.rokomari.com", "rokomari"),
    (lambda c: dispatch.domain_label(c), "pbs.com.bd", "pbs"),
    (lambda c: dispatch.domain_label(c), "a.com.b.com.bd", "b"),
    (lambda c: dispatch.domain_label(c), "com.example.org", "org"),
    (lambda c: dispatch.domain_label(c), "x.org", None),
    (lambda c: dispatch.host(c), "HTTP://U:p@WWW.A_b.com:80/x?y", "www.a_b.com"),
    (lambda c: dispatch.host(c), "no url", None),
    (lambda c: dispatch.host(c), None, None),
]


def test_goldens(spark):
    for i, (rule, given_text, want) in enumerate(CASES):
        df = spark.createDataFrame([(given_text,)], "t string").select(rule(F.col("t")).alias("r"))
        assert df.first()["r"] == want, (i, given_text)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(max_size=30).filter(lambda t: not any(0xD800 <= ord(c) < 0xE000 for c in t)), min_size=1, max_size=30))
def test_rules_are_total(spark, texts):
    c = F.col("t")
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(S.parse_price(c), S.first_int(c), S.whole_int(c), S.digits_and_dots(c), S.first_decimal(c), S.page_count(c), S.image_from_query(c, "https://x"), dispatch.domain_label(dispatch.host(c)))
    assert len(df.collect()) == len(texts)


@pytest.mark.parametrize("n", [0, 57, 58, 200])
def test_base64_is_one_line(spark, n):
    import base64

    row = spark.createDataFrame([(bytearray(range(n)) if n < 256 else b"",)], "b binary").select(S.base64_text(F.col("b")).alias("r")).first()
    assert row["r"] == base64.b64encode(bytes(range(n))).decode()
