"""Bytes of a page to text, as browsers guess it.

A byte order mark decides, then the charset that the server names, then the one that the page names
among its first bytes; without any of them it is UTF-8 where the bytes are valid UTF-8, else
windows-1252. Labels of Latin-1 and ASCII mean windows-1252. An unknown label counts as none.
"""

from __future__ import annotations

import codecs
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import PAGES

#: Byte order marks, labels that mean another encoding, and the bytes that are searched for a label.
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le"))
ALIASES = {"ascii": "cp1252", "iso8859-1": "cp1252", "gb2312": "gb18030", "gbk": "gb18030", "euc_kr": "cp949", "shift_jis": "cp932"}
PRESCAN = 1024
_META = re.compile(rb"""<meta\b[^>]*?\bcharset\s*=\s*["']?\s*([\w.:-]+)""", re.I)
_COMMENT = re.compile(rb"<!--.*?-->", re.S)


def _codec(label: str | None) -> str | None:
    """The text encoding that a label means, or None."""
    try:
        info = codecs.lookup((label or "").strip())
    except (LookupError, ValueError):
        return None
    return ALIASES.get(info.name, info.name) if info._is_text_encoding else None


def encoding_of(body: bytes, charset: str | None = None) -> tuple[str, int]:
    """The encoding of a page and the length of its byte order mark."""
    for mark, name in MARKS:
        if body.startswith(mark):
            return name, len(mark)
    if named := _codec(charset):
        return named, 0
    if (meta := _META.search(_COMMENT.sub(b"", body[:PRESCAN]))) and (named := _codec(meta[1].decode("ascii", "replace"))):
        # What was found byte by byte can't be in units of two or four bytes.
        return "utf-8" if named.startswith(("utf-16", "utf-32")) else named, 0
    try:
        body.decode()
    except UnicodeDecodeError:
        return "cp1252", 0
    return "utf-8", 0


def decoded(body: bytes, charset: str | None = None) -> str:
    """A page's text; what its encoding has no character for becomes U+FFFD. Never raises."""
    name, mark = encoding_of(body, charset)
    try:
        return body[mark:].decode(name, "replace")
    except (UnicodeError, LookupError, ValueError):  # codecs that refuse a text as a whole
        return body[mark:].decode("cp1252", "replace")


@F.arrow_udf(T.StringType())
def _decoded(body: pa.Array, charset: pa.Array) -> pa.Array:
    return pa.array([None if b is None else decoded(b, c) for b, c in zip(body.to_pylist(), charset.to_pylist(), strict=True)], pa.string())


def page_text(body: Column, charset: Column | None = None) -> Column:
    """Text of a binary column of pages; charset is what the server said, null where it said nothing."""
    return _decoded(body, F.lit(None).cast("string") if charset is None else charset)


def decoded_pages(raw: DataFrame) -> DataFrame:
    """PAGES from a table of page_id, url, body (binary) and, where it is known, charset and body_specs."""
    charset = F.col("charset") if "charset" in raw.columns else None
    specs = page_text(F.col("body_specs"), charset) if "body_specs" in raw.columns else F.lit(None).cast("string")
    made = raw.select(F.col("page_id").cast("long").alias("page_id"), "url", page_text(F.col("body"), charset).alias("html"), specs.alias("html_specs"))
    return made.select(*PAGES.names)
