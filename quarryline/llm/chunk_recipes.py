"""Exact duplicates by recipes of content-defined chunks.

A text is cut where a rolling hash of its last bytes says so, so equal texts are cut alike and
texts that share long passages share chunks. The distinct chunks of all texts are compared byte
by byte, once each: that makes a chunk's code a verified identifier. After that only recipes move,
the ordered lists of identifiers, 16 bytes for some 4 KB of text; texts are equal when their
recipes are. A long text that many rows repeat crosses the network at most once a task.

Should two different chunks have one code, all chunks get their number among those of their code
as well, and recipes hold both.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_rows, drop_written, join_hot, written

#: Bytes of a chunk: at least, at most, and between them some 2^BITS on average.
LEAST, MOST, BITS = 1024, 65_536, 12
#: Bytes that the rolling hash sees, and bytes that are hashed at a time.
WINDOW, STRIDE = 32, 1 << 20
#: A number for each byte.
_GEAR = np.frombuffer(hashlib.shake_128(b"content-defined chunks").digest(1024), "<u4")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def normalised(text: bytes | None) -> bytes:
    """UTF-8 with A-Z in lower case and all else as it is; null is empty."""
    return (text or b"").translate(_LOWER)


def _stops(text: bytes) -> list[int]:
    """Where the hash of the WINDOW bytes before a place has BITS leading zeros."""
    data = np.frombuffer(text, np.uint8)
    found = []
    for begin in range(WINDOW, len(data), STRIDE):
        h = _GEAR[data[begin - WINDOW : begin + STRIDE]]
        for s in (1, 2, 4, 8, 16):  # each round doubles the bytes that a hash sees
            h[s:] += h[:-s] << np.uint32(s)
        found.append(np.flatnonzero(h[WINDOW - 1 :] < 1 << (32 - BITS)) + begin)
    return np.unique(np.concatenate(found)).tolist() if found else []


def chunks(text: bytes) -> list[bytes]:
    """The text in chunks of LEAST to MOST bytes (the last may be shorter); none for an empty text."""
    if len(text) <= LEAST:
        return [text] if text else []
    stops, out, begin = _stops(text), [], 0
    while len(text) - begin > LEAST:
        at = bisect_left(stops, begin + LEAST)
        end = min(stops[at] if at < len(stops) else len(text), begin + MOST, len(text))
        out.append(text[begin:end])
        begin = end
    return out + [text[begin:]] * (begin < len(text))


def code_of(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    batch_rows(docs.sparkSession)
    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("binary").alias("text"))


def _distinct(texts: DataFrame, code: Callable[[bytes], bytes]) -> DataFrame:
    """code and chunk of all different chunks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(dict.fromkeys(c for t in batch.column(0).to_pylist() for c in chunks(normalised(t))))
            yield pa.RecordBatch.from_arrays([pa.array(map(code, found), pa.binary()), pa.array(found, pa.binary())], names=["code", "chunk"])

    return texts.select("text").mapInArrow(cut, "code binary, chunk binary").distinct()


def _with_recipes(texts: DataFrame, code: Callable[[bytes], bytes], whole: bool) -> DataFrame:
    """key, text_sha256, recipe (codes, joined) and, if whole, the chunks in order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normalised(t) for t in batch.column(1).to_pylist()]
            parts = [chunks(t) for t in texts]
            out = [batch.column(0), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array([b"".join(map(code, p)) for p in parts], pa.binary())]
            if whole:
                out.append(pa.array([[{"code": code(c), "chunk": c} for c in p] for p in parts], pa.list_(pa.struct([("code", pa.binary()), ("chunk", pa.binary())]))))
            yield pa.RecordBatch.from_arrays(out, names=["key", "text_sha256", "recipe", "chunks"][: len(out)])

    schema = T.StructType([texts.schema["key"], *T.StructType.fromDDL("text_sha256 string, recipe binary" + ", chunks array<struct<code: binary, chunk: binary>>" * whole).fields])
    return texts.mapInArrow(cut, schema).withColumn("row", F.monotonically_increasing_id())


def _numbered(texts: DataFrame, code: Callable[[bytes], bytes], clashes: DataFrame) -> DataFrame:
    """Recipes in which a chunk whose code others have too is told apart by its number among them."""
    from pyspark.sql import Window

    numbers = _distinct(texts, code).join(clashes, "code", "left_semi").select("code", "chunk", F.row_number().over(Window.partitionBy("code").orderBy("chunk")).alias("number"))
    rows = written(_with_recipes(texts, code, whole=True), "cut")
    each = rows.select("row", F.posexplode("chunks").alias("at", "c")).select("row", "at", "c.*").join(numbers, ["code", "chunk"], "left")
    one = F.transform(F.array_sort(F.collect_list(F.struct("at", "code", F.coalesce("number", F.lit(0)).alias("number")))), lambda c: F.concat(F.hex(c["code"]), F.lit("-"), c["number"].cast("string")))
    lists = each.groupBy("row").agg(F.array_join(one, ",").cast("binary").alias("list"))
    out = written(rows.drop("chunks").join(lists, "row", "left").withColumn("recipe", F.coalesce("list", "recipe")).drop("list"), "recipes")
    drop_written(rows)
    return out


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", code: Callable[[bytes], bytes] = code_of) -> DataFrame:
    """One row per row: key, keep_id (the key that stays), group_size long, kept boolean, text_sha256.

    Texts are equal when they are identical after A-Z became lower case; null counts as empty, and
    texts that aren't valid UTF-8 are compared as bytes. The row with the largest key of a group
    stays; where several rows of a group have that key, or none has a key, just one of them does.
    keep_id is null where no row of a group has a key. Texts of any length are read whole, in bounded
    chunks. An empty table gives no rows. Other columns are dropped and may have any names.

    code gives a chunk's code; codes need not be unique.
    """
    texts = _texts(docs, key, text)
    clashes = written(_distinct(texts, code).groupBy("code").agg(F.count("*").alias("n")).where("n > 1").select("code"), "clashes")
    recipes = written(_with_recipes(texts, code, whole=False), "recipes") if clashes.isEmpty() else _numbered(texts, code, clashes)
    drop_written(clashes)
    groups = written(recipes.groupBy("recipe").agg(F.count("*").alias("group_size"), F.max("key").alias("keep_id"), F.coalesce(F.max_by("row", "key"), F.max("row")).alias("keep_row")), "groups")
    out = join_hot(recipes, groups, "recipe", "group_size", recipes.count())
    return out.select(F.col("key").alias(key), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that exact_duplicates keeps, with all their columns; of rows equal in key and text one."""
    kept = exact_duplicates(docs, key, text).where("kept").select(F.col(key).alias("k"), F.col("text_sha256").alias("h"))
    record = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), F.col(f"`{key}`").alias("k"), F.sha2(F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").cast("binary"), 256).alias("h"))
    there = (record["h"] == kept["h"]) & record["k"].eqNullSafe(kept["k"])
    return record.join(kept, there, "left_semi").dropDuplicates(["k", "h"]).select("record.*")
