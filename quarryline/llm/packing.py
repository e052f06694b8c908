"""Optimal length buckets: boundaries that minimise padding over the whole corpus, then token-budget batches.

Texts are encoded once, and their ids written. The histogram of lengths is global and goes to the
driver: n different lengths add up to n * (n - 1) / 2 tokens at least, so 10^13 tokens have fewer
than 5 million of them. Batches form inside each bucket as the written ids are read, in each task
on its own, so ids are never shuffled; a task holds one open batch for each bucket. Batches are
written padded, and what is returned about documents is read back from them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import encoder, gathered
from .common import batch_rows, drop_written, fanned_out, text_or_empty, written

#: Buckets, and the tokens that a batch may have with its padding.
BUCKETS, TOKEN_BUDGET = 16, 65_536


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens long, ids binary: the ids of each whole text (null: empty) and end_id, as unsigned integers of encoder(path).unit."""
    rows = fanned_out(docs.select(F.col(key), text_or_empty(text).alias("text")))
    batch_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        for batch in gathered(batches, 1):
            ids, ends = own.encode(batch.column(1))
            ids = np.insert(ids, ends[1:], end_id)
            ends = (ends + np.arange(len(ends))) * own.unit.itemsize
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends) // own.unit.itemsize), raw.cast(pa.binary())], names=["key", "n_tokens", "ids"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids binary")


def boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper lengths of at most `buckets` buckets that minimise the padding of all rows.

    Dynamic programming over the sorted lengths; the cost of a bucket (i, j] is
    length[j] * count(i, j] - tokens(i, j], so the best i for a j is the lowest of a set of lines
    at length[j], and one pass of a convex hull serves each layer. Exact, in integers.
    """
    histogram = sorted(histogram)
    n = len(histogram)
    if n <= buckets:
        return [length for length, _ in histogram]
    rows, tokens = [0], [0]
    for length, count in histogram:
        rows.append(rows[-1] + count)
        tokens.append(tokens[-1] + length * count)
    best = [0] + [histogram[j - 1][0] * rows[j] - tokens[j] for j in range(1, n + 1)]
    cuts: list[list[int]] = []
    for layer in range(1, buckets):
        new, cut, hull, at = [None] * (n + 1), [0] * (n + 1), [], 0
        for j in range(layer + 1, n + 1):
            i = j - 1  # a new line: slope -rows[i], height best[i] + tokens[i]
            line = (-rows[i], best[i] + tokens[i], i)
            while len(hull) >= 2 and (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]) >= (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]):
                hull.pop()
            hull.append(line)
            x = histogram[j - 1][0]
            at = min(at, len(hull) - 1)
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] < hull[at][0] * x + hull[at][1]:
                at += 1
            slope, height, cut[j] = hull[at]
            new[j] = slope * x + height + x * rows[j] - tokens[j]
        cuts.append(cut)
        best = new
    out, j = [], n
    for cut in reversed(cuts):
        out.append(histogram[j - 1][0])
        j = cut[j]
    out.append(histogram[j - 1][0])
    return out[::-1]


def batches_of(ids: DataFrame, uppers: list[int], unit: str, pad_id: int, budget: int, key: str) -> DataFrame:
    """One row per batch: part, number (in the part), bucket, padded, keys, lengths, ids.

    ids holds as many rows of `padded` unsigned integers as there are keys. Each part, a task's share
    of the input, fills batches of its own, in input order; in a part, all batches of a bucket but the
    last are full.
    """
    kind = ids.schema[key].dataType.simpleString()
    itemsize = np.dtype(unit).itemsize
    bounds = np.array(uppers, np.int64)
    batch_rows(ids.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}
        schema = None

        def closed(bucket: int) -> pa.RecordBatch:
            nonlocal number
            rows, padded = held.pop(bucket), int(bounds[bucket])
            pad = np.array([pad_id], unit).tobytes()
            body = b"".join([x + pad * (padded - len(x) // itemsize) for _, x in rows])
            keys = pa.array([k for k, _ in rows], schema.field(0).type)
            out = [pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([bucket], pa.int32()), pa.array([padded], pa.int64()), pa.ListArray.from_arrays([0, len(rows)], keys), pa.array([[len(x) // itemsize for _, x in rows]], pa.list_(pa.int64())), pa.array([body], pa.binary())]
            number += 1
            return pa.RecordBatch.from_arrays(out, names=["part", "number", "bucket", "padded", "keys", "lengths", "ids"])

        for batch in batches:
            schema = batch.schema
            where = np.searchsorted(bounds, batch.column(1).to_numpy())
            for k, b, x in zip(batch.column(0).to_pylist(), where.tolist(), batch.column(2).to_pylist(), strict=True):
                rows = held.setdefault(b, [])
                rows.append((k, x))
                if len(rows) >= max(1, budget // max(1, int(bounds[b]))):
                    yield closed(b)
        for b in sorted(held):
            yield closed(b)

    return ids.select(key, "n_tokens", "ids").mapInArrow(run, f"part int, number long, bucket int, padded long, keys array<{kind}>, lengths array<long>, ids binary")


def write_batches(docs: DataFrame, tokenizer_path: str, end_id: int, pad_id: int = 0, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All texts as padded batches of ids, written and read back: batch long, bucket, padded, keys, lengths, ids.

    A text's ids are those of the whole text (null: empty) and end_id. A batch is of one bucket and
    holds as many rows as the budget allows at the bucket's upper length, at least one: a document
    longer than the budget is a batch of its own. Batches are numbered without gaps. Keys are carried
    as they are (null and repeated ones too); other columns, whatever their names, are left out. An
    empty table gives no batches.
    """
    ids = written(encoded(docs, tokenizer_path, end_id, text, key), "ids")
    uppers = boundaries([(r[0], r[1]) for r in ids.groupBy("n_tokens").count().collect()], buckets)
    batches = written(batches_of(ids, uppers, encoder(tokenizer_path).unit.str, pad_id, budget, key), "batches")
    drop_written(ids)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = batches.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # A row for each task of the write, so there are at most some 100,000.
    return batches.join(F.broadcast(bases), "part").select((F.col("base") + F.col("number")).alias("batch"), "bucket", "padded", "keys", "lengths", "ids")


def packed(docs: DataFrame, tokenizer_path: str, end_id: int, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document, read back from its batch: key, n_tokens, bucket, padded, batch, slot, ids_crc32.

    ids_crc32 is that of the document's ids as little-endian unsigned 32-bit integers, its padding
    left out. For odd rows see write_batches.
    """
    unit = encoder(tokenizer_path).unit.str
    batches = write_batches(docs, tokenizer_path, end_id, 0, buckets, budget, text, key)
    kind = docs.schema[key].dataType.simpleString()

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for i in range(batch.num_rows):
                number, bucket, padded, lengths = (batch.column(c)[i].as_py() for c in ("batch", "bucket", "padded", "lengths"))
                n = len(lengths)
                ids = np.frombuffer(batch.column("ids")[i].as_py(), unit).astype("<u4").reshape(n, padded)
                crcs = [zlib.crc32(row[:m]) for row, m in zip(ids, lengths, strict=True)]
                same = [pa.array([x] * n, t) for x, t in ((bucket, pa.int32()), (padded, pa.int64()), (number, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("keys")[i].values, pa.array(lengths, pa.int64()), *same, pa.array(range(n), pa.int64()), pa.array(crcs, pa.int64())], names=["key", "n_tokens", "bucket", "padded", "batch", "slot", "ids_crc32"])

    return batches.mapInArrow(read, f"`{key}` {kind}, n_tokens long, bucket int, padded long, batch long, slot long, ids_crc32 long")
