"""Token ids as flat binary files that can be memory-mapped.

Documents are dealt into ranges of their keys; each range becomes one part of three files:

- `<part>.ids`: unsigned little-endian ids, 16 bits wide where the vocabulary allows, else 32
- `<part>.off`: 64-bit offsets of each document's first id in the part, then the part's length
- `<part>.key`: 64-bit keys of the documents (and a bit that says the key is null)

Parts are numbered in key order. A part's base, the number of ids before it, is the prefix sum
of the lengths of the parts before it, so an id has a place in the whole without any file being
rewritten. A task writes under a name of its own attempt; the manifest names the files that count.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import encoder
from .common import BATCH_ROWS, batch_rows, text_or_empty, work_path


@dataclass(frozen=True)
class TokenFiles:
    """A written set: folder, unit of the ids, and the parts as (number, name, documents, ids, base)."""

    folder: str
    unit: str
    parts: tuple[tuple[int, str, int, int, int], ...]


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, text: str = "text", key: str = "doc_id", parts: int | None = None) -> TokenFiles:
    """Write the ids of all documents in ascending key order, each followed by end_id.

    A null text counts as empty and has just end_id. Null keys come first; documents with equal
    keys are ordered by a hash of the text. Texts of any length are encoded whole. Other columns,
    whatever their names, are left out; an empty table gives no parts. Only the manifest, a row for
    each part, comes to the driver. The input is shuffled once, by range of key, into as many parts as
    it is read in.
    """
    spark = docs.sparkSession
    batch_rows(spark)
    folder = folder or work_path(spark, "token-files")
    rows = docs.select(F.col(key).cast("long").alias("k"), text_or_empty(text).alias("t"), F.monotonically_increasing_id().alias("at"))
    n = parts or max(spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        lengths: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        with store.open_output_stream(f"{root}/{name}.ids") as out:
            for batch in batches:
                ks = batch.column(0)
                keys.append(np.stack([ks.fill_null(0).to_numpy(zero_copy_only=False), ks.is_null().to_numpy(zero_copy_only=False)], 1).astype("<i8"))
                ids, ends = own.encode(batch.column(1))
                lengths.append(np.diff(ends) + 1)
                out.write(np.insert(ids, ends[1:], end_id).tobytes())
        if not lengths:
            store.delete_file(f"{root}/{name}.ids")
            return
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype("<i8")
        for kind, data in (("off", offsets), ("key", np.concatenate(keys))):
            with store.open_output_stream(f"{root}/{name}.{kind}") as out:
                out.write(data.tobytes())
        yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "docs": [len(offsets) - 1], "ids": [int(offsets[-1])]}, pa.schema([("part", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    # Rows equal in key and text differ in their places, so that ranges can part them.
    order = [F.col("k").asc_nulls_first(), F.xxhash64("t"), F.col("at")]
    manifest = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(write, "part int, name string, docs long, ids long").collect()
    known, base = [], 0
    for number, row in enumerate(sorted(manifest, key=lambda r: r["part"])):
        known.append((number, row["name"], row["docs"], row["ids"], base))
        base += row["ids"]
    return TokenFiles(folder, encoder(tokenizer_path).unit.str, tuple(known))


def _mapped(store: fs.FileSystem, path: str, unit: str) -> np.ndarray:
    """The numbers of a file: mapped into memory where the store is a local or mounted disk, else read."""
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, unit, "r") if os.path.getsize(path) else np.empty(0, unit)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), unit)


def read_token_files(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """key long, start long (ids before the document in the whole set), ids array<long> of every document.

    Each part is read by one task, a slice of documents at a time.
    """
    return _read(spark, files, "doc_id long, start long, ids array<long>", lambda ids: {"ids": [x.astype("i8") for x in ids]})


def token_digests(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), read from the files."""
    return _read(spark, files, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda ids: {"n_tokens": [len(x) for x in ids], "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]})


def _read(spark: SparkSession, files: TokenFiles, schema: str, columns) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(files.folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = _mapped(store, f"{root}/{name}.ids", files.unit)
                offsets = _mapped(store, f"{root}/{name}.off", "<i8")
                keys = _mapped(store, f"{root}/{name}.key", "<i8").reshape(-1, 2)
                for at in range(0, len(keys), BATCH_ROWS):
                    k, o = keys[at : at + BATCH_ROWS], offsets[at : at + BATCH_ROWS + 1]
                    each = [ids[a:b] for a, b in zip(o[:-1], o[1:], strict=True)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(k[:, 0], pa.int64(), mask=k[:, 1].astype(bool)), "start": base + o[:-1], **columns(each)})

    parts = spark.createDataFrame([(name, base) for _, name, _, _, base in files.parts], "name string, base long")
    return parts.repartition(max(1, len(files.parts))).mapInArrow(read, schema)
