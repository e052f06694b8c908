"""Shared helpers: table reading, work folders on shared storage, Arrow batch mapping."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of one Arrow batch; with whole texts of up to some 100 KB a batch stays in the tens of MB.
BATCH_ROWS = 512
#: Keys that may count as hot: each has more than this part of all rows.
HOT_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset (tests, local mode) a temporary folder is made and remembered.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="quarryline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def work_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows of df, written to the shared folder and reread: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_written_at"] = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a frame made by `written`, or behind one that reads nothing else, when nothing reads them any more."""
    spark = df.sparkSession
    at = df.__dict__.get("_written_at")
    own = shared_root(spark).split(":", 1)[-1].lstrip("/")
    for root in [at] if at else {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if not root.split(":", 1)[-1].lstrip("/").startswith(own):
            raise ValueError(f"{root} isn't in the shared folder")
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fanned_out(df: DataFrame) -> DataFrame:
    """Deal rows anew only where the input came as fewer partitions than the cluster has cores.

    Many small executors and one input file is the case of the small test tables; there the
    shuffle is cheap and the CPU-bound map after it is not.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def join_hot(rows: DataFrame, keyed: DataFrame, on: str | list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with `keyed`, which has one row a key and in the column `count` how many of the `total` rows have that key.

    Keys with more than total / HOT_KEYS rows, of which there are fewer than HOT_KEYS, are broadcast,
    so their rows stay where they are; the others meet by a shuffle in which no key is large. Only
    hashes of the hot keys come to the driver. how: inner or left. Both frames are read several times:
    they should be tables or cheap.
    """
    on = [on] if isinstance(on, str) else on
    code = F.xxhash64(*on)
    hot = [r[0] for r in keyed.where(F.col(count) * HOT_KEYS > total).select(code).collect()]
    if not hot:
        return rows.join(keyed, on, how)
    is_hot = code.isin(hot)
    few = rows.where(is_hot).join(F.broadcast(keyed.where(is_hot)), on, how)
    return few.unionByName(rows.where(~is_hot).join(keyed.where(~is_hot), on, how))


def dealt(df: DataFrame, by: list[str], run: Callable[[pa.Table], pa.Table], schema: str, order: Sequence[str] = ()) -> DataFrame:
    """Apply run to the rows of each group of equal `by`, in the order of `order`.

    As applyInArrow, but groups follow each other in one stream, which costs less where many are
    small. A group must fit in memory.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        now = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
            begin = 0
            for i, key in enumerate(keys):
                if key != now:
                    parts.append(table.slice(begin, i - begin))
                    if now is not None:
                        yield from run(pa.concat_tables(parts).combine_chunks()).to_batches()
                    parts, begin, now = [], i, key
            parts.append(table.slice(begin))
        if now is not None:
            yield from run(pa.concat_tables(parts).combine_chunks()).to_batches()

    batch_rows(df.sparkSession)
    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(stream, schema)


def batch_rows(spark: SparkSession) -> None:
    """All operators take batches of the same size, so it doesn't matter which of them set it last."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def map_batches(df: DataFrame, make: Callable[[], Callable[[list], dict]], column: str, schema: str, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Apply make()'s function to lists of values of `column`; carry `keep` through unchanged.

    make runs once in each Python task. Batches go through Arrow whole, so nulls and 64-bit
    integers of the carried columns survive. schema lists the new columns only.
    """
    batch_rows(df.sparkSession)
    # Numbered names on the way through Python, which takes no names with dots.
    plain = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{column}`").alias("value"))
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields[:-1]]
    made = {f.name: to_arrow_type(f.dataType) for f in T.StructType.fromDDL(schema).fields}
    width = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            got = apply(batch.column(width).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(width)), *(pa.array(got[n], kind) for n, kind in made.items())], names=[*batch.schema.names[:width], *made])

    return plain.mapInArrow(run, ", ".join([*kept, schema])).toDF(*keep, *made)


class Memo:
    """Remembers function values of strings in two generations of at most `most` keys each.

    When the young one is full it becomes the old one and what was old goes; a value found in the
    old one moves to the young one. So memory is bounded and frequent keys stay. `compute` gets
    the list of distinct strings that are missing, and returns their values.
    """

    def __init__(self, compute: Callable[[list[str]], list], most: int):
        self.compute, self.most = compute, most
        self.young: dict = {}
        self.old: dict = {}

    def of(self, keys: list[str]) -> list:
        """The values of keys, in order."""
        found = list(map(self.young.get, keys))
        if None not in found:
            return found
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        got = {k: self.old.pop(k, None) for k, v in zip(keys, found, strict=True) if v is None}
        if lacking := [k for k, v in got.items() if v is None]:
            got.update(zip(lacking, self.compute(lacking), strict=True))
        self.young.update((k, v) for k, v in got.items() if len(k) <= 64)
        return [got[k] if v is None else v for k, v in zip(keys, found, strict=True)]
