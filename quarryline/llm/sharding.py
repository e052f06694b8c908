"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters whole records uniformly into memory-sized buckets by a seeded hash. Pass two
shuffles each bucket (Fisher-Yates) and writes it. The buckets in order are one random order of
all records; a record's place in it is the prefix sum of the sizes of the buckets before its own
plus its place in the bucket. Shards are equal cuts of that order (law `rows`), so their counts
differ by one at most.

Records never stand in arrays: a bucket's permutation is made from the bucket's number and size
alone, as a string of 3-byte numbers, and each record reads its own place from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import work_path

#: Bytes and rows of records in a bucket, on average; whichever is reached first.
BUCKET_BYTES, BUCKET_ROWS = 4 << 20, 1024
#: Bytes of records that a task of pass two handles, as several buckets.
TASK_BYTES = 64 << 20
#: Bytes that a record counts besides its text.
RECORD_BYTES = 16
#: Bytes of a number in a permutation.
WIDE = 3


def record_size(text: str = "text"):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + RECORD_BYTES


def _number(order: Column, i: Column) -> Column:
    """The i-th number of a string of numbers."""
    return F.conv(F.hex(F.substring(order, i * WIDE + 1, F.lit(WIDE))), 16, 10).cast("int")


def fisher_yates(n: Column, *seed: Column) -> Column:
    """The numbers below n in a random order that depends on seed alone, as a binary of n 3-byte numbers.

    From the last place down, each place i changes with place j <= i, which a hash of seed and i
    draws. (The built-in shuffle() draws by partition, so its order could change when a lost task
    runs again.) A step copies 3 * n bytes; buckets are small. n is 1 or more, and below 2^24.
    """
    digits = lambda i: F.lpad(F.hex(i), 2 * WIDE, "0")
    whole = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), digits), ""))
    swaps = F.transform(F.sequence(n - 1, F.lit(0), F.lit(-1)), lambda i: F.struct(i.alias("i"), F.pmod(F.xxhash64(*seed, i), i + 1).cast("int").alias("j")))
    at = lambda order, i: F.substring(order, i * WIDE + 1, F.lit(WIDE))
    put = lambda order, number, i: F.overlay(order, number, i * WIDE + 1, F.lit(WIDE))
    return F.aggregate(swaps, whole, lambda a, s: put(put(a, at(a, s["j"]), s["i"]), at(a, s["i"]), s["j"]))


def numbers(order: Column, n: Column) -> Column:
    """A string of n numbers as an array of int."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: _number(order, i))


def write_shards(docs: DataFrame, shards: int, seed: int = 5, folder: str | None = None, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write all records into `shards` shards in a seeded random order; returns them as read back.

    The result has all columns of docs and shard int, slot long (gapless from 0 in each shard);
    columns of docs with these names are replaced, all others, whatever their names, stay. Files lie
    in folders shard=0, shard=1, ..., each in the order of slots. Records are scattered by a hash of
    seed, key and their place in the input, so equal rows and null or repeated keys spread like all
    others, and no group of them fills a bucket. An empty table gives empty shards. A text of any
    length moves as one record. Written again from the same files, the input gives the same order;
    a frame that may deal its rows differently when it is computed again must be written first.
    """
    spark = docs.sparkSession
    folder = folder or work_path(spark, "shards")
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    n, total = docs.agg(F.count("*"), F.coalesce(F.sum(record_size(text)), F.lit(0))).first()
    buckets = max(1, -(-total // bucket_bytes), -(-n // bucket_rows))
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    # A struct keeps the record's names apart from those used here.
    rows = docs.select(F.monotonically_increasing_id().alias("id"), F.col(key).alias("key"), F.struct(*[F.col(f"`{c}`") for c in own]).alias("record"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "key", "id"), F.lit(buckets)))
    # Buckets are numbered so that those of one task of pass two follow each other: its rows then
    # belong to one or two shards. Prefix sums: within tasks, then over tasks.
    task = F.pmod(F.hash("bucket"), F.lit(tasks))
    counts = rows.groupBy("bucket").agg(F.count("*").cast("int").alias("n")).withColumn("task", task)
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = counts.withColumn("inner", before(Window.partitionBy("task").orderBy("bucket")))
    outer = counts.groupBy("task").agg(F.sum("n").alias("n")).withColumn("outer", before(Window.orderBy("task"))).drop("n")
    orders = inner.join(outer, "task").select("bucket", (F.col("outer") + F.col("inner")).alias("base"), fisher_yates(F.col("n"), F.lit(seed), F.col("bucket")).alias("order"))
    turn = F.row_number().over(Window.partitionBy("bucket").orderBy("id")) - 1
    placed = rows.repartition(tasks, "bucket").withColumn("turn", turn).join(orders, "bucket").withColumn("place", F.col("base") + _number(F.col("order"), F.col("turn")))
    # Whole-number arithmetic: the shard s holds the places from ceil(s * n / shards) on.
    placed = placed.withColumn("shard", F.expr(f"cast(place * {shards}L div {max(1, n)}L as int)"))
    placed = placed.withColumn("slot", F.expr(f"place - (cast(shard as long) * {n}L + {shards - 1}L) div {shards}L"))
    fields = [F.col("record").getField(c).alias(c) for c in own]
    placed.sortWithinPartitions("shard", "slot").select(*fields, "shard", "slot").write.partitionBy("shard").parquet(folder)
    schema = T.StructType([*[f for f in docs.schema.fields if f.name in own], T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    return spark.read.schema(schema).parquet(folder)
