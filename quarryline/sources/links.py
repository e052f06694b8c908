"""Links of records to others (authors, publishers), of which whole sets are replaced record by record.

A table is a folder. Links lie in buckets by a hash of the record's key, and a manifest says for each
bucket which folder holds it. Replacing the sets of some records writes their buckets anew, next
to the old ones, and then the next manifest, in one rename: until it is there all readers see the
old state, so a write that fails or is tried again changes nothing, and of two that race one fails.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Folder


class LinkTable:
    """The links at a path; the number of buckets is fixed when the first set is written."""

    def __init__(self, spark: SparkSession, path: str, key: str = "wizard_id", other: str = "partner_id", buckets: int = 64):
        self.spark, self.key, self.other = spark, key, other
        self.folder = Folder(spark, path)
        self.buckets = self._manifest()[1].get("buckets", buckets)

    def _manifest(self) -> tuple[int, dict]:
        found = [n for n in self.folder.names() if n.startswith("manifest-")]
        return (int(found[-1][9:-5]), self.folder.read_json(found[-1])) if found else (0, {})

    @property
    def version(self) -> int:
        """0 for a table that was never written, then 1, 2, ..."""
        return self._manifest()[0]

    def _links(self, folders: list[str]) -> DataFrame:
        schema = f"{self.key} long, {self.other} long"
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder.path}/{f}" for f in folders))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def links(self) -> DataFrame:
        """key and other, one row for each link, as they are now; later writes don't change this frame."""
        return self._links(sorted(self._manifest()[1].get("folders", {}).values()))

    def sets(self) -> DataFrame:
        """key and ids (sorted) of every record that has links."""
        return self.links().groupBy(self.key).agg(F.array_sort(F.collect_list(self.other)).alias("ids"))

    def replace(self, given: DataFrame) -> int:
        """Replace the sets of the records in `given` (key, ids); returns the version that is made.

        Other records keep theirs. An empty ids clears a record's set, a null one leaves it. Where a
        key comes several times its sets are put together. Null keys, null ids in a set and repeated
        ids are left out. Only the buckets of the records given are read and written.
        """
        number, manifest = self._manifest()
        made = f"v{number + 1}-{uuid.uuid4().hex}"
        try:
            rows = given.where(F.col(self.key).isNotNull() & F.col("ids").isNotNull()).select(F.col(self.key).cast("long").alias(self.key), F.explode_outer(F.col("ids").cast("array<long>")).alias(self.other))
            rows.distinct().withColumn("bucket", self._bucket()).write.partitionBy("bucket").parquet(f"{self.folder.path}/{made}/given")
            touched = [n[7:] for n in self.folder.names(f"{made}/given") if n.startswith("bucket=")]
            if not touched:
                self.folder.delete(made)
                return number
            staged = self._links([f"{made}/given/bucket={b}" for b in touched])
            folders = manifest.get("folders", {})
            kept = self._links([folders[b] for b in touched if b in folders]).join(staged.select(self.key).distinct(), self.key, "left_anti")
            new = kept.unionByName(staged.where(F.col(self.other).isNotNull())).withColumn("bucket", self._bucket())
            new.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.folder.path}/{made}/links")
            full = {n[7:] for n in self.folder.names(f"{made}/links") if n.startswith("bucket=")}
            after = {b: f for b, f in folders.items() if b not in touched} | {b: f"{made}/links/bucket={b}" for b in full}
            self.folder.commit_json(f"manifest-{number + 1:012d}.json", {"buckets": self.buckets, "folders": after})
        except BaseException:
            self.folder.delete(made)
            raise
        self.folder.delete(f"{made}/given")
        return number + 1

    def vacuum(self, keep: int = 1) -> None:
        """Delete all that the last `keep` versions don't need. No write may run meanwhile."""
        manifests = [n for n in self.folder.names() if n.startswith("manifest-")]
        needed = {f for m in manifests[-keep:] for f in self.folder.read_json(m)["folders"].values()}
        for m in manifests[:-keep]:
            self.folder.delete(m)
        for version in (n for n in self.folder.names() if n.startswith("v")):
            buckets = [f"{version}/links/{b}" for b in self.folder.names(f"{version}/links")]
            for b in buckets:
                if b not in needed:
                    self.folder.delete(b)
            if not needed & set(buckets):
                self.folder.delete(version)
