"""Pages as a stream: extraction is stateless, so each micro-batch is the batch job over new rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.catalog import catalog_local
from ..operators.dispatch import rejected
from ..operators.extract import extract
from ..operators.profiles import Site
from ..plans.sites import SITES
from ..schemas import PAGES


def page_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_ingest(pages: DataFrame, out: str, checkpoint: str, sites: Iterable[str | Site] | None = None) -> StreamingQuery:
    """Write local catalog rows to out/catalog and rejects to out/rejects, a folder for each batch. sites: as for extract.

    A batch that is tried again writes the same folder anew, so restarts leave no row twice.
    """

    chosen = SITES.chosen(sites)

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        catalog_local(extract(batch, chosen)).write.mode("overwrite").parquet(f"{out}/catalog/batch={number}")
        rejected(batch, [s.label for s in chosen]).write.mode("overwrite").parquet(f"{out}/rejects/batch={number}")
        batch.unpersist()

    return pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
