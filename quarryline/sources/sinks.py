"""Where catalog rows go: tables here, links in links.py, a remote catalog in remote.py."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .links import LinkTable


def append_catalog(rows: DataFrame, path: str) -> None:
    """Append rows to a catalog; nothing is merged or dropped."""
    rows.write.mode("append").parquet(path)


def replace_links(links: DataFrame, path: str, key: str = "wizard_id") -> int:
    """Replace the sets (ids) of the records given; those of other records stay. See links.LinkTable."""
    return LinkTable(links.sparkSession, path, key).replace(links)
