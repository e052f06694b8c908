"""The two jobs from end to end: addresses to product records, and records to a remote catalog."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from ..operators.catalog import catalog_remote
from ..operators.dispatch import supported
from ..operators.extract import extract
from ..sources.pages import fetch_images, fetch_pages
from ..sources.remote import push_remote
from .sites import SITES


def fetch_products(urls: DataFrame, sites: Iterable[str] | None = None, strict: bool = False, backoff_s: float = 1.0, warm_up: bool = True, **fetching) -> DataFrame:
    """Product records of a table of page_id and url; `fetching` goes to fetch_pages. Addresses of unknown sites aren't fetched; see dispatch.rejected."""
    chosen = SITES.chosen(sites)
    return extract(fetch_pages(supported(urls.select("page_id", "url"), [s.label for s in chosen]), backoff_s, warm_up, **fetching), chosen, strict)


def create_remote(records: DataFrame, url: str, database: str, user: str, secret: Callable[[], str], backoff_s: float = 1.0) -> DataFrame:
    """Create a remote product for each record, with its image where that can be had; returns page_id, remote_id, error. Runs at once."""
    return push_remote(catalog_remote(records, fetch_images(records, backoff_s=backoff_s)), url, database, user, secret, backoff_s=backoff_s)
