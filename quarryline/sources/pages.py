"""Where pages and images come from: tables of fetched pages, files, or the network."""

from __future__ import annotations

import http.client
import http.cookiejar
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..schemas import PAGES
from .crawl import AHEAD, IN_FLIGHT, MAX_BYTES, SLICE_BYTES, Answer, crawl, slices
from .encoding import decoded

#: Tasks that fetch from one host, at most.
HOST_TASKS = 16
#: Statuses worth another try, tries, seconds that a host's first page and a page may take, and a browser's headers.
RETRY_STATUS, TRIES, WARM_UP_S, TIMEOUT_S = (429, 500, 502, 503, 504), 3, 10, 15
HEADERS = {
    "User-Agent": "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36",
    "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8",
    "Accept-Language": "en-US,en;q=0.9",
}


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A table of fetched pages; html_specs is null where the table lacks it."""
    pages = spark.read.parquet(path)
    return pages.select(*[F.col(f.name).cast(f.dataType) if f.name in pages.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in PAGES.fields])


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path and content of image files, for a join with what names them."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


class Session:
    """One browser-like session: cookies are kept, and each host's home page is asked for once before its other pages."""

    def __init__(self, backoff_s: float = 1.0, warm_up: bool = True, max_bytes: int = MAX_BYTES, proxy: str | None = None):
        by_proxy = [urllib.request.ProxyHandler({"http": proxy, "https": proxy})] if proxy else []
        self.opener = urllib.request.build_opener(urllib.request.HTTPCookieProcessor(http.cookiejar.CookieJar()), *by_proxy)
        self.opener.addheaders = list(HEADERS.items())
        self.backoff, self.warm_up, self.max_bytes, self.known = backoff_s, warm_up, max_bytes, set()

    def _warm(self, url: str) -> None:
        parts = urllib.parse.urlsplit(url)
        home = f"{parts.scheme}://{parts.netloc}/"
        if self.warm_up and home not in self.known:
            self.known.add(home)
            try:
                self.opener.open(home, timeout=WARM_UP_S).close()
            except (OSError, ValueError, http.client.HTTPException):
                pass

    def get(self, url: str | None) -> Answer:
        """One GET with retries; never raises. A body of more than max_bytes is an error."""
        if not url:
            return Answer(error="no address")
        try:
            self._warm(url)
        except ValueError as e:
            return Answer(error=str(e))
        status, error = None, None
        for attempt in range(TRIES + 1):
            if attempt:
                time.sleep(self.backoff * 2 ** (attempt - 1))
            try:
                with self.opener.open(url, timeout=TIMEOUT_S) as r:
                    body = r.read(self.max_bytes + 1)
                    if len(body) > self.max_bytes:
                        return Answer(r.status, error=f"more than {self.max_bytes} bytes")
                    return Answer(r.status, body, r.headers.get_content_charset())
            except urllib.error.HTTPError as e:
                status, error = e.code, str(e)
                if e.code not in RETRY_STATUS:
                    break
            except (OSError, ValueError, http.client.HTTPException) as e:
                status, error = None, str(e)
        return Answer(status, error=error)

    def page(self, url: str | None) -> str | None:
        """A page's text, null where the fetch failed; see encoding.decoded."""
        answer = self.get(url)
        return None if answer.body is None else decoded(answer.body, answer.charset)


def placed(addresses: DataFrame, url: str = "url", partitions: int | None = None) -> DataFrame:
    """Addresses dealt to a fixed number of tasks: those of a host to a few, those of many hosts to all, in no order of hosts.

    A number that is given stays: adaptive execution would merge the few bytes of many addresses into
    one task, and it is the waiting that takes time.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    spread = F.pmod(F.xxhash64(url), F.lit(HOST_TASKS))
    return addresses.repartition(partitions or 4 * addresses.sparkSession.sparkContext.defaultParallelism, host, spread).sortWithinPartitions(F.xxhash64(url))


def _fetched(addresses: DataFrame, columns: dict[str, pa.DataType], schema, make: Callable[[list], list[pa.Array]], session: Callable[[], Session], in_flight: int, slice_bytes: int) -> DataFrame:
    """addresses (key, url) with what was made of each slice of answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for part in slices(crawl(rows, lambda: session().get, in_flight, AHEAD), slice_bytes):
            made = make(part)
            del part
            yield pa.RecordBatch.from_arrays([a.cast(k) for a, k in zip(made, columns.values(), strict=True)], names=list(columns))

    return addresses.mapInArrow(run, schema)


def fetch_pages(urls: DataFrame, backoff_s: float = 1.0, warm_up: bool = True, partitions: int | None = None, in_flight: int = IN_FLIGHT, max_bytes: int = MAX_BYTES, slice_bytes: int = SLICE_BYTES, proxy: str | None = None) -> DataFrame:
    """PAGES for a table of page_id and url; html is null where a fetch failed or a page has more than max_bytes.

    Each task fetches in_flight pages at once, one a host, and keeps a session (cookies, one visit of
    the home page) for each host. See placed and crawl for how work is dealt and what a task holds.
    proxy is the address of an HTTP proxy, where pages aren't fetched directly.
    """

    def make(part: list) -> list[pa.Array]:
        html = [None if a.body is None else decoded(a.body, a.charset) for _, a in part]
        return [pa.array([r[0] for r, _ in part], pa.int64()), pa.array([r[1] for r, _ in part], pa.string()), pa.array(html, pa.string()), pa.nulls(len(part), pa.string())]

    rows = placed(urls.select(F.col("page_id").cast("long").alias("page_id"), "url"), partitions=partitions)
    kinds = {"page_id": pa.int64(), "url": pa.string(), "html": pa.string(), "html_specs": pa.string()}
    return _fetched(rows, kinds, PAGES, make, lambda: Session(backoff_s, warm_up, max_bytes, proxy), in_flight, slice_bytes)


def fetch_images(records: DataFrame, key: str = "page_id", url: str = "image_url", backoff_s: float = 1.0, partitions: int | None = None, in_flight: int = IN_FLIGHT, max_bytes: int = MAX_BYTES, slice_bytes: int = SLICE_BYTES, proxy: str | None = None) -> DataFrame:
    """key and content (binary) of the images that records name; content is null for any status but 200 and beyond max_bytes."""

    def make(part: list) -> list[pa.Array]:
        return [pa.array([r[0] for r, _ in part], pa.int64()), pa.array([a.body if a.status == 200 else None for _, a in part], pa.binary())]

    rows = placed(records.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url")), partitions=partitions)
    got = _fetched(rows, {"key": pa.int64(), "content": pa.binary()}, "key long, content binary", make, lambda: Session(backoff_s, False, max_bytes, proxy), in_flight, slice_bytes)
    return got.withColumnRenamed("key", key)


class _Urls(InputPartition):
    def __init__(self, rows: list[tuple[int, str]]):
        self.rows = rows


class _PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = [u for u in options.get("urls", "").split("\n") if u]
        self.each = int(options.get("urlsPerTask", "50"))
        self.warm_up = options.get("warmUp", "true").lower() == "true"
        self.backoff = float(options.get("backoffSeconds", "1"))

    def partitions(self):
        rows = list(enumerate(self.urls))
        return [_Urls(rows[i : i + self.each]) for i in range(0, len(rows), self.each)] or [_Urls([])]

    def read(self, partition) -> Iterator[tuple]:
        for (i, url), a in crawl(partition.rows, lambda: Session(self.backoff, self.warm_up).get):
            yield i, url, None if a.body is None else decoded(a.body, a.charset), None


class HttpPages(DataSource):
    """spark.read.format("http_pages").option("urls", one per line): pages as PAGES, html null where a fetch failed.

    For a handful of addresses; fetch_pages takes a table of them.
    """

    @classmethod
    def name(cls) -> str:
        return "http_pages"

    def schema(self) -> StructType:
        return PAGES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PageReader(dict(self.options))
