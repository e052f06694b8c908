import http.server
import threading

import pytest
from pyspark.sql import functions as F

from quarryline.plans.jobs import fetch_products
from quarryline.plans.queries import generated_pages
from quarryline.schemas import PAGES
from quarryline.sources.pages import HttpPages, Session, fetch_images, fetch_pages, read_images, read_pages
from quarryline.sources.sinks import append_catalog
from quarryline.streaming.ingest import page_stream, run_ingest


class Handler(http.server.BaseHTTPRequestHandler):
    seen: dict = {}

    def do_GET(self):
        n = self.seen[self.path] = self.seen.get(self.path, 0) + 1
        if self.path == "/":
            self.send_response(200)
            self.send_header("Set-Cookie", "visit=yes; Path=/")
            self.end_headers()
            return
        if self.path == "/latin":  # only for those who have been at the home page, as a browser
            known = "visit=yes" in self.headers.get("Cookie", "") and "Chrome" in self.headers["User-Agent"]
            self.send_response(200 if known else 403)
            self.send_header("Content-Type", "text/html; charset=iso-8859-1")
            self.end_headers()
            self.wfile.write("<h1>é</h1>".encode("latin-1"))
            return
        if self.path in ("/image", "/created"):
            self.send_response(200 if self.path == "/image" else 201)
            self.end_headers()
            self.wfile.write(b"\x89PNG")
            return
        ok = self.path == "/ok" or (self.path == "/flaky" and n > 1)
        self.send_response(200 if ok else 503 if self.path == "/flaky" else 404)
        self.end_headers()
        self.wfile.write("<h1>ৎ</h1>".encode())

    def log_message(self, *a):
        pass


@pytest.fixture
def server():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_http_pages(spark, server):
    spark.dataSource.register(HttpPages)
    urls = "\n".join(f"{server}/{p}" for p in ("ok", "flaky", "gone"))
    rows = spark.read.format("http_pages").option("urls", urls).option("backoffSeconds", "0.01").load().orderBy("page_id").collect()
    assert [r["html"] for r in rows] == ["<h1>ৎ</h1>", "<h1>ৎ</h1>", None]


def test_session_keeps_cookies(spark, server):
    Handler.seen.clear()
    urls = [(i, f"{server}/{p}") for i, p in enumerate(("latin", "ok", "flaky", "gone"))] + [(4, None), (5, "nonsense"), (6, "http://[bad")]
    df = spark.createDataFrame(urls, "page_id long, url string").withColumn("extra", F.lit(1))
    got = {r["page_id"]: r["html"] for r in fetch_pages(df.coalesce(1), backoff_s=0.01).collect()}
    assert got == {0: "<h1>é</h1>", 1: "<h1>ৎ</h1>", 2: "<h1>ৎ</h1>", 3: None, 4: None, 5: None, 6: None}
    assert Handler.seen["/flaky"] == 2 and Handler.seen["/gone"] == 1
    session = Session(0.01)
    assert [session.page(f"{server}/latin") for _ in range(3)] == ["<h1>é</h1>"] * 3
    Handler.seen.clear()
    assert Session(0.01, warm_up=False).get(f"{server}/latin")[0] == 403 and "/" not in Handler.seen


def test_images(spark, server, tmp_path):
    rows = spark.createDataFrame([(1, f"{server}/image"), (2, f"{server}/created"), (3, f"{server}/gone"), (4, None)], "page_id long, image_url string")
    got = {r["page_id"]: r["content"] for r in fetch_images(rows, backoff_s=0.01).collect()}
    assert {k: v and bytes(v) for k, v in got.items()} == {1: b"\x89PNG", 2: None, 3: None, 4: None}
    (tmp_path / "a.png").write_bytes(b"abc")
    assert [bytes(r["content"]) for r in read_images(spark, str(tmp_path)).collect()] == [b"abc"]


def test_unknown_sites_are_not_fetched(spark, server):
    Handler.seen.clear()
    urls = spark.createDataFrame([(1, f"{server}/ok")], "page_id long, url string")
    assert fetch_products(urls, backoff_s=0.01).count() == 0 and not Handler.seen


def test_read_pages(spark, sf):
    assert read_pages(spark, f"{sf}/pages.parquet").schema.names == PAGES.names


def test_append(spark, tmp_path):
    df = spark.range(3)
    append_catalog(df, str(tmp_path / "c"))
    append_catalog(df, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 6


def test_stream(spark, sf, tmp_path):
    pages = generated_pages(spark, sf, "sottayon").selectExpr("page_id", "url", "html", "cast(null as string) html_specs")
    pages.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        run_ingest(page_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/catalog")).count() == pages.count()
    run_ingest(page_stream(spark, str(tmp_path / "in")), str(tmp_path / "two"), str(tmp_path / "cp2"), ["pbs"]).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "two/catalog")).count() == 0 and spark.read.parquet(str(tmp_path / "two/rejects")).count() == pages.count()
