import gc
import http.server
import threading
import time
import weakref
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarryline.plans.jobs import fetch_products
from quarryline.plans.queries import TEMPLATES
from quarryline.sources.crawl import Answer, crawl, host_of, slices
from quarryline.sources.pages import fetch_images, fetch_pages, placed


def recorder(seconds=lambda url: 0.01):
    """A fetcher whose calls are counted by host while they run."""
    lock, running, most, order = threading.Lock(), Counter(), Counter(), []

    def fetch(url):
        host = host_of(url)
        with lock:
            running[host] += 1
            order.append(host)
            most[host] = max(most[host], running[host])
            most["all"] = max(most["all"], sum(running.values()))
        time.sleep(seconds(url))
        with lock:
            running[host] -= 1
        return Answer(200, url.encode())

    return fetch, most, order


def test_hosts_take_turns():
    rows = [(i, f"http://big/{i}") for i in range(40)] + [(100 + i, f"http://h{i}/") for i in range(20)]
    fetch, most, order = recorder()
    got = list(crawl(rows, lambda: fetch, in_flight=4))
    assert sorted(r for r, _ in got) == rows and all(a.body == u.encode() for (_, u), a in got)
    assert most["all"] == 4 and all(most[f"h{i}"] == 1 for i in range(20)) and most["big"] == 1
    assert order.index("h19") < 40  # the small ones don't wait for the large one's end


def test_a_slow_host_holds_up_nobody():
    rows = [(i, f"http://{'slow' if i % 10 == 0 else f'h{i % 10}'}/{i}") for i in range(100)]
    fetch, _, _ = recorder(lambda url: 0.2 if "slow" in url else 0.001)
    seen = [host_of(u) for (_, u), _ in crawl(rows, lambda: fetch, in_flight=4)]
    assert len(seen) == 100 and "slow" not in seen[60:90]


def test_reads_ahead_only_so_far():
    taken = []

    def rows():
        for i in range(1000):
            taken.append(i)
            yield i, f"http://h{i % 50}/"

    it = crawl(rows(), lambda: lambda u: Answer(200, b""), in_flight=4, ahead=32)
    for _ in range(10):
        next(it)
    assert len(taken) <= 10 + 32 + 8
    it.close()


def test_sessions_are_kept_by_host():
    made = []

    def fetcher():
        seen = []
        made.append(seen)
        return lambda u: (seen.append(host_of(u)), Answer(200, b""))[1]

    list(crawl([(i, f"http://h{i % 3}/{i}") for i in range(30)], fetcher, in_flight=8))
    assert len(made) == 3 and all(len(set(s)) == 1 and len(s) == 10 for s in made)


def test_odd_rows():
    rows = [(1, None), (2, "nonsense"), (3, "http://[bad"), (4, None)]
    assert {k for (k, _), _ in crawl(rows, lambda: lambda u: Answer(error="no"))} == {1, 2, 3, 4}
    assert list(crawl([], lambda: lambda u: Answer())) == []
    with pytest.raises(ZeroDivisionError):
        list(crawl([(1, "http://a/")], lambda: lambda u: 1 / 0))


def test_bytes_held_are_bounded():
    live = weakref.WeakSet()
    lock, most = threading.Lock(), [0]

    class Held:
        def __init__(self, n):
            self.n = n

        def __len__(self):
            return self.n

    def fetch(url):
        with lock:
            live.add(body := Held(1 << 20))
            most[0] = max(most[0], len(live))
        return Answer(200, body)

    for part in slices(crawl([(i, f"http://h{i}/") for i in range(300)], lambda: fetch, in_flight=4), most_bytes=8 << 20):
        assert sum(len(a.body) for _, a in part) <= 9 << 20
        del part
        gc.collect()
    assert most[0] <= 8 + 2 * 4 + 1  # a slice, and what is in flight or has just landed, of 300


def test_slices_end_by_rows_too():
    assert [len(s) for s in slices((((i, "u"), Answer()) for i in range(10)), most_rows=4)] == [4, 4, 2]
    assert [len(s) for s in slices((((i, "u"), Answer(200, b"x" * 10)) for i in range(5)), most_bytes=20)] == [2, 2, 1]


def test_addresses_are_dealt_to_all_tasks(spark):
    """Ten thousand small addresses of forty hosts, and of one, with adaptive execution on."""
    for hosts, least in ((40, 24), (1, 10)):
        urls = spark.range(10_000).select(F.col("id").alias("page_id"), F.concat(F.lit("https://h"), (F.col("id") % hosts).cast("string"), F.lit(".com/"), F.col("id").cast("string")).alias("url"))
        sizes = [r["count"] for r in placed(urls, partitions=32).groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 10_000 and len(sizes) >= least and max(sizes) < 10_000 / 5
        assert "AQEShuffleRead" not in placed(urls, partitions=32)._jdf.queryExecution().executedPlan().toString()



def page(name, price, size, brand):
    return TEMPLATES["sottayon"][1].replace("%1$s", name).replace("%2$.2f", f"{price:.2f}").replace("%3$d", str(size)).replace("%4$s", brand)


class Proxy(http.server.BaseHTTPRequestHandler):
    """Serves every host, as a proxy does."""

    seen: Counter = Counter()

    def do_GET(self):
        self.seen[self.path] += 1
        path = self.path.rsplit("/", 1)[1]
        if self.path.endswith(".com/"):
            body = b""
        elif path == "big":
            body = b"x" * 3_000_000
        elif path.startswith("img"):
            body = b"\x89PNG" + path.encode() * 50_000
        else:
            body = page(f"name {path}", float(path), int(path), "ৎ").encode()
        self.send_response(404 if path == "13" else 200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *a):
        pass


@pytest.fixture
def proxy():
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Proxy)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    Proxy.seen.clear()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_fetch_products_of_a_supported_site(spark, proxy):
    """From addresses to records over the network: routing, warm-up, fetch, charset, extraction."""
    urls = [(i, f"http://sottayon.com/p/{i}") for i in range(1, 31)] + [(100, "http://unknown.com/1"), (101, None), (102, "http://sottayon.com/big")]
    got = {r["page_id"]: r for r in fetch_products(spark.createDataFrame(urls, "page_id long, url string"), backoff_s=0.01, proxy=proxy, partitions=4, max_bytes=1_000_000).collect()}
    assert set(got) == {*range(1, 31), 102}
    assert all((got[i]["product_name"], got[i]["price"], got[i]["stock_qty"], got[i]["ecommerce_description"]) == (f"name {i}", float(i), i, "ৎ") for i in range(1, 31) if i != 13)
    assert all(got[i]["product_name"] is None and got[i]["site"] == "sottayon" for i in (13, 102))
    assert not any("unknown" in u for u in Proxy.seen) and 1 <= Proxy.seen["http://sottayon.com/"] <= 4  # one visit of the home page a task


def test_images_come_in_slices(spark, proxy):
    records = spark.range(40).select(F.col("id").alias("page_id"), F.concat(F.lit("http://i"), (F.col("id") % 7).cast("string"), F.lit(".com/img"), F.col("id").cast("string")).alias("image_url"))
    got = fetch_images(records, backoff_s=0.01, proxy=proxy, partitions=2, slice_bytes=1_000_000).collect()
    assert {r["page_id"]: bytes(r["content"]) for r in got} == {i: b"\x89PNG" + f"img{i}".encode() * 50_000 for i in range(40)}
    none = fetch_images(records.limit(3), backoff_s=0.01, proxy=proxy, max_bytes=1000).collect()
    assert [r["content"] for r in none] == [None] * 3


def test_no_addresses(spark):
    assert fetch_pages(spark.createDataFrame([], "page_id long, url string")).count() == 0
