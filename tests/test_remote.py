import http.server
import threading
import xmlrpc.client
import xmlrpc.server

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quarryline.plans.jobs import create_remote
from quarryline.sources import remote
from quarryline.sources.remote import RemoteCatalog, push_remote


class Catalog:
    """A stub of a remote catalog: products by id, and the calls that were made."""

    def __init__(self):
        self.products, self.calls, self.garbage, self.lose = {}, [], 0, 0

    def execute_kw(self, db, user, word, model, method, args):
        assert (db, user, word, model) == ("d", 7, "w", "product.template")
        self.calls.append(method)
        if method == "search_read":
            ((_, op, codes),) = args[0]
            return [{"id": i, "default_code": p["default_code"]} for i, p in self.products.items() if p["default_code"] in codes]
        if method == "create":
            for p in args[0]:
                if p.get("name") == "bad":
                    raise xmlrpc.client.Fault(1, "bad name")
            ids = []
            for p in args[0]:
                ids.append(len(self.products) + 1 + sum(m == "unlink" for m in self.calls) * 1000)
                self.products[ids[-1]] = dict(p)
            return ids
        for i in args[0]:
            if method == "unlink":
                self.products.pop(i)
            else:
                self.products[i] |= args[1]
        return True


@pytest.fixture
def catalog():
    stub = Catalog()

    class Handler(xmlrpc.server.SimpleXMLRPCRequestHandler):
        rpc_paths = ("/xmlrpc/2/common", "/xmlrpc/2/object")

        def do_POST(self):
            if stub.garbage:
                stub.garbage -= 1
                self.send_response(200)
                self.end_headers()
                self.wfile.write(b"<html>no XML-RPC & broken")
                return
            super().do_POST()

        def send_header(self, *a):
            if stub.lose and self.path.endswith("object") and stub.calls[-1:] == ["create"]:  # created, but the answer is lost
                stub.lose -= 1
                self.connection.close()
                raise ConnectionResetError
            super().send_header(*a)

        def log_message(self, *a):
            pass

    s = xmlrpc.server.SimpleXMLRPCServer(("127.0.0.1", 0), requestHandler=Handler, logRequests=False, allow_none=True)
    s.handle_error = lambda *a: None
    s.register_function(stub.execute_kw)
    s.register_function(lambda db, user, word, _: 7 if word == "w" else False, "authenticate")
    threading.Thread(target=s.serve_forever, daemon=True).start()
    stub.url = f"http://127.0.0.1:{s.server_address[1]}"
    yield stub
    s.shutdown()


def push(rows, catalog, word="w", **kw):
    return push_remote(rows, catalog.url, "d", "u", lambda: word, backoff_s=0.01, **kw)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id long, name string, list_price double, is_published boolean")


def test_rows_are_created_and_published(spark, catalog):
    rows = frame(spark, (1, "a", 1.0, True), (2, "b", None, True), (3, "c", 2.0, False), (None, "d", 1.0, True), (2, "twice", 1.0, True)).coalesce(1)
    out = push(rows, catalog)
    by = {p["default_code"]: p | {"id": i} for i, p in catalog.products.items()}
    want = [(k, by[f"page-{k}"]["id"], None) for k in (1, 2, 2, 3)] + [(None, None, "no key")]
    assert sorted(((r["page_id"], r["remote_id"], r["error"]) for r in out.collect()), key=str) == sorted(want, key=str)
    assert set(by) == {"page-1", "page-2", "page-3"} and "list_price" not in by["page-2"] and by["page-2"]["name"] == "b"
    assert [by[f"page-{k}"]["is_published"] for k in (1, 2, 3)] == [True, True, False]
    calls = len(catalog.calls)
    assert out.count() == 5 and len(catalog.calls) == calls  # reading the report makes no call
    assert {r["remote_id"] for r in push(rows, catalog).collect()} == {r["remote_id"] for r in out.collect()}  # a second run finds what the first made
    assert len(catalog.products) == 3


def test_a_thousand_rows_in_few_calls(spark, catalog):
    rows = spark.range(1000).select(F.col("id").alias("page_id"), F.lit("n").alias("name"), F.lit(True).alias("is_published")).repartition(2)
    assert push(rows, catalog).where("error is null").count() == 1000 == len(catalog.products)
    assert len(catalog.calls) <= 2 * 2 * 3 + 2 and all(p["is_published"] for p in catalog.products.values())


def test_a_refused_row_is_alone(spark, catalog):
    rows = frame(spark, *((i, "bad" if i in (5, 17) else "ok", 1.0, True) for i in range(40))).coalesce(1)
    got = {r["page_id"]: (r["remote_id"] is None, r["error"]) for r in push(rows, catalog).collect()}
    assert {k for k, v in got.items() if v != (False, None)} == {5, 17} and got[5] == (True, "bad name") and len(catalog.products) == 38


def test_answers_that_are_no_xml(spark, catalog):
    rows = frame(spark, (1, "a", 1.0, True)).coalesce(1)
    catalog.garbage = remote.TRIES - 1
    assert [r["error"] for r in push(rows, catalog).collect()] == [None]
    catalog.garbage = 1000
    (row,) = push(frame(spark, (2, "b", 1.0, True)), catalog).collect()
    assert row["remote_id"] is None and "ExpatError" in row["error"]


def test_wrong_password(spark, catalog):
    assert {r["error"] for r in push(frame(spark, (1, "a", 1.0, True)), catalog, "x").collect()} == {"authentication failed"} and not catalog.products


def test_a_lost_answer_makes_no_second_product(spark, catalog):
    catalog.lose = 1
    (row,) = push(frame(spark, (1, "a", 1.0, True)), catalog).collect()
    assert row["error"] is None and len(catalog.products) == 1


def writer(catalog, tmp_path, **options):
    source = RemoteCatalog({"url": catalog.url, "database": "d", "user": "u", "report": f"file://{tmp_path}/r", "backoffSeconds": "0.01", "secretEnv": "TEST_SECRET", **options})
    from pyspark.sql.types import StructType

    return source.writer(StructType.fromDDL("page_id long, name string, is_published boolean"), False)


def test_a_task_that_runs_again(catalog, tmp_path, monkeypatch):
    """The first try dies after its first batch; the second finds nothing of it, or all of it if it couldn't tidy up."""
    monkeypatch.setenv("TEST_SECRET", "w")
    rows = [Row(i, "n", True) for i in range(10)]

    def dying():
        yield from rows[:6]
        raise RuntimeError("lost executor")

    for tidy in (True, False):
        catalog.products.clear()
        w = writer(catalog, tmp_path, batchRows="3")
        with monkeypatch.context() as m:
            if not tidy:
                m.setattr(remote.Remote, "delete", lambda *a: None)
            with pytest.raises(RuntimeError):
                w.write(dying())
        assert len(catalog.products) == (0 if tidy else 6)
        message = w.write(iter(rows))
        assert len(catalog.products) == 10 and not any(p["is_published"] for p in catalog.products.values())
        w.commit([message])
        assert all(p["is_published"] for p in catalog.products.values())


def test_abort_deletes_what_was_made(spark, catalog, tmp_path, monkeypatch):
    monkeypatch.setenv("TEST_SECRET", "w")
    w = writer(catalog, tmp_path)
    old = w.write(iter([Row(0, "old", True)]))
    w.commit([old])
    message = w.write(iter([Row(0, "old", True), Row(1, "new", True)]))
    w.abort([message, None])
    assert [p["name"] for p in catalog.products.values()] == ["old"]  # what was there before stays
    # A whole job that is to fail with its first refused row.
    rows = frame(spark, *((i, "bad" if i == 30 else "ok", 1.0, True) for i in range(10, 40))).repartition(3)
    with pytest.raises(Exception, match="bad name"):
        push(rows, catalog, errors="fail")
    assert [p["name"] for p in catalog.products.values()] == ["old"]


def test_records_with_images(spark, catalog):
    class Images(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"\x89PNG")

        def log_message(self, *a):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Images)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    records = spark.createDataFrame([(9, "n", 1.5, 2.0, "d", f"http://127.0.0.1:{s.server_port}/i"), (10, "m", 1.5, 2.0, "d", None)], "page_id long, product_name string, price double, face_value double, ecommerce_description string, image_url string")
    assert {r["page_id"] for r in create_remote(records, catalog.url, "d", "u", lambda: "w", 0.01).where("remote_id is not null").collect()} == {9, 10}
    by = {p["name"]: p for p in catalog.products.values()}
    assert by["n"]["image_1920"] == "iVBORw==" and by["n"]["standard_price"] == 1.5 and "image_1920" not in by["m"] and by["m"]["is_published"]
    s.shutdown()


def test_no_rows(spark, catalog):
    assert push(frame(spark), catalog).count() == 0 and not catalog.products
