"""A remote catalog by XML-RPC as a sink with commit and abort.

Tasks create products in batches, unpublished, and write down what they made; the driver's commit
publishes it, its abort deletes it. So a catalog's visitors see all of a job's products or none.
A product's key goes along as its default_code and is looked up before anything is created: a task
that is tried again finds what its first try made. A server that refuses a batch gets it in
halves, until the row that it refuses is alone; that row is reported and the others are made.
"""

from __future__ import annotations

import http.client
import json
import os
import time
import uuid
import xmlrpc.client
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import batched
from xml.parsers.expat import ExpatError

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .store import shared_path

#: Tries of a call that gets no usable answer, and products that one call publishes or deletes.
TRIES, MANY = 3, 1000
#: Products of one create, and characters of their texts and images, whichever is reached first.
BATCH_ROWS, BATCH_CHARS = 200, 8_000_000
#: What goes wrong on the way to a server, answers that are no XML among it; a Fault is its own answer.
TROUBLE = (OSError, http.client.HTTPException, ExpatError, xmlrpc.client.ProtocolError, xmlrpc.client.ResponseError)
REPORT = pa.schema([("key", pa.int64()), ("remote_id", pa.int64()), ("error", pa.string()), ("created", pa.bool_()), ("publish", pa.bool_())])


class RemoteError(Exception):
    """The remote catalog can't be reached or doesn't let us in."""


class _Once:
    """The standard transports send a request again when its answer is lost, and so might create twice; these don't."""

    def request(self, host, handler, body, verbose=False):
        return self.single_request(host, handler, body, verbose)


class _Plain(_Once, xmlrpc.client.Transport):
    pass


class _Safe(_Once, xmlrpc.client.SafeTransport):
    pass


class Remote:
    """One authenticated connection to the products of a catalog."""

    def __init__(self, url: str, database: str, user: str, word: str, backoff_s: float = 1.0):
        self.database, self.word, self.backoff = database, word, backoff_s
        server = lambda path: xmlrpc.client.ServerProxy(f"{url}/xmlrpc/2/{path}", transport=_Safe() if url.startswith("https:") else _Plain(), allow_none=True)
        self.models = server("object")
        try:
            self.user = self.tried(lambda: server("common").authenticate(database, user, word, {}))
        except xmlrpc.client.Fault as e:
            raise RemoteError(e.faultString) from e
        if not self.user:
            raise RemoteError("authentication failed")

    def tried(self, call: Callable[[], object]):
        for attempt in range(TRIES):
            if attempt:
                time.sleep(self.backoff * 2 ** (attempt - 1))
            try:
                return call()
            except TROUBLE as e:
                error = e
        raise RemoteError(f"{type(error).__name__}: {error}")

    def call(self, method: str, *args):
        return self.models.execute_kw(self.database, self.user, self.word, "product.template", method, list(args))

    def known(self, codes: list[str]) -> dict[str, int]:
        """Ids of products by default_code, of the first made where there are several."""
        rows = self.call("search_read", [["default_code", "in", codes]], ["default_code"])
        return {r["default_code"]: r["id"] for r in sorted(rows, key=lambda r: -r["id"])}

    def ensure(self, products: dict[str, dict]) -> dict[str, tuple[int | None, str | None, bool]]:
        """id, error and whether it was created of each product by code; what is there already is left as it is."""
        there: dict[str, int] = {}
        created: set[str] = set()
        looked = False

        def make() -> None:
            nonlocal looked
            there.update(self.known(list(products)))  # anew at each try: an answer that was lost may have made some
            looked = True
            lacking = [c for c in products if c not in there]
            if lacking:
                ids = self.call("create", [products[c] | {"default_code": c, "is_published": False} for c in lacking])
                if not isinstance(ids, list) or len(ids) != len(lacking):
                    raise xmlrpc.client.ResponseError(f"{len(lacking)} products created, answered with {ids!r:.80}")
                there.update(zip(lacking, ids, strict=True))
                created.update(lacking)

        try:
            self.tried(make)
        except RemoteError as e:
            return {c: (there.get(c), None if c in there else str(e), c in created) for c in products}
        except xmlrpc.client.Fault as e:
            if len(products) == 1 or not looked:
                return {c: (None, e.faultString, False) for c in products}
            codes = list(products)
            half = len(codes) // 2
            return self.ensure({c: products[c] for c in codes[:half]}) | self.ensure({c: products[c] for c in codes[half:]})
        return {c: (i, None, c in created) for c, i in there.items()}

    def delete(self, ids: Iterable[int]) -> None:
        for some in batched(ids, MANY):
            self.tried(lambda some=some: self.call("unlink", list(some)))

    def publish(self, ids: Iterable[int]) -> None:
        for some in batched(ids, MANY):
            self.tried(lambda some=some: self.call("write", list(some), {"is_published": True}))


@dataclass
class _Made(WriterCommitMessage):
    part: str


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: T.StructType, secret: Callable[[], str]):
        self.options, self.names, self.secret = options, schema.names, secret
        self.key = options.get("key", "page_id")
        self.report = options["report"].rstrip("/")
        self.strict = options.get("errors", "report") == "fail"
        if self.key not in self.names:
            raise ValueError(f"no column {self.key}")

    def _connect(self) -> Remote:
        o = self.options
        return Remote(o["url"], o["database"], o["user"], self.secret(), float(o.get("backoffSeconds", "1")))

    def _batches(self, rows: Iterator) -> Iterator[list[dict]]:
        batch: list[dict] = []
        chars, most = 0, int(self.options.get("batchRows", BATCH_ROWS))
        for row in rows:
            values = dict(zip(self.names, row, strict=True))
            batch.append(values)
            chars += sum(len(v) for v in values.values() if isinstance(v, str))
            if len(batch) >= most or chars >= BATCH_CHARS:
                yield batch
                batch, chars = [], 0
        if batch:
            yield batch

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        out: list[dict] = []
        remote, refused = None, None
        try:
            remote = self._connect()
        except RemoteError as e:
            refused = str(e)
        try:
            for batch in self._batches(iterator):
                keyed = {f"page-{r[self.key]}": {c: v for c, v in r.items() if c != self.key and v is not None} for r in reversed(batch) if r[self.key] is not None}
                done = remote.ensure(keyed) if remote and keyed else {}
                for r in batch:
                    made, error, created = done.get(f"page-{r[self.key]}", (None, refused or "no key", False))
                    out.append({"key": r[self.key], "remote_id": made, "error": error, "created": created, "publish": bool(r.get("is_published"))})
                if self.strict and (wrong := next((r for r in out[-len(batch) :] if r["error"]), None)):
                    raise RemoteError(f"row {wrong['key']}: {wrong['error']}")
        except BaseException:
            if remote:
                _try(lambda: remote.delete({r["remote_id"] for r in out if r["created"]}))
            raise
        task = TaskContext.get()
        part = f"{self.report}/part-{task.partitionId() if task else 0:05d}-{uuid.uuid4().hex}.parquet"
        files, path = fs.FileSystem.from_uri(part)
        files.create_dir(os.path.dirname(path), recursive=True)
        pq.write_table(pa.Table.from_pylist(out, REPORT), path, filesystem=files)
        return _Made(part)

    def _parts(self, messages: list[WriterCommitMessage | None]) -> Iterator[pa.Table]:
        """What the tasks wrote down, a task at a time."""
        for m in messages:
            if m is not None:
                files, path = fs.FileSystem.from_uri(m.part)
                yield pq.read_table(path, filesystem=files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        remote = None
        for part in self._parts(messages):
            ids = {r["remote_id"] for r in part.to_pylist() if r["publish"] and r["remote_id"] is not None}
            if ids:
                remote = remote or self._connect()
                remote.publish(sorted(ids))
        files, path = fs.FileSystem.from_uri(f"{self.report}/committed.json")
        files.create_dir(os.path.dirname(path), recursive=True)
        with files.open_output_stream(path) as f:
            f.write(json.dumps([m.part for m in messages if m is not None]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Delete what tasks that ended well had made; those that failed have done so themselves."""
        remote = None
        for part in self._parts(messages):
            ids = {r["remote_id"] for r in part.to_pylist() if r["created"]}
            if ids:
                remote = remote or self._connect()
                _try(lambda ids=ids: remote.delete(sorted(ids)))


def _try(call: Callable[[], None]) -> None:
    """Tidying up after a failure, which must not hide it."""
    try:
        call()
    except (RemoteError, xmlrpc.client.Fault):
        pass


class RemoteCatalog(DataSource):
    """df.write.format("catalog_rpc"): url, database, user, report (a folder that all machines share), key, batchRows, errors, backoffSeconds.

    The password is read in the tasks, from the variable of their environment that secretEnv names.
    """

    @classmethod
    def name(cls) -> str:
        return "catalog_rpc"

    def secret(self) -> Callable[[], str]:
        variable = self.options.get("secretEnv", "CATALOG_SECRET")
        return lambda: os.environ[variable]

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a remote catalog can only be appended to")
        return _Writer(dict(self.options), schema, self.secret())


def push_remote(rows: DataFrame, url: str, database: str, user: str, secret: Callable[[], str], key: str = "page_id", batch_rows: int = BATCH_ROWS, errors: str = "report", backoff_s: float = 1.0) -> DataFrame:
    """Create a remote product for each row, now; returns key, remote_id, error as a table that can be read again and again.

    Rows without a key aren't sent. A key that comes twice in a batch is created once, from its first
    row. A row that fails is reported; with errors="fail" the job fails instead, and what it made is
    deleted. secret is called in the tasks and is part of no plan, table or option. Where tasks are
    run twice at once (speculation) two of them may create the same product.
    """

    class WithSecret(RemoteCatalog):
        def secret(self) -> Callable[[], str]:
            return secret

    spark = rows.sparkSession
    report = shared_path(spark, "remote")
    spark.dataSource.register(WithSecret)
    options = {"url": url, "database": database, "user": user, "key": key, "report": report, "batchRows": str(batch_rows), "errors": errors, "backoffSeconds": str(backoff_s)}
    rows.write.format("catalog_rpc").options(**options).mode("append").save()
    files, path = fs.FileSystem.from_uri(f"{report}/committed.json")
    with files.open_input_stream(path) as f:
        parts = json.loads(f.read())
    schema = "key long, remote_id long, error string"
    made = spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
    return made.withColumnRenamed("key", key)
