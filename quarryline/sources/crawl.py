"""Several fetches in flight in one task, fair to hosts, with a bound on what is held.

Addresses wait in a queue for each host, hosts take turns, and a host has one request at a time, so
a slow host holds up nobody else and no host is pressed. Rows come as they are answered. What is in
memory at once: the addresses that were read ahead, an answer for each fetch in flight, and the
slice that is being filled, which ends when it has enough bytes.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from typing import NamedTuple
from urllib.parse import urlsplit

#: Fetches in flight and addresses read ahead in a task, and hosts whose sessions it remembers.
IN_FLIGHT, AHEAD, SESSIONS = 8, 512, 256
#: Bytes of a body, at most, and bytes and rows of a slice. A task holds (IN_FLIGHT + 1) * MAX_BYTES + SLICE_BYTES = 160 MB of bodies at most.
MAX_BYTES, SLICE_BYTES, SLICE_ROWS = 16 << 20, 16 << 20, 256


class Answer(NamedTuple):
    """Of one fetch: status, body and charset, or what went wrong."""

    status: int | None = None
    body: bytes | None = None
    charset: str | None = None
    error: str | None = None


def host_of(url: str | None) -> str:
    try:
        return urlsplit(url or "").netloc.lower()
    except ValueError:
        return ""


def crawl(rows: Iterable[tuple], fetcher: Callable[[], Callable[[str | None], Answer]], in_flight: int = IN_FLIGHT, ahead: int = AHEAD) -> Iterator[tuple[tuple, Answer]]:
    """(row, answer) for rows of (key, url). fetcher makes what fetches from one host; it serves one address at a time."""
    rows = iter(rows)
    queues: dict[str, deque] = {}
    turns: deque[str] = deque()  # hosts with a queue and nothing in flight
    flying: dict[Future, tuple[str, tuple, Callable]] = {}
    idle: OrderedDict[str, Callable] = OrderedDict()
    waiting, more = 0, True
    with ThreadPoolExecutor(in_flight) as pool:
        try:
            while True:
                while more and waiting < ahead:
                    if (row := next(rows, None)) is None:
                        more = False
                        break
                    host = host_of(row[1])
                    if host not in queues:
                        queues[host] = deque()
                        turns.append(host)
                    queues[host].append(row)
                    waiting += 1
                while turns and len(flying) < in_flight:
                    host = turns.popleft()
                    row = queues[host].popleft()
                    waiting -= 1
                    fetch = idle.pop(host, None) or fetcher()
                    flying[pool.submit(fetch, row[1])] = host, row, fetch
                if not flying:
                    return
                for future in wait(flying, return_when=FIRST_COMPLETED).done:
                    host, row, fetch = flying.pop(future)
                    idle[host] = fetch
                    if len(idle) > SESSIONS:
                        idle.popitem(last=False)
                    if queues[host]:
                        turns.append(host)
                    else:
                        del queues[host]
                    yield row, future.result()
        finally:
            for future in flying:
                future.cancel()


def slices(answers: Iterable[tuple[tuple, Answer]], most_bytes: int = SLICE_BYTES, most_rows: int = SLICE_ROWS) -> Iterator[list[tuple[tuple, Answer]]]:
    """Answers in lists that end with the one that reaches most_bytes or most_rows."""
    held: list[tuple[tuple, Answer]] = []
    size = 0
    for row, answer in answers:
        held.append((row, answer))
        size += len(answer.body or b"")
        del row, answer
        if size >= most_bytes or len(held) >= most_rows:
            yield held
            held, size = [], 0
    if held:
        yield held
