"""How services are asked: kept connections, requests in flight, tries with growing pauses.

A transport takes (url, payload, timeout) and returns the decoded answer. Connections belong to the
Python worker that opened them and outlive a batch; what a worker keeps is bounded by its requests in
flight. A request that fails in a way that may pass is sent again, so services must be idempotent,
which tasks that run again ask of them anyway.
"""

from __future__ import annotations

import http.client
import json
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
import zlib
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

Transport = Callable[[str, dict, float], dict]

#: Statuses that a later try may not meet again.
PASSING = {408, 425, 429, 500, 502, 503, 504}
_idle: dict[tuple[str, str], list[http.client.HTTPConnection]] = {}
_guard = threading.Lock()


def post(url: str, payload: dict, timeout: float) -> dict:
    """One request on a connection of its own. Raises on statuses from 400 on (urllib does) and on answers that aren't JSON."""
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.loads(answer.read())


def _send(connection: http.client.HTTPConnection, path: str, body: bytes) -> tuple[http.client.HTTPResponse, bytes]:
    connection.request("POST", path, body, {"Content-Type": "application/json"})
    answer = connection.getresponse()
    return answer, answer.read()


def pooled(url: str, payload: dict, timeout: float) -> dict:
    """As post, on a connection that earlier requests of this worker left open, if there is one.

    A kept connection may have been closed by the service meanwhile; then a new one is opened.
    """
    at = urllib.parse.urlsplit(url)
    key, body = (at.scheme, at.netloc), json.dumps(payload).encode()
    path = urllib.parse.urlunsplit(("", "", at.path or "/", at.query, ""))
    with _guard:
        connection = _idle[key].pop() if _idle.get(key) else None
    kind = http.client.HTTPSConnection if at.scheme == "https" else http.client.HTTPConnection
    try:
        if connection is not None:
            connection.timeout = timeout
            if connection.sock is not None:
                connection.sock.settimeout(timeout)
            try:
                answer, raw = _send(connection, path, body)
            except (ConnectionError, http.client.BadStatusLine, http.client.CannotSendRequest):
                connection.close()
                connection = None
        if connection is None:
            connection = kind(at.netloc, timeout=timeout)
            answer, raw = _send(connection, path, body)
    except BaseException:
        if connection is not None:
            connection.close()
        raise
    if answer.will_close:
        connection.close()
    else:
        with _guard:
            _idle.setdefault(key, []).append(connection)
    if answer.status >= 400:
        raise urllib.error.HTTPError(url, answer.status, answer.reason, answer.headers, None)
    return json.loads(raw)


def may_pass(e: Exception) -> bool:
    """Whether the same request may succeed later."""
    if isinstance(e, urllib.error.HTTPError):
        return e.code in PASSING
    return isinstance(e, OSError | http.client.HTTPException)  # URLError, timeouts and lost connections are OSErrors


@dataclass(frozen=True)
class Patient:
    """A transport that tries again: pauses double from `pause` seconds up to `longest`, all within `deadline` seconds.

    Pauses are shortened by up to half, by a hash of the request and the try, so that tasks don't come back at
    one time. A Retry-After in seconds is kept to. The last error is raised as it is.
    """

    transport: Transport = pooled
    tries: int = 4
    pause: float = 0.5
    longest: float = 30.0
    deadline: float = 900.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep

    def __call__(self, url: str, payload: dict, timeout: float) -> dict:
        start, seed = self.clock(), None
        for k in range(1, self.tries + 1):
            left = self.deadline - (self.clock() - start)
            try:
                return self.transport(url, payload, min(timeout, left))
            except Exception as e:
                if k == self.tries or not may_pass(e):
                    raise
                if seed is None:
                    seed = zlib.crc32(json.dumps(payload).encode())
                wait = min(self.longest, self.pause * 2 ** (k - 1)) * (1 - zlib.crc32(f"{seed} {k}".encode()) / 2**33)
                asked = (getattr(e, "headers", None) or {}).get("Retry-After", "")
                wait = max(wait, float(asked)) if asked.isdigit() else wait
                if self.clock() - start + wait >= self.deadline:
                    raise
                self.sleep(wait)
        raise ValueError("tries must be at least 1")


def in_flight(most: int, ask: Callable, items: Iterable[tuple]) -> Iterator:
    """ask(*item) for each, at most `most` at a time, in the order of the items.

    No more than `most` answers are held ahead of the one that is due; after an error nothing more is sent.
    """
    if most <= 1:
        yield from (ask(*x) for x in items)
        return
    with ThreadPoolExecutor(most) as pool:
        waiting: list = []
        try:
            for x in items:
                waiting.append(pool.submit(ask, *x))
                if len(waiting) >= most:
                    yield waiting.pop(0).result()
            while waiting:
                yield waiting.pop(0).result()
        finally:
            pool.shutdown(cancel_futures=True)
