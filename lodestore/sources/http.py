"""JSON over HTTP with an injectable transport, so that clients run without a network in tests."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

Transport = Callable[["Request"], "Response"]


@dataclass(frozen=True)
class Request:
    method: str
    url: str
    headers: dict
    body: bytes | None
    timeout: float


@dataclass
class Response:
    status: int
    lines: Iterator[bytes]

    def read(self) -> bytes:
        return b"".join(self.lines)


class HttpError(Exception):
    """An answer with an error status; 429 and 5xx are temporary."""

    def __init__(self, status: int, detail: str = ""):
        super().__init__(f"HTTP {status} {detail[:200]}")
        self.status = status
        self.temporary = status == 429 or status >= 500


def send(request: Request) -> Response:
    plain = urllib.request.Request(request.url, data=request.body, headers=request.headers, method=request.method)
    try:
        answer = urllib.request.urlopen(plain, timeout=request.timeout)  # noqa: S310 - the caller names the endpoint
    except urllib.error.HTTPError as error:
        return Response(error.code, iter([error.read()]))
    return Response(answer.status, iter(answer))


@dataclass
class Client:
    base: str
    key: str = ""
    transport: Transport = send
    timeout: float = 60.0

    def call(self, method: str, path: str, body: dict | list | None = None, accept: tuple[int, ...] = ()) -> Response:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        data = None if body is None else json.dumps(body).encode()
        got = self.transport(Request(method, self.base.rstrip("/") + path, headers, data, self.timeout))
        if got.status >= 300 and got.status not in accept:
            raise HttpError(got.status, got.read().decode(errors="replace"))
        return got

    def json(self, method: str, path: str, body: dict | list | None = None, accept: tuple[int, ...] = ()):
        raw = self.call(method, path, body, accept).read()
        return json.loads(raw) if raw.strip() else None
