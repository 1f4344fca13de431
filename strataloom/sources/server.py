"""A folder over HTTP with byte ranges, tags and faults on demand: for tests of clients, on one machine."""

from __future__ import annotations

import hashlib
import itertools
import os
import threading
import time
from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer


def tag_of(path: str) -> str:
    """A tag that changes with a file's name, size or time."""
    state = os.stat(path)
    return '"' + hashlib.sha256(f"{os.path.basename(path)}:{state.st_size}:{state.st_mtime_ns}".encode("utf-8", "surrogatepass")).hexdigest()[:32] + '"'


class Faults:
    """Every n-th request fails, or its range is cut to half; every one waits."""

    def __init__(self, fail_every: int = 0, fail_status: int = 503, truncate_every: int = 0, delay_ms: int = 0):
        self.fail_every, self.fail_status, self.truncate_every, self.delay_ms = fail_every, fail_status, truncate_every, delay_ms
        self.numbers = itertools.count(1)


def _range(header: str, size: int) -> tuple[int, int] | None:
    """First and last byte of `bytes=a-b`, within the file; None if it can't be satisfied."""
    first, _, last = header.removeprefix("bytes=").partition("-")
    try:
        a, b = int(first or 0), int(last or size - 1)
    except ValueError:
        return None
    return (a, min(b, size - 1)) if 0 <= a <= b and a < size else None


class Handler(SimpleHTTPRequestHandler):
    faults = Faults()

    def log_message(self, *args):
        pass

    def do_HEAD(self):
        self._answer(False)

    def do_GET(self):
        self._answer(True)

    def _answer(self, with_body: bool) -> None:
        number = next(self.faults.numbers)
        time.sleep(self.faults.delay_ms / 1000)
        if self.faults.fail_every and number % self.faults.fail_every == 0:
            self.send_error(self.faults.fail_status)
            return
        path = self.translate_path(self.path)
        if not os.path.isfile(path):
            self.send_error(404)
            return
        size, tag, asked = os.path.getsize(path), tag_of(path), self.headers.get("Range", "")
        ranged = asked.startswith("bytes=") and self.headers.get("If-Range", tag) == tag
        span = _range(asked, size) if ranged else (0, size - 1)
        if span is None:
            self.send_error(416)
            return
        length = span[1] - span[0] + 1
        self.send_response(206 if ranged else 200)
        self.send_header("Content-Type", "application/octet-stream")
        self.send_header("Content-Length", str(length))
        self.send_header("Accept-Ranges", "bytes")
        self.send_header("ETag", tag)
        if ranged:
            self.send_header("Content-Range", f"bytes {span[0]}-{span[1]}/{size}")
        self.end_headers()
        if with_body:
            if ranged and self.faults.truncate_every and number % self.faults.truncate_every == 0:
                length //= 2
                self.close_connection = True
            with open(path, "rb") as file:
                file.seek(span[0])
                while length > 0 and (data := file.read(min(length, 1 << 16))):
                    self.wfile.write(data)
                    length -= len(data)


def serve(folder: str, port: int = 0, faults: Faults | None = None) -> ThreadingHTTPServer:
    """A server that runs beside the caller until shutdown(); its port is server_address[1]."""
    kind = type("Bound", (Handler,), {"faults": faults or Faults()})
    held = ThreadingHTTPServer(("127.0.0.1", port), lambda *a, **k: kind(*a, directory=folder, **k))
    threading.Thread(target=held.serve_forever, daemon=True).start()
    return held
