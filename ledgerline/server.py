"""An HTTP front end: python -m ledgerline.server --db FOLDER [--host H] [--port P] [--text]"""

from __future__ import annotations

import argparse
import base64
import itertools
import json
import signal
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import SparkSession

from .functions.status import NotFound, Status
from .options import Options
from .store import Store


def _field(name: str, value: bytes | str) -> dict[str, str]:
    """A key or value for JSON: as text, or as base64 under another name if it is not UTF-8."""
    try:
        return {name: value if isinstance(value, str) else bytes(value).decode()}
    except UnicodeDecodeError:
        return {f"{name}_base64": base64.b64encode(bytes(value)).decode()}


def handler(store: Store) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_: object) -> None:
            pass

        def _send(self, code: int, body: bytes | str, kind: str = "text/plain") -> None:
            body = body.encode() if isinstance(body, str) else body
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def _stream(self, rows) -> None:
            """Rows as one JSON list, sent as they come; the end of the connection ends it."""
            first = next(rows, None)  # a scan that fails does so before the status is sent
            self.send_response(200)
            self.send_header("Content-Type", "application/json")
            self.send_header("Connection", "close")
            self.end_headers()
            self.wfile.write(b"[")
            for i, r in enumerate(rows if first is None else itertools.chain([first], rows)):
                body = json.dumps(_field("key", r.key) | _field("value", r.value), ensure_ascii=False)
                self.wfile.write((", " if i else "").encode() + body.encode())
            self.wfile.write(b"]")
            self.close_connection = True

        def _key(self) -> str | None:
            path = urlsplit(self.path).path
            return unquote(path[4:]) if path.startswith("/db/") and len(path) > 4 else None

        def _guarded(self, work) -> None:
            try:
                work()
            except NotFound:
                self._send(404, "Not Found")
            except Status as e:
                self._send(500, str(e))
            except Exception as e:  # noqa: BLE001  the client gets any other failure
                self._send(500, f"IOError: {type(e).__name__}")

        def do_GET(self) -> None:  # noqa: N802
            self._guarded(self._get)

        def _get(self) -> None:
            url = urlsplit(self.path)
            if url.path == "/health":
                return self._send(200, '{"status":"ok"}', "application/json")
            if url.path == "/db":
                asked = parse_qs(url.query, keep_blank_values=True)
                if not {"start", "end"} <= asked.keys():
                    return self._send(400, "Missing start/end params")
                return self._stream(store.scan(asked["start"][0], asked["end"][0]).toLocalIterator())
            if (key := self._key()) is not None:
                value = store.get(key)
                return self._send(200, value, "application/octet-stream")
            return self._send(404, "Not Found")

        def do_PUT(self) -> None:  # noqa: N802
            def work() -> None:
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                if (key := self._key()) is None:
                    return self._send(404, "Not Found")
                try:
                    store.put(key, body if store.options.binary else body.decode())
                except UnicodeDecodeError:
                    return self._send(400, "This store holds text; the value is not UTF-8")
                return self._send(200, "OK")

            self._guarded(work)

        def do_DELETE(self) -> None:  # noqa: N802
            def work() -> None:
                if (key := self._key()) is None:
                    return self._send(404, "Not Found")
                store.delete(key)
                return self._send(200, "OK")

            self._guarded(work)

    return Handler


class Server:
    def __init__(self, store: Store, host: str = "127.0.0.1", port: int = 8080):
        self.http = ThreadingHTTPServer((host, port), handler(store))

    @property
    def port(self) -> int:
        return self.http.server_address[1]

    def start(self) -> None:
        self.http.serve_forever(poll_interval=0.1)

    def stop(self) -> None:
        self.http.shutdown()
        self.http.server_close()


def main(args: list[str]) -> int:
    options = argparse.ArgumentParser(prog="ledgerline.server")
    options.add_argument("--db", default=Options().db_path)
    options.add_argument("--host", default="127.0.0.1")
    options.add_argument("--port", type=int, default=8080)
    options.add_argument("--text", action="store_true", help="the store holds text; without it, keys and values are bytes")
    asked = options.parse_args(args)
    spark = SparkSession.builder.appName("ledgerline").getOrCreate()
    with Store(spark, Options(db_path=asked.db, binary=not asked.text)) as store:
        server = Server(store, asked.host, asked.port)
        for s in (signal.SIGINT, signal.SIGTERM):
            signal.signal(s, lambda *_: sys.exit(0))
        try:
            server.start()
        finally:
            server.http.server_close()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
