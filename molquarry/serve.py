"""Scoring over HTTP with the standard library: /health, /info and /predict, their schemas, and a client that asks in chunks."""

from __future__ import annotations

import json
import socket
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Iterable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from molquarry.operators.scoring import ScoringService

#: Texts of a request, and bytes of its body, at most.
MOST_TEXTS, MOST_BYTES = 10_000, 64 << 20


class BadRequest(ValueError):
    """What a client did wrong, in words for it."""


def parsed_request(body: bytes) -> list[str | None]:
    """The texts of {"smiles": [...]}: texts or nulls, MOST_TEXTS at most; anything else is a BadRequest."""
    try:
        got = json.loads(body)
    except ValueError as e:
        raise BadRequest(f"no JSON: {e}") from None
    texts = got.get("smiles") if isinstance(got, dict) else None
    if not isinstance(texts, list) or any(t is not None and not isinstance(t, str) for t in texts):
        raise BadRequest('expected {"smiles": [text or null, ...]}')
    if len(texts) > MOST_TEXTS:
        raise BadRequest(f"{len(texts)} texts; at most {MOST_TEXTS} a request")
    return texts


class Server:
    """A service on a port of its own choosing (or a given one); requests are answered by threads."""

    def __init__(self, service: ScoringService, host: str = "127.0.0.1", port: int = 0, port_file: str | None = None):
        class Handler(BaseHTTPRequestHandler):
            def _send(self, status: int, content: dict) -> None:
                body = json.dumps(content).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json")
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def do_GET(self) -> None:
                found = {"/health": lambda: {"status": "ok"}, "/info": service.info}.get(self.path)
                self._send(*((200, found()) if found else (404, {"error": f"no {self.path}"})))

            def do_POST(self) -> None:
                if self.path != "/predict":
                    return self._send(404, {"error": f"no {self.path}"})
                size = int(self.headers.get("Content-Length") or 0)
                if size > MOST_BYTES:
                    return self._send(413, {"error": "request too large"})
                try:
                    self._send(200, service.predict(parsed_request(self.rfile.read(size))))
                except BadRequest as e:
                    self._send(422, {"error": str(e)})
                except Exception as e:  # noqa: BLE001 - a failed request isn't the server's end
                    self._send(500, {"error": type(e).__name__})

            def log_message(self, *_: object) -> None:
                pass

        self.http = ThreadingHTTPServer((host, port), Handler)
        self.url = f"http://{host}:{self.http.server_address[1]}"
        if port_file:
            with open(port_file, "w", encoding="utf-8") as f:
                f.write(str(self.http.server_address[1]))
        self.thread = threading.Thread(target=self.http.serve_forever, daemon=True)

    def __enter__(self) -> Server:
        self.thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self.http.shutdown()
        self.http.server_close()


def endpoint(url: str | None = None, port_file: str | None = None, host: str = "127.0.0.1") -> str:
    """The address given, else that of a port file."""
    if url:
        return url.rstrip("/")
    if not port_file:
        raise ValueError("neither an address nor a port file")
    with open(port_file, encoding="utf-8") as f:
        return f"http://{host}:{int(f.read())}"


def ready(url: str, seconds: float = 30.0, wait: float = 0.2) -> bool:
    """Whether /health answers before the deadline."""
    end = time.monotonic() + seconds
    while time.monotonic() < end:
        try:
            with urllib.request.urlopen(f"{url}/health", timeout=max(0.1, end - time.monotonic())) as r:
                return r.status == 200
        except (urllib.error.URLError, socket.timeout, ConnectionError):
            time.sleep(wait)
    return False


def ask(url: str, texts: list[str | None], chunk: int = 512, timeout: float = 60.0) -> dict[str, list]:
    """Series of scores in the order of the texts, asked for in chunks; a series of another length than asked is an error."""
    out: dict[str, list] = {}
    for start in range(0, len(texts), chunk):
        part = texts[start : start + chunk]
        request = urllib.request.Request(f"{url}/predict", json.dumps({"smiles": part}).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as r:
            got = json.load(r)
        for name, series in got.items():
            if len(series) != len(part):
                raise ValueError(f"{name}: {len(series)} values for {len(part)} texts")
            out.setdefault(name, []).extend(series)
    return out


def ask_all(endpoints: Iterable[tuple[str, str]], texts: list[str | None], chunk: int = 512) -> list[list[float]]:
    """Of each (address, series) the series of all texts, null as nan; each address is asked once, however many series it gives."""
    asked: dict[str, dict[str, list]] = {}
    out = []
    for url, name in endpoints:
        if url not in asked:
            asked[url] = ask(url, texts, chunk)
        out.append(ScoringService.selected(asked[url], name))
    return out
