"""Answering requests over HTTP: POST /fraud-score and GET /ready.

Requests that arrive while a batch is being scored wait together and are the next batch, so a Spark job answers many of
them.  Whatever happens to a request, it is answered: one that can't be read or scored is approved with score 0.0.
"""

from __future__ import annotations

import queue
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from nearfold.plans.engine import Engine

SAFE = '{"approved":true,"fraud_score":0.0}'
#: Requests that a batch has at most, and seconds that one waits for its answer.
MOST, PATIENCE = 512, 60.0


class Waiting:
    """A request and its answer."""

    def __init__(self, body: str):
        self.body, self.answer, self.done = body, SAFE, threading.Event()


class Service:
    """Gathers requests into batches for an engine."""

    def __init__(self, engine: Engine):
        self.engine, self.queue = engine, queue.Queue()
        self.stopped = False
        self.thread = threading.Thread(target=self._work, daemon=True)
        self.thread.start()

    def ask(self, body: str) -> str:
        one = Waiting(body)
        self.queue.put(one)
        one.done.wait(PATIENCE)
        return one.answer

    def close(self) -> None:
        self.stopped = True
        self.queue.put(None)
        self.thread.join()

    def _work(self) -> None:
        while not self.stopped:
            batch = [self.queue.get()]
            while len(batch) < MOST and not self.queue.empty():
                batch.append(self.queue.get())
            batch = [x for x in batch if x is not None]
            if batch:
                self._answer(batch)

    def _answer(self, batch: list[Waiting]) -> None:
        try:
            spark = self.engine.index.lists.sparkSession
            requests = spark.createDataFrame([(i, x.body) for i, x in enumerate(batch)], "q_id long, value string")
            for r in self.engine.respond(requests).collect():
                batch[r["q_id"]].answer = r["value"]
        except Exception as e:  # noqa: BLE001 - a request is answered whatever happens
            print(f"a batch failed and gets the safe answer: {e}")
        for one in batch:
            one.done.set()


def server(engine: Engine, port: int = 8080, host: str = "0.0.0.0") -> ThreadingHTTPServer:
    """An HTTP server that isn't running yet (``serve_forever`` runs it); its ``service`` answers."""
    service = Service(engine)

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def _send(self, status: int, body: str) -> None:
            raw = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def do_GET(self) -> None:  # noqa: N802
            self._send(*(engine.ready() if self.path == "/ready" else (405 if self.path == "/fraud-score" else 404, "")))

        def do_POST(self) -> None:  # noqa: N802
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode("utf-8", "replace")
            if self.path == "/fraud-score":
                self._send(200, service.ask(body) if engine.is_ready else SAFE)
            else:
                self._send(405 if self.path == "/ready" else 404, "")

        def log_message(self, *args) -> None:
            pass

    made = ThreadingHTTPServer((host, port), Handler)
    made.service = service
    return made
