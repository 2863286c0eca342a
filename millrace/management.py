"""Around a running engine, on the driver: saving its state in time, signals, and a page with its status."""

from __future__ import annotations

import html
import json
import logging
import signal
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from millrace.runtime import Runtime, State
from millrace.state import Store

log = logging.getLogger(__name__)


@dataclass
class Saver:
    """Saves beside the caller: every ``every_s`` where something has changed, every ``whole_s`` whatever has. After ``most``
    failures one after the other the caller itself saves, and sees the error."""

    save: Callable[[], object]
    every_s: float = 1.0
    whole_s: float = 3600.0
    most: int = 10
    clock: Callable[[], float] = time.monotonic
    dirty: bool = False
    failures: int = 0
    at: float = field(default=float("-inf"))
    whole_at: float | None = None
    thread: threading.Thread | None = None

    def _run(self) -> None:
        try:
            self.save()
            self.failures = 0
        except Exception:
            log.exception("the state was not saved")
            self.failures, self.dirty = self.failures + 1, True

    def tick(self) -> bool:
        """Save if it is time and no other saving is on its way; tells whether it was."""
        now = self.clock()
        if self.whole_at is None:
            self.whole_at = now
        due = self.dirty and now - self.at >= self.every_s or now - self.whole_at >= self.whole_s
        if not due or (self.thread and self.thread.is_alive()):
            return False
        if now - self.whole_at >= self.whole_s:
            self.whole_at = now
        self.at, self.dirty = now, False
        if self.failures >= self.most:
            try:
                self.save()
            except Exception:
                self.dirty = True
                raise
            self.failures = 0
        else:
            self.thread = threading.Thread(target=self._run, daemon=True)
            self.thread.start()
        return True


def on_signals(runtime: Runtime, store: Store) -> dict:
    """INT and TERM stop the engine after saving its state, HUP only saves. Returns the handlers that were there."""

    def stop(*_) -> None:
        if runtime.state in (State.RUNNING, State.RECOVERY):
            runtime.stop(store)

    made = {signal.SIGINT: stop, signal.SIGTERM: stop, signal.SIGHUP: lambda *_: runtime.save_state(store)}
    return {kind: signal.signal(kind, call) for kind, call in made.items()}


def page(status: dict) -> str:
    rows = "".join(
        f"<tr><th>{html.escape(str(k))}</th><td><pre>{html.escape(json.dumps(v, indent=1, default=str))}</pre></td></tr>" for k, v in status.items()
    )
    return f"<!doctype html><title>millrace</title><table>{rows}</table>"


def serve(runtime: Runtime, host: str = "127.0.0.1", port: int = 3000) -> ThreadingHTTPServer:
    """The status at / until shutdown() is called on what this returns. Other paths are 404, other methods 405."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self, code: int, text: str, kind: str = "text/plain") -> None:
            body = text.encode()
            self.send_response(code)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:
            if self.path.split("?")[0] != "/":
                return self.answer(404, "Not found")
            try:
                made = page(runtime.status())
            except Exception:
                log.exception("no status")
                return self.answer(500, "The status can't be shown")
            self.answer(200, made, "text/html")

        def refuse(self) -> None:
            self.answer(*((405, "Method not allowed") if self.path.split("?")[0] == "/" else (404, "Not found")))

        do_POST = do_PUT = do_DELETE = do_PATCH = refuse

        def log_message(self, text: str, *args) -> None:
            log.debug(text, *args)

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
