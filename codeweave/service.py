"""HTTP front: ``GET /health`` and ``POST /parse``, and the callbacks a parse reports to."""

from __future__ import annotations

import json
import time
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from codeweave.sources import tree
from codeweave.tools import Tools

PROGRESS_S, COMPLETION_TRIES, PAUSE_S = 5, 3, 2


def post(url: str, body: dict, timeout: float) -> bool:
    request = urllib.request.Request(url, json.dumps(body, default=str).encode(), {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status < 300
    except OSError:
        return False


def report_progress(url: str | None, project: str):
    """A callback that tells ``url`` the stage; a failure to tell is no failure of the parse."""
    return lambda stage: post(url, {"project": project, "stage": stage}, PROGRESS_S) if url else None


def report_completion(url: str | None, body: dict, pause: float = PAUSE_S) -> bool:
    for attempt in range(COMPLETION_TRIES if url else 0):
        if post(url, body, 10 * PROGRESS_S):
            return True
        if attempt + 1 < COMPLETION_TRIES:
            time.sleep(pause)
    return False


def parse_request(tools: Tools, body: dict) -> tuple[int, dict]:
    """(status, answer) of a request ``{repo, project, clean, incremental, changed_files, removed_files, trigger, file_discovery, ..}``."""
    repo = body.get("repo")
    if not repo:
        return 400, {"error": "repo is required"}
    project = body.get("project") or str(repo).rstrip("/").rsplit("/", 1)[-1].removesuffix(".git")
    d = body.get("file_discovery") or {}
    config = tree.Discovery(d.get("max_file_size", tree.registry.MAX_FILE_BYTES), d.get("include", []), d.get("exclude", []), d.get("folder", ""))
    incremental = bool(body.get("incremental", False))
    try:
        out = tools.parse_repo(repo, project, progress=report_progress(body.get("progress_url"), project), clean=bool(body.get("clean", not incremental)), incremental=incremental,
                               changed_files=body.get("changed_files"), removed_files=body.get("removed_files"), trigger=body.get("trigger", "http"), config=config, token=body.get("github_token"))
    except Exception as e:  # every failure of a job is an answer of the service
        out = {"status": "failed", "project": project, "error": f"{type(e).__name__}: {e}"}
    report_completion(body.get("completion_url"), out)
    return (200 if out["status"] == "completed" else 500), out


def server(tools: Tools, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def answer(self, status: int, body: dict) -> None:
            data = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            self.answer(*((200, {"status": "ok"}) if self.path == "/health" else (404, {"error": "not found"})))

        def do_POST(self):
            if self.path != "/parse":
                return self.answer(404, {"error": "not found"})
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
            except ValueError:
                return self.answer(400, {"error": "bad JSON"})
            return self.answer(*(parse_request(tools, body) if isinstance(body, dict) else (400, {"error": "bad JSON"})))

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
