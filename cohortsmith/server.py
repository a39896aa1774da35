"""A thin HTTP server over the job manager: POST and GET /jobs, GET and DELETE /jobs/<id>, GET /health."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from . import hocon
from .jobs import JobManager, Parameters
from .plans.model import RequestError


def posted(body: str) -> dict:
    """A job as JSON or HOCON."""
    try:
        data = json.loads(body)
    except ValueError:
        data = hocon.loads(body)
    if not isinstance(data, dict):
        raise RequestError("a job is an object")
    return data


def server(manager: JobManager, port: int) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, body) -> None:
            data = json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _job(self):
            name = self.path.removeprefix("/jobs/")
            job = manager.job(name)
            if job is None:
                self._send(404, {"message": f"no job {name}"})
            return job

        def do_GET(self):
            if self.path == "/health":
                self._send(200, {"status": "UP"})
            elif self.path.rstrip("/") == "/jobs":
                self._send(200, [j.summary() for j in manager.list()])
            elif self.path.startswith("/jobs/"):
                if job := self._job():
                    self._send(200, job.callback() | job.summary())
            else:
                self._send(404, {"message": "not found"})

        def do_POST(self):
            if self.path.rstrip("/") != "/jobs":
                return self._send(404, {"message": "not found"})
            try:
                job = manager.submit(Parameters.from_json(posted(self.rfile.read(int(self.headers.get("Content-Length", 0))).decode())))
            except (RequestError, ValueError) as e:
                return self._send(400, {"status": "KO", "message": str(e)})
            return self._send(202, {"status": job.status, "jobId": job.id})

        def do_DELETE(self):
            if self.path.startswith("/jobs/") and (job := self._job()):
                manager.cancel(job.id)
                self._send(200, {"status": job.status, "jobId": job.id})

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer(("", port), Handler)
