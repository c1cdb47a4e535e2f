"""Pages over HTTP from a local server: errors, retries, sessions and pacing."""

import threading
import time
from collections import defaultdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from rosterlens.operators import crawl as C

LONG = "<p>" + "words of a page " * 20 + "</p>"


@pytest.fixture
def server():
    seen = defaultdict(list)

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_GET(self):
            path = self.path
            seen[path].append((time.monotonic(), self.client_address[1], dict(self.headers)))
            status, body, more = 200, LONG, {}
            if path == "/forbidden-once" and len(seen[path]) == 1:
                status = 403
            elif path == "/busy":
                status = 429
            elif path in ("/gone", "/login"):
                status = {"/gone": 404, "/login": 401}[path]
            elif path == "/short":
                body = "short"
            elif path == "/slow":
                time.sleep(3)
            elif path == "/moved":
                status, more = 302, {"Location": "/page"}
            elif path == "/loop":
                status, more = 302, {"Location": "/loop"}
            elif path == "/cookie":
                more = {"Set-Cookie": "a=1; Path=/"}
            elif path == "/close":
                more = {"Connection": "close"}
            raw = body.encode()
            try:
                self.send_response(status)
                for k, v in more.items():
                    self.send_header(k, v)
                self.send_header("Content-Length", str(len(raw)))
                self.end_headers()
                self.wfile.write(raw)
            except OSError:
                pass

        def log_message(self, *_):
            pass

    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}", seen
    httpd.shutdown()


def test_errors_are_values(spark, server):
    root, seen = server
    paths = ("/page", "/forbidden-once", "/busy", "/gone", "/login", "/short", "/slow", "/moved", "/loop", "/a b?q=é ü")
    urls = [(root + p,) for p in paths] + [("http://127.0.0.1:1/none",), ("ftp://x/y",), ("no address",), (None,), ("",), (root + "/page",)]
    rows = C.fetch(spark.createDataFrame(urls, "url string"), timeout=1.0, attempts=3, pace=0.0, backoff=0.05).collect()
    got = {(r["url"] or "").removeprefix(root): (r["html"], r["error"]) for r in rows}
    assert len(rows) == len({u for u, in urls})
    assert got["/page"] == got["/forbidden-once"] == got["/moved"] == got["/a b?q=é ü"] == (LONG, None)
    assert got["/busy"] == (None, "status 429") and got["/gone"] == (None, "status 404") and got["/login"] == (None, "status 401") and got["/short"] == (None, "too short")
    assert "timed out" in got["/slow"][1] and got["/loop"][1] == "too many redirects" and "refused" in got["http://127.0.0.1:1/none"][1]
    assert got["ftp://x/y"][1] == got["no address"][1] == "not an address of a page" and got[""][1] == "no address"
    assert len(seen["/busy"]) == 3 and len(seen["/gone"]) == len(seen["/login"]) == len(seen["/short"]) == 1 and len(seen["/forbidden-once"]) == 2
    assert "Accept-Language" not in seen["/forbidden-once"][0][2] and "Accept-Language" in seen["/forbidden-once"][1][2], "the second try looks like a browser"


def test_one_session_a_host_and_paced(spark, server):
    root, seen = server
    urls = [(f"{root}/p{i}",) for i in range(6)] + [(f"{root}/cookie",)]
    rows = C.fetch(spark.createDataFrame(urls, "url string").repartition(4), pace=0.2).collect()
    assert all(r["error"] is None for r in rows)
    calls = sorted(c for path in seen.values() for c in path)
    assert len({port for _, port, _ in calls}) == 1, "one connection"
    assert all(b[0] - a[0] >= 0.19 for a, b in zip(calls, calls[1:], strict=False))
    assert [c[2].get("Cookie") for c in calls][0] is None and calls[-1][2].get("Cookie") == "a=1"


def test_closed_connections_are_opened_again(server):
    root, seen = server
    s = C.Session(2.0)
    assert [s.get(f"{root}{p}", C.PLAIN)[0] for p in ("/close", "/page", "/close", "/page")] == [200] * 4
    s.close()
