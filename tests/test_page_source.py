"""The page source against a server in this process: attempts, rate, pushed filters, cache."""

import threading
import time
from collections import defaultdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from corpusforge.sources import corpus, page_source


@pytest.fixture
def server():
    asked = defaultdict(list)

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked[self.path].append(time.monotonic())
            bad = self.path == "/bad" or self.path == "/flaky" and len(asked[self.path]) == 1
            body = b"" if self.path == "/empty" else f"page {self.path}".encode()
            self.send_response(500 if bad else 200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=httpd.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{httpd.server_port}", asked
    httpd.shutdown()


def test_pages_over_http(spark, server, tmp_path):
    at, asked = server
    names = ["a", "b", "c", "flaky", "bad", "empty"]
    listed = spark.createDataFrame([(n, f"{at}/{n}") for n in names] + [("none", None)], "page_id string, source_url string")
    rows = {r.page_id: r for r in page_source.fetched(spark, listed, per_host=10, pause=0.01).collect()}
    assert {n: r.html for n, r in rows.items()} == {"a": "page /a", "b": "page /b", "c": "page /c", "flaky": "page /flaky", "bad": None, "empty": None, "none": None}
    assert [len(asked[f"/{n}"]) for n in names] == [1, 1, 1, 2, 2, 2]
    assert "500" in rows["bad"].error and "empty" in rows["empty"].error and rows["none"].error and rows["a"].error is None
    times = sorted(t for ts in asked.values() for t in ts)
    times = times[1:]  # the server takes its time over the first
    assert times[-1] - times[0] > 0.1 * (len(times) - 1) - 0.05 and all(b - a > 0.05 for a, b in zip(times, times[1:]))  # one host, ten a second

    asked.clear()
    one = page_source.fetched(spark, listed, per_host=50).where("page_id in ('b', 'c') and html is not null")
    assert sorted(r.page_id for r in one.collect()) == ["b", "c"] and set(asked) == {"/b", "/c"}

    cache = str(tmp_path / "cache")
    page_source.save(spark.createDataFrame([(r.page_id, r.html) for r in rows.values()], "page_id string, html string"), cache)
    asked.clear()
    again = {r.page_id: r for r in corpus.cached_or_fetched(spark, listed, cache, per_host=50, pause=0.01).collect()}
    assert again["a"].from_cache and again["a"].html == "page /a" and not again["bad"].from_cache and again["bad"].error
    assert set(asked) == {"/bad", "/empty"}
