"""Paged answers of a local server, read through the data source."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from scriptorium.sources import api, lms

CALLS = []


class Server(BaseHTTPRequestHandler):
    def do_GET(self):
        url = urlsplit(self.path)
        CALLS.append((self.path, self.headers.get("Authorization")))
        offset = int(parse_qs(url.query).get("page[offset]", parse_qs(url.query).get("from", ["0"]))[0])
        _, _, course, kind = url.path.split("/")
        if course == "broken":
            self.send_response(500)
            self.end_headers()
            return
        total = {"a": 300, "b": 250, "c": 0}[course]
        data = [{"id": f"{course}{i}", "attributes": {"keyword": f"Seite {i}", "content": "x" * 50}} for i in range(offset, min(offset + 100, total))]
        told = {"data": data}
        if course == "a":
            told["links"] = {"next": f"{url.path}?from={offset + 100}"} if offset + 100 < total else {"next": None}
        else:
            told["meta"] = {"page": {"offset": offset, "limit": 100, "total": total}}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(told).encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def base():
    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    CALLS.clear()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_all_pages_arrive(spark, base):
    routes = [f"/courses/{c}/wiki-pages" for c in ("a", "b", "c", "broken")]
    pages = api.read_pages(spark, base, routes, {"Authorization": "Bearer t"}, retries=[])
    got = pages.collect()
    assert sorted((r.route.split("/")[2], r.page, r.status) for r in got) == [("a", 0, 200), ("a", 1, 200), ("a", 2, 200), ("b", 0, 200), ("b", 1, 200), ("b", 2, 200), ("broken", 0, 500), ("c", 0, 200)]
    assert {t for _, t in CALLS} == {"Bearer t"}
    items = lms.items(pages, r"^/courses/([^/?]+)/wiki-pages", "wiki-pages", "course").collect()
    assert sorted((r.course, r.n) for r in items) == [("a", i) for i in range(300)] + [("b", i) for i in range(250)]
    assert all(json.loads(r.item)["id"] == f"{r.course}{r.n}" for r in items)
    first = lms.items(pages.filter("page = 0").drop("page"), r"^/courses/([^/?]+)/wiki-pages", "wiki-pages", "course", cap=7)
    assert first.filter("course = 'a'").count() == 7


def test_unreachable_servers_and_circles():
    assert api.call("http://127.0.0.1:9/x", {}, timeout=1, retries=(0.0, 0.0))[0] == 599
    assert api.following("http://s/a?x=1", '{"links": {"next": "?x=2"}}') == "http://s/a?x=2"
    assert api.following("http://s/a?x=1", '{"links": {"next": {"href": "http://s/b"}}}') == "http://s/b"
    assert api.following("http://s/a", '{"meta": {"page": {"offset": 0, "limit": 2, "total": 5}}}') == "http://s/a?page%5Boffset%5D=2&page%5Blimit%5D=2"
    for body in ("no json", "[]", "{}", '{"links": []}', '{"meta": {"page": {"offset": 4, "limit": 2, "total": 5}}}'):
        assert api.following("http://s/a", body) is None


def test_pages_as_a_stream(spark, base, tmp_path):
    spark.dataSource.register(api.ApiSource)
    stream = spark.readStream.format("scriptorium-api").options(base=base, routes='["/courses/b/wiki-pages"]', retries="[]").load()
    for _ in range(2):  # nothing is new at the second start
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
