"""The HTTP source against a server in this process: limits, missing pages, failures, a shared rate, a stream with a restart."""

import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

import pytest

from prosemill.sources import api


@pytest.fixture
def server():
    seen, times = Counter(), []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            title = unquote(self.path[1:])
            seen[title] += 1
            times.append(time.monotonic())
            code, headers = 200, {}
            if title.startswith("gone"):
                code = 404
            elif title.startswith("down"):
                code = 500
            elif title.startswith("bad"):
                code = 403
            elif title.startswith("busy") and seen[title] < 3:
                code, headers = 429, {"Retry-After": "0.3"}
            self.send_response(code)
            for k, v in headers.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(f"body of {title} é".encode() if code == 200 else b"no")

        def log_message(self, *a):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/{{title}}", seen, times
    s.shutdown()


def test_statuses(spark, server, tmp_path):
    url, seen, times = server
    (tmp_path / "titles").write_text("a b/c?\n\ngone\ndown\nbusy\nbad\nlast")
    got = {r.title: r for r in api.read_api(spark, url, str(tmp_path / "titles"), tasks=3, rate=1000, retries=2, unit=0.01).collect()}
    assert [got[t].place for t in ("a b/c?", "gone", "down", "busy", "bad", "last")] == list(range(6))
    assert got["a b/c?"].body == "body of a b/c? é" and got["gone"].status == "missing" and got["gone"].tries == 1
    assert (got["down"].status, got["down"].body, got["down"].tries) == ("error", None, 3)
    assert (got["busy"].status, got["busy"].tries) == ("ok", 3) and (got["bad"].status, got["bad"].tries) == ("error", 1)
    assert seen["down"] == 3 and seen["busy"] == 3
    (tmp_path / "none").write_text("\n")
    assert api.read_api(spark, url, str(tmp_path / "none")).count() == 0


def test_tasks_share_the_rate(spark, server, tmp_path):
    url, _, times = server
    (tmp_path / "titles").write_text("\n".join(f"t{i}" for i in range(30)))
    rows = api.read_api(spark, url, "file://" + str(tmp_path / "titles"), tasks=3, rate=15)
    assert rows.rdd.getNumPartitions() == 3
    times.clear()
    assert rows.count() == 30 and max(times) - min(times) >= (30 - 3) / 15 * 0.9


def test_stream_goes_on_behind_the_last_title(spark, server, tmp_path):
    url, seen, _ = server
    titles = tmp_path / "titles"
    for part in ("a\nb\n", "c\ngone 1\n", ""):
        with open(titles, "a") as f:
            f.write(part)
        q = api.stream_api(spark, url, str(titles), rate=1000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(60)
    got = sorted((r.place, r.title, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, "a", "ok"), (1, "b", "ok"), (2, "c", "ok"), (3, "gone 1", "missing")] and set(seen.values()) == {1}
