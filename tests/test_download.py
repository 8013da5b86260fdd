"""Fetching from a server on this machine that breaks off, forgets ranges, and refuses."""

import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from trendloom.sources import download

DATA = bytes(range(256)) * 4000


@pytest.fixture()
def server():
    asked, log = Counter(), []

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def do_HEAD(self):
            self.send_response(404 if "missing" in self.path else 405 if "nohead" in self.path else 200)
            if "nohead" not in self.path:
                self.send_header("Content-Length", str(len(DATA)))
            self.end_headers()

        def do_GET(self):
            asked[self.path] += 1
            start = int(self.headers["Range"][6:-1]) if self.headers["Range"] else 0
            log.append((self.path, start))
            if "missing" in self.path:
                return self.send_error(404)
            if "stale" in self.path and start:
                return self.send_error(416)
            if "forgets" in self.path and start:
                start = 0
                self.send_response(200)
            else:
                self.send_response(206 if start else 200)
            self.send_header("Content-Length", str(len(DATA) - start))
            self.end_headers()
            breaks = ("breaks" in self.path or "forgets" in self.path or "stale" in self.path) and asked[self.path] == 1
            self.wfile.write(DATA[start : start + (300_000 if breaks else len(DATA))])

    made = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}", asked, log
    made.shutdown()


def test_files_come_whole_whatever_the_server_does(spark, server, tmp_path):
    base, asked, log = server
    names = ["plain", "breaks", "forgets", "stale", "nohead", "missing"]
    wanted = spark.createDataFrame([(f"{base}/{n}", f"{tmp_path}/{n}.nc") for n in [*names, "plain"]] + [(None, "x")], "url string, path string")
    rows = {r.url.rsplit("/", 1)[1]: r for r in download.fetch(wanted, tries=3, pause=0.01).collect()}
    assert {n: r.state for n, r in rows.items()} == {n: "failed" if n == "missing" else "fetched" for n in names}
    assert all((tmp_path / f"{n}.nc").read_bytes() == DATA for n in names if n != "missing")
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(f"{n}.nc" for n in names if n != "missing")  # no pieces left
    assert ("/breaks", 300_000) in log and rows["breaks"].tries == 2 and rows["plain"].tries == 1
    assert rows["missing"].tries == 3 and "404" in rows["missing"].error
    # a second run fetches nothing but what failed; a file of the wrong size is fetched again
    (tmp_path / "plain.nc").write_bytes(b"short")
    before = Counter(asked)
    again = {r.url.rsplit("/", 1)[1]: r.state for r in download.fetch(wanted, tries=1, pause=0).collect()}
    assert again == {n: {"missing": "failed", "plain": "fetched"}.get(n, "kept") for n in names}
    assert (tmp_path / "plain.nc").read_bytes() == DATA and Counter(asked) - before == {"/missing": 1, "/plain": 1}


def test_a_killed_run_goes_on_where_it_was(spark, server, tmp_path):
    base, _, log = server
    (tmp_path / "one.nc.part-00000000000000000000").write_bytes(DATA[:1000])
    (tmp_path / "one.nc.part-00000000000000001000").write_bytes(DATA[1000:5000])
    (tmp_path / "one.nc.part-00000000000000009000").write_bytes(b"does not join on")
    assert download.fetch_one(f"{base}/one", f"{tmp_path}/one.nc", 2, 0, 5)[:3] == ("fetched", len(DATA), 1)
    assert log == [("/one", 5000)] and [p.name for p in tmp_path.iterdir()] == ["one.nc"] and (tmp_path / "one.nc").read_bytes() == DATA


def test_names_of_yearly_files(spark, tmp_path):
    rows = download.yearly_files(spark, "http://x/base/", "/data", ["tmax", "rain"], 1979, 1980).collect()
    assert len(rows) == 4 and ("http://x/base/rain/1980.rain.nc", "/data/rain/1980.rain.nc") in {tuple(r) for r in rows}
