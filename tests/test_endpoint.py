"""The paged endpoint against a server on this machine: pages, limits, a 429, a 404, and a server that is gone."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from gridspark.sources import endpoint, feeds, responses
from gridspark.sources.endpoint import Client, EndpointOptions, Limiter, read_endpoint, retry_after


class Server:
    """Serves 7 races in pages; counts requests, and answers some paths as told."""

    def __init__(self):
        self.seen, self.tries, outer = [], {}, self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *args):
                pass

            def do_GET(self):
                u = urlparse(self.path)
                q = {k: v[0] for k, v in parse_qs(u.query).items()}
                outer.seen.append((time.monotonic(), self.path))
                n = outer.tries[self.path] = outer.tries.get(self.path, 0) + 1
                if u.path == "/none":
                    return self.say(404, b"{}")
                if u.path == "/bad":
                    return self.say(400, b"{}")
                if u.path == "/busy" and n == 1:
                    return self.say(429, b"{}", {"Retry-After": "0.2"})
                if u.path == "/list":
                    return self.say(200, json.dumps([{"session_key": int(q["k"]), "lap": i} for i in range(2)]).encode())
                if u.path == "/broken":
                    return self.say(200, b"<html>")
                lo, size = int(q.get("offset", 0)), int(q.get("limit", 3))
                races = [{"season": "2024", "round": str(i + 1), "date": "2024-03-01", "Circuit": {"circuitId": f"c{i}"}} for i in range(7)][lo : lo + size]
                self.say(200, json.dumps({"MRData": {"limit": str(size), "offset": str(lo), "total": "7", "RaceTable": {"Races": races}}}).encode())

            def say(self, status, body, headers=()):
                self.send_response(status)
                for k, v in dict(headers).items():
                    self.send_header(k, v)
                self.end_headers()
                self.wfile.write(body)

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.http.server_port}"
        threading.Thread(target=self.http.serve_forever, daemon=True).start()

    def close(self):
        self.http.shutdown()
        self.http.server_close()


@pytest.fixture
def server():
    s = Server()
    yield s
    s.close()


def test_pages_cache_and_stale_answers(spark, server, tmp_path):
    options = EndpointOptions(cache=str(tmp_path / "cache"), retries=2, backoff=0.01, lanes=2)
    pages = read_endpoint(spark, f"{server.url}/races", 3, "MRData.total", options)
    rows = sorted(pages.collect(), key=lambda r: r["offset"])
    assert [(r["offset"], r["origin"], r["status"], r["attempts"]) for r in rows] in ([(0, "network", 200, 1), (3, "network", 200, 1), (6, "network", 200, 1)], [(0, "cache", 200, 0), (3, "network", 200, 1), (6, "network", 200, 1)])
    asked = len(server.seen)
    assert asked == 3 and all(r["bytes"] == len(r["body"]) for r in rows)
    races = responses.flatten_schedule(endpoint.landed(pages, "races"))
    assert sorted(r["race_id"] for r in races.collect()) == [f"2024_{k:02d}" for k in range(1, 8)] and responses.missing_pages(endpoint.landed(pages, "races"), "query").isEmpty()
    assert len(server.seen) == asked  # all from the cache
    assert feeds.provenance(spark, str(tmp_path / "cache")).count() == 3
    again = read_endpoint(spark, f"{server.url}/races", 3, "MRData.total", EndpointOptions(**{**options.__dict__, "refresh": True}))
    assert {r["origin"] for r in again.collect()} == {"network"} and len(server.seen) > asked
    server.close()
    gone = read_endpoint(spark, f"{server.url}/races", 3, "MRData.total", EndpointOptions(**{**options.__dict__, "refresh": True, "timeout": 2.0}))
    late = gone.collect()
    assert {r["origin"] for r in late} == {"stale"} and all(r["error"] and r["body"] for r in late) and sorted(r["fetched_at"] for r in late) != []


def test_busy_missing_and_dead_servers(spark, server):
    quick = EndpointOptions(retries=3, backoff=0.01, timeout=2.0, strict=False)
    one = lambda path, o=quick: read_endpoint(spark, f"{server.url}{path}", options=o).collect()
    (busy,) = one("/busy")
    assert (busy["origin"], busy["attempts"]) == ("network", 2)
    stamps = [t for t, p in server.seen if p == "/busy"]
    assert stamps[1] - stamps[0] >= 0.2
    (none,) = one("/none")
    assert (none["origin"], none["status"], none["body"]) == ("missing", 404, None)
    assert endpoint.records(read_endpoint(spark, f"{server.url}/none", options=quick), "lap int").columns == ["lap", "source_url", "fetched_at"]
    assert endpoint.records(read_endpoint(spark, f"{server.url}/none", options=quick), "lap int").isEmpty()
    (bad,) = one("/bad")
    assert (bad["origin"], bad["status"], bad["attempts"]) == ("failed", 400, 1)
    (broken,) = one("/broken")
    assert (broken["origin"], broken["attempts"]) == ("failed", 3)
    with pytest.raises(Exception, match="no list of records"):
        endpoint.records(read_endpoint(spark, f"{server.url}/races", options=quick), "lap int").collect()
    server.close()
    (dead,) = one("/races")
    assert (dead["origin"], dead["status"], dead["body"]) == ("failed", None, None) and dead["error"]
    with pytest.raises(Exception, match="no response"):
        one("/races", EndpointOptions(retries=1, timeout=1.0))


def test_requests_of_a_table(spark, server):
    urls = spark.createDataFrame([(f"{server.url}/list?k={k % 5}",) for k in range(20)] + [(None,)], "url string")
    out = endpoint.fetch_each(urls, options=EndpointOptions(lanes=2))
    rows = endpoint.records(out, "session_key int, lap int")
    assert sorted((r["session_key"], r["lap"]) for r in rows.collect()) == [(k, i) for k in range(5) for i in range(2)]
    assert {r["source_url"] for r in rows.collect()} == {f"{server.url}/list?k={k}" for k in range(5)}


def test_limits_are_shared():
    lane = EndpointOptions(interval=0.5, quota=6, lanes=4).shared(100)
    assert (lane.lanes, lane.interval, lane.quota) == (4, 2.0, 1)
    assert EndpointOptions(quota=2, lanes=8).shared(100).lanes == 2 and EndpointOptions(lanes=8).shared(3).lanes == 3
    now, sent = [0.0], []
    limiter = Limiter(0.1, 3, 1.0, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(12):
        limiter.wait()
        sent.append(now[0])
    assert all(b - a >= 0.1 - 1e-9 for a, b in zip(sent, sent[1:])) and all(sent[k + 3] - sent[k] >= 1.0 - 1e-9 for k in range(9))
    assert retry_after("1.5") == 1.5 and retry_after(None) == 0 and retry_after("soon") == 0
    from datetime import UTC, datetime

    assert retry_after("Fri, 01 Mar 2024 10:00:30 GMT", datetime(2024, 3, 1, 10, tzinfo=UTC)) == 30


def test_quota_holds_over_partitions(spark, server):
    options = EndpointOptions(quota=4, window=1.0, lanes=2)
    read_endpoint(spark, f"{server.url}/races", 1, "MRData.total", options).collect()
    stamps = sorted(t for t, p in server.seen if "offset" in p and "offset=0" not in p)
    assert len(stamps) == 6 and all(b - a >= 0.95 for a, b in zip(stamps, stamps[4:]))


def test_client_sleeps_between_attempts(server):
    naps = []
    client = Client(EndpointOptions(retries=3, backoff=2.0, timeout=1.0, strict=False), sleep=naps.append)
    server.close()
    assert client.get(server.url)[3] == "failed" and naps == [2.0, 4.0]
