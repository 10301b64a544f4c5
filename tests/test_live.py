"""Live providers against a local server: selection page by page, early stop, batches, and refusals."""

import base64
import json
import threading
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlparse

import pytest
from pyspark.sql import functions as F

from tracelake.sources import live, live_rows

SEEN: list = []
KEYS_SEEN: list = []
TIME = "2026-01-01T00:00:{:02d}Z"


def observation(i):
    return {"id": f"o{i}", "traceId": f"t{i}", "type": "GENERATION", "startTime": TIME.format(i), "parentObservationId": "gone" if i == 2 else None}


def run(i, parent=None):
    return {"id": i, "trace_id": i.split("-")[0], "parent_run_id": parent, "run_type": "tool" if parent else "chain", "name": "n", "start_time": TIME.format(1), "end_time": TIME.format(3), "status": "success", "total_cost": 0.5}


def pages(rows, page, size):
    part = rows[(page - 1) * size : page * size]
    return {"data": part, "pagination": {"page": page, "page_size": size, "current_page_size": len(part), "total_pages": max(1, -(-len(rows) // size)), "total_results": len(rows)}}


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *args):
        pass

    def answer(self, body, **headers):
        data = json.dumps(body).encode()
        self.send_response(200)
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self):
        KEYS_SEEN.append(self.headers.get("Authorization"))
        url = urlparse(self.path)
        query = {k: v[0] for k, v in parse_qs(url.query).items()}
        SEEN.append(url.path)
        if url.path == "/api/public/traces":
            first = (int(query["page"]) - 1) * 2
            return self.answer({"data": [{"id": f"t{i}", "timestamp": TIME.format(i)} for i in range(9 - first, max(9 - first - 2, 0), -1)], "meta": {"totalPages": 5}})
        if url.path.startswith("/api/public/traces/"):
            i = int(url.path.rsplit("t", 1)[1])
            return self.answer({"id": f"t{i}", "timestamp": TIME.format(i), "observations": [observation(i)], "scores": []})
        what = url.path.rsplit("/", 1)[1]
        assert unquote(url.path.split("/")[5]) == "w s"
        rows = {
            "traces": [{"id": f"t{i}", "session_id": "s", "started_at": TIME.format(i), "cost_usd": 1.5} for i in ([1, 3] if query.get("filter[evaluation_name]") != "b" else [2])],
            "evaluations": [{"name": "a"}, {"name": "b"}],
            "spans": [{"span_id": "x" + query.get("filter[trace_id]", ""), "session_id": "s", "kind": "TOOL", "source": "atif", "started_at": "2026-01-01T00:00:00", "status": "success",
                       "input": '{"function_name": "f", "arguments": {"a": 1}, "tool_call_id": "c"}', "output": '{"source_call_id": "c", "content": "ok"}'}],
            "evaluator-results": [{"span_id": s, "session_id": "s", "name": "q", "data_type": "NUMERIC", "value": v} for s, v in (("xt1", 0.5), ("other", 1.0))],
        }[what]
        self.answer(pages(rows, int(query["page"]), int(query["page_size"])))

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        SEEN.append((self.path, body))
        if self.path.endswith("/search"):
            token = int(body.get("page_token") or 0)
            end = min(token + min(2, body["max_results"]), 5)
            traces = [{"info": {"trace_id": f"m{i}"}, "data": {"spans": []}} for i in range(token, end)]
            return self.answer({"traces": traces, "next_page_token": str(end) if end < 5 else None})
        if self.path.endswith("/runs/query"):
            if body.get("is_root"):
                return self.answer({"runs": [run("r1"), run("r2")] if "cursor" not in body else [run("r3")], "cursors": {"next": None if "cursor" in body else "c"}})
            return self.answer({"runs": [x for i in ("r1", "r2", "r3") if f'"{i}"' in body["trace_filter"] for x in (run(i), run(f"{i}-a", i))], "cursors": {}})
        text = body["query"]
        if "is_root AND" in text:
            first = "OFFSET" not in text
            return self.answer({"data": [{"root_span_id": "b1", "created": TIME.format(2)}] if first else [{"root_span_id": "it's", "created": TIME.format(1)}]}, **({"x_bt_cursor": "q"} if first else {}))
        root = "it's" if "it''s" in text else "b1"
        rows = [
            {"id": "1", "span_id": "t", "root_span_id": root, "is_root": False, "span_parents": ["r"], "span_attributes": {"name": "f", "type": "tool"}, "metrics": {"start": 2, "end": 3}},
            {"id": "2", "span_id": "r", "root_span_id": root, "is_root": True, "span_attributes": {"type": "task"}, "metrics": {"start": 1.5}, "scores": {"q": 1}, "output": None},
        ]
        self.answer({"data": rows})


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_langfuse(spark, url):
    got = live_rows.load(spark, "langfuse", url=url, since=TIME.format(0), until=TIME.format(50), limit="8", batch="3")
    assert [r.trace_id for r in got.ordered().collect()] == [f"t{i}" for i in range(2, 10)]
    assert got.spans.where("span_id = 'o2'").first().unresolved_parent == "gone"
    assert sum(p == "/api/public/traces" for p in SEEN) == 4  # the fifth page isn't asked for


def test_keys_reach_tasks_without_an_environment(spark, url, monkeypatch):
    """Workers' environments have no key (this session started before it was set), and neither options nor plan show it."""
    monkeypatch.setenv("LANGFUSE_PUBLIC_KEY", "public-1")
    monkeypatch.setenv("LANGFUSE_SECRET_KEY", "hidden-2")
    in_worker = spark.range(1).mapInPandas(lambda frames: (f.assign(k=__import__("os").environ.get("LANGFUSE_SECRET_KEY", "none")) for f in frames), "id long, k string").first().k
    assert in_worker == "none"
    KEYS_SEEN.clear()
    rows = live_rows.load(spark, "langfuse", url=url, since=TIME.format(0), until=TIME.format(50), limit="2", batch="1")
    assert rows.traces.count() == 2
    expected = "Basic " + base64.b64encode(b"public-1:hidden-2").decode()
    assert len(KEYS_SEEN) >= 3 and set(KEYS_SEEN) == {expected}  # selection and both tasks
    frame = spark.read.format("trace_pages").options(provider="langfuse", url=url, since="a", until="b")
    assert "hidden-2" not in str(frame.load()._jdf.queryExecution().toString())


def test_failures_that_pass_are_tried_again(monkeypatch):
    monkeypatch.setattr(live, "PAUSES", (0, 0))
    answers = [urllib.error.HTTPError("u", 503, "", {}, None), urllib.error.URLError("reset"), None]

    class Answer:
        headers = {"X-A": "b"}
        read = staticmethod(lambda: b'{"ok": 1}')
        __enter__, __exit__ = lambda self: self, lambda self, *a: None

    def once(request, timeout):
        error = answers.pop(0)
        if error:
            raise error
        return Answer()

    monkeypatch.setattr(urllib.request, "urlopen", once)
    assert live.call("http://x/y", {}) == ({"ok": 1}, {"x-a": "b"}) and not answers
    answers[:] = [urllib.error.HTTPError("u", 404, "", {}, None)]
    with pytest.raises(live.ProviderError, match="/y: status 404"):
        live.call("http://x/y?key=1", {})
    answers[:] = [urllib.error.URLError("reset")] * 3
    with pytest.raises(live.ProviderError, match="reset"):
        live.call("http://x/y", {})


def test_selection_keeps_places_alone(url):
    """What the driver holds of a trace doesn't grow with the trace, and spans are asked for by tasks alone."""
    SEEN.clear()
    intake = live.Intake({"url": url, "workspace": "w s", "since": TIME.format(0), "until": TIME.format(9), "page_size": "1", "experiment": "e"})
    assert all(len(json.loads(i)) == 3 and len(i) < 40 for i in intake.select())
    flow = live.MLflow({"url": url, "experiment": "1", "limit": "3"})
    places = flow.select()
    asked = [x[1]["include_spans"] for x in SEEN if isinstance(x, tuple) and x[0].endswith("/search")]
    assert asked and not any(asked)
    assert [i for i, _, _ in flow.fetch(places)] == ["m0", "m1", "m2"]
    token, size, listed = json.loads(places[0])
    with pytest.raises(live.ProviderError, match="other traces"):
        list(flow.fetch([json.dumps([token, size, listed[::-1]])]))


def test_mlflow(spark, url):
    got = live_rows.load(spark, "mlflow", url=url, experiment="1", limit="3")
    assert sorted(r.trace_id for r in got.traces.select("trace_id").collect()) == ["m0", "m1", "m2"]


def test_langsmith(spark, url):
    got = live_rows.load(spark, "langsmith", url=url, project="p", limit="3", batch="2")
    rows = {r.trace_id: (r.cost_usd, r.latency_ms) for r in got.traces.select("trace_id", "cost_usd", "latency_ms").collect()}
    assert rows == {f"r{i}": (1.0, 2000.0) for i in (1, 2, 3)}
    assert {len(x[1]["trace_filter"].split(",")) for x in SEEN if isinstance(x, tuple) and "trace_filter" in x[1]} == {2, 3}  # in(id, ...) of batches


def test_braintrust(spark, url):
    got = live_rows.load(spark, "braintrust", url=url, project="p", since=TIME.format(0), until=TIME.format(9))
    spans = got.spans.where("trace_id = \"it's\"").select("span_id", "parent_id", "kind", F.to_json("output").alias("o"), F.try_variant_get("tool_call", "$.result_count", "int").alias("n")).collect()
    assert {tuple(r) for r in spans} == {("t", "r", "TOOL", None, 0), ("r", None, "CHAIN", "null", None)}
    assert {r.latency_ms for r in got.traces.select("latency_ms").collect()} == {1500.0}


def test_intake(spark, url):
    options = {"url": url, "workspace": "w s", "since": TIME.format(0), "until": TIME.format(9), "page_size": "1"}
    got = live_rows.load(spark, "intake", experiment="e", **options)
    rows = {r.trace_id: (r.position, r.results) for r in got.traces.select("trace_id", "position", F.to_json("results").alias("results")).collect()}
    assert rows == {"t1": (0, '{"q":0.5}'), "t2": (1, None), "t3": (2, None)}
    span = got.spans.where("trace_id = 't1'").select("tool", F.to_json("input").alias("i"), F.to_json("output").alias("o"), F.to_json("tool_call").alias("c")).first()
    assert tuple(span) == ("f", '{"a":1}', '"ok"', '{"call_id":"c","result_id":"c"}')
    assert len(live.Intake(options | {"experiment": "e", "evaluation": "b"}).select()) == 1


@pytest.mark.parametrize(("told", "why"), [({"page": 2}, "another page"), ({"current_page_size": 5}, "another size"), ({"total_results": 9}, "more or fewer")])
def test_intake_refuses_inconsistent_pages(monkeypatch, told, why):
    answer = pages([{"id": "t", "started_at": "x"}], 1, 1)
    answer["pagination"] |= told
    monkeypatch.setattr(live, "call", lambda *a, **k: (answer, {}))
    with pytest.raises(live.ProviderError, match=why):
        live.Intake({"url": "http://x", "workspace": "w", "since": "", "until": ""}).select()


def test_pages_without_progress(monkeypatch):
    monkeypatch.setattr(live, "call", lambda *a, **k: ({"traces": [{"info": {"trace_id": str(len(SEEN))}}], "next_page_token": "x", "data": [{"root_span_id": "r", "created": "c"}], "runs": []}, {"x-bt-cursor": "q"}) if SEEN.append(0) is None else None)
    for provider, more in ((live.MLflow, {"experiment": "1", "limit": "9"}), (live.Braintrust, {"project": "p", "since": "a", "until": "b"})):
        with pytest.raises(live.ProviderError):
            provider({"url": "http://x", **more}).select()
