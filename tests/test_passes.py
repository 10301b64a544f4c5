"""Registry of passes, and problems from tables."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracelake import config
from tracelake.__main__ import main
from tracelake.operators import problems
from tracelake.operators import projections as P
from tracelake.plans import review
from tracelake.plans.passes import FunctionPass, Registry, Result, built_in
from tracelake.sinks.files import digest
from tracelake.sources import canonical
from tracelake.sources.common import Snapshot


def test_registry(spark):
    empty = Snapshot(spark.createDataFrame([], "trace_id string"), spark.createDataFrame([], "trace_id string"))
    one = Snapshot(spark.createDataFrame([("t",)], "trace_id string"), empty.spans)
    registry = Registry()
    registry.register(FunctionPass("a", lambda s: Result("a", limitations=["x"])))
    registry.register(FunctionPass("b", lambda s: Result("a"), lambda s: None))
    registry.register(FunctionPass("c", lambda s: Result("c"), lambda s: "not set up"))
    assert registry.names == ("a", "b", "c")
    assert registry.analyze("a", one).limitations == ["x"]
    assert registry.analyze("a", empty).skip_reason == "No traces loaded"
    assert registry.analyze("c", one).skip_reason == "not set up"
    for bad in (lambda: registry.analyze("b", one), lambda: registry.register(FunctionPass("a", None)), lambda: registry.register(FunctionPass(" ", None))):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError, match="a, b, c"):
        registry.analyze("z", one)


def test_problems(spark):
    groups = spark.createDataFrame([("m", 5, 3, ["y", "x"], [("t1", "c1"), ("t2", "c2")]), ("n", 1, 1, ["x"], [("t3", "c3")])], "message_signature string, event_count int, independent_trace_count int, tools array<string>, representatives array<struct<trace_id:string,call_id:string>>")
    rows = problems.from_cross_tool(groups).collect()
    assert len(rows) == 1 and "called: x, y" in rows[0].description and rows[0].supporting_trace_ids == ["t1", "t2"]
    flagged = spark.createDataFrame([("a", 0.9, True), ("b", 0.95, True), ("c", 0.1, False)], "trace_id string, score double, flagged boolean")
    reasons = spark.createDataFrame([("a", ["high x"]), ("b", ["high x", "low y"]), ("c", ["z"])], "trace_id string, reasons array<string>")
    row = problems.from_outliers(flagged, reasons).first()
    assert row.description.startswith("2 traces differ") and "high x in 2, low y in 1" in row.description and row.supporting_trace_ids == ["b", "a"]
    assert problems.from_outliers(flagged.where("score < 0.5"), reasons).count() == 0


def trace(i, case, catalog=True, fail=True):
    output = {"isError": True, "content": "boom: ref77 not found"} if fail else {"content": "ok"}
    call = {"id": f"s{i}", "kind": "TOOL", "tool_name": "find", "input": {"user_id": "ref77"}, "output": output, "children": []}
    other = {"id": f"o{i}", "kind": "TOOL", "tool_name": "odd", "input": {"x": 1}, "output": None, "children": [], "tool_call": {"result_count": 0}}
    root = {"id": f"r{i}", "kind": "AGENT", "input": "hello", "output": "done", "children": [call, call | {"id": f"t{i}"}, call | {"id": f"u{i}"}, other]}
    attributes = {"logical_case_id": case, "complete_provenance_context": True, "observed_verdict": "bad run 12", "metrics": {"own": i}}
    if catalog:
        attributes["tool_catalog"] = {"find": None, "other": {"type": "object"}}
    return {"id": f"t{i}", "root_spans": [root], "aggregate": {"cost_usd": float(i)}, "attributes": attributes}


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus") / "a.jsonl"
    path.write_text("\n".join(json.dumps(trace(i, f"k{i % 4}", fail=i != 5)) for i in range(6)))
    return path


def test_built_in_passes(spark, corpus):
    snapshot = canonical.read(spark, str(corpus))
    issues, odd = built_in({"tool_issues": {}, "anomalies": {"robust": True}}).analyze_all(snapshot)
    cards = {r.issue_type: (r.finding_count, r.independent_case_count, r.eligible) for r in issues.tables["cards"].collect()}
    assert cards["unknown_tool"] == (6, 4, True) and cards["explicit_tool_failure"] == (15, 4, True) and cards["missing_tool_result"] == (6, 4, True)
    assert cards["explicitly_rejected_ungrounded_identifier"] == (5, 4, True)  # the first result mentions it, later calls repeat it
    assert cards["repeated_identical_failed_call"] == (5, 4, True) and "malformed_tool_call" not in cards
    assert issues.limitations == ["6 of 24 calls have no result to judge."]
    failures = odd.tables["failures"].collect()
    assert [(r.signature, r.event_count, r.independent_trace_count) for r in failures] == [("find: boom: ref7<n> not found", 15, 5)]
    assert odd.tables["verdicts"].first().verdict == "bad run <n>" and odd.tables["features"].where("own = 3").count() == 1
    clusters = odd.tables["clusters"].collect()
    assert {r.status for r in clusters} == {"all trajectories are alike"}
    assert all(r.problems.count() > 0 for r in (issues, odd))
    source = spark.createDataFrame([(1,)], "a int")
    text = digest(odd.tables["anomalies"], odd.tables["failures"], odd.tables["cross_tool"], odd.tables["verdicts"], source, snapshot.traces, {"traces": 6})
    assert "traces: 6" in text and "find: boom" in text
    with pytest.raises(ValueError, match="unknown traces"):
        digest(odd.tables["anomalies"], odd.tables["failures"], odd.tables["cross_tool"], odd.tables["verdicts"], source, snapshot.traces.where("trace_id = 't1'"))


def test_command_line(corpus, tmp_path, capsys):
    settings = tmp_path / "s.json"
    settings.write_text(json.dumps({"source": {"canonical": {"path": str(corpus)}}, "passes": {"tool_issues": {"minimum_cases": 5, "audit": True}}, "artifacts": str(tmp_path / "art")}))
    assert main(["run", str(settings), "--output", str(tmp_path / "out.yml")]) == 0
    assert "tool_issues:" in capsys.readouterr().out and "unknown tool" in (tmp_path / "out.yml").read_text() and (tmp_path / "art/tool_issues/cards").exists()
    assert main(["coverage", str(settings), "--verbose"]) == 0
    said = capsys.readouterr().out
    assert "Rules that can fire" in said and "no call has a result id" in said and "traces 6, calls 24" in said
    settings.write_text("{}")
    assert main(["run", str(settings)]) == 2 and "source" in capsys.readouterr().err


def test_plugins_add_sources(corpus, tmp_path, monkeypatch, capsys):
    """A module that settings name registers a reader; a run with it writes a digest beside its tables."""
    (tmp_path / "own_source_plugin.py").write_text(
        "from tracelake.sources import canonical, readers\n"
        "readers.register('own', lambda spark, folder, name, limit=None: canonical.read(spark, folder + '/' + name), 'folder', 'name')\n"
    )
    monkeypatch.syspath_prepend(str(tmp_path))
    settings, values = tmp_path / "s.json", {"plugins": ["own_source_plugin"], "source": {"own": {"folder": str(corpus.parent), "name": corpus.name, "limit": 3}}}
    settings.write_text(json.dumps(values | {"passes": {"anomalies": {}}, "artifacts": str(tmp_path / "art")}))
    assert main(["run", str(settings), "--output", str(tmp_path / "out.yml")]) == 0
    text = "".join(p.read_text() for p in (tmp_path / "art/anomalies/digest").glob("*.txt"))
    assert "# Evidence digest" in text and "- trace_count: 6" in text and "find: boom" in text and "## Trajectories" in text
    settings.write_text(json.dumps(values | {"source": {"own": {"folder": "x"}}}))
    assert main(["run", str(settings)]) == 2 and "name missing" in capsys.readouterr().err
    settings.write_text(json.dumps(values | {"plugins": ["no_such_module"]}))
    assert main(["run", str(settings)]) == 2 and "no_such_module" in capsys.readouterr().err
    with pytest.raises(config.ConfigError, match="already"):
        config.register_source("atif", ["path"])


@pytest.mark.parametrize(("values", "why"), [
    ({}, "exactly one"), ({"source": {"atif": {"path": "a"}, "runs": {"path": "b"}}}, "exactly one"), ({"source": {"x": {}}}, "no source"), ({"source": {"atif": {}}}, "path missing"),
    ({"source": {"atif": {"path": "a", "odd": 1}}}, "no option odd"), ({"source": {"atif": {"path": "a"}}, "more": 1}, "no setting"), ({"source": {"atif": {"path": "a", "limit": 0}}}, "limit"),
    *(({"source": {"atif": {"path": "a"}}, "passes": p}, why) for p, why in (
        ({"odd": True}, "no pass"), ({"tool_issues": False}, "no pass is on"), ({"tool_issues": {"minimum_cases": 0}}, "1 or more"), ({"anomalies": {"contamination": 0.5}}, "between"),
        ({"anomalies": {"features": ["a", "a"]}}, "twice"), ({"anomalies": {"recurrence": 1}}, "2 or more"), ({"anomalies": {"x": 1}}, "no option x"), ({"anomalies": 3}, "true, false"),
    )),
])
def test_config_refusals(values, why):
    with pytest.raises(config.ConfigError, match=why):
        config.parse(values)


def test_config(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("export KEY_A='x y'\n# no\nKEY_B=z\n")
    monkeypatch.setenv("KEY_B", "set")
    assert (config.secret("KEY_A", str(tmp_path)), config.secret("KEY_B", str(tmp_path)), config.secret("KEY_C", str(tmp_path))) == ("x y", "set", None)
    got = config.parse({"source": {"atif": {"path": "a"}}, "passes": {"tool_issues": {}, "anomalies": False}})
    assert got.passes == {"tool_issues": config.PASSES["tool_issues"]} and got.output == "-"


def test_review(spark, corpus):
    snapshot = canonical.read(spark, str(corpus))
    walked = P.visits(snapshot.spans)

    def failing(spans):
        bad = spans[spans["output"].fillna("").str.contains("isError")]["span_id"].tolist()
        return ("match", bad) if bad else ("no_match", []) if len(spans) > 1 else ("unknown", [])

    example = lambda *outputs: pd.DataFrame({"trace_id": "x", "span_id": [f"s{i}" for i in range(len(outputs))], "output": outputs})
    examples = {"match": example("isError", ""), "no_match": example("", ""), "unknown": example("")}
    saved = spark.createDataFrame([("i", "t1", "old", ["gone"])], "insight_id string, trace_id string, url string, spans array<string>")
    broken = (failing, examples | {"unknown": example("isError")})
    got = review.compile_insights(snapshot, walked, saved, {"i": (failing, examples), "j": broken, "k": (lambda s: ("match", ["nobody"]), examples)}, "2026-01-01")
    assert set(got.failed) == {"j", "k"}
    rows = {r.trace_id: r for r in got.evidence.collect()}
    assert sorted(rows) == ["t0", "t1", "t2", "t3", "t4"] and rows["t1"].url == "old" and rows["t1"].spans == ["gone", "s1", "t1", "u1"] and rows["t0"].spans == ["s0", "t0", "u0"]
    assert got.updated.first().updated_date == "2026-01-01"
    for predicate in (lambda s: ("match", []), lambda s: ("maybe", []), lambda s: ("match", ["nobody"])):
        with pytest.raises(Exception, match="GuardError"):
            review.scan_traces(walked, predicate).collect()
    messages = lambda rows: lambda s: s.traces.limit(rows).select("trace_id", F.array().cast("array<string>").alias("messages"))
    assert review.extracted_messages(snapshot, messages(6)).count() == 6
    with pytest.raises(review.GuardError, match="left out"):
        review.extracted_messages(snapshot, messages(5))
    found = lambda *ids: spark.createDataFrame([("a", list(ids)), ("b", [])], "description string, supporting_trace_ids array<string>")

    class Finds:
        def detect(self, snapshot, description, extras):
            return found(*extras["ids"])

    assert review.detected(None, snapshot) is None and review.detected(Finds(), snapshot, {"ids": ["t1"]}).count() == 2
    with pytest.raises(review.GuardError, match="t9"):
        review.detected(Finds(), snapshot, {"ids": ["t9"]})
    fetcher = review.Fetcher(snapshot, 1)
    assert fetcher.fetch("t1").traces.count() == 1 and fetcher.checked(found("t1")).count() == 2
    for bad in (lambda: fetcher.fetch("t2"), lambda: fetcher.checked(found("t2"))):
        with pytest.raises(review.GuardError):
            bad()
    stays, n = review.validated(found("t1"), lambda d: review.Verdict(d != "a", lookups=1))
    assert [r.description for r in stays.collect()] == ["b"] and n == 1
    assert review.validated(found("t1"), lambda d: review.Verdict(False))[1] == 0
