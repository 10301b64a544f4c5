"""Readers of trace exports: flat tables, missing against null, order, and refusals with a place."""

import json

import pytest
from pyspark.sql import functions as F

from tracelake.operators.trees import preorder
from tracelake.sinks.files import markdown_table, write_json
from tracelake.sources import atif_exports, canonical, mlflow_exports, observation_exports, rollout_exports, run_exports
from tracelake.sources.common import Snapshot, TraceLoadError


def span(i, children=(), **more):
    return {"id": i, "kind": "AGENT", "children": list(children), **more}


def write(tmp_path, name, rows):
    path = tmp_path / name
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def test_canonical(spark, tmp_path):
    tool = span("c", kind="TOOL", tool_name="t", input={"a": 1}, output=None, start_time="2026-01-01T00:00:00Z", end_time="2026-01-01T00:00:01.5+00:00", tool_call={"call_id": "x"})
    trace = {"id": "t1", "root_spans": [span("a", [span("b", [tool])]), span("d")], "aggregate": {"cost_usd": 1.5}, "attributes": {"logical_case_id": "k"}}
    path = write(tmp_path, "a.jsonl", [trace, "", {"id": "t2", "root_spans": [], "aggregate": {}}])
    got = canonical.read(spark, path)
    spans = {r.span_id: r for r in got.spans.withColumn("null_output", (F.col("output").isNotNull() & F.is_variant_null("output"))).drop("input", "output", "attributes").collect()}
    assert {i: s.parent_id for i, s in spans.items()} == {"a": None, "b": "a", "c": "b", "d": None}
    assert spans["c"].null_output is True and spans["a"].null_output is False and spans["c"].duration_ms == 1500.0
    assert [r.span_id for r in preorder(got.spans.select("trace_id", "span_id", "parent_id", "start")).orderBy("dfs_index").collect()] == ["a", "b", "c", "d"]
    assert [r.source_url[-3:] for r in got.traces.orderBy("trace_id").collect()] == ["#L1", "#L3"]
    assert tuple(got.describe().first()) == (2, 2, 1)
    got.save(str(tmp_path / "snapshot"))
    assert Snapshot.open(spark, str(tmp_path / "snapshot")).spans.count() == 4


@pytest.mark.parametrize(("row", "said"), [
    ("{bad", ":1: malformed JSON"), ({"id": "", "root_spans": [], "aggregate": {}}, ":1: invalid trace"),
    ({"id": "t", "root_spans": [span("a", kind="ODD")], "aggregate": {}}, "invalid id or kind"),
    ({"id": "t", "root_spans": [span("a", start_time="2026-01-01T00:00:00")], "aggregate": {}}, "time without an offset"),
    ({"id": "t", "root_spans": [span("a", [span("a")])], "aggregate": {}}, "duplicate span"),
    ({"id": "t", "root_spans": [span("a", tool_call={})], "aggregate": {}}, "no tool"),
    ({"id": "t", "root_spans": [span("a", cost_usd=-1)], "aggregate": {}}, "negative"),
    ({"id": "t", "root_spans": [span("a", start_time="2026-01-01T00:00:01Z", end_time="2026-01-01T00:00:00Z")], "aggregate": {}}, "ends before"),
])
def test_canonical_refusals(spark, tmp_path, row, said):
    with pytest.raises(TraceLoadError, match=said):
        canonical.read(spark, write(tmp_path, "a.jsonl", [row]))


def run(i, parent=None, trace="r", **more):
    return {k: None for k in run_exports.REQUIRED} | {"run_id": i, "trace_id": trace, "parent_run_id": parent, "run_type": "chain", "start_time": "2026-01-01T00:00:00Z", "status": "success"} | more


def test_run_exports(spark, tmp_path):
    rows = [run("r", custom_metadata={"thread_id": "th"}), run("x", "r", run_type="tool", name="t", error="boom", costs={"total_cost": 0.5}, end_time="2026-01-01T00:00:02Z"), run("q", trace="q", start_time="2026-01-02T00:00:00Z", run_type="odd")]
    got = run_exports.read(spark, write(tmp_path, "a.jsonl", rows))
    assert {r.span_id: (r.kind, r.subtype, r.tool, r.error) for r in got.spans.drop("input", "output", "attributes").collect()} == {"r": ("CHAIN", None, None, None), "x": ("TOOL", None, "t", "boom"), "q": ("UNKNOWN", "ODD", None, None)}
    assert {r.trace_id: (r.case_id, r.cost_usd, r.latency_ms) for r in got.traces.drop("results", "attributes").collect()} == {"r": ("th", 0.5, 2000.0), "q": (None, None, None)}
    assert [r.trace_id for r in run_exports.read(spark, write(tmp_path, "a.jsonl", rows), limit=1).traces.select("trace_id").collect()] == ["q"]
    for bad, said in (([{k: v for k, v in run("r").items() if k != "tags"}], "tags is missing"), ([run("r"), run("x", "gone")], "parent not found"), ([run("x", "y"), run("y", "x"), run("r")], "cycle")):
        with pytest.raises(TraceLoadError, match=said):
            run_exports.read(spark, write(tmp_path, "b.jsonl", bad))


def test_mlflow_exports(spark, tmp_path):
    s = {"span_id": "s", "parent_span_id": "gone", "name": "n", "start_time_unix_nano": 1788374258529802123, "end_time_unix_nano": 1788374258533442000, "status": {"code": "STATUS_CODE_ERROR", "message": ""},
         "attributes": {"mlflow.spanType": '"CHAT_MODEL"', "mlflow.spanInputs": '{"q": 1}', "mlflow.spanOutputs": "null"}}
    trace = {"info": {"trace_id": "tr", "trace_metadata": {"mlflow.trace.session": "se"}, "assessments": [{"assessment_name": "a", "valid": False}, {"assessment_name": "b", "x": 1}]}, "data": {"spans": [s]}}
    for rows in ([trace], [[trace]], [{"traces": [trace], "next_page_token": None}], [trace, json.dumps(trace).replace('"tr"', '"tr2"')]):
        got = mlflow_exports.read(spark, write(tmp_path, "a.json", rows))
        first = got.spans.where("trace_id = 'tr'").withColumn("n", (F.col("output").isNotNull() & F.is_variant_null("output"))).drop("input", "output", "attributes").first()
        assert (first.kind, first.subtype, first.error, first.unresolved_parent, first.n) == ("LLM", "CHAT_MODEL", "MLflow span status ERROR", "gone", True)
        assert first.start.microsecond == 529802
    head = got.traces.where("trace_id = 'tr'").select("case_id", F.to_json("results").alias("r")).first()
    assert head.case_id == "se" and list(json.loads(head.r)) == ["b"]


def test_observation_exports(spark, tmp_path):
    o = {"id": "o", "traceId": "t", "type": "GENERATION", "startTime": "2026-01-01T00:00:00Z", "endTime": "2026-01-01T00:00:01Z", "input": '{"a": 1}', "output": None, "level": "ERROR", "statusMessage": "", "costDetails": {"total": -1}, "calculatedTotalCost": 2}
    body = {"id": "t", "timestamp": "2026-01-01T00:00:00Z", "sessionId": "s", "observations": [o], "scores": [{"id": "2", "name": "n"}, {"id": "1", "name": "n"}]}
    got = observation_exports.read(spark, write(tmp_path, "a.json", [{"status": 200, "headers": {}, "body": body}]))
    s = got.spans.select("kind", "error", "cost_usd", F.to_json("input").alias("i"), F.col("output").isNull().alias("none")).first()
    assert tuple(s) == ("LLM", "ERROR", 2.0, '{"a":1}', True)
    t = got.traces.select("case_id", "cost_usd", "latency_ms", F.to_json("results").alias("r")).first()
    assert tuple(t)[:3] == ("s", 2.0, 1000.0) and [x["id"] for x in json.loads(t.r)["n"]] == ["1", "2"]
    with pytest.raises(TraceLoadError, match="status"):
        observation_exports.read(spark, write(tmp_path, "b.json", [{"status": 500, "body": body}]))


def test_sinks(spark, tmp_path):
    table = spark.createDataFrame([("a|b", float("nan")), ("c\nd", 1.0)], "name string, x double")
    assert "a\\|b" in markdown_table("T", table, 5) and "c d" in markdown_table("T", table, 5)
    write_json(table, str(tmp_path / "j"))
    assert sorted(str(r.x) for r in spark.read.json(str(tmp_path / "j")).collect()) == ["1.0", "None"]


def test_lines_have_numbers_in_splits(spark, tmp_path):
    """Files are read in several splits; lines keep their numbers."""
    from tracelake.sources.common import lines_of

    text = "\n".join("" if i % 7 == 0 else f"line {i} " + "x" * (i % 50) for i in range(1, 4001))
    for name in ("a.jsonl", "b.jsonl"):
        (tmp_path / name).write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = lines_of(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 2 * sum(i % 7 != 0 for i in range(1, 4001))
    assert all(r.text.startswith(f"line {r.line} ") for r in rows)


def step(i, source="agent", message="m", **more):
    return {"step_id": i, "source": source, "message": message, **more}


def atif(steps, trajectory="t", **more):
    return {"schema_version": "ATIF-v1.4", "trajectory_id": trajectory, "agent": {"name": "a", "version": "1", "model_name": "mo"}, "steps": steps, **more}


def test_atif(spark, tmp_path):
    calls = [{"tool_call_id": c, "function_name": "f", "arguments": {"x": 1}} for c in ("c1", "c2", "c3")]
    results = [
        {"source_call_id": "c1", "content": None}, {"source_call_id": "c2", "content": "a"}, {"source_call_id": "c2", "content": "b"},
        {"content": "loose", "subagent_trajectory_ref": [{"trajectory_id": "s1"}]},
    ]
    row = atif([
        step(1, "user", [{"type": "text", "text": "hi"}, {"type": "image"}, {"type": "text", "text": "there"}]),
        step(2, tool_calls=calls, observation={"results": results}, metrics={"prompt_tokens": 9, "cached_tokens": 4, "completion_tokens": 1, "cost_usd": 0.5}, timestamp="2026-01-01T00:00:00Z"),
        step(3, llm_call_count=0, timestamp="2026-01-01T00:00:00"),
    ], session_id="se", final_metrics={"total_cost_usd": 2}, subagent_trajectories=[atif([step(1)], "s1"), atif([step(1)], "s2")])
    got = atif_exports.read(spark, write(tmp_path, "a.jsonl", [row]))
    assert tuple(got.traces.select("trace_id", "case_id", "cost_usd").first()) == ("t", "se", 2.0)
    columns = ["span_id", "parent_id", "kind", "model", "tool", "start", "tokens", F.to_json("input").alias("i"), F.to_json("output").alias("o"), F.to_json("tool_call").alias("call")]
    spans = {r.span_id.removeprefix("trajectory"): r for r in preorder(got.spans).orderBy("dfs_index").select(*columns).collect()}
    assert list(spans) == [
        "", "/step/1", "/step/2", "/step/2/tool/0", "/step/2/tool/1", "/step/2/tool/2", "/step/2/observation/0", "/subagent/0", "/subagent/0/step/1", "/step/3", "/subagent/1", "/subagent/1/step/1",
    ]
    assert spans["/subagent/0"].parent_id == "trajectory/step/2/observation/0" and spans["/subagent/1"].parent_id == "trajectory"
    assert [spans[k].kind for k in ("", "/step/1", "/step/2", "/step/3", "/step/2/tool/0")] == ["AGENT", "CHAIN", "LLM", "CHAIN", "TOOL"]
    assert [spans[f"/step/2/tool/{i}"].o for i in range(3)] == ["null", '[{"content":"a","source_call_id":"c2"},{"content":"b","source_call_id":"c2"}]', None]
    call = json.loads(spans["/step/2/tool/1"].call)
    assert (call["call_id"], call["result_count"], call["prior_user_text"]) == ("c2", 2, "hi\nthere")
    assert tuple(spans["/step/2"].tokens) == (5, 4, 1) and spans["/step/2"].model == "mo" and spans["/step/3"].start is None and spans["/step/3"].model is None


@pytest.mark.parametrize(("row", "said"), [
    (atif([step(2)]), "sequential"), (atif([step(1, "user", metrics={"cost_usd": 1})]), "only an agent"), (atif([step(1, llm_call_count=0, metrics={})]), "without a model call"),
    (atif([step(1, observation={"results": [{"source_call_id": "x"}]})]), "unknown call"), (atif([step(1)], schema_version="ATIF-v2.0"), "schema_version"),
    (atif([step(1, observation={"results": [{"subagent_trajectory_ref": [{"trajectory_id": "x"}]}]})]), "no embedded sub-agent"), (atif([step(1)], continued_trajectory_ref="x"), "continues"),
    (atif([step(1, metrics={"prompt_tokens": 1, "cached_tokens": 2})]), "more cached"), (atif([step(1)], trajectory=None), "no trajectory_id"),
    (atif([step(1, tool_calls=[{"tool_call_id": "c", "function_name": "f"}] * 2)]), "duplicate tool call"), (atif([step(1)], subagent_trajectories=[atif([], "s")] * 2), "duplicate sub-agent"),
])
def test_atif_refusals(spark, tmp_path, row, said):
    with pytest.raises(TraceLoadError, match=said):
        atif_exports.read(spark, write(tmp_path, "a.jsonl", [row]))


def rollout(**more):
    return {"ng_trajectory": {"schema_version": "1.0", "task_id": "k", "rollout_id": "r", **more}, "reward": 0.5}


def test_rollouts(spark, tmp_path):
    talk = [
        {"role": "user", "content": "go"}, {"type": "function_call", "call_id": "c1", "name": "f", "arguments": '{"a": 1}'}, {"type": "function_call_output", "call_id": "c1", "output": "ok"},
        {"type": "function_call", "call_id": "c2", "name": "g"},
    ]
    row = rollout(
        invocations=[
            {"invocation_id": "i1", "status": "failed", "conversation": talk, "model_calls": [{"model_call_id": "m1"}, {"response_id": "q", "model_ref": {"n": 1}}, {"model_call_id": "gone"}]},
            {"invocation_id": "i2", "parent_invocation_id": "i1"}, {"invocation_id": "i3", "parent_invocation_id": "nobody"},
        ],
        model_calls=[
            {"model_call_id": "m1", "started_at": 5.5, "completed_at": 6, "token_stats": {"prompt_tokens": 3, "cached_tokens": 1, "completion_tokens": 2}, "response_metadata": {"model": "x", "status_code": 503}},
            {"response_metadata": {"response_id": "q", "model_ref": {"n": 1}}}, {},
        ],
        tool_calls=[{"invocation_id": "i1", "tool_call_id": "c2", "tool_name": "g", "output": "late", "started_at": 1}, {"invocation_id": "i1", "tool_call_id": "c9", "tool_name": "h", "output": None}, {"invocation_id": "zz", "tool_call_id": "c"}],
        turns=[{"invocation_id": "i1", "task_id": "k", "rollout_id": "r", "turn_no": 1, "timestamp": 2, "step_count": 0, "question": "q"}], gaps=[{"code": "own"}],
    )
    got, gaps = rollout_exports.read(spark, write(tmp_path, "a.json", [row]))
    columns = ["span_id", "parent_id", "kind", "error", "tokens", F.to_json("input").alias("i"), F.to_json("output").alias("o"), F.to_json("tool_call").alias("call")]
    walked = preorder(got.spans).orderBy("dfs_index").select(*columns).collect()
    spans = {r.span_id.removeprefix("gym/"): r for r in walked}
    top = "invocation/0"
    assert [k for k, r in spans.items() if r.parent_id == f"gym/{top}"] == [f"{top}/tool/1", "turn/0", "model/0", "invocation/1", "model/1", f"{top}/tool/0", "observed-tool/1"]
    assert spans["model/0"].error == "HTTP 503" and tuple(spans["model/0"].tokens) == (2, 1, 2) and spans[top].error == "failed"
    assert (spans[f"{top}/tool/0"].i, spans[f"{top}/tool/0"].o, spans[f"{top}/tool/1"].o, spans["observed-tool/1"].o) == ('{"a":1}', '"ok"', '"late"', "null")
    counts = {k: json.loads(spans[k].call)["result_count"] for k in (f"{top}/tool/0", f"{top}/tool/1", "observed-tool/1", "observed-tool/2")}
    assert list(counts.values()) == [1, 1, 0, 0] and spans["observed-tool/2"].parent_id is None
    codes = sorted(r.code for r in gaps.collect())
    assert codes == ["missing_parent_invocation", "model_call_owner_unrecorded", "model_reference_unresolved", "own", "tool_owner_unrecorded"]
    head = got.traces.select("trace_id", "case_id", F.to_json("results").alias("r"), F.try_variant_get("attributes", "$.gym_gap_count", "int").alias("n")).first()
    assert tuple(head) == ("r", "k", '{"gym.reward":0.5}', 5)


@pytest.mark.parametrize(("row", "said"), [
    ({"x": 1}, "no ng_trajectory"), (rollout(schema_version="2.0"), "schema_version"), ('{"ng_trajectory": {"schema_version": "1.0", "schema_version": "1.0"}}', "malformed"),
    (rollout(invocations=[{"invocation_id": "i"}] * 2), "duplicate invocation"), (rollout(invocations=[{"invocation_id": "i", "parent_invocation_id": "i"}]), "cycle"),
    (rollout(invocations=[{"invocation_id": "i", "conversation": [{"type": "function_call_output", "call_id": "c"}]}]), "without a call"),
    (rollout(invocations=[{"invocation_id": "i", "model_calls": [{}]}]), "without a key"), (rollout(model_calls=[{"model_call_id": "m"}] * 2), "duplicate model call"),
    (rollout(invocations=[{"invocation_id": i, "model_calls": [{"model_call_id": "m"}]} for i in "ab"], model_calls=[{"model_call_id": "m"}]), "owner of model call"),
    (rollout(turns=[{"invocation_id": "i", "task_id": "other", "rollout_id": "r", "turn_no": 1, "timestamp": 1, "step_count": 0}]), "another rollout"),
])
def test_rollout_refusals(spark, tmp_path, row, said):
    with pytest.raises(TraceLoadError, match=said):
        rollout_exports.read(spark, write(tmp_path, "a.jsonl", [row]))


def jobs_of(spark, work):
    spark.sparkContext.setJobGroup("counted", "")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    result = work()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) - before
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return result, jobs


@pytest.mark.parametrize("reader", ["canonical", "atif"])
def test_trees_are_walked_in_one_plan(spark, reader):
    """All nodes of trees of any depth, with their parents and places, in as many jobs as a flat one takes."""
    from tracelake.sources import atif_exports

    def nested(depth, wide):
        kept, node = ("root_spans", "children") if reader == "canonical" else ("subagent_trajectories",) * 2, None
        for d in range(depth, 0, -1):
            own = {"id": f"n{d}", "trajectory_id": f"n{d}", "text": '"children":[1', kept[1]: [node, *({"id": f"n{d}-{i}", "trajectory_id": f"n{d}-{i}", kept[1]: []} for i in range(wide))] if node else []}
            node = own
        return json.dumps({"id": "t", kept[0]: [node]})

    def found(depth, wide):
        rows = spark.createDataFrame([("t", nested(depth, wide)), ("empty", "{}")], "trace_id string, j string").select("trace_id", F.parse_json("j").alias("value"))
        if reader == "canonical":
            out = canonical.spans_of(rows).select("parent_id", "sibling", F.try_variant_get("span", "$.id", "string").alias("id"))
        else:
            out = atif_exports._trajectories(rows.withColumnRenamed("value", "v")).where("above IS NOT NULL").select("above", (F.col("sibling") - atif_exports.AFTER).alias("sibling"), "own_id")
        got, jobs = jobs_of(spark, out.collect)
        return sorted(tuple(r) for r in got) if reader == "atif" else sorted(((r[0] or "", *r[1:]) for r in got)), jobs

    flat, few = found(1, 0)
    deep, jobs = found(70, 2)
    assert jobs == few and len(flat) == 1 and len(deep) == 70 + 2 * 69
    if reader == "canonical":
        assert deep == sorted([("", 0, "n1")] + [(f"n{d}", 0, f"n{d + 1}") for d in range(1, 70)] + [(f"n{d}", i + 1, f"n{d}-{i}") for d in range(1, 70) for i in range(2)])
    else:
        assert {r[2] for r in deep} == {f"n{d}" for d in range(1, 71)} | {f"n{d}-{i}" for d in range(1, 70) for i in range(2)}
        assert max(r[0].count("/subagent/") for r in deep) == 69
