"""Saved snapshots: what comes back, and plans that don't shuffle by trace."""

import json

import pytest
from pyspark.sql import functions as F

from tracelake.operators import features as A
from tracelake.operators import projections as P
from tracelake.operators import tool_rules as R
from tracelake.plans.passes import built_in
from tracelake.sources import canonical
from tracelake.sources.common import Snapshot


def trace(i):
    call = {"id": f"s{i}", "kind": "TOOL", "tool_name": "find", "input": {"user_id": "ref77"}, "output": {"isError": True, "content": "ref77 not found"}, "children": []}
    other = {"id": f"o{i}", "kind": "TOOL", "tool_name": "odd", "input": {"x": i}, "output": None, "children": [], "tool_call": {"result_count": 0}}
    root = {"id": f"r{i}", "kind": "AGENT", "input": "hello", "output": "done", "children": [call, call | {"id": f"t{i}"}, call | {"id": f"u{i}"}, other]}
    attributes = {"complete_provenance_context": True, "tool_catalog": {"find": {"required": ["q"]}, "other": None}}
    return {"id": f"t{i}", "root_spans": [root], "aggregate": {"cost_usd": float(i)}, "attributes": attributes}


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus") / "a.jsonl"
    path.write_text("\n".join(json.dumps(trace(i)) for i in range(40)))
    return canonical.read(spark, str(path))


@pytest.fixture(scope="module")
def saved(spark, loaded, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("snapshots") / "it's one")
    loaded.save(path, buckets=3)
    return Snapshot.open(spark, path)


@pytest.fixture
def without_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip() for line in plan.splitlines() if "Exchange" in line]


def rows(df):
    return sorted(json.dumps(r.asDict(recursive=True), default=str, sort_keys=True) for r in df.collect())


def test_comes_back_as_it_was(loaded, saved):
    assert saved.buckets == 3 and rows(saved.traces) == rows(loaded.traces)
    columns = [F.to_json(c).alias(c) if t == "variant" else F.col(c) for c, t in P.visits(loaded.spans).dtypes]
    assert rows(saved.spans.select(*columns)) == rows(P.visits(loaded.spans).select(*columns))
    assert P.visits(saved.spans) is saved.spans


def test_passes_do_not_shuffle_by_trace(saved, without_broadcasts):
    """Trees, projections, all rules of a trace, features: nothing but bucketed scans and sorts within buckets."""
    calls = P.audit_calls(saved.traces, P.visits(saved.spans))
    audited = R.audited(calls)
    assert exchanges(audited) == []
    stored = saved.kept(audited)
    assert exchanges(R.findings_of(stored, P.orphan_results(saved.traces))) == []
    used = A.decoded_calls(P.feature_calls(P.visits(saved.spans)))
    assert exchanges(A.trace_features(used, saved.traces, P.steps(P.visits(saved.spans)))) == []
    assert exchanges(P.trajectory_tokens(saved.traces, P.steps(saved.spans), used)) == []


def test_same_results(loaded, saved):
    for before, after in zip(built_in({"tool_issues": {}, "anomalies": {}}).analyze_all(loaded), built_in({"tool_issues": {}, "anomalies": {}}).analyze_all(saved), strict=True):
        assert before.tables.keys() == after.tables.keys() and before.limitations == after.limitations
        for name in before.tables:
            if name != "clusters":
                assert rows(before.tables[name]) == rows(after.tables[name]), name


def test_positions_follow_the_keys(saved):
    ordered = saved.sorted_by(F.desc("cost_usd"))
    assert [(r.position, r.cost_usd) for r in ordered.ordered().collect()] == [(i + 1, 39.0 - i) for i in range(40)]


def test_failed_save_leaves_nothing(spark, loaded, tmp_path):
    broken = Snapshot(loaded.traces, loaded.spans.withColumn("name", F.raise_error(F.lit("no"))))
    with pytest.raises(Exception, match="no"):
        broken.save(str(tmp_path / "x"))
    assert not (tmp_path / "x").exists()
    loaded.save(str(tmp_path / "x"))
    with pytest.raises(FileExistsError):
        loaded.save(str(tmp_path / "x"))
