"""Saved insights: files, versions, and runs that add to them."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracelake.__main__ import main
from tracelake.plans import review
from tracelake.plans.insights import merged
from tracelake.sinks.files import write_insights
from tracelake.sinks.insights import InsightError, Insights, InsightStore, read_file
from tracelake.sources.common import SPANS, TRACES, Snapshot, completed

ODD_TEXT = 'quote " back \\ colon: # hash\nline  end \x85 \U0001f600 - yes: null'
FILE = [
    {"id": "platform-1", "name": "Timeouts", "description": ODD_TEXT, "updated_date": "2026-01-02T03:04:05+00:00", "evidence": [{"trace_id": "a", "url": "https://h/a", "spans": [{"span_id": "s1", "url": "https://h/a/s1"}, {"span_id": "s2"}]}, {"trace_id": "gone", "url": "https://h/gone"}]},
    {"name": "2026-01-01", "description": "yes", "evidence": [{"trace_id": "1"}, {"trace_id": "true"}]},
]


def plain(found):
    """{insight id: everything about it}."""
    evidence = {}
    for r in found.evidence.collect():
        evidence.setdefault(r.insight_id, []).append((r.trace_id, r.url, r.spans, r.span_urls or {}))
    return {r.insight_id: (r.id, r.name, r.description, r.updated_date, sorted(evidence.get(r.insight_id, []), key=lambda e: e[0])) for r in found.insights.collect()}


def test_files_round_trip(spark, tmp_path):
    source, out = tmp_path / "in.json", tmp_path / "out.yml"
    source.write_text(json.dumps(FILE))
    first = read_file(spark, str(source))
    assert plain(first)["platform-1"][:4] == ("platform-1", "Timeouts", ODD_TEXT, "2026-01-02T03:04:05+00:00")
    assert write_insights(first, str(out))
    assert plain(read_file(spark, str(out))) == plain(first)
    text = out.read_text()
    assert text.count("updated_date") == 1 and text.count("id: \"platform-1\"") == 1  # what isn't there isn't written
    assert not write_insights(Insights.none(spark), str(out)) and out.read_text() == text


@pytest.mark.parametrize(("change", "said"), [
    ({"id": ""}, "id is empty"), ({"name": ""}, "name missing"), ({"description": None}, "description missing"), ({"evidence": [{"trace_id": "a"}]}, "fewer than 2"), ({"evidence": 3}, "no list"),
    ({"evidence": [{"trace_id": "a"}, {"trace_id": ""}]}, "no list"), ({"updated_date": "2026-01-01"}, "offset"), ({"evidence": [{"trace_id": "a", "spans": [{}]}, {"trace_id": "b"}]}, "span has no id"),
])
def test_files_are_checked(spark, tmp_path, change, said):
    path = tmp_path / "x.json"
    path.write_text(json.dumps([FILE[1] | change]))
    with pytest.raises(InsightError, match=said):
        read_file(spark, str(path))
    path.write_text(json.dumps([FILE[1], FILE[1]]))
    with pytest.raises(InsightError, match="twice"):
        read_file(spark, str(path))


def snapshot_of(spark, ids):
    traces = spark.createDataFrame([(i, f"https://now/{i}") for i in ids], "trace_id string, source_url string")
    spans = spark.createDataFrame([(i, f"s{n}", "TOOL") for i in ids for n in (1, 3)], "trace_id string, span_id string, kind string")
    return Snapshot(completed(traces, TRACES), completed(spans, SPANS))


def test_runs_add_to_saved_insights(spark, tmp_path):
    source = tmp_path / "in.json"
    source.write_text(json.dumps(FILE))
    saved = read_file(spark, str(source))
    snapshot = snapshot_of(spark, ["a", "b", "c"])
    problems = spark.createDataFrame(
        [("Timeouts", "other words", ["a", "b", "b"]), ("Fresh", "d", ["b", "c"]), ("Lone", "d", ["c"]), ("Nothing", "d", [])], "name string, description string, supporting_trace_ids array<string>"
    )
    run = merged(snapshot, problems, saved, "2026-05-05T00:00:00+00:00")
    assert (run.new, run.extended, run.unchanged, run.too_few) == (1, 1, 1, 1)
    got = plain(run.insights)
    assert set(got) == {"platform-1", "2026-01-01", "Fresh"}
    old = got["platform-1"]
    assert old[:4] == ("platform-1", "Timeouts", ODD_TEXT, "2026-05-05T00:00:00+00:00")  # words stay, the date is that of the added trace
    # Of a trace that is there, the link of now and the spans that exist; of one that is gone, what was saved.
    assert [e[:3] for e in old[4]] == [("a", "https://now/a", ["s1"]), ("b", "https://now/b", []), ("gone", "https://h/gone", [])]
    assert got["2026-01-01"][3] is None and [e[0] for e in got["2026-01-01"][4]] == ["1", "true"]
    assert got["Fresh"][0] is None and got["Fresh"][3] == "2026-05-05T00:00:00+00:00"
    # The same problems again add nothing, so nothing is dated anew.
    again = merged(snapshot, problems, run.insights, "2026-06-06T00:00:00+00:00")
    assert (again.new, again.extended, again.unchanged) == (0, 0, 3) and {v[3] for v in plain(again.insights).values()} == {None, "2026-05-05T00:00:00+00:00"}
    with pytest.raises(ValueError, match="zz"):
        merged(snapshot, problems.withColumn("supporting_trace_ids", F.array(F.lit("zz"))), saved, "2026-05-05T00:00:00+00:00")


def test_versions(spark, tmp_path):
    source = tmp_path / "in.json"
    source.write_text(json.dumps(FILE))
    first = read_file(spark, str(source))
    store = InsightStore(spark, str(tmp_path / "store"))
    assert store.current() == 0 and store.read().insights.count() == 0
    assert store.write(first, 0) == 1 and plain(store.read()) == plain(first)
    # A run that dies while it writes its tables, or between making its marker and filling it, leaves the old version.
    broken = Insights(first.insights, first.evidence.withColumn("url", F.raise_error(F.lit("died"))))
    with pytest.raises(Exception, match="died"):
        store.write(broken, 1)
    (tmp_path / "store/versions/00000002").touch()
    assert store.current() == 1 and plain(store.read()) == plain(first)
    less = Insights(first.insights.where("id IS NULL"), first.evidence.where("insight_id = '2026-01-01'"))
    assert store.write(less, 1) == 3 and set(plain(store.read())) == {"2026-01-01"} and plain(store.read(1)) == plain(first)
    with pytest.raises(InsightError, match="version 3 was saved meanwhile"):
        store.write(first, 1)
    with pytest.raises(InsightError, match="no version 2"):
        store.read(2)


def canonical_file(path, ids):
    def one(i):
        call = {"id": f"s{i}", "kind": "TOOL", "tool_name": "find", "input": {"q": 1}, "output": {"isError": True, "content": "boom"}, "children": []}
        return {"id": f"t{i}", "root_spans": [call], "aggregate": {}, "attributes": {"logical_case_id": f"k{i}"}}

    path.write_text("\n".join(json.dumps(one(i)) for i in ids))


@pytest.mark.parametrize("kind", ["file", "store"])
def test_command_line_is_incremental(spark, tmp_path, capsys, kind):
    traces, settings = tmp_path / "a.jsonl", tmp_path / "s.json"
    out = str(tmp_path / ("out.yml" if kind == "file" else "out"))
    values = {"source": {"canonical": {"path": str(traces)}}, "passes": {"tool_issues": {}}, "output": out}
    read = lambda: read_file(spark, out) if kind == "file" else InsightStore(spark, out).read()
    canonical_file(traces, range(3))
    settings.write_text(json.dumps(values))
    assert main(["run", str(settings)]) == 0 and "1 new, 0 retained" in capsys.readouterr().out
    (name, first), = plain(read()).items()
    assert name == "tid:explicit_tool_failure:structured_error_flag" and [e[0] for e in first[4]] == ["t0", "t1", "t2"] and first[3]
    canonical_file(traces, range(3, 7))  # the first traces are gone
    settings.write_text(json.dumps(values | {"existing": out}))
    assert main(["run", str(settings)]) == 0 and "0 new, 1 retained, 1 of them with new traces" in capsys.readouterr().out
    (_, second), = plain(read()).items()
    assert [e[0] for e in second[4]] == ["t0", "t1", "t2", "t3", "t4", "t5"] and second[2] == first[2]
    before = plain(read())
    (tmp_path / "empty.json").write_text("[]")
    assert main(["run", str(settings), "--existing", str(tmp_path / "nowhere.json")]) == 2
    assert plain(read()) == before


def test_predicates_share_one_scan(spark, tmp_path):
    """However many predicates there are, each trace is read once, and one that fails leaves the others alone."""
    snapshot = snapshot_of(spark, ["a", "b", "c"])
    seen = spark.sparkContext.accumulator(0)
    spans = snapshot.spans.select("trace_id", "span_id")

    def counting(part):
        seen.add(len(part))
        return "match", part["span_id"].tolist()[:1]

    def failing(part):
        if part["trace_id"].iloc[0] == "b":
            raise RuntimeError("can't read b")
        return "no_match", []

    example = lambda n: pd.DataFrame({"trace_id": "x", "span_id": ["s"] * n})
    rows = review.scan_all(spans, {"one": counting, "two": failing, "odd": lambda p: ("maybe", [])}).collect()
    assert seen.value == 6 and len(rows) == 9
    assert {(r.name, r.trace_id): (r.state, r.error) for r in rows if r.name == "two"} == {("two", "a"): ("no_match", None), ("two", "b"): (None, "trace b: can't read b"), ("two", "c"): ("no_match", None)}
    assert all("no state" in r.error for r in rows if r.name == "odd")
    one = lambda part: ("match", ["s1"]) if "s1" in set(part["span_id"]) else ("no_match" if len(part) == 1 else "unknown", [])
    examples = {"match": pd.DataFrame({"trace_id": "x", "span_id": ["s1"]}), "no_match": example(1), "unknown": example(2)}
    dies = lambda part: one(part) if part["trace_id"].iloc[0] == "x" else 1 / 0
    saved = spark.createDataFrame([("good", "z", "u", ["s9"])], "insight_id string, trace_id string, url string, spans array<string>")
    got = review.compile_insights(snapshot, spans, saved, {"good": (one, examples), "dies": (dies, examples)}, "2026-01-01")
    assert got.failed == {"dies": "trace a: division by zero"} and {r.trace_id for r in got.evidence.collect()} == {"a", "b", "c", "z"}


def steppers():
    """Made in a function, so that workers, which can't import tests, get them by value."""

    class FailureThenRetry:
        """Matches a trace in which a failed span is followed by one with the same input; unknown if there is a single span."""

        def __init__(self):
            self.n, self.failed, self.found = 0, {}, []

        def step(self, span):
            self.n += 1
            if span["error"] == "die":
                raise RuntimeError("can't go on")
            if span["input"] in self.failed:
                self.found.append(span["span_id"])
            if span["error"]:
                self.failed[span["input"]] = span["span_id"]

        def result(self):
            return ("match", self.found) if self.found else ("no_match" if self.n > 1 else "unknown", [])

    class Odd(FailureThenRetry):
        def result(self):
            return "match", ["nobody"] if self.n > 1 else []

    return {"retry": FailureThenRetry, "odd": Odd}


def test_streamed_predicates_agree_with_gathered_ones(spark):
    rows = [("a", "s1", 0, "x", "boom"), ("a", "s2", 1, "y", None), ("a", "s3", 2, "x", None), ("b", "s1", 0, "x", None), ("b", "s2", 1, "x", "late"), ("c", "s1", 0, "x", "boom"), ("d", "s1", 0, "x", "die"), ("d", "s2", 1, "x", None)]
    spans = spark.createDataFrame(rows, "trace_id string, span_id string, dfs_index int, input string, error string").repartition(3)

    def gathered(make):
        def predicate(part):
            one = make()
            for row in part.where(part.notna(), None).to_dict("records"):
                one.step(row)
            return one.result()

        return predicate

    as_set = lambda df: {(r.name, r.trace_id, r.state, tuple(r.witnesses), r.error) for r in df.collect()}
    makers = steppers()
    got = as_set(review.stream_all(spans, makers))
    assert got == as_set(review.scan_all(spans, {n: gathered(m) for n, m in makers.items()}))
    assert ("retry", "a", "match", ("s3",), None) in got and ("retry", "d", None, (), "trace d: can't go on") in got and ("odd", "b", None, (), "trace b: no span nobody") in got


def test_insights_may_be_steppers(spark):
    rows = [("a", "s1", 0, "x", "boom"), ("a", "s2", 1, "x", None), ("b", "s1", 0, "x", None), ("b", "s2", 1, "x", None)]
    spans = spark.createDataFrame(rows, "trace_id string, span_id string, dfs_index int, input string, error string")
    snapshot = snapshot_of(spark, ["a", "b"])
    example = lambda *errors: pd.DataFrame({"trace_id": "x", "span_id": [f"s{i}" for i in range(len(errors))], "input": "q", "error": errors})
    examples = {"match": example("e", None), "no_match": example(None, None), "unknown": example(None)}
    anything = lambda part: ("match", ["s1"]) if part["error"].notna().any() else ("unknown" if len(part) == 1 else "no_match", [])
    saved = spark.createDataFrame([], "insight_id string, trace_id string, url string, spans array<string>")
    retry = steppers()["retry"]
    got = review.compile_insights(snapshot, spans, saved, {"streamed": (retry, examples), "gathered": (anything, examples | {"match": example(None, "e")})}, "2026-01-01")
    assert got.failed == {} and sorted((r.insight_id, r.trace_id, r.spans) for r in got.evidence.collect()) == [("gathered", "a", ["s1"]), ("streamed", "a", ["s2"])]
    alone = review.compile_insights(snapshot, spans, saved, {"streamed": (retry, examples)}, "2026-01-01")
    assert alone.evidence.count() == 1 and review.compile_insights(snapshot, spans, saved, {}, "2026-01-01").evidence.count() == 0


def test_a_long_trace_is_streamed(spark):
    """A trace of 300,000 spans, about 150 MB of text, passes a worker that grows by much less."""

    class Weighs:
        def __init__(self):
            self.first = self.last = None

        def step(self, span):
            if self.first is None:
                import resource

                self.first = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
            self.last = span["dfs_index"]

        def result(self):
            import resource

            return f"{self.last} {(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - self.first) // 1024}", []

    spans = spark.range(300_000).select(F.lit("t").alias("trace_id"), F.col("id").cast("string").alias("span_id"), F.col("id").alias("dfs_index"), F.repeat(F.col("id").cast("string"), 100).alias("input"))
    (row,) = review.stream_all(spans, {"w": Weighs}).collect()
    last, grown = row.error.split("'")[1].split()
    assert int(last) == 299_999 and int(grown) < 100
