"""What a corpus can show: how often fields are recorded, which rules can fire, notes for the reader, and a report."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tracelake.functions.json_values import at, is_flag, kind, text_at
from tracelake.operators.cards import NEEDS

#: Trace attributes that are counted where they hold something.
TRACE_FIELDS = ["tool_catalog", "logical_case_id", "source_pointer", "observed_verdict", "metrics", "task_text", "orphan_results"]
#: What a corpus lacks if a rule can't fire, by what the rule needs.
REASONS = {
    "tool_catalog": "no trace has a tool catalog", "result_id": "no call has a result id", "result_count": "no call has more than one result",
    "orphan_results": "no trace lists results without a call", "instrumentation_alias_of": "no call names the tool behind an alias",
    "complete_provenance_context": "no trace says that all messages and results were captured",
    "result-key discipline": "every call has a result, so none can be missing; a source that loses results has to leave the field out",
    "result": "no call has a result that could be decoded", "always": "",
}
#: Field of presence() that has to be above zero for each need.
FIELD = {
    "tool_catalog": "tool_catalog", "result_id": "result_id", "result_count": "result_count_gt_1", "orphan_results": "orphan_results",
    "instrumentation_alias_of": "instrumentation_alias_of", "complete_provenance_context": "complete_provenance_context",
    "result-key discipline": "result_absent", "result": "result_present",
}
FEW, NEARLY_ALL, ALMOST_EVERY = 3, 0.95, 0.9


def holds_something(value: Column) -> Column:
    """Whether a value is there and isn't null, false, zero, or an empty string, list or object."""
    return F.coalesce(~F.to_json(value).isin("null", "false", "0", "0.0", '""', "[]", "{}"), F.lit(False))


def _is_empty(value: Column) -> Column:
    return F.coalesce(F.to_json(value).isin("null", '""', "{}", "[]"), F.lit(False))


def _empty_arguments(value: Column) -> Column:
    """Nothing recorded, nothing in it, or only a placeholder: one field whose name starts with `_` and that holds nothing."""
    fields = F.map_entries(F.when(kind(value) == "OBJECT", F.try_variant_get(value, "$", "map<string,variant>")))
    first = F.get(fields, F.lit(0))
    placeholder = (F.size(fields) == 1) & F.startswith(first["key"], F.lit("_")) & _is_empty(first["value"])
    return value.isNull() | F.to_json(value).isin("null", '""', "{}") | F.coalesce(placeholder, F.lit(False))


def presence(traces: DataFrame, spans: DataFrame) -> DataFrame:
    """One row of counts over traces (trace_id, cost_usd, attributes) and spans (trace_id, kind, input, output, ...)."""
    attributes, call = F.col("attributes"), F.col("tool_call")
    of_traces = traces.agg(
        *(F.count_if(holds_something(at(attributes, f"$.{f}"))).alias(f) for f in TRACE_FIELDS), F.count("cost_usd").alias("cost"),
        F.count_if(is_flag(attributes, "$.complete_provenance_context", True)).alias("complete_provenance_context"), F.count("*").alias("total_traces"),
        F.count_distinct(F.coalesce(F.nullif(F.col("case_id"), F.lit("")), F.col("trace_id"))).alias("distinct_cases"),
    )
    count = F.coalesce(F.try_variant_get(call, "$.result_count", "int"), F.lit(1))
    tool = F.col("kind") == "TOOL"
    missing = F.col("output").isNull() | (count == 0)
    timed = (kind(at(attributes, "$.duration_ms")) != "VOID") | (F.col("start").isNotNull() & F.col("end").isNotNull())
    counts = {
        "result_present": ~missing, "result_absent": missing, "result_empty": ~missing & _is_empty(F.col("output")), "arguments_empty": _empty_arguments(F.col("input")),
        "result_id": kind(at(call, "$.result_id")) != "VOID", "result_count_gt_1": count > 1, "duration_ms": timed,
        "explicit_error_true": is_flag(attributes, "$.explicit_error", True) | F.col("error").isNotNull(), "explicit_error_false": is_flag(attributes, "$.explicit_error", False),
        "instrumentation_alias_of": F.coalesce(text_at(call, "$.instrumentation_alias_of"), F.lit("")) != "", "prior_user_text": F.coalesce(text_at(call, "$.prior_user_text"), F.lit("")) != "",
        "returned_data": at(call, "$.returned_data").isNotNull(), "call_source_pointer": holds_something(at(attributes, "$.source_pointer")),
    }
    # Per trace first: traces with steps are counted without a distinct.
    per_trace = spans.groupBy("trace_id").agg(*(F.count_if(tool & F.coalesce(c, F.lit(False))).alias(n) for n, c in counts.items()), F.count_if(tool).alias("calls"), F.count("*").alias("n"))
    sums = [F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in counts]
    of_calls = per_trace.agg(*sums, F.coalesce(F.sum("calls"), F.lit(0)).alias("total_calls"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_steps"), F.count("*").alias("steps"))
    return of_traces.crossJoin(of_calls)  # one row each


def rules(found: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """(issue_type, requires, evaluable, fired, reason) of all nineteen rules, for presence() and the findings, if any."""
    table = found.sparkSession.createDataFrame(sorted((t, "complete_provenance_context" if "provenance" in n else n) for t, n in NEEDS.items()), "issue_type string, requires string")
    need = F.create_map(*(F.lit(x) for n, f in FIELD.items() for x in (n, f)))
    counts = F.create_map(*(x for f in set(FIELD.values()) for x in (F.lit(f), F.col(f))))
    reason = F.create_map(*(F.lit(x) for pair in REASONS.items() for x in pair))
    out = table.crossJoin(F.broadcast(found)).withColumn("evaluable", F.coalesce(counts[need[F.col("requires")]] > 0, F.lit(True)))  # nineteen rows by one
    fired = table.select("issue_type").limit(0) if findings is None else findings.select("issue_type").distinct()
    out = out.join(fired.withColumn("_fired", F.lit(True)), "issue_type", "left")
    return out.select("issue_type", "requires", "evaluable", F.coalesce("_fired", F.lit(False)).alias("fired"), F.when(F.col("evaluable"), "").otherwise(reason[F.col("requires")]).alias("reason"))


def notes(p: Row | dict) -> list[str]:
    """What a reader should know about a corpus with this presence() row."""
    told = {
        f"There are {p['total_traces']} traces; trajectories are clustered from {FEW} on.": p["total_traces"] < FEW,
        f"There are {p['distinct_cases']} logical cases; a card counts from {FEW} independent cases on, so none can.": p["distinct_cases"] < FEW,
        "No trace names its logical case, so each counts as its own; retries of one task would be counted several times.":
            p["total_traces"] > 0 and p["distinct_cases"] == p["total_traces"] and p["logical_case_id"] == 0,
        f"{p['result_empty']} of {p['result_present']} results hold nothing, so rules that read results find nothing; the export may lack payloads.":
            p["result_present"] > 0 and p["result_empty"] >= NEARLY_ALL * p["result_present"],
        f"{p['arguments_empty']} of {p['total_calls']} calls have no arguments, so rules about arguments find nothing; is the right field read?":
            p["total_calls"] > 0 and p["arguments_empty"] >= NEARLY_ALL * p["total_calls"],
        "Almost every call says explicit_error is false, which rules out reading failures from results.":
            p["total_calls"] > 0 and p["explicit_error_false"] > ALMOST_EVERY * p["total_calls"],
        "Every call has a result; lost results can't be told.": p["total_calls"] > 0 and p["result_absent"] == 0,
        "No trace has steps; trajectories are made of tool calls.": p["steps"] == 0,
        f"{p['steps']} of {p['total_traces']} traces have steps; trajectories of the others aren't comparable with theirs.": 0 < p["steps"] < p["total_traces"],
    }
    return [text for text, applies in told.items() if applies]


def report(source: str, found: DataFrame, rule_rows: DataFrame, verbose: bool = False) -> str:
    """The coverage of a corpus as text: counts, rules that can't fire by reason, notes. One row and nineteen are read."""
    p, listed = found.first().asDict(), rule_rows.orderBy("issue_type").collect()
    able = [r for r in listed if r.evaluable]
    lines = [
        f"Corpus {source}", f"  traces {p['total_traces']}, calls {p['total_calls']}, steps {p['total_steps']}, logical cases {p['distinct_cases']}"
        + ("" if p["logical_case_id"] else ", taken from the traces' ids"), "", f"Rules that can fire: {len(able)} of {len(listed)}",
    ]
    by_reason: dict[str, list[str]] = {}
    for r in listed:
        if not r.evaluable:
            by_reason.setdefault(r.reason, []).append(r.issue_type)
    for reason, types in by_reason.items():
        lines += [f"  {reason}:", *(f"    {t}" for t in types)]
    if verbose:
        lines += ["", "All rules:", *(f"  {'yes' if r.evaluable else 'no':4}{r.issue_type} (needs {r.requires}){', fired' if r.fired else ''}" for r in listed)]
    told = notes(p)
    return "\n".join([*lines, *(["", "Notes:", *(f"  {n}" for n in told)] if told else [])])


def limitations(p: Row | dict, unevaluable: Iterable[Row] = ()) -> list[str]:
    """What an audit couldn't look at. unevaluable: rows (tool, calls, reason) of tools whose schema can't be checked."""
    out = [f"{p['result_absent']} of {p['total_calls']} calls have no result to judge."] if p["result_absent"] else []
    lacking = p["total_traces"] - p["tool_catalog"]
    out += [f"{lacking} of {p['total_traces']} traces have no tool catalog, so their arguments weren't checked."] if lacking else []
    return out + [f"The schema of {r['tool']} can't be checked ({r['reason']}), so the arguments of {r['calls']} calls weren't." for r in unevaluable]
