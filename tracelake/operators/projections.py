"""From traces and spans of a snapshot to what analyses look at: tool calls, steps, the catalog, tokens.

Spans carry what was recorded; these projections add the agreed fallbacks. All windows are by trace, in depth-first order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.json_values import as_object, at, is_flag, kind, plain_text, text_at
from tracelake.functions.text import duration_ms, sequence_token
from tracelake.operators.trees import carried_text, preorder

#: Step types of kinds; other kinds are their own name in lower case (fixed values).
STEP_TYPES = {"EVALUATOR": "evaluation"}


def _plain(value: Column) -> Column:
    """A value as text: strings as they are, others as JSON; NULL for null and for what wasn't recorded."""
    return F.coalesce(plain_text(value), F.when(kind(value) != "VOID", F.to_json(value)))


def _filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _messages(value: Column) -> Column:
    return F.when(kind(value) == "ARRAY", F.try_variant_get(value, "$", "array<variant>"))


def _content(message: Column) -> Column:
    return text_at(message, "$.content")


def user_text(value: Column) -> Column:
    """A string itself, else the content of the last user message with a string for content; empty if there is none."""
    said = F.filter(F.coalesce(_messages(at(value, "$.messages")), _messages(value)), lambda m: (text_at(m, "$.role") == "user") & _content(m).isNotNull())
    return F.coalesce(plain_text(value), _content(F.try_element_at(said, F.lit(-1))), F.lit(""))


def output_text(value: Column) -> Column:
    """Text of a span's output: a string, its content, the content of its last message that has one, else JSON."""
    told = F.filter(_messages(at(value, "$.messages")), lambda m: _content(m).isNotNull())
    other = F.when(kind(value) != "VOID", F.to_json(value))
    return F.coalesce(plain_text(value), _content(value), _content(F.try_element_at(told, F.lit(-1))), other, F.lit(""))


def source_pointer(span: Column, trace_id: Column, span_id: Column, path: Column) -> Column:
    """The recorded pointer of a span's attributes, else one made of trace, span and path."""
    own = as_object(at(span, "$.source_pointer"))
    return F.coalesce(own, F.to_variant_object(F.struct(trace_id.alias("trace_id"), span_id.alias("span_id"), path.alias("span_path"))))


def visits(spans: DataFrame) -> DataFrame:
    """Spans in depth-first order (path, depth, dfs_index), with source_pointer and, for tool spans, their running number (by clock_index where spans have one).

    Spans of a saved snapshot have all that already.
    """
    if "dfs_index" in spans.columns:
        return spans
    rows = preorder(spans)
    by = "clock_index" if "clock_index" in spans.columns else "dfs_index"
    number = F.row_number().over(W.partitionBy("trace_id", F.col("kind") == "TOOL").orderBy(by)) - 1
    pointer = source_pointer(F.col("attributes"), F.col("trace_id"), F.col("span_id"), F.col("path"))
    return rows.withColumns({"source_pointer": pointer, "tool_number": F.when(F.col("kind") == "TOOL", number)})


def catalog(traces: DataFrame) -> DataFrame:
    """(trace_id, tool, schema): the tools of each trace's catalog with the JSON text of their schema; NULL where it is null."""
    tools = F.try_variant_get("attributes", "$.tool_catalog", "map<string,variant>")
    rows = traces.where(kind(at(F.col("attributes"), "$.tool_catalog")) == "OBJECT").select("trace_id", F.explode(tools).alias("tool", "rule"))
    return rows.select("trace_id", "tool", F.when(kind(F.col("rule")) != "VOID", F.to_json("rule")).alias("schema"))


def orphan_results(traces: DataFrame) -> DataFrame:
    """(trace_id, case_id, result_id, source_pointer) of the results that no call asked for; the pointer is all that was recorded of one, as JSON.

    A trace without a logical case is a case of its own.
    """
    rows = traces.select("trace_id", F.coalesce(_filled(F.col("case_id")), F.col("trace_id")).alias("case_id"), F.explode(_messages(at(F.col("attributes"), "$.orphan_results"))).alias("r")).where(kind(F.col("r")) == "OBJECT")
    return rows.select("trace_id", "case_id", F.coalesce(_plain(at(F.col("r"), "$.result_id")), _plain(at(F.col("r"), "$.call_id"))).alias("result_id"), F.to_json("r").alias("source_pointer"))


def _tool_columns() -> dict[str, Column]:
    call, attributes = F.col("tool_call"), F.col("attributes")
    return {
        "call_id": F.coalesce(_filled(text_at(call, "$.call_id")), F.col("span_id")),
        "call_index": F.coalesce(F.try_variant_get(call, "$.index", "long"), F.col("tool_number").cast("long")),
        "tool": F.coalesce(_filled(F.col("tool")), _filled(_plain(at(attributes, "$.name"))), F.lit("")),
    }


def audit_calls(traces: DataFrame, walked: DataFrame) -> DataFrame:
    """Tool calls for the audit, from visits(): see tool_rules for the columns."""
    of_traces = traces.select(
        "trace_id", F.coalesce(_filled(F.col("case_id")), F.col("trace_id")).alias("case_id"), (kind(at(F.col("attributes"), "$.tool_catalog")) == "OBJECT").alias("has_catalog"),
        is_flag(F.col("attributes"), "$.complete_provenance_context", True).alias("complete_provenance"), user_text(at(F.col("attributes"), "$.task_text")).alias("task_text"),
    )
    call, attributes = F.col("tool_call"), F.col("attributes")
    # The user's text is carried over all spans, those of other kinds included, before tool spans are picked.
    rows = walked.withColumn("said", carried_text(user_text(F.col("input")), "dfs_index")).where("kind = 'TOOL'").join(of_traces, "trace_id")
    count = F.coalesce(F.try_variant_get(call, "$.result_count", "int"), F.lit(1))
    flag = at(attributes, "$.explicit_error")
    rows = rows.withColumns({
        **_tool_columns(), "arguments": F.col("input"), "result_count": count, "result_id": _plain(at(call, "$.result_id")), "alias_of": text_at(call, "$.instrumentation_alias_of"),
        "output": F.when(count != 0, F.col("output")),
        "explicit_error": F.coalesce(F.when(kind(flag) == "BOOLEAN", F.try_variant_get(flag, "$", "boolean")), F.when(F.col("error").isNotNull(), True)),
        "outcome_marker": F.coalesce(_plain(at(attributes, "$.outcome_marker")), F.col("error")),
        "prior_user_text": F.coalesce(_filled(text_at(call, "$.prior_user_text")), F.col("said"), F.col("task_text")),
    })
    # A call's tool is looked up within its trace: the join is by trace_id alone, by which both sides lie already.
    listed = catalog(traces).select(F.col("trace_id").alias("_trace"), F.col("tool").alias("_tool"), "schema")
    known = (F.col("trace_id") == F.col("_trace")) & F.array_contains(F.array("_tool"), F.col("tool"))
    rows = rows.join(listed, known, "left").withColumn("in_catalog", F.col("_trace").isNotNull())
    return rows.select(
        "trace_id", "case_id", "call_id", "call_index", "tool", "arguments", "output", "result_count", "result_id", "alias_of", "explicit_error", "outcome_marker",
        "prior_user_text", "complete_provenance", F.coalesce("has_catalog", F.lit(False)).alias("has_catalog"), "in_catalog", "schema", "span_id", "source_pointer",
    )


def feature_calls(walked: DataFrame) -> DataFrame:
    """Tool calls for features, from visits(): trace_id, call_id, call_index, tool, arguments, output, error, duration_ms.

    returned_data of the call is added to an output that is an object without it; unread_flag tells calls whose output
    isn't an object, so that the flag can't be read.
    """
    flag = at(F.col("tool_call"), "$.returned_data")
    text = F.to_json("output")
    inner = F.substr(text, F.lit(2), F.length(text) - 2)
    merged = F.parse_json(F.concat(F.lit('{"returned_data":'), F.to_json(flag), F.when(inner != "", F.concat(F.lit(","), inner)).otherwise(""), F.lit("}")))
    is_object = F.coalesce(kind(F.col("output")) == "OBJECT", F.lit(False))
    rows = walked.where("kind = 'TOOL'").withColumns({
        **_tool_columns(), "arguments": F.col("input"), "unread_flag": flag.isNotNull() & ~is_object,
        "output": F.when(flag.isNotNull() & is_object & at(F.col("output"), "$.returned_data").isNull(), merged).otherwise(F.col("output")),
        "duration_ms": duration_ms(_number(at(F.col("attributes"), "$.duration_ms")), F.col("start"), F.col("end")),
    })
    return rows.select("trace_id", "call_id", "call_index", "tool", "arguments", "output", "error", "duration_ms", "unread_flag", "source_pointer")


def _number(value: Column) -> Column:
    """A number, true and false counting as 1 and 0; NULL for anything else."""
    flag = F.when(kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("double"))
    return F.coalesce(flag, F.when(~kind(value).isin("STRING", "OBJECT", "ARRAY", "VOID"), F.try_variant_get(value, "$", "double")))


def steps(walked: DataFrame) -> DataFrame:
    """(trace_id, step_index, step_type, name, content, source_pointer) of all spans of visits()."""
    attributes = F.col("attributes")
    own = F.lower("kind")
    for name, other in STEP_TYPES.items():
        own = F.when(F.col("kind") == name, F.lit(other)).otherwise(own)
    return walked.select(
        "trace_id", F.col("dfs_index").cast("long").alias("step_index"), F.coalesce(_filled(_plain(at(attributes, "$.subtype"))), own).alias("step_type"),
        F.coalesce(_filled(_plain(at(attributes, "$.name"))), _filled(F.col("tool")), F.lit("")).alias("name"),
        F.coalesce(_plain(at(attributes, "$.summary")), output_text(F.col("output"))).alias("content"), "source_pointer",
    )


def trajectory_tokens(traces: DataFrame, step_rows: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """(trace_id, pos, token): a token per step; per call for traces without steps; one fixed token for empty traces."""
    tokens = step_rows.select("trace_id", F.col("step_index").alias("pos"), sequence_token(F.col("step_type"), F.col("name")).alias("token"))
    stepped, empty = step_rows.select("trace_id"), traces.select("trace_id")
    empty = empty.join(stepped, "trace_id", "left_anti")
    if calls is not None:
        extra = calls.join(stepped, "trace_id", "left_anti")
        tokens = tokens.unionByName(extra.select("trace_id", F.col("call_index").alias("pos"), sequence_token(F.lit("tool"), F.col("tool")).alias("token")))
        empty = empty.join(calls.select("trace_id"), "trace_id", "left_anti")
    return tokens.unionByName(empty.select("trace_id", F.lit(0).cast("long").alias("pos"), F.lit("trajectory:empty").alias("token")))


def caller_metrics(traces: DataFrame) -> DataFrame:
    """(trace_id, metric, value) of the numbers in each trace's metrics; these replace features of the same name."""
    found = F.try_variant_get("attributes", "$.metrics", "map<string,variant>")
    rows = traces.select("trace_id", F.explode(found).alias("metric", "v"))
    return rows.select("trace_id", "metric", _number(F.col("v")).alias("value")).where("value IS NOT NULL")


def verdicts(traces: DataFrame) -> DataFrame:
    """(trace_id, position, verdict, cost): the observed verdict and known cost of each trace."""
    return traces.select("trace_id", F.col("trace_id").alias("position"), _plain(at(F.col("attributes"), "$.observed_verdict")).alias("verdict"), F.col("cost_usd").alias("cost"))
