"""Per-trace features, robust deviations, and recurring failures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.failures import CODE_TOOLS, widely_decoded
from tracelake.functions.json_values import as_object, is_flag, kind
from tracelake.functions.tables import exact_medians, kept
from tracelake.functions.text import error_template, failure_message, fingerprint, head_tail, message_signature, one_line

#: Features and their names in reasons (fixed values).
LABELS = {
    "tool_call_count": "tool-call count", "distinct_tool_count": "distinct-tool count", "trajectory_step_count": "trajectory length",
    "dominant_tool_share": "dominant-tool share", "repeated_identical_call_rate": "identical-call repetition",
    "explicit_failure_rate": "explicit tool-failure rate", "returned_data_false_rate": "no-structured-data rate",
    "code_execution_share": "code-execution share", "output_kb_per_call": "average tool-output size",
    "largest_output_kb": "largest tool output", "tool_duration_sec_total": "total recorded tool time",
}
FEATURES = list(LABELS)
RECURRENCE = 3


def decoded_calls(calls: DataFrame) -> DataFrame:
    """calls (trace_id, call_id, call_index, tool, arguments, output, error, duration_ms) with text and failure marker."""
    return widely_decoded(calls)


def trace_features(calls: DataFrame, traces: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """(trace_id, eleven features) for every row of traces; zeros for traces without calls.

    calls as decoded_calls() gives them, and read once: equal calls of a trace are combined first, then its tools, so a
    trace with many calls needs no sort.
    """
    size = F.octet_length("text")
    duration = F.col("duration_ms")
    finite = F.when(duration.isNotNull() & ~F.isnan(duration) & (F.abs(duration) != float("inf")), F.greatest(duration, F.lit(0.0)))
    given = F.coalesce(F.when(kind(F.col("arguments")) == "OBJECT", fingerprint(F.col("arguments"))), fingerprint(F.parse_json(F.lit("{}"))))
    alike = calls.groupBy("trace_id", "tool", given.alias("given")).agg(
        F.count("*").alias("n"), F.count("marker").alias("failed"), F.sum(size).alias("bytes"), F.max(size).alias("largest"), F.sum(finite).alias("ms"),
        F.count_if(is_flag(as_object(F.col("output")), "$.returned_data", False)).alias("empty"),
    )
    per_tool = alike.groupBy("trace_id", "tool").agg(
        F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.sum("bytes").alias("bytes"), F.max("largest").alias("largest"), F.sum("ms").alias("ms"), F.sum("empty").alias("empty"), F.count("*").alias("prints"),
    )
    n = F.sum("n")
    rates = per_tool.groupBy("trace_id").agg(
        n.cast("double").alias("tool_call_count"), F.count("*").cast("double").alias("distinct_tool_count"), (F.max("n") / n).alias("dominant_tool_share"),
        (1.0 - F.sum("prints") / n).alias("repeated_identical_call_rate"),
        (F.sum("failed") / n).alias("explicit_failure_rate"), (F.sum("empty") / n).alias("returned_data_false_rate"),
        (F.sum(F.when(F.col("tool").isin(CODE_TOOLS), F.col("n")).otherwise(0)) / n).alias("code_execution_share"),
        (F.sum("bytes") / n / 1024.0).alias("output_kb_per_call"), (F.max("largest") / 1024.0).alias("largest_output_kb"),
        (F.coalesce(F.sum("ms"), F.lit(0.0)) / 1000.0).alias("tool_duration_sec_total"),
    )
    out = traces.select("trace_id").join(rates, "trace_id", "left")
    if steps is None:
        out = out.withColumn("trajectory_step_count", F.col("tool_call_count"))
    else:
        counted = steps.groupBy("trace_id").agg(F.count("*").cast("double").alias("trajectory_step_count"))
        out = out.join(counted, "trace_id", "left").withColumn("trajectory_step_count", F.coalesce("trajectory_step_count", "tool_call_count"))
    return out.select("trace_id", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in FEATURES))


def _unpivoted(features: DataFrame, names: list[str]) -> DataFrame:
    return features.unpivot(["trace_id"], names, "feature", "value")


def robust_z(features: DataFrame, names: list[str] = FEATURES) -> DataFrame:
    """(trace_id, feature, value, center, mad, z): deviation from the corpus median in units of 1.4826 median deviations.

    Medians are exact; their table has one row per feature. The features are stored, as each median reads them twice.
    """
    rows = kept(_unpivoted(features, names))
    rows = rows.join(F.broadcast(exact_medians(rows, "feature", "value", "center")), "feature")
    off = rows.select("feature", F.abs(F.col("value") - F.col("center")).alias("off"))
    rows = rows.join(F.broadcast(exact_medians(off, "feature", "off", "mad")), "feature").withColumn("mad", F.when(F.col("mad") == 0, 1e-9).otherwise(F.col("mad")))
    return rows.withColumn("z", (F.col("value") - F.col("center")) / (1.4826 * F.col("mad")))


def robust_reasons(features: DataFrame, names: list[str] = FEATURES) -> DataFrame:
    """(trace_id, reasons): up to three features that deviate by more than 1.5, else the name of the most deviant one."""
    label = F.create_map(*(F.lit(x) for n in names for x in (n, LABELS.get(n, n.replace("_", " ")))))
    delta = F.col("value") - F.col("center")
    ranked = robust_z(features, names).groupBy("trace_id").agg(
        F.sort_array(F.collect_list(F.struct(F.abs("z").alias("size"), delta.alias("delta"), "feature")), asc=False).alias("r")
    )
    strong = F.filter(F.slice("r", 1, 3), lambda x: x["size"] > 1.5)
    told = F.transform(strong, lambda x: F.concat(F.when(x["delta"] > 0, "high ").otherwise("low "), label[x["feature"]]))
    return ranked.select("trace_id", F.when(F.size(strong) > 0, told).otherwise(F.array(label[F.get("r", F.lit(0))["feature"]])).alias("reasons"))


def failure_events(calls: DataFrame) -> DataFrame:
    """(trace_id, call_id, call_index, tool, marker, signature, message_signature, excerpt) of decoded calls that failed."""
    # A span error without a result tells its own text. Each step is a column, so that none is worked out twice.
    text = F.when((F.col("marker") == "span_error") & (F.col("text") == ""), F.col("error")).otherwise(F.col("text"))
    rows = calls.where(F.col("marker").isNotNull()).withColumn("text", text)
    rows = rows.withColumn("message", failure_message(F.col("text"), F.col("marker")))
    rows = rows.withColumn("template", error_template(F.col("message"))).withColumn("signature", F.concat_ws(": ", "tool", "template"))
    line = one_line(F.col("text"))
    return rows.select(
        "trace_id", "call_id", "call_index", "tool", "marker", "signature", message_signature(F.col("signature")).alias("message_signature"),
        F.when(F.length("text") > 300, head_tail(line, 300)).otherwise(line).alias("excerpt"),
    )


def recurring(events: DataFrame, key: str = "signature", least: int = RECURRENCE, most_tools: int | None = 5) -> DataFrame:
    """(key, event_count, independent_trace_count, first_trace, tools, representatives) of failures in several traces.

    tools are the most frequent ones, or all with most_tools=None. Ranked by traces, then events, then first seen. Events combine per trace first, so a hot signature is one row per
    trace when it meets; recurring_traces() has the ids of its traces, which aren't gathered into a row.
    """
    at = F.struct("call_index", "call_id")
    per_tool = events.groupBy(key, "trace_id", "tool").agg(F.count("*").alias("n"), F.min(at).alias("at"))
    tools = per_tool.groupBy(key, "tool").agg(F.sum("n").alias("n")).groupBy(key).agg(
        F.transform(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "tool"))), 1, most_tools or (1 << 31) - 1), lambda x: x["tool"]).alias("tools")
    )
    per_trace = per_tool.groupBy(key, "trace_id").agg(F.sum("n").alias("n"), F.min("at").alias("at"))
    # The filter on the rank right behind the window keeps five rows per key and task, so hot keys don't meet whole.
    first = per_trace.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("trace_id"))).where(F.col("rank") <= 5)
    first = first.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("trace_id", "at.call_id"))).alias("representatives"))
    out = per_trace.groupBy(key).agg(
        F.sum("n").alias("event_count"), F.count("*").alias("independent_trace_count"), F.min("trace_id").alias("first_trace"), F.min(F.struct("trace_id", "at")).alias("first_at")
    ).join(first, key)
    out = out.where(F.col("independent_trace_count") >= least).join(tools, key)
    return out.orderBy(F.desc("independent_trace_count"), F.desc("event_count"), "first_at", key).drop("first_at")


def recurring_traces(events: DataFrame, groups: DataFrame, key: str = "signature") -> DataFrame:
    """(key, trace_id): all traces of each group that recurring() gave."""
    return events.select(key, "trace_id").distinct().join(groups.select(key), key, "left_semi")


def verdict_groups(traces: DataFrame, least: int = 1) -> DataFrame:
    """(verdict, independent_trace_count, total_known_cost, first_position, representatives) of traces (trace_id, position, verdict, cost)."""
    rows = traces.where(F.coalesce("verdict", F.lit("")) != "").withColumn("verdict", error_template(F.col("verdict")))
    order = W.partitionBy("verdict").orderBy(F.coalesce("cost", F.lit(-1.0)).desc(), "position")
    best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 5)
    best = best.groupBy("verdict").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "trace_id"))), lambda x: x["trace_id"]).alias("representatives"))
    out = rows.groupBy("verdict").agg(
        F.count("*").alias("independent_trace_count"), F.sum("cost").alias("total_known_cost"), F.min("position").alias("first_position")
    ).join(best, "verdict")
    return out.where(F.col("independent_trace_count") >= least).orderBy(F.desc("independent_trace_count"), "first_position")
