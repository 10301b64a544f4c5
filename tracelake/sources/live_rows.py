"""Snapshots from what live providers returned: (trace_id, position, part, body) as the data source gives it, or as saved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.config import secret
from tracelake.functions.json_values import at, kind, text_at
from tracelake.functions.tables import kept
from tracelake.functions.text import duration_ms
from tracelake.operators.evidence import evaluator_problem, session_results
from tracelake.sources import mlflow_exports, observation_exports
from tracelake.sources.common import Snapshot, checked, kind_of, require, require_all, span_latency, text_payload, unique, zoned_time
from tracelake.sources.live import KEYS, PROVIDERS, source_with

#: Kinds that providers name differently (fixed values).
BRAINTRUST_KINDS = {"LLM": "LLM", "TOOL": "TOOL", "SCORE": "EVALUATOR", "FUNCTION": "CHAIN", "TASK": "CHAIN", "EVAL": "CHAIN"}


def load(spark: SparkSession, provider: str, **options: str) -> Snapshot:
    """Select, fetch and normalise traces of a provider; see the data source for options. Keys come from the driver's environment or .env file."""
    if provider not in PROVIDERS:
        raise ValueError(f"no provider {provider!r}; there are: {', '.join(PROVIDERS)}")
    spark.dataSource.register(source_with({name: secret(name) or "" for name in KEYS}))
    # Kept, so that a provider is asked once.
    rows = kept(spark.read.format("trace_pages").options(provider=provider, **options).load())
    return SNAPSHOTS[provider](rows)


def _value(rows: DataFrame, part: str) -> DataFrame:
    return rows.where(F.col("part") == part).select("trace_id", "position", F.try_parse_json("body").alias("v"))


def _documents(rows: DataFrame) -> DataFrame:
    return _value(rows, "trace").select(F.lit("live").alias("file"), (F.col("position") + 1).alias("line"), F.lit(None).cast("string").alias("text"), F.col("v").alias("value"))


def langfuse(rows: DataFrame) -> Snapshot:
    return observation_exports.snapshot(_documents(rows), detach=True)


def mlflow(rows: DataFrame) -> Snapshot:
    return mlflow_exports.snapshot(_documents(rows))


def _recorded(v: Column, path: str) -> Column:
    return F.when(kind(at(v, path)) != "VOID", at(v, path))


def _filled(v: Column, path: str) -> Column:
    return F.nullif(text_at(v, path), F.lit(""))


def langsmith(rows: DataFrame) -> Snapshot:
    """Runs whose parent wasn't returned become roots."""
    v = F.col("v")
    kinds, subtype = kind_of(text_at(v, "$.run_type"), {"PROMPT": "CHAIN", "PARSER": "CHAIN"})
    runs = kept(_value(rows, "run"))
    spans = runs.select(
        "trace_id", text_at(v, "$.id").alias("span_id"), _filled(v, "$.parent_run_id").alias("parent_id"), kinds.alias("kind"), subtype.alias("subtype"), _filled(v, "$.name").alias("name"),
        F.when(kinds == "TOOL", _filled(v, "$.name")).alias("tool"), zoned_time(text_at(v, "$.start_time")).alias("start"), zoned_time(text_at(v, "$.end_time")).alias("end"),
        _recorded(v, "$.inputs").alias("input"), _recorded(v, "$.outputs").alias("output"),
        F.coalesce(_filled(v, "$.error"), F.when(F.lower(text_at(v, "$.status")) == "error", F.lit("LangSmith Run status ERROR"))).alias("error"), F.try_variant_get(v, "$.total_cost", "double").alias("cost_usd"), F.coalesce(text_at(v, "$.dotted_order"), F.lit("")).alias("tie"), v.alias("attributes"),
    ).withColumn("duration_ms", duration_ms(F.lit(None).cast("double"), F.col("start"), F.col("end")))
    metadata = lambda k: _filled(v, f"$.extra.metadata.{k}")
    roots = runs.where(text_at(v, "$.id") == F.col("trace_id")).select("trace_id", "position", F.coalesce(*map(metadata, ("thread_id", "session_id", "conversation_id"))).alias("case_id"), at(v, "$.feedback_stats").alias("results"), v.alias("attributes"))
    totals = spans.groupBy("trace_id").agg(F.sum("cost_usd").alias("cost_usd"), span_latency(F.col("start"), F.col("end")).alias("latency_ms"))
    return checked(roots.join(totals, "trace_id"), spans, detach=True, clock=True)


def braintrust(rows: DataFrame) -> Snapshot:
    """Rows of traces; each trace has one root, and every other row one parent that is there."""
    v = F.col("v")
    found = kept(_value(rows, "row"))
    parents = F.try_variant_get(v, "$.span_parents", "array<string>")
    is_root = F.coalesce(F.try_variant_get(v, "$.is_root", "boolean"), F.coalesce(F.size(parents), F.lit(0)) <= 0)
    metric = lambda k: F.try_variant_get(v, f"$.metrics.{k}", "double")
    time = lambda k: F.timestamp_micros((metric(k) * 1_000_000).cast("long"))
    who = F.concat(F.lit("trace "), "trace_id", F.lit(", span "), F.coalesce(text_at(v, "$.span_id"), F.lit("?")))
    require_all(found, who, {
        "no id": F.coalesce(text_at(v, "$.span_id"), F.lit("")) == "", "it belongs to another trace": text_at(v, "$.root_span_id") != F.col("trace_id"),
        "a root has no parents": is_root & (F.size(parents) > 0), "not exactly one parent": ~is_root & (F.coalesce(F.size(parents), F.lit(0)) != 1),
        **{f"metric {k} is no number": kind(at(v, f"$.metrics.{k}")).isin("STRING", "BOOLEAN", "OBJECT", "ARRAY") for k in ("start", "end", "estimated_cost")},
    })
    unique(found.select("trace_id", text_at(v, "$.id").alias("row_id")), ["trace_id", "row_id"], "row")
    require(found.groupBy("trace_id").agg(F.count_if(is_root).alias("n")), F.concat(F.lit("not exactly one root in trace "), "trace_id"), F.col("n") != 1)
    name = text_at(v, "$.span_attributes.name")
    what = F.upper(text_at(v, "$.span_attributes.type"))
    of_type = F.lit("UNKNOWN")
    for own, other in BRAINTRUST_KINDS.items():
        of_type = F.when(what == own, F.lit(other)).otherwise(of_type)
    span_id, tool = text_at(v, "$.span_id"), of_type == "TOOL"
    call = F.when(tool, F.to_variant_object(F.struct(span_id.alias("call_id"), F.when(at(v, "$.output").isNull(), 0).otherwise(1).alias("result_count"))))
    spans = found.select(
        "trace_id", span_id.alias("span_id"), F.get(parents, F.lit(0)).alias("parent_id"), of_type.alias("kind"), text_at(v, "$.span_attributes.type").alias("subtype"), name.alias("name"), F.when(tool, name).alias("tool"),
        time("start").alias("start"), time("end").alias("end"), at(v, "$.input").alias("input"), at(v, "$.output").alias("output"), text_at(v, "$.error").alias("error"), metric("estimated_cost").alias("cost_usd"),
        text_at(v, "$.metadata.model").alias("model"), call.alias("tool_call"), F.to_variant_object(F.struct(name.alias("name"), text_at(v, "$.span_attributes.type").alias("subtype"), v.alias("braintrust"))).alias("attributes"),
    ).withColumn("duration_ms", duration_ms(F.lit(None).cast("double"), F.col("start"), F.col("end")))
    times = spans.groupBy("trace_id").agg(span_latency(F.col("start"), F.col("end")).alias("latency_ms"))
    return checked(found.where(is_root).select("trace_id", "position", at(v, "$.scores").alias("results")).join(times, "trace_id"), spans, detach=False, clock=True)


def unwrapped(v: Column) -> dict[str, Column]:
    """Arguments, output, call and result ids of a tool span that carries an ATIF call and result in its payloads."""
    given, got = text_payload(text_at(v, "$.input")), text_payload(text_at(v, "$.output"))
    is_atif = (F.upper(text_at(v, "$.kind")) == "TOOL") & (F.lower(text_at(v, "$.source")) == "atif")
    return {
        "input": F.when(is_atif & (kind(given) == "OBJECT"), F.coalesce(at(given, "$.arguments"), given)).otherwise(given),
        "output": F.when(is_atif & (kind(got) == "OBJECT"), F.coalesce(at(got, "$.content"), got)).otherwise(got),
        "tool": F.coalesce(_filled(v, "$.tool_name"), F.when(is_atif, text_at(given, "$.function_name"))),
        "call_id": F.when(is_atif, text_at(given, "$.tool_call_id")), "result_id": F.when(is_atif, text_at(got, "$.source_call_id")),
    }


def intake(rows: DataFrame) -> Snapshot:
    """Traces with spans and evaluator results; results of other traces of the session are left out."""
    v = F.col("v")
    heads, found, marks = (kept(_value(rows, part)) for part in ("trace", "span", "result"))
    who = F.concat(F.lit("trace "), "trace_id", F.lit(", span "), F.coalesce(text_at(v, "$.span_id"), F.lit("?")))
    sessions = heads.select("trace_id", text_at(v, "$.session_id").alias("session"))
    of_session = found.join(sessions, "trace_id")
    require_all(of_session, who, {"it belongs to another trace": F.coalesce(text_at(v, "$.trace_id"), F.col("trace_id")) != F.col("trace_id"), "it belongs to another session": text_at(v, "$.session_id") != F.col("session")})
    kinds, subtype = kind_of(text_at(v, "$.kind"))
    utc = lambda k: F.coalesce(zoned_time(text_at(v, f"$.{k}")), F.try_to_timestamp(F.concat(text_at(v, f"$.{k}"), F.lit("Z"))))
    tool = unwrapped(v)
    status = F.lower(text_at(v, "$.status"))
    spans = found.select(
        "trace_id", text_at(v, "$.span_id").alias("span_id"), _filled(v, "$.parent_span_id").alias("parent_id"), kinds.alias("kind"), subtype.alias("subtype"), _filled(v, "$.name").alias("name"), utc("started_at").alias("start"), utc("ended_at").alias("end"),
        tool["input"].alias("input"), tool["output"].alias("output"), F.when(kinds == "TOOL", F.coalesce(tool["tool"], _filled(v, "$.name"))).alias("tool"),
        F.coalesce(_filled(v, "$.error_message"), _filled(v, "$.error_type"), F.when(status == "error", F.lit("Intake span status error"))).alias("error"),
        F.try_variant_get(v, "$.cost_total_usd", "double").alias("cost_usd"), _filled(v, "$.model").alias("model"),
        F.when(kinds == "TOOL", F.to_variant_object(F.struct(tool["call_id"].alias("call_id"), tool["result_id"].alias("result_id")))).alias("tool_call"),
        F.coalesce(F.try_parse_json(text_at(v, "$.raw_attributes")), F.parse_json(F.lit("{}"))).alias("attributes"),
    ).withColumn("duration_ms", duration_ms(F.lit(None).cast("double"), F.col("start"), F.col("end")))
    results = marks.select(
        "trace_id", text_at(v, "$.session_id").alias("session_id"), text_at(v, "$.span_id").alias("span_id"), text_at(v, "$.name").alias("name"), text_at(v, "$.data_type").alias("data_type"),
        F.try_variant_get(v, "$.value", "double").alias("value"), text_at(v, "$.string_value").alias("string_value"),
    )
    problem = evaluator_problem(F.col("data_type"), F.col("value"), F.col("string_value"))
    require(results, F.concat(F.lit("result "), "name", F.lit(" of span "), "span_id", F.lit(": "), problem), problem.isNotNull())
    own = session_results(results, found.select("trace_id", text_at(v, "$.span_id").alias("span_id"), text_at(v, "$.session_id").alias("session_id")))
    told = F.when(F.col("data_type").isin("NUMERIC", "BOOLEAN"), F.col("value").cast("variant")).otherwise(F.col("string_value").cast("variant"))
    values = own.groupBy("trace_id", "name").agg(F.sort_array(F.collect_list(F.struct("span_id", F.to_json(told).alias("json")))).alias("x"))
    several = F.concat(F.lit("["), F.array_join(F.transform("x", lambda e: e["json"]), ","), F.lit("]"))
    values = values.select("trace_id", "name", F.parse_json(F.when(F.size("x") == 1, F.get("x", F.lit(0))["json"]).otherwise(several)).alias("value"))
    by_name = values.groupBy("trace_id").agg(F.to_variant_object(F.map_from_entries(F.collect_list(F.struct("name", "value")))).alias("results"))
    traces = heads.select(
        "trace_id", "position", F.coalesce(_filled(v, "$.evaluation_context.test_case_id"), _filled(v, "$.session_id")).alias("case_id"), F.try_variant_get(v, "$.cost_usd", "double").alias("cost_usd"),
        F.try_variant_get(v, "$.duration_ms", "double").alias("latency_ms"), v.alias("attributes"),
    )
    return checked(traces.join(by_name, "trace_id", "left"), spans, detach=False, clock=True)


SNAPSHOTS = {"langfuse": langfuse, "mlflow": mlflow, "langsmith": langsmith, "braintrust": braintrust, "intake": intake}
