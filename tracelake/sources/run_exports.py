"""Exports with one run per line (LangSmith command line): runs name their trace and parent."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracelake.functions.json_values import at, kind, text_at
from tracelake.functions.tables import kept
from tracelake.functions.text import duration_ms
from tracelake.operators.evidence import newest
from tracelake.sources.common import Snapshot, checked, kind_of, lines_of, require, require_all, span_latency, zoned_time

#: Keys that each line has to have (fixed by the format).
REQUIRED = [
    "run_id", "trace_id", "parent_run_id", "name", "run_type", "start_time", "end_time", "status", "duration_ms", "first_token_time", "token_usage", "costs",
    "tags", "custom_metadata", "inputs", "outputs", "error", "events", "feedback_stats",
]


def read(spark: SparkSession, path: str, limit: int = 100) -> Snapshot:
    """The newest traces of a file or folder, oldest first. A trace has exactly one root, whose run id is the trace's.

    Of a folder only the .jsonl files right in it are read, and each holds one trace; a single file may hold several.
    """
    lines = kept(lines_of(spark, path, **({} if path.endswith(".jsonl") else {"pathGlobFilter": "*.jsonl"})).withColumn("v", F.try_parse_json("text")))
    place, v = F.concat_ws(":", "file", "line"), F.col("v")
    optional = lambda p, of: ~F.coalesce(kind(at(v, p)), F.lit("VOID")).isin("VOID", *of)
    empty = lambda k: F.coalesce(text_at(v, f"$.{k}"), F.lit("")) == ""
    tags = F.try_variant_get(v, "$.tags", "array<variant>")
    require_all(lines, place, {
        "malformed JSON": v.isNull(), "not an object": kind(v) != "OBJECT",
        **{f"{k} is missing": at(v, f"$.{k}").isNull() for k in REQUIRED}, **{f"{k} is no text": empty(k) for k in ("run_id", "trace_id", "status")},
        **{f"{k} is no text": optional(f"$.{k}", ["STRING"]) for k in ("parent_run_id", "name", "run_type", "error")},
        **{f"{k} is no object": optional(f"$.{k}", ["OBJECT"]) for k in ("custom_metadata", "costs", "feedback_stats")},
        "tags aren't texts": optional("$.tags", ["ARRAY"]) | F.exists(tags, lambda x: kind(x) != "STRING"),
        "start_time has no offset": zoned_time(text_at(v, "$.start_time")).isNull(), "end_time has no offset": text_at(v, "$.end_time").isNotNull() & zoned_time(text_at(v, "$.end_time")).isNull(),
    })
    if not path.endswith(".jsonl"):
        require(lines.groupBy("file").agg(F.count_distinct(text_at(v, "$.trace_id")).alias("n")), F.concat("file", F.lit(": several traces")), F.col("n") > 1)
    kinds, subtype = kind_of(text_at(v, "$.run_type"))
    status, error = F.lower(text_at(v, "$.status")), F.nullif(text_at(v, "$.error"), F.lit(""))
    recorded = lambda p: F.when(kind(at(v, p)) != "VOID", at(v, p))
    runs = lines.select(
        "file", "line", text_at(v, "$.trace_id").alias("trace_id"), text_at(v, "$.run_id").alias("span_id"), F.nullif(text_at(v, "$.parent_run_id"), F.lit("")).alias("parent_id"),
        kinds.alias("kind"), subtype.alias("subtype"), F.nullif(text_at(v, "$.name"), F.lit("")).alias("name"), zoned_time(text_at(v, "$.start_time")).alias("start"),
        zoned_time(text_at(v, "$.end_time")).alias("end"), recorded("$.inputs").alias("input"), recorded("$.outputs").alias("output"),
        F.coalesce(error, F.when(status == "error", F.lit("LangSmith Run status ERROR"))).alias("error"), F.try_variant_get(v, "$.costs.total_cost", "double").alias("cost_usd"),
        F.coalesce(*(F.nullif(text_at(v, f"$.custom_metadata.{k}"), F.lit("")) for k in ("thread_id", "session_id", "conversation_id"))).alias("case_id"),
        at(v, "$.feedback_stats").alias("feedback"), F.coalesce(text_at(v, "$.dotted_order"), F.lit("")).alias("tie"), v.alias("attributes"),
    ).withColumn("tool", F.when(F.col("kind") == "TOOL", F.col("name"))).withColumn("duration_ms", duration_ms(F.lit(None).cast("double"), F.col("start"), F.col("end")))
    require(runs, F.concat(place, F.lit(": invalid cost")), (F.col("cost_usd") < 0) | F.isnan("cost_usd"))
    roots = runs.where("parent_id IS NULL")
    bad = runs.groupBy("trace_id").agg(F.count_if(F.col("parent_id").isNull()).alias("n"), F.count_if(F.col("parent_id").isNull() & (F.col("span_id") == F.col("trace_id"))).alias("own"))
    require(bad, F.concat(F.lit("not exactly one root in trace "), "trace_id"), (F.col("n") != 1) | (F.col("own") != 1))
    chosen = newest(roots.select("trace_id", F.col("start").alias("ts")), limit).select("trace_id")
    runs = runs.join(F.broadcast(chosen), "trace_id")  # limit rows
    totals = runs.groupBy("trace_id").agg(
        F.sum("cost_usd").alias("cost_usd"), span_latency(F.col("start"), F.col("end")).alias("latency_ms"),
        F.to_variant_object(F.map_from_entries(F.collect_list(F.when(kind(F.col("feedback")) == "OBJECT", F.struct("span_id", F.to_json("feedback").alias("stats")))))).alias("results"),
    )
    place = F.concat("file", F.lit("#L"), "line")
    traces = roots.select("trace_id", "case_id", place.alias("source_url"), "attributes").join(totals, "trace_id")
    return checked(traces, runs, detach=False, clock=True)
