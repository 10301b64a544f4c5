"""Langfuse trace details (version 3): raw bodies, or responses with status, headers and body."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.json_values import at, kind, text_at
from tracelake.functions.text import duration_ms
from tracelake.operators.evidence import newest
from tracelake.sources.common import Snapshot, checked, chosen_cost, documents_of, kind_of, require, span_latency, text_payload, within, zoned_time

ALIASES = {"GENERATION": "LLM"}


def catalogs(spans: DataFrame) -> DataFrame:
    """(trace_id, catalog): tools by name that all model calls of a trace agree on; none where they differ.

    A tool is what `tools` of a model call's input lists, by name with its parameters' schema.
    """
    tool = F.col("tool")
    given = F.coalesce(F.try_variant_get("input", "$.tools", "array<variant>"), F.try_variant_get("attributes", "$.modelParameters.tools", "array<variant>"))
    calls = spans.where((F.col("kind") == "LLM") & (F.size(given) > 0)).select("trace_id", "span_id", F.explode(given).alias("tool"))
    name = F.coalesce(text_at(tool, "$.function.name"), text_at(tool, "$.name"))
    schema = F.coalesce(at(tool, "$.function.parameters"), at(tool, "$.parameters"), at(tool, "$.input_schema"), F.parse_json(F.lit("null")))
    listed = calls.select("trace_id", "span_id", F.struct(name.alias("name"), F.to_json(schema).alias("schema")).alias("t")).where(name.isNotNull())
    per_call = listed.groupBy("trace_id", "span_id").agg(F.to_json(F.array_sort(F.collect_set("t"))).alias("all"))
    agreed = per_call.groupBy("trace_id").agg(F.min("all").alias("all"), F.max("all").alias("other")).where(F.col("all") == F.col("other"))
    entries = F.from_json("all", "array<struct<name:string,schema:string>>")
    text = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(F.lit('"'), e["name"], F.lit('":'), e["schema"])), ","), F.lit("}"))
    return agreed.select("trace_id", F.try_parse_json(text).alias("catalog"))


def read(spark: SparkSession, path: str, limit: int = 100, since: str | None = None, until: str | None = None) -> Snapshot:
    """The newest traces of the files from since up to until, oldest first. Trees must be complete and observations belong to their trace."""
    return snapshot(documents_of(spark, path), limit, since, until)


def snapshot(found: DataFrame, limit: int | None = None, since: str | None = None, until: str | None = None, detach: bool = False) -> Snapshot:
    """Traces of documents (file, line, value). Live traces may lack spans: with detach=True spans whose parent is missing become roots."""
    v = F.col("value")
    require(found, F.concat_ws(":", "file", "line", F.lit("malformed JSON")), v.isNull())
    status = F.try_variant_get(v, "$.status", "int")
    wrapped = (kind(at(v, "$.body")) == "OBJECT") & status.isNotNull()
    require(found, F.concat_ws(":", "file", "line", F.lit("status is not 200")), wrapped & (status != 200))
    t = F.col("t")
    rows = found.select("file", "line", F.when(wrapped, at(v, "$.body")).otherwise(v).alias("t"))
    rows = rows.select("file", "line", "t", text_at(t, "$.id").alias("trace_id"), zoned_time(text_at(t, "$.timestamp")).alias("ts"))
    require(rows, F.concat_ws(":", "file", "line", F.lit("invalid id or timestamp")), (F.coalesce("trace_id", F.lit("")) == "") | F.col("ts").isNull())
    rows = rows.where(within(F.col("ts"), since, until))
    if limit is not None:
        rows = rows.join(F.broadcast(newest(rows.select("trace_id", "ts"), limit).select("trace_id")), "trace_id")  # limit rows
    o = F.col("o")
    seen = rows.select("trace_id", F.explode(F.try_variant_get(t, "$.observations", "array<variant>")).alias("o"))
    require(seen, F.concat(F.lit("observation of another trace in "), "trace_id"), text_at(o, "$.traceId") != F.col("trace_id"))
    kinds, subtype = kind_of(text_at(o, "$.type"), ALIASES)
    payload = lambda p: F.when(kind(at(o, p)) == "STRING", text_payload(text_at(o, p))).when(kind(at(o, p)) != "VOID", at(o, p))
    failed = F.upper(text_at(o, "$.level")) == "ERROR"
    costs = [F.try_variant_get(o, p, "double") for p in ("$.costDetails.total", "$.calculatedTotalCost")]
    spans = seen.select(
        "trace_id", text_at(o, "$.id").alias("span_id"), F.nullif(text_at(o, "$.parentObservationId"), F.lit("")).alias("parent_id"), kinds.alias("kind"), subtype.alias("subtype"),
        text_at(o, "$.name").alias("name"), F.when(kinds == "TOOL", text_at(o, "$.name")).alias("tool"), zoned_time(text_at(o, "$.startTime")).alias("start"),
        zoned_time(text_at(o, "$.endTime")).alias("end"), payload("$.input").alias("input"), payload("$.output").alias("output"),
        F.when(failed, F.coalesce(F.nullif(text_at(o, "$.statusMessage"), F.lit("")), F.lit("ERROR"))).alias("error"),
        chosen_cost(*costs).alias("cost_usd"), o.alias("attributes"),
    ).withColumn("duration_ms", duration_ms(F.lit(None).cast("double"), F.col("start"), F.col("end")))
    totals = spans.groupBy("trace_id").agg(F.sum("cost_usd").alias("spent"), span_latency(F.col("start"), F.col("end")).alias("span_ms"))
    score = F.col("x")
    scores = rows.select("trace_id", F.explode(F.try_variant_get(t, "$.scores", "array<variant>")).alias("x"))
    scores = scores.groupBy("trace_id", text_at(score, "$.name").alias("name")).agg(F.sort_array(F.collect_list(F.struct(text_at(score, "$.id").alias("id"), F.to_json("x").alias("score")))).alias("list"))
    results = scores.groupBy("trace_id").agg(F.to_variant_object(F.map_from_entries(F.collect_list(F.struct("name", "list")))).alias("results"))
    given = F.try_variant_get(t, "$.totalCost", "double")
    heads = rows.join(totals, "trace_id", "left").join(results, "trace_id", "left").select(
        "trace_id", F.nullif(text_at(t, "$.sessionId"), F.lit("")).alias("case_id"), F.concat("file", F.lit("#L"), "line").alias("source_url"),
        F.coalesce(F.when(given >= 0, given), "spent").alias("cost_usd"), F.coalesce(F.try_variant_get(t, "$.latency", "double") * 1000, "span_ms").alias("latency_ms"), "results", t.alias("attributes"), F.unix_micros("ts").alias("position"),
    )
    return checked(heads, spans, detach, clock=True)
