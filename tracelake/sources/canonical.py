"""Canonical JSON Lines: one trace per line, with nested spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.json_values import at, kind, text_at
from tracelake.functions.tables import kept
from tracelake.functions.text import duration_ms
from tracelake.functions.urls import file_page
from tracelake.sources.common import KINDS, TOKENS, Snapshot, TraceLoadError, all_nodes, checked, filled_lists, lines_of, require_all, zoned_time


def spans_of(rows: DataFrame) -> DataFrame:
    """(trace_id, parent_id, sibling, span): the spans of each row's tree (trace_id, value), walked in the row."""

    def nodes(parent: Column, spans: Column) -> Column:
        made = F.transform(spans, lambda span, i: F.struct(parent.cast("string").alias("parent_id"), i.alias("sibling"), span.alias("span")))
        return F.coalesce(made, F.array().cast("array<struct<parent_id:string,sibling:int,span:variant>>"))

    listed = lambda value, path: F.try_variant_get(value, path, "array<variant>")
    found = all_nodes(
        nodes(F.lit(None), listed(F.col("value"), "$.root_spans")), lambda n: nodes(text_at(n["span"], "$.id"), listed(n["span"], "$.children")), filled_lists(F.col("value"), "children")
    )
    return rows.select("trace_id", F.explode(found).alias("n")).select("trace_id", "n.*")


def read(spark: SparkSession, path: str) -> Snapshot:
    """Traces of a file or folder. Raises TraceLoadError with file and line for lines that aren't valid traces."""
    lines = kept(lines_of(spark, path).withColumn("value", F.try_parse_json("text")).drop("text"))
    if not lines.head(1):
        raise TraceLoadError(f"no traces in {path}")
    value = F.col("value")
    valid = (F.coalesce(text_at(value, "$.id"), F.lit("")) != "") & (kind(at(value, "$.root_spans")) == "ARRAY") & (kind(at(value, "$.aggregate")) == "OBJECT")
    require_all(lines, F.concat_ws(":", "file", "line"), {"malformed JSON": value.isNull(), "invalid trace": ~F.coalesce(valid, F.lit(False))})
    rows = lines.withColumn("trace_id", text_at(value, "$.id"))
    traces = rows.select(
        "trace_id", text_at(value, "$.attributes.logical_case_id").alias("case_id"), file_page(F.col("file"), F.col("line")).alias("source_url"),
        F.try_variant_get(value, "$.aggregate.cost_usd", "double").alias("cost_usd"), F.try_variant_get(value, "$.aggregate.latency_ms", "double").alias("latency_ms"),
        F.try_variant_get(value, "$.aggregate.token_counts", TOKENS).alias("tokens"), at(value, "$.evaluator_results").alias("results"), at(value, "$.attributes").alias("attributes"),
        F.col("line").alias("position"),
    )
    flat = kept(spans_of(rows))
    s = F.col("span")
    spans = flat.select(
        "trace_id", "parent_id", F.col("sibling").cast("long").alias("sibling"), text_at(s, "$.id").alias("span_id"), text_at(s, "$.kind").alias("kind"),
        text_at(s, "$.attributes.subtype").alias("subtype"), text_at(s, "$.attributes.name").alias("name"), text_at(s, "$.tool_name").alias("tool"),
        text_at(s, "$.start_time").alias("_start"), text_at(s, "$.end_time").alias("_end"), at(s, "$.input").alias("input"), at(s, "$.output").alias("output"),
        text_at(s, "$.error").alias("error"), F.try_variant_get(s, "$.cost_usd", "double").alias("cost_usd"), text_at(s, "$.model").alias("model"),
        F.try_variant_get(s, "$.token_counts", TOKENS).alias("tokens"), F.try_variant_get(s, "$.attributes.duration_ms", "double").alias("_ms"),
        at(s, "$.attributes").alias("attributes"), at(s, "$.tool_call").alias("tool_call"),
    ).withColumns({"start": zoned_time(F.col("_start")), "end": zoned_time(F.col("_end"))})
    lost = lambda text, time: F.col(text).isNotNull() & F.col(time).isNull()
    require_all(spans, F.concat(F.lit("trace "), "trace_id", F.lit(", span "), F.coalesce("span_id", F.lit("?"))), {
        "invalid id or kind": (F.coalesce("span_id", F.lit("")) == "") | ~F.coalesce(F.col("kind").isin(KINDS), F.lit(False)),
        "time without an offset": lost("_start", "start") | lost("_end", "end"),
    })
    return checked(traces, spans.withColumn("duration_ms", duration_ms(F.col("_ms"), F.col("start"), F.col("end"))), detach=False)
