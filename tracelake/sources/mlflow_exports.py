"""MLflow trace exports (version 3): a trace, a list, a search result with `traces`, or JSON Lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.json_values import at, kind, text_at
from tracelake.functions.text import duration_ms, nanos_to_timestamp
from tracelake.sources.common import Snapshot, checked, documents_of, kind_of, require, span_latency, unique

ALIASES = {"CHAT_MODEL": "LLM"}
TYPE_KEYS = ["mlflow.spanType", "openinference.span.kind"]


def read(spark: SparkSession, path: str, limit: int = 10_000) -> Snapshot:
    """The first traces of the files, in their order. Spans whose parent is missing become roots."""
    return snapshot(documents_of(spark, path), limit)


def snapshot(found: DataFrame, limit: int | None = None) -> Snapshot:
    """Traces of documents (file, line, value)."""
    require(found, F.concat_ws(":", "file", "line"), F.col("value").isNull())
    many = kind(at(F.col("value"), "$.traces")) == "ARRAY"
    found = found.select("file", "line", F.posexplode(F.when(many, F.try_variant_get("value", "$.traces", "array<variant>")).otherwise(F.array("value"))).alias("pos", "t"))
    if limit is not None:
        found = found.orderBy("file", "line", "pos").limit(limit)
    found = found.withColumn("position", F.col("line") * 1_000_000 + F.col("pos"))
    t = F.col("t")
    traces = found.withColumn("trace_id", text_at(t, "$.info.trace_id"))
    require(traces, F.concat_ws(":", "file", "line", F.lit("no trace id")), F.coalesce("trace_id", F.lit("")) == "")
    spans = traces.select("trace_id", F.explode(F.try_variant_get(t, "$.data.spans", "array<variant>")).alias("s"))
    s = F.col("s")
    # Attribute values are JSON texts.
    mime = lambda k: F.coalesce(text_at(s, f"$.attributes['{k}MimeType']"), F.lit("application/json"))

    def attribute(k: str) -> Column:
        # The text null is a recorded null only where it is said to be JSON.
        text = text_at(s, f"$.attributes['{k}']")
        return F.when((text == "null") & ~F.contains(mime(k), F.lit("json")), text.cast("variant")).otherwise(F.try_parse_json(text))

    names = F.coalesce(*(F.nullif(text_at(attribute(k), "$"), F.lit("")) for k in TYPE_KEYS))
    kinds, subtype = kind_of(names, ALIASES)
    code = F.upper(text_at(s, "$.status.code"))
    message = F.nullif(text_at(s, "$.status.message"), F.lit(""))
    nanos = lambda k: nanos_to_timestamp(F.try_variant_get(s, f"$.{k}", "long"))
    spans = spans.select(
        "trace_id", text_at(s, "$.span_id").alias("span_id"), F.nullif(text_at(s, "$.parent_span_id"), F.lit("")).alias("parent_id"), kinds.alias("kind"), subtype.alias("subtype"),
        text_at(s, "$.name").alias("name"), F.when(kinds == "TOOL", text_at(s, "$.name")).alias("tool"), nanos("start_time_unix_nano").alias("start"), nanos("end_time_unix_nano").alias("end"),
        attribute("mlflow.spanInputs").alias("input"), attribute("mlflow.spanOutputs").alias("output"),
        F.when(code.endswith("ERROR"), F.coalesce(message, F.lit("MLflow span status ERROR"))).alias("error"), F.lit(None).cast("double").alias("cost_usd"), at(s, "$.attributes").alias("attributes"),
    ).withColumn("duration_ms", duration_ms(F.lit(None).cast("double"), F.col("start"), F.col("end")))
    marks = traces.select("trace_id", F.explode(F.try_variant_get(t, "$.info.assessments", "array<variant>")).alias("a"))
    a = F.col("a")
    marks = marks.where(~F.coalesce(F.try_variant_get(a, "$.valid", "boolean") == F.lit(False), F.lit(False))).select("trace_id", text_at(a, "$.assessment_name").alias("name"), a.alias("a"))
    marks = marks.where("name <> ''")
    unique(marks, ["trace_id", "name"], "assessment")
    results = marks.groupBy("trace_id").agg(F.to_variant_object(F.map_from_entries(F.collect_list(F.struct("name", F.to_json("a").alias("value"))))).alias("results"))
    times = spans.groupBy("trace_id").agg(span_latency(F.col("start"), F.col("end")).alias("latency_ms"))
    case = F.nullif(text_at(t, "$.info.trace_metadata['mlflow.trace.session']"), F.lit(""))
    heads = traces.select("trace_id", "position", case.alias("case_id"), F.lit(None).cast("string").alias("source_url"), F.lit(None).cast("double").alias("cost_usd"), at(t, "$.info").alias("attributes"))
    return checked(heads.join(times, "trace_id", "left").join(results, "trace_id", "left"), spans, detach=True, clock=True)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, traces, truncated) of the export files: their digest, how many traces they hold, and whether a page token says that there are more."""
    whole = spark.read.format("binaryFile").load(path).select("path", "content")
    value = F.try_parse_json(F.col("content").cast("string"))
    rows = whole.select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"), value.alias("v"))
    v = F.col("v")
    n = F.when(kind(v) == "ARRAY", F.size(F.try_variant_get(v, "$", "array<variant>"))).when(kind(at(v, "$.traces")) == "ARRAY", F.size(F.try_variant_get(v, "$.traces", "array<variant>"))).otherwise(1)
    return rows.select("file", "sha256", n.alias("traces"), (F.coalesce(text_at(v, "$.next_page_token"), F.lit("")) != "").alias("truncated"))
