"""Guards, merges and links of insights, and trace predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uncited(cited: DataFrame, allowed: DataFrame, key: str = "trace_id") -> DataFrame:
    """Rows of cited whose key isn't allowed; must be empty."""
    return cited.join(allowed.select(key).distinct(), key, "left_anti")


def key_differences(left: DataFrame, right: DataFrame, key: str = "trace_id") -> DataFrame:
    """(key, side) of keys that only one of two tables has; empty if both cover the same."""
    a, b = (x.select(key).distinct() for x in (left, right))
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def merge_evidence(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full outer merge of evidence (insight_id, trace_id, url, spans): saved URLs stay, new spans follow old ones.

    added tells the rows of new traces; only these update an insight.
    """
    b = new.select("insight_id", "trace_id", F.col("url").alias("new_url"), F.col("spans").alias("new_spans"))
    out = old.withColumn("known", F.lit(True)).join(b, ["insight_id", "trace_id"], "full_outer")
    none = F.array().cast(old.schema["spans"].dataType)
    spans = F.array_distinct(F.concat(F.coalesce("spans", none), F.coalesce("new_spans", none)))
    return out.select("insight_id", "trace_id", F.coalesce("url", "new_url").alias("url"), spans.alias("spans"), F.col("known").isNull().alias("added"))


def updated_insights(merged: DataFrame, today: str) -> DataFrame:
    """(insight_id, n_traces, n_added, updated_date): the date is set only where a trace was added."""
    out = merged.groupBy("insight_id").agg(F.count("*").alias("n_traces"), F.count_if("added").alias("n_added"))
    return out.withColumn("updated_date", F.when(F.col("n_added") > 0, F.lit(today)))


def resolve_links(evidence: DataFrame, traces: DataFrame, spans: DataFrame) -> DataFrame:
    """evidence (insight_id, trace_id, url, span_ids) with links: of present traces their own URL and known spans, else what was saved."""
    keys = ["insight_id", "trace_id"]
    present = traces.select("trace_id", F.col("source_url").alias("found_url"), F.lit(True).alias("present"))
    cited = evidence.select(*keys, F.posexplode("span_ids").alias("pos", "span_id"))
    found = cited.join(spans.select("trace_id", "span_id").distinct(), ["trace_id", "span_id"])
    found = found.groupBy(*keys).agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("pos", "span_id"))), lambda x: x["span_id"])).alias("known_spans"))
    out = evidence.join(present, "trace_id", "left").join(found, keys, "left")
    here = F.coalesce("present", F.lit(False))
    known = F.coalesce("known_spans", F.array().cast(evidence.schema["span_ids"].dataType))
    return out.select(
        *keys, F.when(here, F.coalesce("found_url", "url")).otherwise(F.col("url")).alias("url"),
        F.when(here, known).otherwise(F.array_distinct("span_ids")).alias("span_ids"), here.alias("present"),
    )


def scan(traces: DataFrame, match: Column, known: Column) -> DataFrame:
    """(trace_id, state): match, no_match, or unknown where what the predicate needs wasn't recorded."""
    state = F.when(~F.coalesce(known, F.lit(False)), F.lit("unknown")).when(match, F.lit("match")).otherwise(F.lit("no_match"))
    return traces.select("trace_id", state.alias("state"))


def scan_totals(states: DataFrame) -> DataFrame:
    """One row: traces, matches, unknown."""
    return states.agg(F.count("*").alias("traces"), F.count_if(F.col("state") == "match").alias("matches"), F.count_if(F.col("state") == "unknown").alias("unknown"))


def evaluation_index(traces: DataFrame, calls: DataFrame) -> DataFrame:
    """(trace_id, case_id, results, tools, errors): traces (with results) and the sorted distinct tools and errors of their calls."""
    used = calls.groupBy("trace_id").agg(
        F.sort_array(F.collect_set(F.nullif(F.col("tool"), F.lit("")))).alias("tools"), F.sort_array(F.collect_set(F.nullif(F.col("error"), F.lit("")))).alias("errors")
    )
    none = F.array().cast("array<string>")
    out = traces.join(used, "trace_id", "left")
    return out.select("trace_id", "case_id", "results", F.coalesce("tools", none).alias("tools"), F.coalesce("errors", none).alias("errors"))


def newest(traces: DataFrame, n: int, time: str = "ts", key: str = "trace_id") -> DataFrame:
    """The newest n traces, oldest first."""
    return traces.orderBy(F.desc(time), F.desc(key)).limit(n).orderBy(time, key)


def corpus_description(spans: DataFrame, traces: DataFrame) -> DataFrame:
    """One row: traces, tool calls, and distinct logical cases (a trace without one is its own)."""
    cases = F.coalesce(F.nullif(F.col("case_id"), F.lit("")), F.col("trace_id"))
    of_traces = traces.agg(F.count("*").alias("trace_count"), F.countDistinct(cases).alias("logical_case_count"))
    return of_traces.crossJoin(spans.agg(F.count_if(F.col("kind") == "TOOL").alias("call_count")))  # one row each


def insight_status(insights: DataFrame, saved: DataFrame) -> DataFrame:
    """insights (name, description) with status: retained if a saved one has the same name and description, else new."""
    known = saved.select("name", "description").distinct().withColumn("_known", F.lit(True))
    out = insights.join(known, ["name", "description"], "left")
    return out.withColumn("status", F.when(F.col("_known"), "retained").otherwise("new")).drop("_known")


def problem_traces(problems: DataFrame, traces: DataFrame) -> DataFrame:
    """(description, trace_id, columns of traces): the traces that support each problem; traces that aren't there are left out."""
    ids = problems.select("description", F.explode(F.array_distinct("supporting_trace_ids")).alias("trace_id"))
    return ids.join(traces, "trace_id").select("description", "trace_id", *(c for c in traces.columns if c != "trace_id"))


def rejected(before: DataFrame, verdicts: DataFrame, key: str = "description") -> tuple[DataFrame, DataFrame]:
    """(problems that stay, one row with the number of dropped ones): only a verdict that is false drops a problem."""
    refused = verdicts.where(~F.col("verdict")).select(key).distinct()
    stays = before.join(refused, key, "left_anti")
    return stays, before.join(refused, key, "left_semi").agg(F.count("*").alias("rejected"))


def evaluator_problem(data_type: Column, value: Column, string_value: Column) -> Column:
    """What is wrong with an evaluator's result, NULL if nothing: numbers need a value, texts a string, booleans 0 or 1."""
    number, text = data_type.isin("NUMERIC", "BOOLEAN"), data_type.isin("CATEGORICAL", "TEXT")
    return (
        F.when(~(number | text) | data_type.isNull(), "unknown data type").when(number & value.isNull(), "no value")
        .when((data_type == "BOOLEAN") & ~value.isin(0.0, 1.0), "a boolean is 0 or 1").when(text & string_value.isNull(), "no string value")
    )


def session_results(results: DataFrame, spans: DataFrame) -> DataFrame:
    """Results (session_id, span_id, name, value) of the trace whose spans (session_id, span_id) are given; by trace_id, too, if both have it.

    A session holds results of other traces, too; a result of another session or one that is there twice raises ValueError.
    """
    keys = [c for c in ("trace_id", "span_id") if c in results.columns and c in spans.columns]
    own = results.join(spans.select(*keys, F.col("session_id").alias("_session")).distinct(), keys)
    bad = own.groupBy(*keys, "name").agg(F.count("*").alias("n"), F.max(F.col("session_id") != F.col("_session")).alias("other")).where("n > 1 OR other").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"result {r.name} of span {r.span_id} {'is of another session' if r.other else 'is there twice'}" for r in bad))
    return own.drop("_session")
