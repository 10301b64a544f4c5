"""A run's problems merged into the insights of earlier runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.tables import kept
from tracelake.operators.evidence import merge_evidence, resolve_links, uncited, updated_insights
from tracelake.sinks.insights import EVIDENCE, LEAST_TRACES, Insights
from tracelake.sources.common import Snapshot


@dataclass
class Run:
    """insights after a run, and how many of them are new, got traces, or stayed as they were; problems with too few traces."""

    insights: Insights
    new: int
    extended: int
    unchanged: int
    too_few: int


def merged(snapshot: Snapshot, problems: DataFrame, saved: Insights, now: str) -> Run:
    """problems (name, description, supporting_trace_ids) merged into saved insights.

    A problem belongs to the saved insight of its name, else it is a new one, if it has LEAST_TRACES traces. Saved
    insights keep id, description, traces and spans; those that get a trace are dated now, all others keep their date.
    Traces of the snapshot link to where they are now, others to where they were. A problem that cites a trace that
    isn't in the snapshot raises ValueError.
    """
    cited = problems.select("name", "description", F.explode(F.array_distinct("supporting_trace_ids")).alias("trace_id"))
    cited = kept(cited.groupBy("name", "trace_id").agg(F.min("description").alias("description")))
    lost = uncited(cited, snapshot.traces).limit(5).collect()
    if lost:
        raise ValueError(f"problems cite traces that aren't in the snapshot: {', '.join(sorted({r.trace_id for r in lost}))}")
    known = saved.insights.select(F.col("name"), F.col("insight_id").alias("_id"))
    cited = cited.join(known.groupBy("name").agg(F.min("_id").alias("_id")), "name", "left")
    enough = cited.groupBy("name").agg(F.count("*").alias("n"), F.max("_id").alias("_id"), F.min("description").alias("description"))
    enough = kept(enough)
    fresh = enough.where(F.col("_id").isNull() & (F.col("n") >= LEAST_TRACES))
    taken = enough.where(F.col("_id").isNotNull() | (F.col("n") >= LEAST_TRACES)).select("name")
    evidence = cited.join(taken, "name", "left_semi").select(
        F.coalesce("_id", "name").alias("insight_id"), "trace_id", F.lit(None).cast("string").alias("url"), F.array().cast("array<string>").alias("spans")
    )
    whole = kept(merge_evidence(saved.evidence.select("insight_id", "trace_id", "url", "spans"), evidence))
    dates = kept(updated_insights(whole, now).select("insight_id", "n_added", F.col("updated_date").alias("_date")))
    linked = resolve_links(whole.withColumnRenamed("spans", "span_ids"), snapshot.traces.select("trace_id", "source_url"), snapshot.spans)
    urls = saved.evidence.select("insight_id", "trace_id", "span_urls")
    linked = linked.join(urls, ["insight_id", "trace_id"], "left").select("insight_id", "trace_id", "url", F.col("span_ids").alias("spans"), "span_urls")
    none = F.lit(None).cast("string")
    rows = saved.insights.unionByName(fresh.select(F.col("name").alias("insight_id"), none.alias("id"), "name", "description", none.alias("updated_date")))
    rows = rows.join(dates, "insight_id", "left").withColumn("updated_date", F.coalesce("_date", "updated_date"))
    insights = Insights(kept(rows.select("insight_id", "id", "name", "description", "updated_date")), kept(linked.select(*(c.split()[0] for c in EVIDENCE.split(", ")))))
    old = saved.insights.select("insight_id").join(dates.where("n_added > 0"), "insight_id").count()
    return Run(insights, fresh.count(), old, saved.insights.count() - old, enough.where(F.col("_id").isNull() & (F.col("n") < LEAST_TRACES)).count())
