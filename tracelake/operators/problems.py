"""Candidate problems (name, description, supporting_trace_ids) from cards, outliers and recurring failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Traces that support the problem of outliers; all of them are its candidates.
SUPPORT, REASONS = 50, 5


def _counted(n: str, one: str, many: str) -> Column:
    return F.concat(F.col(n).cast("string"), F.when(F.col(n) == 1, F.lit(f" {one}")).otherwise(F.lit(f" {many}")))


def _ids(traces: Column) -> Column:
    return F.array_distinct(F.transform(traces, lambda x: x["trace_id"].cast("string"))).alias("supporting_trace_ids")


def from_cards(cards: DataFrame, audit: bool = False) -> DataFrame:
    """One problem per eligible card (with audit, per card), supported by its examples, which it tells."""
    rows = cards if audit else cards.where("eligible")
    seen = F.transform("examples", lambda x: F.concat(F.coalesce(F.nullif(x["first"]["tool"], F.lit("")), F.lit("unknown tool")), F.lit(": "), x["first"]["summary"]))
    told = F.format_string(
        "Tool calls show %s (%s): %s in %s. Seen: %s. This says what was recorded, not what it led to.", F.replace("issue_type", F.lit("_"), F.lit(" ")), F.col("mechanism_key"),
        _counted("finding_count", "finding", "findings"), _counted("independent_case_count", "case", "cases"), F.array_join(F.array_distinct(seen), "; "),
    )
    return rows.select(F.col("card_id").alias("name"), told.alias("description"), _ids(F.transform("examples", lambda x: x["first"])))


def _recurrence(groups: DataFrame, name: str, prefix: str, where: Column) -> DataFrame:
    told = F.format_string(
        "Tools fail again and again with \"%s\": %s in %s, %s.", F.col(name), _counted("event_count", "failure", "failures"), _counted("independent_trace_count", "trace", "traces"), where
    )
    return groups.select(F.concat(F.lit(prefix), F.col(name)).alias("name"), told.alias("description"), _ids(F.col("representatives")))


def from_failures(groups: DataFrame) -> DataFrame:
    """One problem per recurring failure signature."""
    return _recurrence(groups, "signature", "failure:", F.concat(F.lit("by "), F.array_join("tools", " and ")))


def from_cross_tool(groups: DataFrame) -> DataFrame:
    """One problem per failure message that several tools share; groups list all tools."""
    return _recurrence(groups.where(F.size("tools") >= 2), "message_signature", "failure_across_tools:", F.concat(F.lit("whichever of these is called: "), F.array_join(F.sort_array("tools"), ", ")))


def outlier_summary(flagged: DataFrame, reasons: DataFrame) -> DataFrame:
    """(reason, traces): the reasons of flagged traces (trace_id, score, flagged), most frequent first, five at most."""
    odd = flagged.where("flagged").join(reasons, "trace_id")
    counts = odd.select("trace_id", F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("traces"))
    return counts.orderBy(F.desc("traces"), "reason").limit(REASONS)


def outlier_candidates(flagged: DataFrame) -> DataFrame:
    """(trace_id, score) of all flagged traces, most deviant first."""
    return flagged.where("flagged").select("trace_id", "score").orderBy(F.desc("score"), "trace_id")


def from_outliers(flagged: DataFrame, reasons: DataFrame) -> DataFrame:
    """One problem for all flagged traces with their most common reasons; none if none is flagged."""
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("trace_id").cast("string").alias("trace_id"))))
    support = outlier_candidates(flagged).limit(SUPPORT).agg(_ids(ranked))
    common = F.sort_array(F.collect_list(F.struct((-F.col("traces")).alias("n"), "reason")))
    told = outlier_summary(flagged, reasons).agg(F.array_join(F.transform(common, lambda x: F.concat(x["reason"], F.lit(" in "), -x["n"])), ", ").alias("told"))
    n = flagged.where("flagged").agg(F.count("*").alias("n")).where("n > 0")
    text = F.format_string(
        "%s from the rest of the corpus; what sets them apart most often: %s. Look at them before calling it a fault.",
        F.concat(_counted("n", "trace differs", "traces differ")), F.coalesce(F.nullif("told", F.lit("")), F.lit("no feature in particular")),
    )
    return n.crossJoin(support).crossJoin(told).select(F.lit("outliers").alias("name"), text.alias("description"), "supporting_trace_ids")  # one row each
