"""Recurrence cards over audit findings, and which rules could fire at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.tables import kept
from tracelake.operators.tool_rules import FAMILY

#: Independent cases from which on a card is eligible, and examples on a card.
CASES, EXAMPLES = 3, 3
#: What each rule needs (fixed values).
NEEDS = {
    "unknown_tool": "tool_catalog", "missing_required_argument": "tool_catalog", "unknown_argument": "tool_catalog",
    "argument_type_mismatch": "tool_catalog", "argument_enum_violation": "tool_catalog", "json_schema_violation": "tool_catalog",
    "malformed_tool_call": "always", "duplicate_call_id": "always", "missing_tool_result": "result-key discipline",
    "duplicate_tool_result": "result_count", "call_result_id_mismatch": "result_id", "orphan_tool_result": "orphan_results",
    "mapped_instrumentation_alias": "instrumentation_alias_of", "explicit_tool_failure": "result",
    "explicit_prerequisite_or_state_failure": "result", "unresolved_placeholder_argument": "result",
    "explicitly_rejected_ungrounded_identifier": "complete_provenance_context", "repeated_identical_failed_call": "result",
    "modified_retry_same_failure": "result",
}


def cards(findings: DataFrame, cases: int = CASES) -> DataFrame:
    """One row per issue type and mechanism, in that order: counts, eligibility and up to three cases' first findings.

    An example has its case, place, tool, summary and source pointer. Findings combine per case before they meet, and what
    is combined is stored, as it is used twice; card_traces() has the traces of each card.
    """
    at = F.struct("trace_id", "call_index", "call_id", "tool", "summary", "source_pointer")
    per_case = kept(findings.groupBy("issue_type", "mechanism_key", "case_id").agg(F.count("*").alias("n"), F.min(at).alias("first")))
    keys = ["issue_type", "mechanism_key"]
    first = per_case.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy("first"))).where(F.col("rank") <= EXAMPLES)
    first = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("first", "case_id"))).alias("examples"))
    out = per_case.groupBy(*keys).agg(F.sum("n").alias("finding_count"), F.count("*").alias("independent_case_count")).join(first, keys)
    family = F.create_map(*(F.lit(x) for pair in FAMILY.items() for x in pair))
    return out.withColumns({
        "card_id": F.concat_ws(":", F.lit("tid"), "issue_type", "mechanism_key"), "issue_family": family[F.col("issue_type")],
        "eligible": F.col("independent_case_count") >= cases,
    }).orderBy("issue_type", "mechanism_key")


def card_traces(findings: DataFrame) -> DataFrame:
    """(card_id, trace_id): the traces with findings of each card."""
    return findings.select(F.concat_ws(":", F.lit("tid"), "issue_type", "mechanism_key").alias("card_id"), "trace_id").distinct()


def catalog_coverage(findings: DataFrame) -> DataFrame:
    """Findings per issue type, all nineteen listed."""
    types = findings.sparkSession.createDataFrame([(t,) for t in sorted(FAMILY)], "issue_type string")
    counts = findings.groupBy("issue_type").agg(F.count("*").alias("findings"))
    return types.join(counts, "issue_type", "left").select("issue_type", F.coalesce("findings", F.lit(0)).cast("long").alias("findings"))


def field_presence(calls: DataFrame, traces: DataFrame) -> DataFrame:
    """One row: how many calls and traces have what rules need."""
    of_calls = calls.agg(
        F.count("*").alias("calls"), F.count_if(F.col("output").isNotNull()).alias("with_result"), F.count_if(F.col("output").isNull()).alias("without_result"),
        F.count_if(F.col("result_count") > 1).alias("many_results"), F.count("result_id").alias("with_result_id"),
        F.count_if(F.coalesce("alias_of", F.lit("")) != "").alias("with_alias"), F.count_if(~F.col("explicit_error")).alias("explicit_error_false"),
    )
    of_traces = traces.agg(
        F.count("*").alias("traces"), F.count_if("has_catalog").alias("with_catalog"), F.count_if("complete_provenance").alias("with_provenance"),
        F.count_if(F.col("orphan_results") > 0).alias("with_orphans"),
    )
    return of_calls.crossJoin(of_traces)  # one row each


def rule_evaluability(presence: DataFrame, findings: DataFrame) -> DataFrame:
    """Per rule: what it needs, whether the corpus has that, and how often it fired."""
    rules = presence.sparkSession.createDataFrame(sorted(NEEDS.items()), "issue_type string, needs string")
    have = {
        "tool_catalog": F.col("with_catalog") > 0, "always": F.col("calls") > 0, "result-key discipline": F.col("without_result") > 0,
        "result_count": F.col("many_results") > 0, "result_id": F.col("with_result_id") > 0, "orphan_results": F.col("with_orphans") > 0,
        "instrumentation_alias_of": F.col("with_alias") > 0, "result": F.col("with_result") > 0, "complete_provenance_context": F.col("with_provenance") > 0,
    }
    evaluable = F.coalesce(*(F.when(F.col("needs") == need, condition) for need, condition in have.items()))
    out = rules.crossJoin(F.broadcast(presence)).withColumn("evaluable", evaluable)  # nineteen rows by one
    return out.join(catalog_coverage(findings), "issue_type").select("issue_type", "needs", "evaluable", "findings")
