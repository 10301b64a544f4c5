"""The nineteen rules of the tool-call audit.

calls: one row per tool call with trace_id, case_id, call_id, call_index, tool, arguments and output (variants, NULL
where nothing was recorded), result_count, result_id, alias_of, explicit_error, outcome_marker, prior_user_text,
complete_provenance (of the trace), has_catalog (of the trace), in_catalog (whether the tool is in it; without this
column, whether there is a schema) and schema (JSON text of the tool's parameters; NULL or JSON null where the catalog has
none, so arguments aren't checked). Everything partitions by trace; no rule needs another trace.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.contracts import UNEVALUABLE, contract_issues, string_leaves
from tracelake.functions.failures import strictly_decoded
from tracelake.functions.json_values import kind
from tracelake.functions.tables import kept, settled
from tracelake.functions.text import canonical_json, compact, digest

RETRIES = 3
#: Issue types and their families (fixed values).
FAMILY = {
    "unknown_tool": "tool_contract_and_arguments", "malformed_tool_call": "tool_contract_and_arguments",
    "missing_required_argument": "tool_contract_and_arguments", "unknown_argument": "tool_contract_and_arguments",
    "argument_type_mismatch": "tool_contract_and_arguments", "argument_enum_violation": "tool_contract_and_arguments",
    "json_schema_violation": "tool_contract_and_arguments", "duplicate_call_id": "call_result_integrity",
    "missing_tool_result": "call_result_integrity", "duplicate_tool_result": "call_result_integrity",
    "orphan_tool_result": "call_result_integrity", "call_result_id_mismatch": "call_result_integrity",
    "explicit_tool_failure": "explicit_tool_outcome", "repeated_identical_failed_call": "recovery_and_retries",
    "modified_retry_same_failure": "recovery_and_retries", "mapped_instrumentation_alias": "trace_instrumentation",
    "unresolved_placeholder_argument": "argument_provenance", "explicitly_rejected_ungrounded_identifier": "argument_provenance",
    "explicit_prerequisite_or_state_failure": "explicit_prerequisite_or_state",
}
#: Who is at fault (fixed values); what isn't listed is the agent's call.
ATTRIBUTION = {t: "agent_call" for t in FAMILY} | {
    "duplicate_call_id": "instrumentation", "missing_tool_result": "instrumentation", "duplicate_tool_result": "instrumentation",
    "call_result_id_mismatch": "instrumentation", "mapped_instrumentation_alias": "instrumentation", "orphan_tool_result": "instrumentation",
    "explicit_tool_failure": "tool_or_environment", "explicit_prerequisite_or_state_failure": "tool_or_environment",
    "repeated_identical_failed_call": "agent_recovery", "modified_retry_same_failure": "agent_recovery",
}
#: Fixed patterns: rejections, placeholders, identifier fields and values, states.
REJECTION = r"(?i)(?:invalid|unknown|not found|does not exist|is not existing|missing input|not a valid)"
PLACEHOLDER = (
    r"(?i)\A(?:<[a-z][a-z0-9 _-]{1,40}>|\{\{[^{}]{1,60}\}\}"
    r"|(?:todo|tbd|placeholder|replace[_-]?me|your[_-][a-z0-9_-]+)|[a-z]+\d+[_-](?:ref[_-]?)?id)\z"
)
ID_FIELD = r"(?i)(?:^|_)(?:id|refid|reference|handle|key)$"
ID_VALUE = r"\A[A-Za-z0-9][A-Za-z0-9_.:@/\-]{2,127}\z"
STATES = {
    "no_active_session": r"(?i)(?:\[NO_ACTIVE_SESSION\]|no active [a-z0-9 _-]{1,40}session)",
    "initialize_before_use": r"(?i)(?:not initialized|please .{0,80}\bbefore (?:running|using|calling))",
    "required_type_or_target": r"(?i)(?:must be (?:a|an|the) [a-z][a-z0-9 _-]{1,50}|cannot be created without (?:a|an|the) [a-z][a-z0-9 _-]{1,50})",
    "required_first_step": r"(?i)(?:must|need(?:s)? to|require(?:s|d)?) .{0,100}\bfirst\b",
}


def state_class(text: Column) -> Column:
    """The first state whose pattern the text has, NULL for none."""
    return F.coalesce(*(F.when(text.rlike(p), F.lit(name)) for name, p in STATES.items()))


#: What a finding shows besides its call (what doesn't apply is null), and how many argument strings at most.
EVIDENCE = {
    "path": "string", "keyword": "string", "result_count": "int", "result_id": "string", "alias_of": "string", "failure_marker": "string", "state_class": "string",
    "leaves": "array<struct<path:string,value:string>>", "result_excerpt": "string", "call_indices": "array<bigint>", "distinct_arguments": "bigint",
}
LEAVES = 20
#: What was observed, for a reader.
SUMMARY = {
    "unknown_tool": "the catalog has no such tool", "malformed_tool_call": "the arguments are no object", "missing_required_argument": "a required argument is missing",
    "unknown_argument": "the schema doesn't know an argument", "argument_type_mismatch": "an argument has the wrong type", "argument_enum_violation": "an argument isn't one of the allowed values",
    "json_schema_violation": "an argument breaks the schema", "duplicate_call_id": "an earlier call of the trace has this id", "missing_tool_result": "no result is linked",
    "duplicate_tool_result": "several results are linked", "orphan_tool_result": "no call asked for this result", "call_result_id_mismatch": "the result names another call",
    "mapped_instrumentation_alias": "the name is an alias of another tool", "explicit_tool_failure": "the tool says it failed", "repeated_identical_failed_call": "the same call failed again and again",
    "modified_retry_same_failure": "calls with other arguments failed alike", "unresolved_placeholder_argument": "an argument is still a placeholder",
    "explicitly_rejected_ungrounded_identifier": "the tool refuses an identifier that nothing before mentions", "explicit_prerequisite_or_state_failure": "the result says that something has to happen first",
}
#: Rules that look at the arguments' content, for which Python has to read it.
CONTRACT = {"unknown_tool", "malformed_tool_call", *("missing_required_argument", "unknown_argument", "argument_type_mismatch", "argument_enum_violation", "json_schema_violation")}
SINGLE = CONTRACT | {
    "duplicate_call_id", "missing_tool_result", "duplicate_tool_result", "call_result_id_mismatch", "mapped_instrumentation_alias", "explicit_tool_failure",
    "unresolved_placeholder_argument", "explicit_prerequisite_or_state_failure",
}
FOUND = ["trace_id", "case_id", "call_id", "call_index", "tool", "issue_type", "mechanism_key", "summary", "evidence", "source_pointer"]


def _evidence(**known: Column) -> Column:
    return F.struct(*(known.get(n, F.lit(None)).cast(t).alias(n) for n, t in EVIDENCE.items()))


def _summary(issue: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in SUMMARY.items() for x in pair))[issue]


def _told(leaves: Column) -> Column:
    """The first strings of a list of leaves, with their paths."""
    return F.transform(F.slice(leaves, 1, LEAVES), lambda x: F.struct(x["path"].alias("path"), x["value"].alias("value")))


def audited(calls: DataFrame) -> DataFrame:
    """calls with what the rules look at: result text, failure marker, contract issues, string leaves, repeats.

    contract has (issue, keyword, path); unevaluable says why a call's schema can't be checked, and such a call has no
    contract issue. What no rule asks for isn't worked out: Spark drops the columns, and Python with them.
    """
    c = F.col
    if "in_catalog" not in calls.columns:
        calls = calls.withColumn("in_catalog", c("schema").isNotNull())
    calls = calls.withColumn("source_pointer", F.to_json("source_pointer") if "source_pointer" in calls.columns else F.lit(None).cast("string"))
    # Before anything that Spark can't see through, so that rows that lie by trace needn't move.
    calls = calls.withColumn("repeat", F.row_number().over(W.partitionBy("trace_id", "call_id").orderBy("call_index", "call_id")))
    rows = strictly_decoded(calls)
    rows = settled(rows, {
        "missing": c("output").isNull() | (F.coalesce("result_count", F.lit(1)) == 0), "rejected": c("text").rlike(REJECTION), "state": state_class(c("text")),
        "is_object": F.coalesce(kind(c("arguments")) == "OBJECT", F.lit(False)), "given": F.when(kind(c("arguments")) == "OBJECT", c("arguments")),
    })
    rows = rows.withColumn("argument_text", F.coalesce(canonical_json(c("given")), F.lit("{}"))).drop("given")
    catalog = F.coalesce("has_catalog", F.lit(False))
    checked = F.when(catalog & c("in_catalog") & c("is_object"), c("schema"))
    # Only rejected or failed calls need their arguments' strings.
    told = F.when(c("is_object") & (c("rejected") | c("marker").isNotNull()), c("argument_text"))
    nothing = F.array().cast("array<struct<issue:string,keyword:string,path:string>>")
    rows = rows.withColumns({"leaves": string_leaves(told), "broken": F.coalesce(contract_issues(c("argument_text"), checked), nothing)})
    whole = lambda issue: F.array(F.struct(F.lit(issue).alias("issue"), F.lit(None).cast("string").alias("keyword"), F.lit(None).cast("string").alias("path")))
    contract = (
        F.when(catalog & ~c("in_catalog"), whole("unknown_tool")).when(c("arguments").isNotNull() & ~c("is_object"), whole("malformed_tool_call"))
        .otherwise(F.filter("broken", lambda x: x["issue"] != UNEVALUABLE))
    )
    return rows.withColumns({
        "contract": contract, "unevaluable": F.get(F.filter("broken", lambda x: x["issue"] == UNEVALUABLE), F.lit(0))["keyword"],
    }).drop("broken")


def unevaluable(rows: DataFrame) -> DataFrame:
    """(tool, calls, reason) of audited calls whose tool has a schema that can't be checked; reason is the least of them."""
    return rows.where(F.col("unevaluable").isNotNull()).groupBy("tool").agg(F.count("*").alias("calls"), F.min("unevaluable").alias("reason"))


def per_call(rows: DataFrame, only: Iterable[str] = tuple(SINGLE)) -> DataFrame:
    """Findings (see FOUND) that a single call shows by itself, in one pass. Of some issues only, if these are named."""
    only = set(only)
    failed, excerpt = F.col("marker").isNotNull(), compact(F.col("text"))
    placeholders = F.filter("leaves", lambda x: F.btrim(x["value"]).rlike(PLACEHOLDER))

    def finding(issue: str, condition: Column, mechanism: Column | None = None, **evidence: Column) -> Column:
        shown = F.struct(F.lit(issue).alias("issue_type"), (F.lit(issue) if mechanism is None else mechanism).alias("mechanism_key"), _evidence(**evidence).alias("evidence"))
        return F.when(F.coalesce(condition, F.lit(False)), shown)

    made = {
        "duplicate_call_id": lambda i: finding(i, F.col("repeat") > 1),
        "missing_tool_result": lambda i: finding(i, F.col("missing")),
        "duplicate_tool_result": lambda i: finding(i, F.col("result_count") > 1, result_count=F.col("result_count")),
        "call_result_id_mismatch": lambda i: finding(i, F.col("result_id") != F.col("call_id"), result_id=F.col("result_id")),
        "mapped_instrumentation_alias": lambda i: finding(i, F.coalesce("alias_of", F.lit("")) != "", alias_of=F.col("alias_of")),
        "explicit_tool_failure": lambda i: finding(i, failed & (F.size("contract") == 0), F.col("marker"), failure_marker=F.col("marker")),
        "unresolved_placeholder_argument": lambda i: finding(i, (F.size(placeholders) > 0) & (failed | F.col("rejected")), leaves=_told(placeholders), result_excerpt=excerpt),
        "explicit_prerequisite_or_state_failure": lambda i: finding(i, F.col("state").isNotNull(), F.col("state"), state_class=F.col("state"), result_excerpt=excerpt),
    }
    found = [F.array_compact(F.array(*(make(issue) for issue, make in made.items() if issue in only)))] if only & set(made) else []
    if only & CONTRACT:
        wanted = F.filter("contract", lambda x: x["issue"].isin(*(only & CONTRACT)))
        found.append(F.transform(wanted, lambda x: F.struct(x["issue"].alias("issue_type"), x["issue"].alias("mechanism_key"), _evidence(path=x["path"], keyword=x["keyword"]).alias("evidence"))))
    out = rows.select("trace_id", "case_id", "call_id", "call_index", "tool", "source_pointer", F.explode(F.concat(*found)).alias("f")).select("*", "f.*")
    return out.withColumn("summary", _summary(F.col("issue_type"))).select(*FOUND)


def ungrounded(rows: DataFrame) -> DataFrame:
    """Findings of identifiers that a result rejects and that neither the user nor an earlier result had mentioned.

    Only the identifiers of rejected calls meet the earlier results of their trace.
    """
    own = ["trace_id", "case_id", "call_id", "call_index", "tool", "source_pointer"]
    suspect = rows.where(F.col("complete_provenance") & F.col("rejected")).select(*own, "text", "prior_user_text", F.posexplode("leaves").alias("place", "x"))
    value = F.col("value")
    suspect = suspect.withColumn("value", F.col("x.value")).where(
        F.col("x.name").rlike(ID_FIELD) & value.rlike(ID_VALUE) & F.contains("text", value) & ~F.coalesce(F.contains("prior_user_text", value), F.lit(False))
    )
    before = rows.where(F.col("complete_provenance") & ~F.col("missing")).select(
        F.col("trace_id").alias("_t"), F.struct("call_index", "call_id").alias("_at"), F.col("text").alias("_text")
    )
    # One join and one grouping, both by trace.
    lost = suspect.join(before, (F.col("trace_id") == F.col("_t")) & (F.col("_at") < F.struct("call_index", "call_id")) & F.contains("_text", value), "left_anti")
    leaves = F.sort_array(F.collect_list(F.struct("place", F.col("x.path").alias("path"), "value")))
    found = lost.groupBy(*own).agg(leaves.alias("leaves"), F.first(compact(F.col("text"))).alias("excerpt"))
    issue = F.lit("explicitly_rejected_ungrounded_identifier")
    evidence = _evidence(leaves=_told(F.col("leaves")), result_excerpt=F.col("excerpt"))
    return found.withColumns({"issue_type": issue, "mechanism_key": issue, "summary": _summary(issue), "evidence": evidence}).select(*FOUND)


def retries(rows: DataFrame, threshold: int = RETRIES) -> DataFrame:
    """Findings about repeated failures, anchored at the first call of each group. Their evidence has the indices of all its calls."""
    bad = rows.where(F.col("marker").isNotNull() | (F.size("contract") > 0) | F.col("missing") | (F.coalesce("result_count", F.lit(1)) > 1))
    failure = F.coalesce("marker", digest(F.when(F.col("missing"), F.lit("missing_result")).otherwise(compact(F.col("text"))), 12))
    bad = bad.select("trace_id", "case_id", "tool", "call_index", "call_id", "source_pointer", "argument_text", failure.alias("failure"))
    first = F.min(F.struct("call_index", "call_id", "source_pointer")).alias("first")
    out = []
    for issue, key in (("repeated_identical_failed_call", F.col("argument_text")), ("modified_retry_same_failure", F.col("failure"))):
        groups = bad.withColumn("key", key).groupBy("trace_id", "case_id", "tool", "key").agg(
            first, F.count("*").alias("n"), F.countDistinct("argument_text").alias("kinds"), F.sort_array(F.collect_list(F.col("call_index").cast("long"))).alias("calls")
        )
        same = issue == "repeated_identical_failed_call"
        groups = groups.where((F.col("n") >= threshold) & (F.lit(True) if same else F.col("kinds") >= 2))
        evidence = _evidence(call_indices=F.col("calls"), **({} if same else {"distinct_arguments": F.col("kinds")}))
        out.append(groups.select(
            "trace_id", "case_id", "first.call_id", "first.call_index", "tool", F.lit(issue).alias("issue_type"), (F.lit(issue) if same else F.col("key")).alias("mechanism_key"),
            _summary(F.lit(issue)).alias("summary"), evidence.alias("evidence"), "first.source_pointer",
        ))
    return reduce(DataFrame.unionByName, out)


def orphans(results: DataFrame) -> DataFrame:
    """Findings for results (trace_id, case_id, result_id, and source_pointer if there is one) that no call asked for."""
    issue = F.lit("orphan_tool_result")
    pointer = F.col("source_pointer") if "source_pointer" in results.columns else F.lit(None).cast("string")
    return results.select(
        "trace_id", "case_id", F.coalesce(F.nullif(F.col("result_id"), F.lit("")), F.lit("<missing>")).alias("call_id"), F.lit(-1).cast("long").alias("call_index"),
        F.lit("<unknown>").alias("tool"), issue.alias("issue_type"), issue.alias("mechanism_key"), _summary(issue).alias("summary"), _evidence().alias("evidence"), pointer.alias("source_pointer"),
    )


def findings_of(rows: DataFrame, orphan_results: DataFrame | None = None, threshold: int = RETRIES) -> DataFrame:
    """All findings of audited calls with family, attribution, and a hash of their whole content as issue_id. rows are read several times."""
    parts = [per_call(rows), ungrounded(rows), retries(rows, threshold)] + ([orphans(orphan_results)] if orphan_results is not None else [])
    found = reduce(DataFrame.unionByName, parts)
    family = F.create_map(*(F.lit(x) for pair in FAMILY.items() for x in pair))
    return found.withColumns({
        "issue_family": family[F.col("issue_type")],
        "attribution": F.create_map(*(F.lit(x) for pair in ATTRIBUTION.items() for x in pair))[F.col("issue_type")],
        "issue_id": digest(F.to_json(F.struct(*FOUND)), 24),
    })


def findings(calls: DataFrame, orphan_results: DataFrame | None = None, threshold: int = RETRIES) -> DataFrame:
    """findings_of() calls that are audited here."""
    return findings_of(kept(audited(calls)), orphan_results, threshold)


def in_order(found: DataFrame) -> DataFrame:
    """Findings by trace, call index, issue type and id, for those who read them one after the other."""
    return found.orderBy("trace_id", "call_index", "issue_type", "issue_id")
