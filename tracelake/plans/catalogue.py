"""Queries over the test tables, one per operator or family of operators."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions import text as T
from tracelake.functions.tables import kept
from tracelake.operators import cards as C
from tracelake.operators import evidence as E
from tracelake.operators import features as A
from tracelake.operators import models as M
from tracelake.operators import tool_rules as R
from tracelake.operators import trees as S
from tracelake.plans.adapters import audit_calls, event_calls, order_lines, order_traces, table, turns

#: Parameters of the queries (fixed values).
CENTERS = [-0.3, -0.26, -0.22, -0.18, -0.14, -0.1, -0.06, -0.02, 0.02, 0.06, 0.1, 0.14, 0.18, 0.22, 0.26, 0.3]
WEIGHTS = [round(((7 * i) % 11 - 5) / 10, 1) for i in range(64)]
BIAS, COMPLAINT = -0.25, 0.5
SCHEMA = json.dumps({"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 89, "enum": [i for i in range(100) if i % 10 != 7]}}})
PLACES = 6


def _r(c: str | Column) -> Column:
    return F.round(c, PLACES)


def _events(spark, d) -> DataFrame:
    return A.decoded_calls(event_calls(spark, d))


def _event_traces(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("trace_id")).distinct()


def _event_features(spark, d) -> DataFrame:
    return A.trace_features(_events(spark, d), _event_traces(spark, d))


def _audited(spark, d, **columns: Column) -> DataFrame:
    return R.audited(audit_calls(event_calls(spark, d).withColumns(columns)))


def _short(found: DataFrame, *issues: str) -> DataFrame:
    return found.where(F.col("issue_type").isin(*issues)).select("trace_id", "call_id", "call_index", "tool", "issue_type", "mechanism_key")


def corpus_description(spark: SparkSession, d: str) -> DataFrame:
    calls = event_calls(spark, d)
    traces = calls.select("trace_id", F.col("case_id").cast("string").alias("case_id")).distinct().withColumn("trace_id", F.col("trace_id").cast("string"))
    return E.corpus_description(calls.select(F.lit("TOOL").alias("kind")), traces)


def tree_preorder_paths(spark, d):
    out = S.preorder(turns(spark, d))
    return out.select("trace_id", "span_id", F.array_join("path", ".").alias("path"), F.col("depth").cast("long").alias("depth"), F.col("dfs_index").cast("long").alias("dfs_index"))


def clock_order(spark, d):
    """Turns whose clock runs wild: many start before the turn that they answer."""
    parent = F.when(F.col("span_id") > 0, F.floor((F.col("span_id") - 1) / 2))
    spans = turns(spark, d).withColumns({"start": (F.col("span_id") * 7 + F.col("trace_id")) % 5, "parent_id": F.when(F.col("span_id") % 4 != 3, parent)})
    return S.clock_order(spans).select("trace_id", "span_id", F.col("clock_index").cast("long").alias("clock_index"))


def orphan_parent_detach(spark, d):
    spans = turns(spark, d).withColumn("parent_id", F.when(F.col("parent_id").isNotNull() & (F.col("span_id") % 5 == 0), F.col("parent_id") + 100000).otherwise(F.col("parent_id")))
    return S.detach_orphans(spans).select("trace_id", "span_id", "parent_id", "unresolved_parent")


def cycle_detection(spark, d):
    closed = (F.col("trace_id") % 10 == 0) & (F.col("span_id") == 0)
    spans = turns(spark, d).withColumn("parent_id", F.when(closed, F.lit(1)).when((F.col("trace_id") % 10 == 0) & (F.col("span_id") == 1), F.lit(0)).otherwise(F.col("parent_id")))
    return S.cyclic(S.detach_orphans(spans))


def carry_prior_user_text(spark, d):
    rows = turns(spark, d).withColumn("said", F.when(F.col("role") == "user", F.col("text")))
    return rows.select("trace_id", "span_id", F.md5(F.coalesce(S.carried_text(F.col("said"), "span_id"), F.lit(""))).alias("prior_md5"))


def prior_results_concat(spark, d):
    return turns(spark, d).select("trace_id", "span_id", F.md5(S.prior_texts(F.col("text"), "span_id")).alias("prior_md5"))


def last_agent_excerpt(spark, d):
    kind = F.when(F.col("role") == "assistant", "agent").otherwise(F.col("role"))
    steps = turns(spark, d).select("trace_id", F.col("span_id").alias("step_index"), kind.alias("step_type"), F.col("text").alias("content"))
    return S.last_agent_excerpt(steps)


def sequence_tokens(spark, d):
    token = T.sequence_token(F.lit("tool"), F.col("tool"))
    return event_calls(spark, d).select("trace_id", "call_index", F.when(F.col("event_type") == "view", T.sequence_token(F.lit("Evaluation"), F.lit("x"))).otherwise(token).alias("token"))


def trace_features(spark, d):
    return _event_features(spark, d).select("trace_id", *(_r(c).alias(c) for c in A.FEATURES))


def trace_features_empty_traces(spark, d):
    calls = order_lines(spark, d).withColumns({"arguments": F.lit(None).cast("variant"), "error": F.lit(None).cast("string"), "duration_ms": F.lit(None).cast("double")})
    out = A.trace_features(A.decoded_calls(calls), order_traces(spark, d))
    return out.select("trace_id", *(_r(c).alias(c) for c in ("tool_call_count", "distinct_tool_count", "trajectory_step_count", "dominant_tool_share", "output_kb_per_call")))


def robust_zscores(spark, d):
    names = ["tool_call_count", "explicit_failure_rate", "output_kb_per_call"]
    return A.robust_z(_event_features(spark, d), names).select("trace_id", "feature", _r("value").alias("value"), _r("center").alias("center"), _r("mad").alias("mad"), F.round("z", 4).alias("z"))


def robust_reasons(spark, d):
    names = ["tool_call_count", "dominant_tool_share", "explicit_failure_rate", "tool_duration_sec_total"]
    rounded = _event_features(spark, d).select("trace_id", *(_r(c).alias(c) for c in names))
    return A.robust_reasons(rounded, names).select("trace_id", F.array_join("reasons", "; ").alias("reasons"))


def failure_signatures(spark, d):
    return A.failure_events(_events(spark, d)).select("trace_id", "call_id", "marker", "signature", "message_signature")


def recurring_failures(spark, d):
    out = A.recurring(A.failure_events(_events(spark, d)))
    first = F.transform("representatives", lambda x: F.concat_ws(":", x["trace_id"], x["call_id"]))
    return out.select("signature", "event_count", "independent_trace_count", "first_trace", F.array_join(first, ",").alias("representatives"))


def cross_tool_failures(spark, d):
    out = A.recurring(A.failure_events(_events(spark, d)), "message_signature", most_tools=None)
    return out.select("message_signature", "event_count", "independent_trace_count", F.array_join(F.sort_array("tools"), ",").alias("tool_names"))


def verdict_groups(spark, d):
    out = A.verdict_groups(order_traces(spark, d))
    return out.select("verdict", "independent_trace_count", F.round("total_known_cost", 2).alias("total_known_cost"), "first_position", F.array_join("representatives", ",").alias("representatives"))


def rule_duplicate_call_id(spark, d):
    return _short(R.per_call(R.audited(audit_calls(order_lines(spark, d))), ["duplicate_call_id"]), "duplicate_call_id")


def rule_missing_and_duplicate_result(spark, d):
    return _short(R.per_call(R.audited(audit_calls(order_lines(spark, d))), ["missing_tool_result", "duplicate_tool_result"]), "missing_tool_result", "duplicate_tool_result")


def rule_result_id_mismatch(spark, d):
    return _short(R.per_call(R.audited(audit_calls(order_lines(spark, d))), ["call_result_id_mismatch"]), "call_result_id_mismatch")


def rule_unknown_tool(spark, d):
    known = F.when(F.col("tool") != "op_4", F.lit("{}"))
    return _short(R.per_call(_audited(spark, d, has_catalog=F.lit(True), schema=known)), "unknown_tool")


def rule_argument_contract(spark, d):
    broken = F.when(F.col("k") % 25 == 3, F.parse_json(F.lit("{}"))).when(F.col("k") % 25 == 4, F.parse_json(F.lit('{"k":"x"}'))).when(F.col("k") % 25 == 5, F.parse_json(F.lit("[1]")))
    rows = _audited(spark, d, has_catalog=F.lit(True), schema=F.lit(SCHEMA), arguments=broken.otherwise(F.col("arguments")))
    return _short(R.per_call(rows), "missing_required_argument", "argument_type_mismatch", "argument_enum_violation", "json_schema_violation", "malformed_tool_call")


def rule_explicit_failure(spark, d):
    return _short(R.per_call(_audited(spark, d)), "explicit_tool_failure")


def rule_placeholder(spark, d):
    value = F.when(F.col("k") < 5, F.lit("<user id>")).otherwise(F.concat(F.lit("id-"), F.col("k")))
    return _short(R.per_call(_audited(spark, d, arguments=F.to_variant_object(F.struct(value.alias("target"))))), "unresolved_placeholder_argument")


def rule_ungrounded_identifier(spark, d):
    ident = F.concat(F.lit("ref"), F.col("k"))
    output = F.when(F.col("failed"), F.concat(F.lit("invalid reference "), ident)).otherwise(F.concat(F.lit("saw "), ident))
    args = F.to_variant_object(F.struct(ident.alias("user_id"), F.col("tool").alias("name")))
    return _short(R.ungrounded(_audited(spark, d, complete_provenance=F.lit(True), arguments=args, output=output.cast("variant"))), "explicitly_rejected_ungrounded_identifier")


def rule_state_failure(spark, d):
    said = (
        F.when(F.col("k") % 10 == 0, "no active editing session").when(F.col("k") % 10 == 1, "please log in before using it").when(F.col("k") % 10 == 2, "target must be a file")
        .when(F.col("k") % 10 == 3, "you need to sign in first").otherwise("fine")
    )
    return _short(R.per_call(_audited(spark, d, output=said.cast("variant")), ["explicit_prerequisite_or_state_failure"]), "explicit_prerequisite_or_state_failure")


def rule_repeated_identical(spark, d):
    return _short(R.retries(_audited(spark, d)), "repeated_identical_failed_call")


def rule_modified_retry(spark, d):
    return _short(R.retries(_audited(spark, d)), "modified_retry_same_failure")


def orphan_results(spark, d):
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    lost = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left_anti")
    found = R.orphans(lost.select(F.col("o_orderkey").alias("trace_id"), F.col("o_custkey").alias("case_id"), F.col("o_orderkey").cast("string").alias("result_id")))
    return found.select("trace_id", "case_id", "call_id", "call_index", "tool", "issue_type")


def _event_findings(spark, d) -> DataFrame:
    rows = kept(_audited(spark, d))  # used by all kinds of rules
    return R.per_call(rows).unionByName(R.ungrounded(rows)).unionByName(R.retries(rows))


def issue_cards(spark, d):
    out = C.cards(_event_findings(spark, d))
    examples = F.array_join(F.transform("examples", lambda x: x["first"]["trace_id"].cast("string")), ",")
    return out.select("card_id", "issue_family", "finding_count", "independent_case_count", "eligible", examples.alias("examples"))


def catalog_coverage(spark, d):
    return C.catalog_coverage(_event_findings(spark, d))


def _line_presence(spark, d) -> tuple[DataFrame, DataFrame]:
    calls = audit_calls(order_lines(spark, d))
    lost = table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    traces = order_traces(spark, d).join(lost.withColumn("orphan_results", F.lit(1)), F.col("trace_id") == F.col("o_orderkey"), "left")
    traces = traces.select("trace_id", F.lit(False).alias("has_catalog"), F.lit(False).alias("complete_provenance"), F.coalesce("orphan_results", F.lit(0)).alias("orphan_results"))
    return calls, C.field_presence(calls, traces)


def field_presence(spark, d):
    return _line_presence(spark, d)[1]


def rule_evaluability(spark, d):
    calls, presence = _line_presence(spark, d)
    return C.rule_evaluability(presence, R.per_call(R.audited(calls)))


def evaluation_index(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    traces = labels.select(F.col("doc_id").alias("trace_id"), F.concat(F.lit("quality="), "quality", F.lit(",toxic="), "toxic").alias("results"))
    traces = traces.join(docs.select(F.col("doc_id").alias("trace_id"), F.col("source").alias("case_id")), "trace_id")
    calls = docs.select(F.col("doc_id").alias("trace_id"), F.col("lang").alias("tool"), F.when(F.col("n_chars") > 3000, "long").alias("error"))
    out = E.evaluation_index(traces, calls)
    return out.select("trace_id", "case_id", "results", F.array_join("tools", ",").alias("tools"), F.array_join("errors", ",").alias("errors"))


def evaluation_coverage_limit(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").select("doc_id").distinct().withColumn("judged", F.lit(True))
    return docs.join(labels, "doc_id", "left").agg(F.count("*").alias("traces"), F.count("judged").alias("evaluated"), F.count_if(F.col("judged").isNull()).alias("not_evaluated"))


def fold_adjacent_lines(spark, d):
    return S.fold_lines(table(spark, d, "documents")).select("doc_id", F.md5("folded").alias("folded_md5"))


def head_tail_cap(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.head_tail(F.col("text"), 500)).alias("capped_md5"))


def _tokens(spark, d) -> DataFrame:
    return event_calls(spark, d).select("trace_id", F.col("call_index").alias("pos"), T.sequence_token(F.lit("tool"), F.col("tool")).alias("token"))


def tfidf_vectors(spark, d):
    return M.tfidf(_tokens(spark, d)).select("trace_id", "term", _r("weight").alias("weight"))


def newest_n_traces(spark, d):
    last = table(spark, d, "events").groupBy(F.col("user_id").alias("trace_id")).agg(F.max("ts").alias("ts"))
    return E.newest(last, 25)


def ordered_merge_union(spark, d):
    rows = event_calls(spark, d).select("trace_id", "call_id", "ts", "event_type")
    parts = [rows.where(F.col("event_type") == k) for k in ("error", "purchase", "view")]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return merged.withColumn("position", F.row_number().over(W.partitionBy("trace_id").orderBy("ts", "call_id")).cast("long")).select("trace_id", "call_id", "position")


def citation_guard(spark, d):
    cited = event_calls(spark, d).select((F.col("trace_id") + F.when(F.col("call_id") % 97 == 0, 1000000).otherwise(0)).alias("trace_id")).distinct()
    return E.uncited(cited, _event_traces(spark, d))


def _halves(spark, d) -> list[DataFrame]:
    rows = event_calls(spark, d).select((F.col("trace_id") % 7).alias("insight_id"), "trace_id", "call_id", (F.col("call_id") % 2).alias("half"))
    out = []
    for half in (0, 1):
        part = rows.where((F.col("half") == half) & (F.col("trace_id") % (5 + half) != 0)).groupBy("insight_id", "trace_id").agg(F.slice(F.sort_array(F.collect_set("call_id")), 1, 3).alias("spans"))
        out.append(part.withColumn("url", F.concat(F.lit(f"https://t{half}.example/"), "trace_id")))
    return out


def insight_evidence_merge(spark, d):
    merged = E.merge_evidence(*_halves(spark, d))
    return merged.select("insight_id", "trace_id", "url", F.array_join("spans", ",").alias("spans"), "added")


def link_resolution(spark, d):
    first, second = _halves(spark, d)
    saved = first.unionByName(second.withColumn("insight_id", F.col("insight_id") + 100))  # two insights may cite one trace
    saved = saved.select("insight_id", "trace_id", "url", F.col("spans").alias("span_ids"))
    present = event_calls(spark, d).where(F.col("trace_id") % 3 != 0)
    traces = present.select("trace_id", F.concat(F.lit("https://now.example/"), "trace_id").alias("source_url")).distinct()
    spans = present.where(F.col("call_id") % 4 != 0).select("trace_id", F.col("call_id").alias("span_id"))
    out = E.resolve_links(saved, traces, spans)
    return out.select("insight_id", "trace_id", "url", F.array_join("span_ids", ",").alias("span_ids"), "present")


def tri_state_scan(spark, d):
    per_trace = event_calls(spark, d).groupBy("trace_id").agg(F.count_if("failed").alias("failures"), F.count("*").alias("n"))
    return E.scan(per_trace, F.col("failures") * 4 > F.col("n"), F.col("n") >= 60)


def tri_state_totals(spark, d):
    return E.scan_totals(tri_state_scan(spark, d))


def logistic_screen(spark, d):
    score = M.logistic_score(F.col("embedding"), WEIGHTS, BIAS)
    label = F.when(score >= COMPLAINT, "complaint").otherwise("no_complaint")
    return table(spark, d, "embeddings").select("vec_id", _r(score).alias("score"), label.alias("label"))


def vector_codes(spark, d):
    return table(spark, d, "embeddings").select("vec_id", M.packed_codes(M.nearest_codes(F.transform("embedding", lambda v: v.cast("double")), CENTERS)).alias("codes"))


def vector_validity(spark, d):
    return table(spark, d, "embeddings").select("vec_id", M.unit_length(F.col("embedding")).alias("valid"))


def mlflow_ns_timestamps(spark, d):
    nanos = F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000
    return table(spark, d, "events").select("event_id", F.unix_micros(T.nanos_to_timestamp(nanos)).alias("micros"))


def isolation_forest_flags(spark, d):
    return M.isolation_forest(_event_features(spark, d), A.FEATURES)


def trajectory_clusters(spark, d):
    return M.clusters(M.term_vectors(M.tfidf(_tokens(spark, d))))


def pca_projection(spark, d):
    return M.projection(_event_features(spark, d), A.FEATURES)


QUERIES = {
    f.__name__: f
    for f in (
        corpus_description, tree_preorder_paths, clock_order, orphan_parent_detach, cycle_detection, carry_prior_user_text, prior_results_concat, last_agent_excerpt,
        sequence_tokens, trace_features, trace_features_empty_traces, robust_zscores, robust_reasons, failure_signatures, recurring_failures,
        cross_tool_failures, verdict_groups, rule_duplicate_call_id, rule_missing_and_duplicate_result, rule_result_id_mismatch, rule_unknown_tool,
        rule_argument_contract, rule_explicit_failure, rule_placeholder, rule_ungrounded_identifier, rule_state_failure, rule_repeated_identical,
        rule_modified_retry, orphan_results, issue_cards, catalog_coverage, field_presence, rule_evaluability, evaluation_index,
        evaluation_coverage_limit, fold_adjacent_lines, head_tail_cap, tfidf_vectors, newest_n_traces, ordered_merge_union, citation_guard,
        insight_evidence_merge, link_resolution, tri_state_scan, tri_state_totals, logistic_screen, vector_codes, vector_validity,
        mlflow_ns_timestamps, isolation_forest_flags, trajectory_clusters, pca_projection,
    )
}
