"""Queries over spans made from the test tables: projections, rules on projected calls, coverage, small operators of readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import urls as U
from tracelake.functions.text import digest, markdown_cell
from tracelake.operators import cards as C
from tracelake.operators import coverage as V
from tracelake.operators import evidence as E
from tracelake.operators import features as A
from tracelake.operators import messages as G
from tracelake.operators import models as M
from tracelake.operators import problems as B
from tracelake.operators import projections as P
from tracelake.operators import tool_rules as R
from tracelake.plans.adapters import audit_calls, event_calls, order_lines, table
from tracelake.plans.catalogue import BIAS, WEIGHTS
from tracelake.sources import common as S

KINDS = {"view": "AGENT", "click": "LLM", "signup": "EVALUATOR"}
CATALOG = '{"op_0":{"type":"object","required":["q"],"properties":{"q":{"type":"integer"}},"additionalProperties":false},"op_1":null,"op_2":{"type":"object"}}'


def _object(**fields: Column) -> Column:
    """A variant object of the fields (JSON texts) that aren't null."""
    return F.parse_json(F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), c) for k, c in fields.items())), F.lit("}")))


def _text(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(f'"{prefix}'), c, F.lit('"'))


def event_spans(spark, d) -> DataFrame:
    """Events as spans of a trace per user, with gaps of every sort: fields that are missing, null, empty or of another type."""
    k = F.regexp_extract("props", r"\d+", 0).cast("int")
    every = lambda n, r, x: F.when(k % n == r, x)
    kind = F.lit("TOOL")
    for name, other in KINDS.items():
        kind = F.when(F.col("event_type") == name, F.lit(other)).otherwise(kind)
    is_tool, failed = F.col("event_type").isin("error", "purchase"), F.col("event_type") == "error"
    attributes = _object(
        name=_text("n_", k % 3), explicit_error=F.when(k % 11 == 0, "false").when(k % 13 == 0, "true").when(k % 13 == 1, '"true"'), outcome_marker=every(17, 0, F.lit('"odd"')),
        summary=every(4, 0, _text("sum ", k)), subtype=every(6, 0, F.lit('"planning"')), duration_ms=every(9, 4, k.cast("string")), source_pointer=every(12, 5, F.lit('{"p":1}')),
    )
    call = _object(
        call_id=F.when(k % 3 == 0, _text("c", F.col("event_id"))).when(k % 3 == 1, '""'), index=every(19, 0, F.lit("7")), result_count=F.when(k % 10 == 1, "0").when(k % 10 == 2, "2"),
        result_id=every(9, 0, _text("r", k)), instrumentation_alias_of=every(23, 0, F.lit('"real"')), prior_user_text=every(29, 0, F.lit('"direct"')), returned_data=every(31, 0, F.lit("false")),
    )
    given = (
        F.when(k % 5 == 0, _text("hello ", k)).when(k % 5 == 1, F.concat(F.lit('{"messages":[{"role":"user","content":"u'), k, F.lit('"},{"role":"assistant","content":"x"}]}')))
        .when(k % 5 == 2, F.concat(F.lit('{"q":'), k, F.lit("}"))).when(k % 5 == 4, '""')
    )
    text = F.concat(F.lit('"Error: request '), F.col("event_id"), F.lit('"'))
    got = (
        F.when(failed, text).when(k % 8 == 0, F.concat(F.lit('{"content":"c'), k, F.lit('"}'))).when(k % 8 == 1, F.concat(F.lit('{"messages":[{"content":"m'), k, F.lit('"},{"content":3}]}')))
        .when(k % 8 == 2, "null").when(k % 8 != 3, F.concat(F.lit('{"v":'), k, F.lit("}")))
    )
    rows = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("trace_id"), F.concat(F.lit("s"), "event_id").alias("span_id"), F.lit(None).cast("string").alias("parent_id"), kind.alias("kind"),
        F.when(k % 7 != 0, F.concat(F.lit("op_"), k % 5)).alias("tool"), F.col("ts").alias("start"), F.when(k % 2 == 0, F.col("ts")).alias("end"), F.parse_json(given).alias("input"),
        F.parse_json(got).alias("output"), F.when(failed & (k % 2 == 0), "boom").alias("error"), attributes.alias("attributes"), F.when(is_tool, call).alias("tool_call"),
    )
    return S.completed(rows, S.SPANS)


def event_traces(spark, d) -> DataFrame:
    user = F.col("user_id")
    attributes = _object(
        tool_catalog=F.when(user % 3 != 0, F.lit(CATALOG)), task_text=F.when(user % 4 == 0, F.lit('"start"')), metrics=F.when(user % 5 == 0, F.concat(F.lit('{"m":'), user, F.lit("}"))),
        complete_provenance_context=F.when(user % 6 == 0, "true"), orphan_results=F.when(user % 7 == 0, F.concat(F.lit('[{"result_id":"o'), user, F.lit('"}]'))), logical_case_id=F.when(user % 2 == 0, _text("k", user % 9)),
    )
    rows = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    rows = rows.select(user.cast("string").alias("trace_id"), F.when(user % 2 == 0, F.concat(F.lit("k"), user % 9)).alias("case_id"), F.when(user % 8 == 0, F.col("n") / 4).alias("cost_usd"), attributes.alias("attributes"))
    return S.completed(rows, S.TRACES)


def _calls(spark, d) -> DataFrame:
    return P.audit_calls(event_traces(spark, d), P.visits(event_spans(spark, d)))


def projected_tool_calls(spark, d):
    rows = _calls(spark, d)
    return rows.select("trace_id", "case_id", "call_id", "call_index", "tool", F.col("output").isNull().alias("missing"), "result_count", "result_id", "alias_of", "explicit_error", "outcome_marker", "prior_user_text", "has_catalog", "in_catalog")


def projected_steps(spark, d):
    return P.steps(P.visits(event_spans(spark, d))).select("trace_id", "step_index", "step_type", "name", "content")


def projected_feature_calls(spark, d):
    rows = P.feature_calls(P.visits(event_spans(spark, d)))
    return rows.select("trace_id", "call_id", "call_index", "tool", F.round("duration_ms", 3).alias("duration_ms"), "unread_flag", F.coalesce(F.to_json("output"), F.lit("missing")).alias("output"))


def source_pointers(spark, d):
    return P.visits(event_spans(spark, d)).select("trace_id", "span_id", F.to_json("source_pointer").alias("pointer"))


def projected_orphan_results(spark, d):
    return R.orphans(P.orphan_results(event_traces(spark, d))).select("trace_id", "call_id", "call_index", "tool", "issue_type")


#: Schema of the calls about identifiers.
RULES = '{"properties":{"mode":{"enum":["a"]},"n":{"type":"integer"},"m":{"maximum":9}}}'


def _findings(spark, d) -> DataFrame:
    """Findings of projected calls; every tenth event's call is about an identifier, a placeholder and a schema, and every thirtieth's id recurs."""
    event = F.substring("span_id", 2, 20).cast("long")
    rich, c = event % 10 == 0, F.col
    ident = F.concat(F.lit("ref"), event, F.lit("z"))
    given = F.to_variant_object(F.struct(ident.alias("user_id"), F.lit("<user id>").alias("target"), F.lit("z").alias("mode"), F.lit("x").alias("n"), F.lit(500).alias("m")))
    said = F.concat(F.lit("invalid reference "), ident, F.lit(", no active editing session")).cast("variant")
    changed = {
        "call_id": F.when(event % 30 == 0, F.lit("again")).otherwise(c("call_id")), "call_index": 1000 + event, "has_catalog": F.lit(True), "in_catalog": F.lit(True), "schema": F.lit(RULES), "arguments": given,
        "output": F.when(c("result_count") != 0, said), "explicit_error": F.lit(None).cast("boolean"), "prior_user_text": F.when(event % 20 == 0, F.concat_ws(" ", "prior_user_text", ident)).otherwise(c("prior_user_text")),
    }
    calls = _calls(spark, d).withColumns({name: F.when(rich, value).otherwise(c(name)) for name, value in changed.items()})
    return R.findings(calls, P.orphan_results(event_traces(spark, d)))


def findings_of_spans(spark, d):
    return _findings(spark, d).select("trace_id", "call_id", "call_index", "tool", "issue_type", "mechanism_key", "issue_family", "attribution")


def finding_evidence(spark, d):
    return _findings(spark, d).select("trace_id", "call_id", "call_index", "issue_type", "mechanism_key", "summary", F.to_json("evidence").alias("evidence"), "source_pointer")


def card_examples(spark, d):
    shown = C.cards(_findings(spark, d)).select("issue_type", "mechanism_key", F.explode("examples").alias("e")).select("issue_type", "mechanism_key", "e.case_id", "e.first.*")
    return shown.select("issue_type", "mechanism_key", "case_id", "trace_id", "call_index", "tool", "summary", "source_pointer")


def unevaluable_schemas(spark, d):
    calls = _calls(spark, d).withColumn("schema", F.lit('{"$ref":"nowhere"}'))
    return R.unevaluable(R.audited(calls))


def finding_ids(spark, d):
    rows = R.findings(audit_calls(order_lines(spark, d)).withColumn("alias_of", F.when(F.col("call_id") % 3 == 0, "real")))
    return rows.where(F.col("issue_type").isin("mapped_instrumentation_alias", "missing_tool_result")).select("trace_id", "call_id", "issue_type", "issue_id")


def presence_counts(spark, d):
    return V.presence(event_traces(spark, d), event_spans(spark, d))


def rule_reasons(spark, d):
    found = V.presence(event_traces(spark, d).where("cost_usd IS NOT NULL"), event_spans(spark, d).where("kind <> 'TOOL'"))
    return V.rules(found)


def coverage_notes(spark, d):
    row = V.presence(event_traces(spark, d), event_spans(spark, d)).first()
    return spark.createDataFrame([(n,) for n in V.notes(row) + V.limitations(row)] or [("",)], "note string")


def trajectory_tokens(spark, d):
    traces, spans = event_traces(spark, d), event_spans(spark, d).where(F.col("trace_id").cast("int") % 4 != 0)
    steps, calls = P.steps(P.visits(spans)), _calls(spark, d).where(F.col("trace_id").cast("int") % 8 == 0)
    return P.trajectory_tokens(traces, steps, calls)


def caller_metrics(spark, d):
    return P.caller_metrics(event_traces(spark, d))


def kind_mapping(spark, d):
    kind, subtype = S.kind_of(F.col("event_type"), {"CLICK": "LLM", "PURCHASE": "TOOL"})
    return table(spark, d, "events").select("event_id", kind.alias("kind"), subtype.alias("subtype"))


def token_counts(spark, d):
    prompt, cached = F.col("l_quantity").cast("long"), F.when(F.col("l_linenumber") != 3, F.col("l_linenumber").cast("long") * 5)
    t = S.prompt_tokens(prompt, cached, F.col("l_suppkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", t["input_tokens"].alias("fresh"), t["cached_input_tokens"].alias("cached"), t["output_tokens"].alias("output"))


def time_window(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts")
    return rows.where(S.within(F.col("ts"), "2024-01-02T00:00:00Z", "2024-01-04T12:00:00+00:00")).select("event_id")


def valid_urls(spark, d):
    k = F.col("page_id") % 7
    odd = (
        F.when(k == 1, F.concat(F.lit("ftp://h/"), "page_id")).when(k == 2, F.concat(F.lit("https://u:p@h/"), "page_id")).when(k == 3, F.concat(F.lit("http://h/a b"), "page_id"))
        .when(k == 4, F.concat(F.lit("file:///x/"), "page_id")).when(k == 5, F.lit("https:///x")).otherwise(F.col("url"))
    )
    return table(spark, d, "pages").select("page_id", U.valid_url(odd).alias("url"))


def provider_pages(spark, d):
    i = F.col("p_partkey").cast("string")
    return table(spark, d, "part").select("p_partkey", U.mlflow_page("https://m/", F.col("p_type"), i).alias("tracking"), U.langfuse_page("https://l/", F.concat(F.lit("/project/"), i)).alias("observed"), U.page("https://x", F.col("p_brand"), i).alias("plain"))


def insight_status(spark, d):
    new = event_calls(spark, d).select((F.col("trace_id") % 9).cast("string").alias("name"), F.col("tool").alias("description")).distinct()
    return E.insight_status(new, new.where(F.col("name") < "5"))


def key_set_differences(spark, d):
    rows = event_calls(spark, d).select("trace_id").distinct()
    return E.key_differences(rows.where(F.col("trace_id") % 3 != 0), rows.where(F.col("trace_id") % 5 != 0))


def problem_traces(spark, d):
    calls = event_calls(spark, d)
    problems = calls.groupBy("tool").agg(F.slice(F.sort_array(F.collect_set("trace_id")), 1, 20).alias("supporting_trace_ids")).withColumnRenamed("tool", "description")
    return E.problem_traces(problems, calls.where(F.col("trace_id") % 4 != 0).groupBy("trace_id").agg(F.count("*").alias("calls")))


def evaluator_values(spark, d):
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_linenumber") == 1, "NUMERIC").when(F.col("l_linenumber") == 2, "BOOLEAN").when(F.col("l_linenumber") == 3, "TEXT").otherwise("CATEGORICAL").alias("data_type"),
        F.when(F.col("l_returnflag") != "A", F.col("l_tax") * 100).alias("value"), F.when(F.col("l_linestatus") == "O", F.col("l_returnflag")).alias("string_value"),
    )
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", E.evaluator_problem(F.col("data_type"), F.col("value"), F.col("string_value")).alias("problem"))


def provider_costs(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trace_id"), S.chosen_cost(F.when(F.col("l_linenumber") % 3 == 0, F.col("l_quantity") - 25), F.col("l_suppkey").cast("double")).alias("cost"))
    return rows.groupBy("trace_id").agg(F.round(F.sum("cost"), 6).alias("cost_usd"))


def provider_latency(spark, d):
    rows = table(spark, d, "events")
    return rows.groupBy(F.col("user_id").alias("trace_id")).agg(S.span_latency(F.col("ts").cast("timestamp"), F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 SECOND")).alias("latency_ms"))


def screening(spark, d):
    score = M.logistic_score(F.col("embedding"), WEIGHTS, BIAS)
    scores = table(spark, d, "embeddings").select((F.col("vec_id") % 150).alias("trace_id"), score.alias("score"))
    traces = table(spark, d, "embeddings").select((F.col("vec_id") % 200).alias("trace_id")).distinct()
    return G.screened(traces, scores, 0.5).select("trace_id", "label", "messages", "complaints", F.round("highest", 6).alias("highest"))


def screening_coverage(spark, d):
    return G.screening_coverage(screening(spark, d))


def _flags(spark, d) -> tuple[DataFrame, DataFrame]:
    per_trace = event_calls(spark, d).groupBy("trace_id").agg(F.count_if("failed").cast("double").alias("score"))
    reasons = per_trace.select("trace_id", F.array(F.concat(F.lit("high "), F.col("trace_id") % 7), F.concat(F.lit("low "), F.col("trace_id") % 3)).alias("reasons"))
    return per_trace.withColumn("flagged", F.col("score") % 3 == 0), reasons


def outlier_reasons(spark, d):
    return B.outlier_summary(*_flags(spark, d))


def outlier_candidates(spark, d):
    return B.outlier_candidates(_flags(spark, d)[0])


def recurring_failure_traces(spark, d):
    events = A.failure_events(A.decoded_calls(event_calls(spark, d)))
    return A.recurring_traces(events, A.recurring(events)).select("signature", "trace_id")


def markdown_cells(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(markdown_cell(F.concat("text", F.lit("|x\ny")))).alias("cell_md5"))


def text_digests(spark, d):
    return table(spark, d, "documents").select("doc_id", digest(F.col("text"), 24).alias("id"), digest(F.col("text"), 12).alias("short"))


def cluster_abstention(spark, d):
    """Whether the traces of each case could be clustered: by their number, terms, and a stand-in for their distinct trajectories."""
    case = F.col("case_id")
    shapes = F.count_distinct(F.concat(F.col("failed").cast("string"), case % 5)) * (case % 3)
    counts = event_calls(spark, d).groupBy("case_id").agg(
        F.count_distinct("trace_id").alias("traces"), F.count_distinct(F.when(case % 7 != 0, F.col("tool"))).alias("terms"), shapes.alias("shapes")
    )
    reason, candidates = M.abstention(F.col("traces"), F.col("terms"), F.col("shapes"))
    return counts.select("case_id", "traces", "terms", "shapes", reason.alias("reason"), candidates.alias("candidates"))


QUERIES = {
    f.__name__: f
    for f in (
        projected_tool_calls, projected_steps, projected_feature_calls, source_pointers, projected_orphan_results, findings_of_spans, finding_evidence, card_examples, unevaluable_schemas, finding_ids, presence_counts, rule_reasons, coverage_notes,
        trajectory_tokens, caller_metrics, kind_mapping, token_counts, time_window, valid_urls, provider_pages, insight_status, key_set_differences, problem_traces, evaluator_values,
        provider_costs, provider_latency, screening, screening_coverage, outlier_reasons, outlier_candidates, recurring_failure_traces, markdown_cells, text_digests, cluster_abstention,
    )
}
