"""SQL for DuckDB that gives the same rows as the queries over spans."""

from __future__ import annotations

from tracelake.plans.catalogue import BIAS
from tracelake.plans.expected import ATTRIBUTION, FAMILY, NEEDS, REASONS, SUMMARIES
from tracelake.plans.oracles import EV, FAILS, LI

#: Spans as the adapter makes them, by columns instead of variants; json texts where the query shows them.
SP = """e0 AS (SELECT *, regexp_extract(props, '[0-9]+')::INT AS k, event_type = 'error' AS failed FROM events),
sp AS (
  SELECT user_id::VARCHAR AS trace_id, user_id, 's' || event_id AS span_id, event_id, k, ts, failed,
    CASE event_type WHEN 'view' THEN 'AGENT' WHEN 'click' THEN 'LLM' WHEN 'signup' THEN 'EVALUATOR' ELSE 'TOOL' END AS kind,
    CASE WHEN k % 7 <> 0 THEN 'op_' || (k % 5) END AS tool0, CASE WHEN failed AND k % 2 = 0 THEN 'boom' END AS error,
    CASE WHEN k % 5 = 0 THEN 'hello ' || k WHEN k % 5 = 1 THEN 'u' || k ELSE '' END AS said,
    CASE WHEN failed THEN '"Error: request ' || event_id || '"' WHEN k % 8 = 0 THEN '{"content":"c' || k || '"}' WHEN k % 8 = 1 THEN '{"messages":[{"content":"m' || k || '"},{"content":3}]}'
         WHEN k % 8 = 2 THEN 'null' WHEN k % 8 <> 3 THEN '{"v":' || k || '}' END AS out_json,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, 's' || event_id) - 1 AS dfs FROM e0),
ua AS (SELECT *, last_value(nullif(said, '') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY dfs ROWS UNBOUNDED PRECEDING) AS carried,
    row_number() OVER (PARTITION BY user_id, kind = 'TOOL' ORDER BY dfs) - 1 AS nr FROM sp),
ca AS (
  SELECT trace_id, user_id, span_id, event_id, k, ts, error, out_json, dfs,
    CASE WHEN user_id % 2 = 0 THEN 'k' || (user_id % 9) ELSE user_id::VARCHAR END AS case_id,
    CASE WHEN k % 3 = 0 THEN 'c' || event_id ELSE span_id END AS call_id, CASE WHEN k % 19 = 0 THEN 7 ELSE nr END::BIGINT AS call_index,
    coalesce(tool0, 'n_' || (k % 3)) AS tool, CASE WHEN k % 10 = 1 THEN 0 WHEN k % 10 = 2 THEN 2 ELSE 1 END::INT AS result_count,
    CASE WHEN k % 10 <> 1 THEN out_json END IS NULL AS missing, CASE WHEN k % 9 = 0 THEN 'r' || k END AS result_id, CASE WHEN k % 23 = 0 THEN 'real' END AS alias_of,
    CASE WHEN k % 11 = 0 THEN false WHEN k % 13 = 0 THEN true WHEN error IS NOT NULL THEN true END AS explicit_error,
    CASE WHEN k % 17 = 0 THEN 'odd' ELSE error END AS outcome_marker,
    CASE WHEN k % 29 = 0 THEN 'direct' ELSE coalesce(carried, CASE WHEN user_id % 4 = 0 THEN 'start' ELSE '' END) END AS prior_user_text,
    user_id % 3 <> 0 AS has_catalog FROM ua WHERE kind = 'TOOL'),
cc AS (SELECT *, has_catalog AND tool IN ('op_0', 'op_1', 'op_2') AS in_catalog FROM ca)"""

_CONTENT = """CASE WHEN k % 4 = 0 THEN 'sum ' || k WHEN failed THEN 'Error: request ' || event_id WHEN k % 8 = 0 THEN 'c' || k WHEN k % 8 = 1 THEN 'm' || k
  WHEN k % 8 IN (2, 3) THEN '' ELSE '{"v":' || k || '}' END"""
#: Calls of spans, of which every tenth event's is about an identifier, a placeholder and a schema.
RICH = SP + """, r0 AS (SELECT *, event_id % 10 = 0 AS rich, user_id % 6 = 0 AS provenance, coalesce(out_json LIKE '"Error%', false) AS failed FROM cc),
rc AS (SELECT * REPLACE (
    CASE WHEN rich AND event_id % 30 = 0 THEN 'again' ELSE call_id END AS call_id, CASE WHEN rich THEN 1000 + event_id ELSE call_index END AS call_index, has_catalog OR rich AS has_catalog,
    in_catalog OR rich AS in_catalog, CASE WHEN rich THEN result_count = 0 ELSE missing END AS missing, CASE WHEN NOT rich THEN explicit_error END AS explicit_error),
  CASE WHEN k % 12 = 5 THEN '{"p":1}' ELSE '{"span_id":"' || span_id || '","span_path":[' || dfs || '],"trace_id":"' || trace_id || '"}' END AS pointer,
  CASE WHEN rich THEN 'r' || event_id WHEN k % 5 = 1 THEN 'm' || k WHEN k % 5 = 2 THEN 'q' || k ELSE '' END AS arguments,
  CASE WHEN result_count = 0 THEN '' WHEN rich THEN 'invalid reference ref' || event_id || 'z, no active editing session' WHEN failed THEN 'Error: request ' || event_id WHEN k % 8 = 0 THEN 'c' || k
       WHEN k % 8 = 1 THEN '{"messages":[{"content":"m' || k || '"},{"content":3}]}' WHEN k % 8 = 2 THEN 'null' WHEN k % 8 <> 3 THEN '{"v":' || k || '}' ELSE '' END AS text FROM r0),
rm AS (SELECT *, CASE WHEN rich THEN NULL WHEN explicit_error THEN coalesce(nullif(outcome_marker, ''), 'explicit_error_field') WHEN NOT explicit_error OR missing THEN NULL WHEN failed THEN 'error_prefix' END AS marker,
    rich OR (has_catalog AND NOT in_catalog) OR k % 5 IN (0, 4) OR (has_catalog AND tool = 'op_0' AND k % 5 = 1) AS contract FROM rc),
bd AS (SELECT *, coalesce(marker, sha256(CASE WHEN missing THEN 'missing_result' ELSE text END)[:12]) AS failure, (call_index, call_id, pointer) AS place FROM rm
  WHERE marker IS NOT NULL OR contract OR missing OR result_count > 1)"""


def _leaf(name: str, value: str) -> str:
    return f"""'{{"leaves":[{{"path":"$.{name}","value":"' || {value} || '"}}],"result_excerpt":"' || text || '"}}'"""


#: Condition, and evidence as JSON where there is any; mechanism where it isn't the type.
_ISSUES = {
    "unknown_tool": ("NOT rich AND has_catalog AND NOT in_catalog", "", ""),
    "malformed_tool_call": ("NOT rich AND NOT (has_catalog AND NOT in_catalog) AND k % 5 IN (0, 4)", "", ""),
    "missing_required_argument": ("NOT rich AND has_catalog AND tool = 'op_0' AND k % 5 = 1", """'{"path":"$","keyword":"required"}'""", ""),
    "unknown_argument": ("NOT rich AND has_catalog AND tool = 'op_0' AND k % 5 = 1", """'{"path":"$","keyword":"additionalProperties"}'""", ""),
    "argument_enum_violation": ("rich", """'{"path":"$.mode","keyword":"enum"}'""", ""), "argument_type_mismatch": ("rich", """'{"path":"$.n","keyword":"type"}'""", ""),
    "json_schema_violation": ("rich", """'{"path":"$.m","keyword":"maximum"}'""", ""),
    "duplicate_call_id": ("row_number() OVER (PARTITION BY trace_id, call_id ORDER BY call_index) > 1", "", ""),
    "missing_tool_result": ("missing", "", ""), "duplicate_tool_result": ("result_count > 1", """'{"result_count":' || result_count || '}'""", ""),
    "call_result_id_mismatch": ("result_id <> call_id", """'{"result_id":"' || result_id || '"}'""", ""), "mapped_instrumentation_alias": ("alias_of IS NOT NULL", """'{"alias_of":"real"}'""", ""),
    "explicit_tool_failure": ("marker IS NOT NULL AND NOT contract", """'{"failure_marker":"' || marker || '"}'""", "marker"),
    "unresolved_placeholder_argument": ("rich AND NOT missing", _leaf("target", "'<user id>'"), ""),
    "explicitly_rejected_ungrounded_identifier": ("rich AND NOT missing AND provenance AND event_id % 20 <> 0", _leaf("user_id", "'ref' || event_id || 'z'"), ""),
    "explicit_prerequisite_or_state_failure": ("rich AND NOT missing", """'{"state_class":"no_active_session","result_excerpt":"' || text || '"}'""", "'no_active_session'"),
}


def _cases(column: str, values: dict[str, str]) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return f"CASE {column} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in values.items()) + " END"


_CALLS = "'[' || array_to_string(list_sort(list(call_index)), ',') || ']'"
_FINDINGS = RICH + ", f AS (" + " UNION ALL ".join(
    [f"SELECT trace_id, call_id, call_index, tool, '{i}' AS issue_type, {m or repr(i)} AS mechanism_key, {e or repr('{}')} AS evidence, pointer FROM (SELECT *, {c} AS it FROM rm) WHERE it" for i, (c, e, m) in _ISSUES.items()]
    + [
        f"""SELECT trace_id, min(place)[2], min(place)[1], tool, 'repeated_identical_failed_call', 'repeated_identical_failed_call', '{{"call_indices":' || {_CALLS} || '}}', min(place)[3] FROM bd GROUP BY trace_id, tool, arguments HAVING count(*) >= 3""",
        f"""SELECT trace_id, min(place)[2], min(place)[1], tool, 'modified_retry_same_failure', failure, '{{"call_indices":' || {_CALLS} || ',"distinct_arguments":' || count(DISTINCT arguments) || '}}', min(place)[3]
          FROM bd GROUP BY trace_id, tool, failure HAVING count(*) >= 3 AND count(DISTINCT arguments) > 1""",
        """SELECT DISTINCT user_id::VARCHAR, 'o' || user_id, -1::BIGINT, '<unknown>', 'orphan_tool_result', 'orphan_tool_result', '{}', '{"result_id":"o' || user_id || '"}' FROM events WHERE user_id % 7 = 0""",
    ]
) + ")"
_RULES = ", ".join(f"('{t}', '{'complete_provenance_context' if 'provenance' in n else n}')" for t, n in sorted(NEEDS.items()))
_ABLE = "CASE requires WHEN 'always' THEN true WHEN 'tool_catalog' THEN (SELECT count(*) FROM t WHERE u % 3 <> 0) > 0 WHEN 'orphan_results' THEN (SELECT count(*) FROM t WHERE u % 7 = 0) > 0 WHEN 'complete_provenance_context' THEN (SELECT count(*) FROM t WHERE u % 6 = 0) > 0 ELSE false END"
_REASON = _cases("requires", REASONS)

ORACLES = {
    "projected_tool_calls": f"WITH {SP} SELECT trace_id, case_id, call_id, call_index, tool, missing, result_count, result_id, alias_of, explicit_error, outcome_marker, prior_user_text, has_catalog, in_catalog FROM cc",
    "projected_steps": f"""WITH {SP} SELECT trace_id, dfs AS step_index, CASE WHEN k % 6 = 0 THEN 'planning' WHEN kind = 'EVALUATOR' THEN 'evaluation' ELSE lower(kind) END AS step_type, 'n_' || (k % 3) AS name, {_CONTENT} AS content FROM sp""",
    "projected_feature_calls": f"""WITH {SP} SELECT trace_id, call_id, call_index, tool, CASE WHEN k % 9 = 4 THEN k::DOUBLE WHEN k % 2 = 0 THEN 0::DOUBLE END AS duration_ms,
      k % 31 = 0 AND NOT coalesce(out_json LIKE '{{%', false) AS unread_flag,
      coalesce(CASE WHEN k % 31 = 0 AND out_json LIKE '{{"v"%' THEN '{{"returned_data":false,' || out_json[2:] WHEN k % 31 = 0 AND out_json LIKE '{{%' THEN replace(out_json, '}}', '') || ',"returned_data":false}}' ELSE out_json END, 'missing') AS output FROM cc""",
    "source_pointers": f"""WITH {SP} SELECT trace_id, span_id, CASE WHEN k % 12 = 5 THEN '{{"p":1}}' ELSE '{{"span_id":"' || span_id || '","span_path":[' || dfs || '],"trace_id":"' || trace_id || '"}}' END AS pointer FROM sp""",
    "projected_orphan_results": "SELECT DISTINCT user_id::VARCHAR AS trace_id, 'o' || user_id AS call_id, -1::BIGINT AS call_index, '<unknown>' AS tool, 'orphan_tool_result' AS issue_type FROM events WHERE user_id % 7 = 0",
    "findings_of_spans": f"WITH {_FINDINGS} SELECT trace_id, call_id, call_index, tool, issue_type, mechanism_key, {_cases('issue_type', FAMILY)} AS issue_family, {_cases('issue_type', ATTRIBUTION)} AS attribution FROM f",
    "finding_evidence": f"WITH {_FINDINGS} SELECT trace_id, call_id, call_index, issue_type, mechanism_key, {_cases('issue_type', SUMMARIES)} AS summary, evidence, pointer AS source_pointer FROM f",
    "card_examples": f"""WITH {_FINDINGS}, p AS (SELECT issue_type, mechanism_key, CASE WHEN trace_id::INT % 2 = 0 THEN 'k' || (trace_id::INT % 9) ELSE trace_id END AS case_id, min((trace_id, call_index, call_id, tool, pointer)) AS e FROM f GROUP BY ALL),
      n AS (SELECT *, row_number() OVER (PARTITION BY issue_type, mechanism_key ORDER BY e) AS nr FROM p)
      SELECT issue_type, mechanism_key, case_id, e[1] AS trace_id, e[2] AS call_index, e[4] AS tool, {_cases('issue_type', SUMMARIES)} AS summary, e[5] AS source_pointer FROM n WHERE nr <= 3""",
    "unevaluable_schemas": f"WITH {SP} SELECT tool, count(*) AS calls, 'nowhere' AS reason FROM cc WHERE in_catalog AND k % 5 IN (1, 2) GROUP BY 1",
    "finding_ids": f"""WITH {LI}, f AS (SELECT *, 'missing_tool_result' AS issue_type, '{{}}' AS evidence FROM li WHERE result_count = 0 UNION ALL SELECT *, 'mapped_instrumentation_alias', '{{"alias_of":"real"}}' FROM li WHERE call_id % 3 = 0)
      SELECT trace_id, call_id, issue_type, sha256('{{"trace_id":' || trace_id || ',"case_id":' || trace_id || ',"call_id":' || call_id || ',"call_index":' || call_index || ',"tool":"' || tool || '","issue_type":"' || issue_type || '","mechanism_key":"' || issue_type
        || '","summary":"' || {_cases('issue_type', {k: v for k, v in SUMMARIES.items() if k in ("missing_tool_result", "mapped_instrumentation_alias")})} || '","evidence":' || evidence || '}}')[:24] AS issue_id FROM f""",
    "presence_counts": f"""WITH {SP}, t AS (SELECT user_id AS u, count(*) AS n FROM events GROUP BY 1), c AS (SELECT *, k % 10 <> 1 AND out_json IS NOT NULL AS there FROM ca)
      SELECT count(*) FILTER (WHERE u % 3 <> 0) AS tool_catalog, count(*) FILTER (WHERE u % 2 = 0) AS logical_case_id, 0::BIGINT AS source_pointer, 0::BIGINT AS observed_verdict, count(*) FILTER (WHERE u % 5 = 0) AS metrics,
      count(*) FILTER (WHERE u % 4 = 0) AS task_text, count(*) FILTER (WHERE u % 7 = 0) AS orphan_results, count(*) FILTER (WHERE u % 8 = 0) AS cost, count(*) FILTER (WHERE u % 6 = 0) AS complete_provenance_context, count(*) AS total_traces,
      count(DISTINCT CASE WHEN u % 2 = 0 THEN 'k' || (u % 9) ELSE u::VARCHAR END) AS distinct_cases, (SELECT count(*) FROM c WHERE there) AS result_present, (SELECT count(*) FROM c WHERE NOT there) AS result_absent,
      (SELECT count(*) FROM c WHERE there AND out_json = 'null') AS result_empty, (SELECT count(*) FROM c WHERE k % 5 IN (3, 4)) AS arguments_empty, (SELECT count(*) FROM c WHERE k % 9 = 0) AS result_id, (SELECT count(*) FROM c WHERE k % 10 = 2) AS result_count_gt_1,
      (SELECT count(*) FROM c WHERE k % 9 = 4 OR k % 2 = 0) AS duration_ms, (SELECT count(*) FROM c WHERE (k % 11 <> 0 AND k % 13 = 0) OR error IS NOT NULL) AS explicit_error_true, (SELECT count(*) FROM c WHERE k % 11 = 0) AS explicit_error_false,
      (SELECT count(*) FROM c WHERE k % 23 = 0) AS instrumentation_alias_of, (SELECT count(*) FROM c WHERE k % 29 = 0) AS prior_user_text, (SELECT count(*) FROM c WHERE k % 31 = 0) AS returned_data, (SELECT count(*) FROM c WHERE k % 12 = 5) AS call_source_pointer,
      (SELECT count(*) FROM c) AS total_calls, (SELECT count(*) FROM sp) AS total_steps, (SELECT count(DISTINCT trace_id) FROM sp) AS steps FROM t""",
    "rule_reasons": f"""WITH t AS (SELECT DISTINCT user_id AS u FROM events WHERE user_id % 8 = 0), r(issue_type, requires) AS (VALUES {_RULES}), s AS (SELECT *, {_ABLE} AS evaluable FROM r)
      SELECT issue_type, requires, evaluable, false AS fired, CASE WHEN evaluable THEN '' ELSE {_REASON} END AS reason FROM s""",
    "trajectory_tokens": f"""WITH {SP} SELECT trace_id, (row_number() OVER (PARTITION BY user_id ORDER BY dfs) - 1)::BIGINT AS pos, CASE WHEN k % 6 <> 0 AND kind = 'EVALUATOR' THEN 'evaluation:boundary'
      ELSE CASE WHEN k % 6 = 0 THEN 'planning' ELSE lower(kind) END || ':n_' || (k % 3) END AS token FROM sp WHERE user_id % 4 <> 0
      UNION ALL SELECT trace_id, call_index, 'tool:' || tool FROM cc WHERE user_id % 8 = 0
      UNION ALL SELECT DISTINCT user_id::VARCHAR, 0::BIGINT, 'trajectory:empty' FROM events WHERE user_id % 4 = 0 AND (user_id % 8 <> 0 OR user_id NOT IN (SELECT user_id FROM ca))""",
    "caller_metrics": "SELECT DISTINCT user_id::VARCHAR AS trace_id, 'm' AS metric, user_id::DOUBLE AS value FROM events WHERE user_id % 5 = 0",
    "kind_mapping": """SELECT event_id, CASE event_type WHEN 'click' THEN 'LLM' WHEN 'purchase' THEN 'TOOL' ELSE 'UNKNOWN' END AS kind, upper(event_type) AS subtype FROM events""",
    "token_counts": """WITH l AS (SELECT *, l_quantity::BIGINT AS p, CASE WHEN l_linenumber <> 3 THEN l_linenumber::BIGINT * 5 END AS c FROM lineitem)
      SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN c <= p THEN p - c END AS fresh, CASE WHEN c <= p THEN c END AS cached, CASE WHEN c <= p THEN l_suppkey END AS output FROM l""",
    "time_window": "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-02 00:00:00' AND ts < TIMESTAMP '2024-01-04 12:00:00'",
    "valid_urls": "SELECT page_id, CASE page_id % 7 WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN 'file:///x/' || page_id WHEN 5 THEN NULL ELSE url END AS url FROM pages",
    "provider_pages": """SELECT p_partkey, 'https://m/#/experiments/' || replace(p_type, ' ', '+') || '/traces?selectedEvaluationId=' || p_partkey AS tracking, 'https://l/project/' || p_partkey AS observed,
      'https://x/' || replace(replace(p_brand, '#', '%23'), ' ', '%20') || '/' || p_partkey AS plain FROM part""",
    "insight_status": f"WITH {EV} SELECT DISTINCT (trace_id % 9)::VARCHAR AS name, tool AS description, CASE WHEN trace_id % 9 < 5 THEN 'retained' ELSE 'new' END AS status FROM ev",
    "key_set_differences": f"WITH {EV} SELECT DISTINCT trace_id, CASE WHEN trace_id % 3 <> 0 THEN 'left' ELSE 'right' END AS side FROM ev WHERE (trace_id % 3 <> 0) <> (trace_id % 5 <> 0)",
    "problem_traces": f"""WITH {EV}, p AS (SELECT tool AS description, unnest(list_slice(list_sort(list(DISTINCT trace_id)), 1, 20)) AS trace_id FROM ev GROUP BY 1), t AS (SELECT trace_id, count(*) AS calls FROM ev WHERE trace_id % 4 <> 0 GROUP BY 1)
      SELECT description, trace_id, calls FROM p JOIN t USING (trace_id)""",
    "evaluator_values": """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber <= 2 AND l_returnflag = 'A' THEN 'no value' WHEN l_linenumber = 2 AND l_tax * 100 NOT IN (0, 1) THEN 'a boolean is 0 or 1'
      WHEN l_linenumber > 2 AND l_linestatus <> 'O' THEN 'no string value' END AS problem FROM lineitem""",
    "provider_costs": """SELECT l_orderkey AS trace_id, round(sum(CASE WHEN l_linenumber % 3 = 0 AND l_quantity >= 25 THEN l_quantity - 25 ELSE l_suppkey END), 6) AS cost_usd FROM lineitem GROUP BY 1""",
    "provider_latency": "SELECT user_id AS trace_id, (epoch_us(max(ts)) - epoch_us(min(ts)) + 1000000) / 1000.0 AS latency_ms FROM events GROUP BY 1",
    "recurring_failure_traces": f"WITH {FAILS} SELECT DISTINCT signature, trace_id FROM fl WHERE signature IN (SELECT signature FROM fl GROUP BY 1 HAVING count(DISTINCT trace_id) >= 3)",
    "markdown_cells": r"SELECT doc_id, md5(replace(replace(text || '|x' || chr(10) || 'y', '|', '\|'), chr(10), ' ')) AS cell_md5 FROM documents",
    "text_digests": "SELECT doc_id, sha256(text)[:24] AS id, sha256(text)[:12] AS short FROM documents",
    "outlier_candidates": f"WITH {EV}, s AS (SELECT trace_id, count(*) FILTER (WHERE failed)::DOUBLE AS score FROM ev GROUP BY 1) SELECT * FROM s WHERE score % 3 = 0",
    "outlier_reasons": f"""WITH {EV}, s AS (SELECT trace_id, count(*) FILTER (WHERE failed) AS score FROM ev GROUP BY 1), f AS (SELECT trace_id FROM s WHERE score % 3 = 0),
      r AS (SELECT 'high ' || (trace_id % 7) AS reason FROM f UNION ALL SELECT 'low ' || (trace_id % 3) FROM f) SELECT reason, count(*) AS traces FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""",
    "cluster_abstention": f"""WITH {EV}, c AS (SELECT case_id, count(DISTINCT trace_id) AS traces, count(DISTINCT CASE WHEN case_id % 7 <> 0 THEN tool END) AS terms, count(DISTINCT failed::VARCHAR || (case_id % 5)) * (case_id % 3) AS shapes FROM ev GROUP BY 1)
      SELECT case_id, traces, terms, shapes, CASE WHEN traces < 3 THEN 'fewer than three traces' WHEN terms = 0 THEN 'no trajectories' WHEN shapes < 2 THEN 'all trajectories are alike' END AS reason,
        greatest(0, least(8, traces - 1, shapes) - 1)::INT AS candidates FROM c""",
}
_SCORES = f"""u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
  s AS (SELECT vec_id, 1 / (1 + exp(-(sum(x * (((7 * (i - 1)) % 11 - 5) / 10)) + ({BIAS})))) AS p FROM u GROUP BY 1),
  l AS (SELECT t.trace_id, count(s.p) AS messages, count(*) FILTER (WHERE s.p >= 0.5) AS complaints, round(max(s.p), 6) AS highest FROM (SELECT DISTINCT vec_id % 200 AS trace_id FROM embeddings) t LEFT JOIN s ON s.vec_id % 150 = t.trace_id GROUP BY 1),
  b AS (SELECT *, CASE WHEN messages = 0 THEN 'no_user_messages' WHEN complaints > 0 THEN 'complaint' ELSE 'no_complaint' END AS label FROM l)"""
ORACLES["screening"] = f"WITH {_SCORES} SELECT trace_id, label, messages, complaints, highest FROM b"
ORACLES["screening_coverage"] = f"WITH {_SCORES} SELECT count(*) AS traces, count(*) FILTER (WHERE messages > 0) AS with_messages, count(*) FILTER (WHERE label = 'complaint') AS candidates FROM b"
_P = ORACLES["presence_counts"]
_NOTES = [
    ("total_traces < 3", "'There are ' || total_traces || ' traces; trajectories are clustered from 3 on.'"),
    ("distinct_cases < 3", "'There are ' || distinct_cases || ' logical cases; a card counts from 3 independent cases on, so none can.'"),
    ("total_traces > 0 AND distinct_cases = total_traces AND logical_case_id = 0", "'No trace names its logical case, so each counts as its own; retries of one task would be counted several times.'"),
    ("result_present > 0 AND result_empty >= 0.95 * result_present", "result_empty || ' of ' || result_present || ' results hold nothing, so rules that read results find nothing; the export may lack payloads.'"),
    ("total_calls > 0 AND arguments_empty >= 0.95 * total_calls", "arguments_empty || ' of ' || total_calls || ' calls have no arguments, so rules about arguments find nothing; is the right field read?'"),
    ("total_calls > 0 AND explicit_error_false > 0.9 * total_calls", "'Almost every call says explicit_error is false, which rules out reading failures from results.'"),
    ("total_calls > 0 AND result_absent = 0", "'Every call has a result; lost results can''t be told.'"), ("steps = 0", "'No trace has steps; trajectories are made of tool calls.'"),
    ("steps > 0 AND steps < total_traces", "steps || ' of ' || total_traces || ' traces have steps; trajectories of the others aren''t comparable with theirs.'"),
    ("result_absent > 0", "result_absent || ' of ' || total_calls || ' calls have no result to judge.'"),
    ("total_traces > tool_catalog", "(total_traces - tool_catalog) || ' of ' || total_traces || ' traces have no tool catalog, so their arguments weren''t checked.'"),
]
ORACLES["coverage_notes"] = f"WITH p AS ({_P}) " + " UNION ALL ".join(f"SELECT {text} AS note FROM p WHERE {condition}" for condition, text in _NOTES)
