"""SQL for DuckDB that gives the same rows as the catalogue's queries, from the same tables."""

from __future__ import annotations

from tracelake.operators.features import FEATURES, LABELS
from tracelake.plans.catalogue import BIAS, CENTERS, COMPLAINT, WEIGHTS
from tracelake.plans.expected import FAMILY, NEEDS

EV = """ev AS (
  SELECT user_id AS trace_id, user_id % 50 AS case_id, event_id AS call_id, regexp_extract(props, '[0-9]+')::INT AS k,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS call_index, 'op_' || (regexp_extract(props, '[0-9]+')::INT % 5) AS tool,
         event_type = 'error' AS failed, value AS duration_ms, ts, event_type,
         CASE WHEN event_type = 'error' THEN 'Error: request ' || event_id || ' failed after ' || value::DECIMAL(18,2) || ' s at /srv/app/mod' ELSE 'done' END AS text
  FROM events)"""
LI = """li AS (
  SELECT l_orderkey AS trace_id, l_linenumber::BIGINT AS call_id, 'T' || (l_suppkey % 8) AS tool, l_partkey % 7 AS result_id,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS result_count,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS call_index
  FROM lineitem)"""
CV = """cv AS (
  SELECT conv_id AS trace_id, turn AS span_id, role, text,
         CASE WHEN role = 'assistant' THEN lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) END AS parent_id FROM conversations)"""
# Signatures of event failures: the text is one line, with spaces around every number, so no look-behind is needed.
TEMPLATE = r"""regexp_replace(regexp_replace(regexp_replace({t}, '(?:[A-Za-z]:)?[/\\](?:[^\s:/\\]+[/\\])+[^\s:]*', '<path>', 'g'), '\b(?:0x[0-9a-f]+|[0-9a-f]{{8,}}|\d{{4,}})\b', '<id>', 'gi'), '[-+]?\d+(?:\.\d+)?(?:e[-+]?\d+)?', '<n>', 'gi')"""
FAILS = EV + f""", fl AS (
  SELECT *, tool || ': ' || substr({TEMPLATE.format(t='text')}, 1, 180) AS signature, substr({TEMPLATE.format(t='text')}, 1, 180) AS message_signature FROM ev WHERE failed)"""
FEATURE_SQL = EV + """, tl AS (SELECT trace_id, tool, count(*) AS n FROM ev GROUP BY ALL),
 ft AS (SELECT trace_id, count(*)::DOUBLE AS tool_call_count, count(DISTINCT tool)::DOUBLE AS distinct_tool_count, count(*)::DOUBLE AS trajectory_step_count,
  (SELECT max(n) FROM tl WHERE tl.trace_id = ev.trace_id) / count(*) AS dominant_tool_share, 1 - count(DISTINCT tool || '|' || k) / count(*) AS repeated_identical_call_rate,
  count(*) FILTER (WHERE failed) / count(*) AS explicit_failure_rate, 0.0::DOUBLE AS returned_data_false_rate, 0.0::DOUBLE AS code_execution_share,
  sum(strlen(text)) / count(*) / 1024 AS output_kb_per_call, max(strlen(text)) / 1024 AS largest_output_kb, sum(greatest(duration_ms, 0)) / 1000 AS tool_duration_sec_total
  FROM ev GROUP BY trace_id)"""


def _finding(issue: str, where: str, source: str = "ev", with_: str = EV, mechanism: str | None = None) -> str:
    return f"WITH {with_} SELECT trace_id, call_id, call_index, tool, '{issue}' AS issue_type, {mechanism or repr(issue)} AS mechanism_key FROM {source} WHERE {where}"


def _values(pairs) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in p) + ")" for p in pairs)


# Audit findings of events: failures with their marker, and failures of one kind that were retried with other arguments.
FINDINGS = FAILS + """, fx AS (SELECT trace_id, case_id, tool, k, count(*) AS n, min((call_index, call_id)) AS f FROM ev WHERE failed GROUP BY ALL HAVING count(*) >= 3),
 fm AS (SELECT trace_id, case_id, tool, count(*) AS n, min((call_index, call_id)) AS f FROM ev WHERE failed GROUP BY ALL HAVING count(*) >= 3 AND count(DISTINCT k) >= 2),
 fd AS (SELECT trace_id, case_id, call_id, call_index, tool, 'explicit_tool_failure' AS issue_type, 'error_prefix' AS mechanism_key FROM ev WHERE failed
  UNION ALL SELECT trace_id, case_id, f[2], f[1], tool, 'repeated_identical_failed_call', 'repeated_identical_failed_call' FROM fx
  UNION ALL SELECT trace_id, case_id, f[2], f[1], tool, 'modified_retry_same_failure', 'error_prefix' FROM fm)"""
FAMILIES = f"fam AS (SELECT * FROM (VALUES {_values(FAMILY.items())}) t(issue_type, issue_family))"
HALVES = EV + """, h AS (SELECT trace_id % 7 AS insight_id, trace_id, call_id % 2 AS half, list_slice(list_sort(list(DISTINCT call_id)), 1, 3) AS spans FROM ev GROUP BY ALL),
 h0 AS (SELECT *, 'https://t0.example/' || trace_id AS url FROM h WHERE half = 0 AND trace_id % 5 <> 0),
 h1 AS (SELECT *, 'https://t1.example/' || trace_id AS url FROM h WHERE half = 1 AND trace_id % 6 <> 0)"""
PRESENCE = LI + """, pr AS (SELECT
  (SELECT count(*) FROM li) AS calls, (SELECT count(*) FROM li) AS with_result, 0::BIGINT AS without_result, (SELECT count(*) FROM li WHERE result_count > 1) AS many_results,
  (SELECT count(result_id) FROM li) AS with_result_id, 0::BIGINT AS with_alias, 0::BIGINT AS explicit_error_false, (SELECT count(*) FROM orders) AS traces, 0::BIGINT AS with_catalog,
  0::BIGINT AS with_provenance, (SELECT count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)) AS with_orphans)"""
_NEED = {
    "tool_catalog": "false", "always": "true", "result-key discipline": "false", "result_count": "many_results > 0", "result_id": "with_result_id > 0",
    "orphan_results": "with_orphans > 0", "instrumentation_alias_of": "false", "result": "true", "complete_provenance_context": "false",
}
# Median deviations of four rounded features, largest first.
_REASON_FEATURES = ["tool_call_count", "dominant_tool_share", "explicit_failure_rate", "tool_duration_sec_total"]
_UNPIVOT = "SELECT trace_id, f AS feature, v AS value FROM ft, LATERAL (VALUES {rows}) t(f, v)"
Z = """uz AS ({unpivot}), mz AS (SELECT feature, median(value) AS center FROM uz GROUP BY 1),
 az AS (SELECT uz.feature, CASE WHEN median(abs(value - center)) = 0 THEN 1e-9 ELSE median(abs(value - center)) END AS mad FROM uz JOIN mz USING (feature) GROUP BY 1),
 zz AS (SELECT trace_id, feature, value, center, mad, (value - center) / (1.4826 * mad) AS z FROM uz JOIN mz USING (feature) JOIN az USING (feature))"""

ORACLES = {
    "corpus_description": f"WITH {EV} SELECT count(DISTINCT trace_id) AS trace_count, count(*) AS call_count, count(DISTINCT case_id) AS logical_case_count FROM ev",
    "tree_preorder_paths": f"""WITH RECURSIVE {CV}, nm AS (SELECT *, row_number() OVER (PARTITION BY trace_id, parent_id ORDER BY span_id) - 1 AS nr FROM cv),
      tr AS (SELECT trace_id, span_id, [nr] AS p FROM nm WHERE parent_id IS NULL UNION ALL SELECT nm.trace_id, nm.span_id, list_append(tr.p, nm.nr) FROM nm JOIN tr ON nm.trace_id = tr.trace_id AND nm.parent_id = tr.span_id)
      SELECT trace_id, span_id, array_to_string(p, '.') AS path, len(p) - 1 AS depth, row_number() OVER (PARTITION BY trace_id ORDER BY p) - 1 AS dfs_index FROM tr""",
    "clock_order": """WITH RECURSIVE n AS (SELECT conv_id AS trace_id, turn AS span_id, CASE WHEN turn > 0 AND turn % 4 <> 3 THEN (turn - 1) // 2 END AS parent_id, ((turn * 7 + conv_id) % 5) * 1000000 + turn AS k FROM conversations),
      w AS (SELECT trace_id, span_id, [k] AS waits FROM n WHERE parent_id IS NULL UNION ALL SELECT n.trace_id, n.span_id, list_append(list_filter(w.waits, lambda x: x > n.k), n.k) FROM n JOIN w ON n.trace_id = w.trace_id AND n.parent_id = w.span_id)
      SELECT trace_id, span_id, row_number() OVER (PARTITION BY trace_id ORDER BY waits) - 1 AS clock_index FROM w""",
    "orphan_parent_detach": f"""WITH {CV}, b AS (SELECT trace_id, span_id, CASE WHEN parent_id IS NOT NULL AND span_id % 5 = 0 THEN parent_id + 100000 ELSE parent_id END AS p FROM cv)
      SELECT b.trace_id, b.span_id, CASE WHEN c.span_id IS NOT NULL THEN b.p END AS parent_id, CASE WHEN c.span_id IS NULL THEN b.p END AS unresolved_parent
      FROM b LEFT JOIN cv c ON b.trace_id = c.trace_id AND b.p = c.span_id""",
    "cycle_detection": f"""WITH RECURSIVE {CV}, c0 AS (SELECT trace_id, span_id, CASE WHEN trace_id % 10 = 0 AND span_id = 0 THEN 1 WHEN trace_id % 10 = 0 AND span_id = 1 THEN 0 ELSE parent_id END AS p FROM cv),
      c1 AS (SELECT a.trace_id, a.span_id, b.span_id AS p FROM c0 a LEFT JOIN c0 b ON a.trace_id = b.trace_id AND a.p = b.span_id),
      ok AS (SELECT trace_id, span_id FROM c1 WHERE p IS NULL UNION SELECT c1.trace_id, c1.span_id FROM c1 JOIN ok ON c1.trace_id = ok.trace_id AND c1.p = ok.span_id)
      SELECT trace_id, span_id FROM c1 EXCEPT SELECT trace_id, span_id FROM ok""",
    "carry_prior_user_text": """SELECT conv_id AS trace_id, turn AS span_id, md5(coalesce(last_value(CASE WHEN role = 'user' AND text <> '' THEN text END IGNORE NULLS)
      OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '')) AS prior_md5 FROM conversations""",
    "prior_results_concat": """SELECT conv_id AS trace_id, turn AS span_id, md5(coalesce(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS prior_md5 FROM conversations""",
    "last_agent_excerpt": r"""WITH a AS (SELECT conv_id, trim(regexp_replace(arg_max(text, turn), '\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'assistant' AND text <> '' GROUP BY 1)
      SELECT conv_id AS trace_id, CASE WHEN length(t) > 520 THEN rtrim(substr(t, 1, 519)) || '…' ELSE t END AS excerpt FROM a""",
    "sequence_tokens": f"WITH {EV} SELECT trace_id, call_index, CASE WHEN event_type = 'view' THEN 'evaluation:boundary' ELSE 'tool:' || tool END AS token FROM ev",
    "trace_features": f"WITH {FEATURE_SQL} SELECT trace_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in FEATURES) + " FROM ft",
    "trace_features_empty_traces": f"""WITH {LI}, t AS (SELECT trace_id, tool, count(*) AS n FROM li GROUP BY ALL), a AS (SELECT trace_id, sum(n) AS n, count(*) AS d, max(n) AS m FROM t GROUP BY 1)
      SELECT o_orderkey AS trace_id, coalesce(n, 0)::DOUBLE AS tool_call_count, coalesce(d, 0)::DOUBLE AS distinct_tool_count, coalesce(n, 0)::DOUBLE AS trajectory_step_count,
      round(coalesce(m / n, 0), 6)::DOUBLE AS dominant_tool_share, round(CASE WHEN n IS NULL THEN 0 ELSE 2 / 1024 END, 6)::DOUBLE AS output_kb_per_call FROM orders LEFT JOIN a ON o_orderkey = trace_id""",
    "robust_zscores": f"WITH {FEATURE_SQL}, " + Z.format(unpivot=_UNPIVOT.format(rows=", ".join(f"('{c}', {c})" for c in ("tool_call_count", "explicit_failure_rate", "output_kb_per_call")))) +
      " SELECT trace_id, feature, round(value, 6) AS value, round(center, 6) AS center, round(mad, 6) AS mad, round(z, 4) AS z FROM zz",
    "robust_reasons": f"WITH {FEATURE_SQL}, " + Z.format(unpivot=_UNPIVOT.format(rows=", ".join(f"('{c}', round({c}, 6))" for c in _REASON_FEATURES))) +
      f", lb AS (SELECT * FROM (VALUES {_values((c, LABELS[c]) for c in _REASON_FEATURES)}) t(feature, label))," + """
      rk AS (SELECT trace_id, label, abs(z) AS size, value - center AS delta, row_number() OVER (PARTITION BY trace_id ORDER BY abs(z) DESC, value - center DESC, feature DESC) AS nr FROM zz JOIN lb USING (feature))
      SELECT trace_id, coalesce(string_agg(CASE WHEN delta > 0 THEN 'high ' ELSE 'low ' END || label, '; ' ORDER BY nr) FILTER (WHERE nr <= 3 AND size > 1.5), max(label) FILTER (WHERE nr = 1)) AS reasons FROM rk GROUP BY 1""",
    "failure_signatures": f"WITH {FAILS} SELECT trace_id, call_id, 'tool_output_error_prefix' AS marker, signature, message_signature FROM fl",
    "recurring_failures": f"""WITH {FAILS}, f1 AS (SELECT signature, trace_id, min((call_index, call_id))[2] AS call_id, count(*) AS n FROM fl GROUP BY ALL),
      f2 AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY trace_id) AS nr FROM f1)
      SELECT signature, sum(n)::BIGINT AS event_count, count(*) AS independent_trace_count, min(trace_id) AS first_trace, string_agg(trace_id || ':' || call_id, ',' ORDER BY nr) FILTER (WHERE nr <= 5) AS representatives
      FROM f2 GROUP BY 1 HAVING count(*) >= 3""",
    "cross_tool_failures": f"""WITH {FAILS} SELECT message_signature, count(*) AS event_count, count(DISTINCT trace_id) AS independent_trace_count, string_agg(DISTINCT tool, ',' ORDER BY tool) AS tool_names
      FROM fl GROUP BY 1 HAVING count(DISTINCT trace_id) >= 3""",
    "verdict_groups": """WITH v AS (SELECT *, regexp_replace(o_orderstatus || ' ' || o_orderpriority, '[-+]?[0-9]+', '<n>', 'g') AS verdict FROM orders),
      r AS (SELECT *, row_number() OVER (PARTITION BY verdict ORDER BY o_totalprice DESC, o_orderkey) AS nr FROM v)
      SELECT verdict, count(*) AS independent_trace_count, round(sum(o_totalprice), 2) AS total_known_cost, min(o_orderkey) AS first_position, string_agg(o_orderkey::VARCHAR, ',' ORDER BY nr) FILTER (WHERE nr <= 5) AS representatives FROM r GROUP BY 1""",
    "rule_duplicate_call_id": f"""WITH {LI}, q AS (SELECT *, row_number() OVER (PARTITION BY trace_id, call_id ORDER BY call_index) AS nr FROM li)
      SELECT trace_id, call_id, call_index, tool, 'duplicate_call_id' AS issue_type, 'duplicate_call_id' AS mechanism_key FROM q WHERE nr > 1""",
    "rule_missing_and_duplicate_result": f"""WITH {LI}, q AS (SELECT *, CASE result_count WHEN 0 THEN 'missing_tool_result' WHEN 2 THEN 'duplicate_tool_result' END AS i FROM li)
      SELECT trace_id, call_id, call_index, tool, i AS issue_type, i AS mechanism_key FROM q WHERE i IS NOT NULL""",
    "rule_result_id_mismatch": _finding("call_result_id_mismatch", "result_id <> call_id", "li", LI),
    "rule_unknown_tool": _finding("unknown_tool", "tool = 'op_4'"),
    "rule_argument_contract": f"""WITH {EV}, i AS (SELECT *, CASE WHEN k % 25 = 3 THEN ['missing_required_argument'] WHEN k % 25 = 4 THEN ['argument_type_mismatch', 'argument_enum_violation']
      WHEN k % 25 = 5 THEN ['malformed_tool_call'] ELSE list_concat(CASE WHEN k > 89 THEN ['json_schema_violation'] ELSE [] END, CASE WHEN k % 10 = 7 THEN ['argument_enum_violation'] ELSE [] END) END AS l FROM ev),
      u AS (SELECT trace_id, call_id, call_index, tool, unnest(l) AS issue_type FROM i) SELECT *, issue_type AS mechanism_key FROM u""",
    "rule_explicit_failure": _finding("explicit_tool_failure", "failed", mechanism="'error_prefix'"),
    "rule_placeholder": _finding("unresolved_placeholder_argument", "failed AND k < 5"),
    "rule_ungrounded_identifier": f"""WITH {EV}, o AS (SELECT *, CASE WHEN failed THEN 'invalid reference ref' || k ELSE 'saw ref' || k END AS said FROM ev),
      p AS (SELECT *, coalesce(string_agg(said, chr(10)) OVER (PARTITION BY trace_id ORDER BY call_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prior FROM o)
      SELECT trace_id, call_id, call_index, tool, 'explicitly_rejected_ungrounded_identifier' AS issue_type, 'explicitly_rejected_ungrounded_identifier' AS mechanism_key
      FROM p WHERE failed AND NOT contains(prior, 'ref' || k)""",
    "rule_state_failure": _finding("explicit_prerequisite_or_state_failure", "k % 10 < 4", mechanism="['no_active_session', 'initialize_before_use', 'required_type_or_target', 'required_first_step'][k % 10 + 1]"),
    "rule_repeated_identical": f"WITH {FINDINGS} SELECT * EXCLUDE (case_id) FROM fd WHERE issue_type = 'repeated_identical_failed_call'",
    "rule_modified_retry": f"WITH {FINDINGS} SELECT * EXCLUDE (case_id) FROM fd WHERE issue_type = 'modified_retry_same_failure'",
    "orphan_results": """SELECT o_orderkey AS trace_id, o_custkey AS case_id, o_orderkey::VARCHAR AS call_id, (-1)::BIGINT AS call_index, '<unknown>' AS tool, 'orphan_tool_result' AS issue_type
      FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
    "issue_cards": f"""WITH {FINDINGS}, {FAMILIES}, pc AS (SELECT issue_type, mechanism_key, case_id, count(*) AS n, min((trace_id, call_index, call_id)) AS f FROM fd GROUP BY ALL),
      rc AS (SELECT *, row_number() OVER (PARTITION BY issue_type, mechanism_key ORDER BY f) AS nr FROM pc)
      SELECT 'tid:' || issue_type || ':' || mechanism_key AS card_id, any_value(issue_family) AS issue_family, sum(n)::BIGINT AS finding_count, count(*) AS independent_case_count, count(*) >= 3 AS eligible,
      string_agg(f[1]::VARCHAR, ',' ORDER BY nr) FILTER (WHERE nr <= 3) AS examples FROM rc JOIN fam USING (issue_type) GROUP BY issue_type, mechanism_key""",
    "catalog_coverage": f"WITH {FINDINGS}, {FAMILIES} SELECT fam.issue_type, count(fd.trace_id) AS findings FROM fam LEFT JOIN fd ON fam.issue_type = fd.issue_type GROUP BY 1",
    "field_presence": f"WITH {PRESENCE} SELECT * FROM pr",
    "rule_evaluability": f"""WITH {PRESENCE}, nd AS (SELECT * FROM (VALUES {_values(NEEDS.items())}) t(issue_type, needs)),
      qd AS (SELECT row_number() OVER (PARTITION BY trace_id, call_id ORDER BY call_index) AS nr, * FROM li)
      SELECT issue_type, needs, CASE needs {" ".join(f"WHEN '{n}' THEN {c}" for n, c in _NEED.items())} END AS evaluable,
      CASE issue_type WHEN 'duplicate_call_id' THEN (SELECT count(*) FROM qd WHERE nr > 1) WHEN 'missing_tool_result' THEN (SELECT count(*) FROM li WHERE result_count = 0)
      WHEN 'duplicate_tool_result' THEN (SELECT count(*) FROM li WHERE result_count > 1) WHEN 'call_result_id_mismatch' THEN (SELECT count(*) FROM li WHERE result_id <> call_id) ELSE 0 END AS findings
      FROM nd, pr""",
    "evaluation_index": """SELECT l.doc_id AS trace_id, d.source AS case_id, 'quality=' || l.quality || ',toxic=' || l.toxic AS results, d.lang AS tools, CASE WHEN d.n_chars > 3000 THEN 'long' ELSE '' END AS errors
      FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "evaluation_coverage_limit": """SELECT count(*) AS traces, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS evaluated, count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS not_evaluated FROM documents""",
    "fold_adjacent_lines": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
      s AS (SELECT *, trim(regexp_replace(line, '\s+', ' ', 'g')) AS same FROM l), g AS (SELECT *, same IS DISTINCT FROM lag(same) OVER (PARTITION BY doc_id ORDER BY pos) AS fresh FROM s),
      r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM g),
      a AS (SELECT doc_id, run, arg_min(line, pos) AS line, count(*) - 1 AS extra FROM r GROUP BY ALL)
      SELECT doc_id, md5(string_agg(line || CASE WHEN extra > 0 THEN chr(10) || '<previous line repeated ' || extra || ' times>' ELSE '' END, chr(10) ORDER BY run)) AS folded_md5 FROM a GROUP BY 1""",
    "head_tail_cap": """WITH m AS (SELECT chr(10) || '… <middle omitted by anomaly-and-pattern head+tail cap> …' || chr(10) AS mark)
      SELECT doc_id, md5(CASE WHEN length(text) > 500 THEN left(text, (500 - length(mark) + 1) // 2) || mark || right(text, (500 - length(mark)) // 2) ELSE text END) AS capped_md5 FROM documents, m""",
    "tfidf_vectors": f"""WITH {EV}, tk AS (SELECT trace_id, call_index, 'tool:' || tool AS t FROM ev), tp AS (SELECT trace_id, t FROM tk UNION ALL
      SELECT trace_id, t || ' ' || nx FROM (SELECT trace_id, t, lead(t) OVER (PARTITION BY trace_id ORDER BY call_index) AS nx FROM tk) WHERE nx IS NOT NULL),
      tc AS (SELECT trace_id, t, count(*) AS tf FROM tp GROUP BY ALL), vc AS (SELECT t, sum(tf) AS total, count(*) AS df FROM tc GROUP BY 1 ORDER BY total DESC, t LIMIT 240),
      rw AS (SELECT trace_id, t, (1 + ln(tf)) * (ln((1 + (SELECT count(DISTINCT trace_id) FROM tk)) / (1 + df)) + 1) AS raw FROM tc JOIN vc USING (t))
      SELECT trace_id, t AS term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY trace_id)), 6) AS weight FROM rw""",
    "newest_n_traces": "SELECT user_id AS trace_id, max(ts) AS ts FROM events GROUP BY 1 ORDER BY ts DESC, trace_id DESC LIMIT 25",
    "ordered_merge_union": f"""WITH {EV} SELECT trace_id, call_id, row_number() OVER (PARTITION BY trace_id ORDER BY ts, call_id) AS position FROM ev WHERE event_type IN ('error', 'purchase', 'view')""",
    "citation_guard": f"""WITH {EV} SELECT DISTINCT trace_id + 1000000 AS trace_id FROM ev WHERE call_id % 97 = 0 AND trace_id + 1000000 NOT IN (SELECT trace_id FROM ev)""",
    "insight_evidence_merge": f"""WITH {HALVES} SELECT coalesce(h0.insight_id, h1.insight_id) AS insight_id, coalesce(h0.trace_id, h1.trace_id) AS trace_id, coalesce(h0.url, h1.url) AS url,
      array_to_string(list_concat(coalesce(h0.spans, []), coalesce(h1.spans, [])), ',') AS spans, h0.trace_id IS NULL AS added FROM h0 FULL OUTER JOIN h1 ON h0.trace_id = h1.trace_id""",
    "link_resolution": f"""WITH {HALVES}, hh AS (SELECT insight_id, trace_id, url, spans FROM h0 UNION ALL SELECT insight_id + 100, trace_id, url, spans FROM h1),
      x AS (SELECT insight_id, trace_id, url, unnest(spans) AS s, generate_subscripts(spans, 1) AS pos FROM hh)
      SELECT insight_id, trace_id, CASE WHEN trace_id % 3 <> 0 THEN 'https://now.example/' || trace_id ELSE url END AS url,
      coalesce(string_agg(s::VARCHAR, ',' ORDER BY pos) FILTER (WHERE trace_id % 3 = 0 OR s % 4 <> 0), '') AS span_ids, trace_id % 3 <> 0 AS present FROM x GROUP BY insight_id, trace_id, url""",
    "tri_state_scan": f"""WITH {EV} SELECT trace_id, CASE WHEN count(*) < 60 THEN 'unknown' WHEN count(*) FILTER (WHERE failed) * 4 > count(*) THEN 'match' ELSE 'no_match' END AS state FROM ev GROUP BY 1""",
    "tri_state_totals": f"""WITH {EV}, s AS (SELECT trace_id, CASE WHEN count(*) < 60 THEN 'unknown' WHEN count(*) FILTER (WHERE failed) * 4 > count(*) THEN 'match' ELSE 'no_match' END AS state FROM ev GROUP BY 1)
      SELECT count(*) AS traces, count(*) FILTER (WHERE state = 'match') AS matches, count(*) FILTER (WHERE state = 'unknown') AS unknown FROM s""",
    "logistic_screen": f"""WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), w AS (SELECT unnest({WEIGHTS}) AS w, generate_series AS i FROM generate_series(1, 64)) ,
      s AS (SELECT vec_id, 1 / (1 + exp(-(sum(x * (((7 * (i - 1)) % 11 - 5) / 10)) + ({BIAS})))) AS p FROM u GROUP BY 1)
      SELECT vec_id, round(p, 6) AS score, CASE WHEN p >= {COMPLAINT} THEN 'complaint' ELSE 'no_complaint' END AS label FROM s""".replace(f", w AS (SELECT unnest({WEIGHTS}) AS w, generate_series AS i FROM generate_series(1, 64)) ", ""),
    "vector_codes": f"""WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT unnest({CENTERS})::DOUBLE AS c, unnest(range(16)) AS code),
      n AS (SELECT vec_id, i, arg_min(code, (abs(x - c), code)) AS code FROM u, c GROUP BY ALL)
      SELECT vec_id, string_agg(substr('0123456789abcdef', code + 1, 1), '' ORDER BY i) AS codes FROM n GROUP BY 1""",
    "vector_validity": "WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT vec_id, abs(sqrt(sum(x * x)) - 1) <= 1e-4 AS valid FROM u GROUP BY 1",
    "mlflow_ns_timestamps": "SELECT event_id, epoch_us(ts) AS micros FROM events",
}
