"""Fixed values of the results, written out for the SQL that checks them, so that a wrong entry in the library shows."""

FAMILIES = {
    "tool_contract_and_arguments": [
        "unknown_tool", "malformed_tool_call", "missing_required_argument", "unknown_argument", "argument_type_mismatch", "argument_enum_violation", "json_schema_violation",
    ],
    "call_result_integrity": ["duplicate_call_id", "missing_tool_result", "duplicate_tool_result", "orphan_tool_result", "call_result_id_mismatch"],
    "explicit_tool_outcome": ["explicit_tool_failure"],
    "recovery_and_retries": ["repeated_identical_failed_call", "modified_retry_same_failure"],
    "trace_instrumentation": ["mapped_instrumentation_alias"],
    "argument_provenance": ["unresolved_placeholder_argument", "explicitly_rejected_ungrounded_identifier"],
    "explicit_prerequisite_or_state": ["explicit_prerequisite_or_state_failure"],
}
AT_FAULT = {
    "agent_call": [
        "unknown_tool", "malformed_tool_call", "missing_required_argument", "unknown_argument", "argument_type_mismatch", "argument_enum_violation", "json_schema_violation",
        "unresolved_placeholder_argument", "explicitly_rejected_ungrounded_identifier",
    ],
    "instrumentation": ["duplicate_call_id", "missing_tool_result", "duplicate_tool_result", "call_result_id_mismatch", "mapped_instrumentation_alias", "orphan_tool_result"],
    "tool_or_environment": ["explicit_tool_failure", "explicit_prerequisite_or_state_failure"],
    "agent_recovery": ["repeated_identical_failed_call", "modified_retry_same_failure"],
}
FAMILY = {issue: family for family, issues in FAMILIES.items() for issue in issues}
ATTRIBUTION = {issue: who for who, issues in AT_FAULT.items() for issue in issues}
NEEDS = {
    "unknown_tool": "tool_catalog", "missing_required_argument": "tool_catalog", "unknown_argument": "tool_catalog", "argument_type_mismatch": "tool_catalog",
    "argument_enum_violation": "tool_catalog", "json_schema_violation": "tool_catalog", "malformed_tool_call": "always", "duplicate_call_id": "always",
    "missing_tool_result": "result-key discipline", "duplicate_tool_result": "result_count", "call_result_id_mismatch": "result_id", "orphan_tool_result": "orphan_results",
    "mapped_instrumentation_alias": "instrumentation_alias_of", "explicit_tool_failure": "result", "explicit_prerequisite_or_state_failure": "result",
    "unresolved_placeholder_argument": "result", "explicitly_rejected_ungrounded_identifier": "complete_provenance_context", "repeated_identical_failed_call": "result",
    "modified_retry_same_failure": "result",
}
REASONS = {
    "tool_catalog": "no trace has a tool catalog", "result_id": "no call has a result id", "result_count": "no call has more than one result", "orphan_results": "no trace lists results without a call",
    "instrumentation_alias_of": "no call names the tool behind an alias", "complete_provenance_context": "no trace says that all messages and results were captured",
    "result-key discipline": "every call has a result, so none can be missing; a source that loses results has to leave the field out",
    "result": "no call has a result that could be decoded",
}
SUMMARIES = {
    "unknown_tool": "the catalog has no such tool", "malformed_tool_call": "the arguments are no object", "missing_required_argument": "a required argument is missing",
    "unknown_argument": "the schema doesn't know an argument", "argument_type_mismatch": "an argument has the wrong type", "argument_enum_violation": "an argument isn't one of the allowed values",
    "json_schema_violation": "an argument breaks the schema", "duplicate_call_id": "an earlier call of the trace has this id", "missing_tool_result": "no result is linked",
    "duplicate_tool_result": "several results are linked", "orphan_tool_result": "no call asked for this result", "call_result_id_mismatch": "the result names another call",
    "mapped_instrumentation_alias": "the name is an alias of another tool", "explicit_tool_failure": "the tool says it failed", "repeated_identical_failed_call": "the same call failed again and again",
    "modified_retry_same_failure": "calls with other arguments failed alike", "unresolved_placeholder_argument": "an argument is still a placeholder",
    "explicitly_rejected_ungrounded_identifier": "the tool refuses an identifier that nothing before mentions", "explicit_prerequisite_or_state_failure": "the result says that something has to happen first",
}
