"""Decoders of explicit tool failures. Both give (failed, marker) from recorded evidence only; they differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.json_values import as_object, at, is_flag, kind, parsed, plain_text, text_at
from tracelake.functions.tables import settled

#: Fixed patterns and names.
SHELL_EXIT = r"(?i)Process exited with code\s+(-?\d+)\b"
ERROR_PREFIX = r"(?i)\A\s*(?:error|failed|failure)\s*[:\-]"
TRACEBACK = r"(?m)^Traceback \(most recent call last\):"
CODE_TOOLS = ["CodeExecutionTool"]
STATUS_STRICT = ["error", "failed", "failure"]
STATUS_WIDE = ["error", "failed", "failure", "crashed", "timeout"]
NO_ERROR = ["null", "false", '""', "[]", "0", "0.0"]


def result_text(output: Column) -> Column:
    """Text of a result for features: a string as it is, an object's first telling string, else JSON; empty for null."""
    told = [F.when(F.regexp_replace(text_at(output, f"$.{k}"), r"(?U)\s", "") != "", text_at(output, f"$.{k}")) for k in ("content", "output", "message", "error", "summary")]
    other = F.when(kind(output) != "VOID", F.to_json(output))
    return F.coalesce(plain_text(output), *told, other, F.lit(""))


def _verdict(branches: list[tuple[Column, Column]]) -> Column:
    """(failed, marker) of the first branch whose condition holds; a NULL marker means no failure."""
    chain = F.when(*branches[0])
    for condition, marker in branches[1:]:
        chain = chain.when(condition, marker)
    return chain


def strictly_decoded(rows: DataFrame) -> DataFrame:
    """rows (tool, output, explicit_error, outcome_marker) with text, and marker of the failure that the audit sees, NULL for none.

    An explicit False rules out everything else. Steps are settled one after the other, so that no decoding is repeated.
    """
    c = F.col
    rows = settled(rows, {"_thing": as_object(parsed(c("output")))})
    rows = settled(rows, {
        "text": F.coalesce(text_at(c("_thing"), "$.content"), F.to_json("_thing"), plain_text(c("output")), F.to_json("output"), F.lit("")),
        "_flag": is_flag(c("_thing"), "$.isError", True) | is_flag(c("_thing"), "$.success", False) | is_flag(c("_thing"), "$.called", False),
        "_error": F.to_json(at(c("_thing"), "$.error")), "_status": F.lower(text_at(c("_thing"), "$.status")), "_nested": as_object(at(c("_thing"), "$.result")),
    })
    rows = settled(rows, {
        "_nested": is_flag(c("_nested"), "$.isError", True) | is_flag(c("_nested"), "$.success", False), "_exit": F.regexp_extract("text", SHELL_EXIT, 1),
    })
    rows = settled(rows, {"marker": _verdict([
        (c("explicit_error"), F.coalesce(F.nullif("outcome_marker", F.lit("")), F.lit("explicit_error_field"))),
        (~c("explicit_error") | c("output").isNull(), F.lit(None).cast("string")),
        (c("_flag"), F.lit("structured_error_flag")),
        (c("_error").isNotNull() & ~c("_error").isin(NO_ERROR), F.lit("structured_error_value")),
        (c("_status").isin(STATUS_STRICT), F.lit("structured_error_status")),
        (c("_nested"), F.lit("nested_error_flag")),
        # By its digits, as a code may be longer than any number type.
        (c("_exit") != "", F.when(c("_exit").rlike("[1-9]"), F.concat(F.lit("shell_exit_code_"), F.regexp_replace("_exit", r"^(-?)0+(?=\d)", "$1")))),
        (c("text").rlike(ERROR_PREFIX), F.lit("error_prefix")),
        (c("tool").isin(CODE_TOOLS) & c("text").rlike(TRACEBACK), F.lit("python_traceback")),
    ])})
    return rows.drop("_thing", "_flag", "_error", "_status", "_nested", "_exit")


def widely_decoded(rows: DataFrame) -> DataFrame:
    """rows (tool, output, error) with text, and marker of the failure that features count, NULL for none.

    Any error string counts; JSON in strings doesn't.
    """
    c = F.col
    rows = settled(rows, {"text": result_text(c("output")), "_thing": as_object(c("output"))})
    rows = settled(rows, {
        "_flag": is_flag(c("_thing"), "$.is_error", True) | is_flag(c("_thing"), "$.isError", True), "_failed": is_flag(c("_thing"), "$.success", False) | is_flag(c("_thing"), "$.ok", False),
        "_status": F.lower(F.btrim(text_at(c("_thing"), "$.status"))), "_code": F.coalesce(at(c("_thing"), "$.exit_code"), at(c("_thing"), "$.returncode")),
    })
    number = F.when(kind(c("_code")) == "BOOLEAN", F.try_variant_get("_code", "$", "boolean").cast("double")).when(kind(c("_code")) != "STRING", F.try_variant_get("_code", "$", "double"))
    rows = settled(rows, {"_code": number})
    rows = settled(rows, {"marker": _verdict([
        (c("error").isNotNull(), F.lit("span_error")), (c("_flag"), F.lit("structured_error_flag")), (c("_failed"), F.lit("structured_unsuccessful")),
        (c("_status").isin(STATUS_WIDE), F.concat(F.lit("structured_status_"), c("_status"))), (F.abs("_code") >= 1, F.lit("nonzero_exit_code")),
        (c("text").rlike(ERROR_PREFIX), F.lit("tool_output_error_prefix")), (c("tool").isin(CODE_TOOLS) & c("text").rlike(TRACEBACK), F.lit("python_traceback")),
    ])})
    return rows.drop("_thing", "_flag", "_failed", "_status", "_code")
