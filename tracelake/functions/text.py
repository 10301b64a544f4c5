"""Column functions on texts, JSON values and trajectories. Patterns are fixed values of the result formats."""

from __future__ import annotations

import json
from decimal import Decimal, localcontext

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Unicode has it; absolute paths with at least one folder; long identifiers; numbers not glued to letters.
SPACE = r"(?U)\s+"
PATH = r"(?:[A-Za-z]:)?[/\\](?:[^\s:/\\]+[/\\])+[^\s:]*"
LONG_ID = r"(?i)\b(?:0x[0-9a-f]+|[0-9a-f]{8,}|\d{4,})\b"
NUMBER = r"(?i)(?<![A-Za-z])[-+]?\d+(?:\.\d+)?(?:e[-+]?\d+)?"
OMITTED = "\n… <middle omitted by anomaly-and-pattern head+tail cap> …\n"
ELLIPSIS = "…"


def one_line(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.btrim(F.regexp_replace(text, SPACE, " "))


def cut(text: Column, limit: int) -> Column:
    """At most limit characters, the last an ellipsis if something was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit(ELLIPSIS))).otherwise(text)


def compact(text: Column, limit: int = 900) -> Column:
    return cut(one_line(text), limit)


def head_tail(text: Column, limit: int = 8000) -> Column:
    """At most limit characters: as much of the start as of the end (the start gets an odd one), with a note between."""
    if limit < 80:
        raise ValueError("limit must be at least 80")
    rest = limit - len(OMITTED)
    short = F.concat(F.substring(text, 1, (rest + 1) // 2), F.lit(OMITTED), F.right(text, F.lit(rest // 2)))
    return F.when(F.length(text) > limit, short).otherwise(text)


def error_template(text: Column, limit: int = 180) -> Column:
    """A message without what varies: paths, long identifiers and numbers become marks, in this order."""
    for pattern, mark in ((PATH, "<path>"), (LONG_ID, "<id>"), (NUMBER, "<n>")):
        text = F.regexp_replace(one_line(text) if pattern == PATH else text, pattern, mark)
    return F.substring(text, 1, limit)


def failure_message(text: Column, marker: Column) -> Column:
    """The line that stands for a failure: the first, or of tracebacks the last that names an error."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), one_line), lambda x: x != "")
    errors = F.filter(lines, lambda x: x.rlike(r"(?:Error|Exception|Failed)\b"))
    traced = F.coalesce(F.try_element_at(errors, F.lit(-1)), F.lit("Python traceback"))
    return F.when(marker == "python_traceback", traced).otherwise(F.coalesce(F.get(lines, F.lit(0)), marker))


def message_signature(signature: Column) -> Column:
    """The part after the first `: `, or all of it."""
    at = F.instr(signature, ": ")
    return F.when(at > 0, F.substr(signature, at + 2)).otherwise(signature)


def sequence_token(kind: Column, name: Column) -> Column:
    """`type:name` of a step; a fixed token for evaluations."""
    kind = F.lower(F.btrim(F.coalesce(F.nullif(kind, F.lit("")), F.lit("unknown"))))
    name = F.replace(F.btrim(F.coalesce(F.nullif(name, F.lit("")), kind)), F.lit(" "), F.lit("_"))
    return F.when(kind == "evaluation", F.lit("evaluation:boundary")).otherwise(F.concat(kind, F.lit(":"), name))


def markdown_cell(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def _plain(value: object) -> object:
    """A variant's value with integers as int and all other numbers as float, however they were stored."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, Decimal):
        return int(value) if value.as_tuple().exponent >= 0 else float(value)
    return value


@F.pandas_udf(StringType())
def _canonical(values: pd.Series) -> pd.Series:
    with localcontext(prec=40):  # variants hold up to 38 digits
        return pd.Series([None if v is None else json.dumps(_plain(v.toPython()), ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str) for v in values], dtype=object)


def canonical_json(value: Column) -> Column:
    """JSON text of a variant with keys sorted by code point and no spaces. Numbers keep their form: 1 isn't 1.0, 1.50 is 1.5, 1e2 is 100.0.

    Spark's own text serves where it says the same: values without fractions, and without characters beyond 16 bits, by which
    Spark sorts differently. The others are written in Python, a batch at a time. Integers of more than 38 digits were
    read as floating-point numbers, and the sign of -0.0 was lost, before they get here.
    """
    differs = F.schema_of_variant(value).rlike("DECIMAL|DOUBLE|FLOAT") | F.to_json(value).rlike(r"[\x{10000}-\x{10FFFF}]")
    return F.coalesce(_canonical(F.when(differs, value)), F.to_json(value))


def fingerprint(value: Column) -> Column:
    """A digest under which equal values are equal and others differ, worked out by Spark alone: of the text, and of the types where they
    tell 1 from 1.0. Lists that hold the same numbers in other forms, such as [1, 1.0] and [1.0, 1], are one."""
    types = F.schema_of_variant(value)
    return F.md5(F.concat(F.to_json(value), F.when(types.contains("DECIMAL"), types).otherwise(F.lit(""))))


def digest(text: Column, size: int = 64) -> Column:
    """The first hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, size)


def duration_ms(recorded: Column, start: Column, end: Column) -> Column:
    """The recorded duration, else that from the times, in milliseconds."""
    return F.coalesce(recorded, (F.unix_micros(end) - F.unix_micros(start)) / 1000.0)


def nanos_to_timestamp(nanos: Column) -> Column:
    """Whole microseconds of a count of nanoseconds since 1970."""
    return F.timestamp_micros(F.floor(nanos.cast("decimal(20,0)") / 1000).cast("long"))
