"""Reading variant columns by what was recorded, without the coercions of casts. SQL NULL stands for `not recorded`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID (JSON null), a numeric type, or NULL if nothing was recorded."""
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)


def _is(value: Column, name: str) -> Column:
    """Whether the kind is this one; cheaper than kind()."""
    return F.startswith(F.schema_of_variant(value), F.lit(name))


def at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def text_at(value: Column, path: str) -> Column:
    """The string at a path; NULL if something else is there."""
    return F.when(_is(at(value, path), "STRING"), F.try_variant_get(value, path, "string"))


def is_flag(value: Column, path: str, flag: bool) -> Column:
    """Whether exactly this boolean is at the path."""
    found = _is(at(value, path), "BOOLEAN") & (F.try_variant_get(value, path, "boolean") == flag)
    return F.coalesce(found, F.lit(False))


def plain_text(value: Column) -> Column:
    """A string's own characters; NULL for other values."""
    return F.when(_is(value, "STRING"), F.try_variant_get(value, "$", "string"))


def parsed(value: Column) -> Column:
    """A string's content as JSON (NULL if it is none), other values unchanged."""
    return F.when(_is(value, "STRING"), F.try_parse_json(plain_text(value))).otherwise(value)


def as_object(value: Column) -> Column:
    """The value if it is an object, else NULL."""
    return F.when(_is(value, "OBJECT"), value)
