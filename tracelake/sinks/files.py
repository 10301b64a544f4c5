"""Sinks: insights as YAML, tables as JSON, the digest of an analysis as Markdown."""

from __future__ import annotations

import contextlib
import itertools
import os
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from tracelake.functions.text import markdown_cell
from tracelake.sinks.insights import Insights, yaml_lines

#: Rows of a digest's tables (fixed by its format).
ANOMALIES, GROUPS = 50, 24


def write_insights(saved: Insights, path: str) -> bool:
    """Write insights as YAML; without any, an existing file stays as it is. `-` is standard output. A file is replaced once it is whole."""
    lines = yaml_lines(saved)
    first = next(lines, None)
    if first is None:
        return False
    partial = f"{path}.partial"
    with open(partial, "w", encoding="utf-8") if path != "-" else contextlib.nullcontext(sys.stdout) as file:
        file.writelines(itertools.chain([first], lines))
    if path != "-":
        os.replace(partial, path)
    return True


def _json_ready(value: Column, of: DataType) -> Column:
    """A value whose numbers JSON lacks, at any depth, are null."""
    if isinstance(of, (DoubleType, FloatType)):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    if isinstance(of, ArrayType):
        return F.transform(value, lambda x: _json_ready(x, of.elementType))
    if isinstance(of, MapType):
        return F.transform_values(value, lambda _, x: _json_ready(x, of.valueType))
    if isinstance(of, StructType):
        return F.when(value.isNotNull(), F.struct(*(_json_ready(value[f.name], f.dataType).alias(f.name) for f in of.fields)))
    return value


def write_json(table: DataFrame, path: str, missing: tuple[str, ...] = ()) -> None:
    """A table as JSON Lines; numbers that JSON lacks become null, and nulls in columns of missing say `<missing>`."""
    columns = [_json_ready(F.col(f.name), f.dataType).alias(f.name) for f in table.schema.fields]
    out = table.select(*columns)
    out = out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("<missing>")) for c in missing})
    out.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def markdown_table(title: str, table: DataFrame, limit: int) -> str:
    """The first rows of an ordered table, cells escaped."""
    cells = [markdown_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in table.columns]
    rows = table.limit(limit).select(*cells).collect()
    lines = [f"## {title}", "", "| " + " | ".join(table.columns) + " |", "|" + " - |" * len(table.columns)]
    return "\n".join([*lines, *("| " + " | ".join(r) + " |" for r in rows), ""])


def digest(
    anomalies: DataFrame, failures: DataFrame, cross_tool: DataFrame, verdicts: DataFrame, clusters: DataFrame, known: DataFrame | None = None, inventory: dict[str, object] | None = None
) -> str:
    """The evidence digest: an inventory, top anomalies, then top groups of each kind.

    With known (trace_id) a digest that would cite other traces raises ValueError.
    """
    top = anomalies.orderBy(F.desc("score"), "trace_id")
    if known is not None:
        cited = top.limit(ANOMALIES).select(F.col("trace_id").cast("string").alias("trace_id"))
        for table in (failures, cross_tool):
            if "representatives" in table.columns:
                cited = cited.unionByName(table.limit(GROUPS).select(F.explode(F.transform("representatives", lambda x: x["trace_id"].cast("string"))).alias("trace_id")))
        lost = cited.join(known.select(F.col("trace_id").cast("string").alias("trace_id")), "trace_id", "left_anti").limit(5).collect()
        if lost:
            raise ValueError(f"the digest cites unknown traces: {', '.join(r.trace_id for r in lost)}")
    sections = [
        markdown_table("Anomalies", top, ANOMALIES), markdown_table("Recurring failures", failures, GROUPS),
        markdown_table("Failures across tools", cross_tool, GROUPS), markdown_table("Observed verdicts", verdicts, GROUPS), markdown_table("Trajectories", clusters, GROUPS),
    ]
    counts = [f"- {name}: {value}" for name, value in (inventory or {}).items()]
    return "\n".join(["# Evidence digest", "", *counts, *([""] if counts else []), *sections])


def report(results: list, insights: int = 0, kept_insights: int = 0, rejected: int = 0, extended: int = 0) -> str:
    """What a run found, for a terminal: each pass with its problems, or why it was skipped; limitations; insights."""
    lines = []
    for r in results:
        n = 0 if r.problems is None else r.problems.count()
        lines.append(f"{r.name}: skipped, {r.skip_reason}" if r.skip_reason else f"{r.name}: {n} problem{'s' * (n != 1)}")
        lines += [f"  note: {text}" for text in r.limitations]
    lines.append(f"insights: {insights} new, {kept_insights} retained" + (f", {extended} of them with new traces" if extended else "") + (f"; {rejected} problems refused by code" if rejected else ""))
    return "\n".join(lines)
