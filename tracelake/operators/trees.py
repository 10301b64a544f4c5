"""Span trees as flat tables: spans have trace_id, span_id, parent_id, start and kind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.tables import kept
from tracelake.functions.text import ELLIPSIS, one_line

AGENT_STEPS = ["agent", "agent_step", "planning"]


def detach_orphans(spans: DataFrame) -> DataFrame:
    """Spans whose parent isn't in their trace become roots; unresolved_parent keeps the lost id."""
    ids = spans.select(F.col("trace_id").alias("_trace"), F.col("span_id").alias("_id")).distinct()
    out = spans.join(ids, (F.col("trace_id") == F.col("_trace")) & (F.col("parent_id") == F.col("_id")), "left")
    lost = F.col("parent_id").isNotNull() & F.col("_id").isNull()
    return out.withColumns({"unresolved_parent": F.when(lost, F.col("parent_id")), "parent_id": F.when(~lost, F.col("parent_id"))}).drop("_trace", "_id")


def _chained(spans: DataFrame, name: str, own: Column, joined: Callable[[Column, Column], Column]) -> DataFrame:
    """spans with a column for what leads to each from its root: own of the span itself, joined(above, below) for two parts of a way.

    Ancestors are found by doubling: a round joins each span's known way with that of its top, so a tree of depth d
    takes log2(d) joins that shuffle by trace and span. A round that finishes no way ends them: spans in or below a
    cycle are left out; cyclic() lists them.
    """
    chains = kept(spans.withColumn(name, own).withColumn("top", F.col("parent_id")))
    before, left = None, chains.where(F.col("top").isNotNull()).count()
    while left and left != before:
        above = chains.select(F.col("trace_id").alias("_t"), F.col("span_id").alias("_s"), F.col(name).alias("_above"), F.col("top").alias("_top"))
        chains = chains.join(above, (F.col("trace_id") == F.col("_t")) & (F.col("top") == F.col("_s")), "left")
        both = F.when(F.col("_above").isNull(), F.col(name)).otherwise(joined(F.col("_above"), F.col(name)))
        chains = kept(chains.withColumns({name: both, "top": F.col("_top")}).drop("_t", "_s", "_above", "_top"))
        before, left = left, chains.where(F.col("top").isNotNull()).count()
    return chains.where(F.col("top").isNull()).drop("top")


def _clock(spans: DataFrame) -> list[str]:
    """Columns by which spans follow each other in time: start, the source's own tie-break if there is one, id."""
    return ["start", *(["tie"] if "tie" in spans.columns else []), "span_id"]


def preorder(spans: DataFrame) -> DataFrame:
    """spans with path (child numbers from the root, by place among siblings where that is known, start, tie and id), depth and dfs_index in depth-first order."""
    order = (["sibling"] if "sibling" in spans.columns else []) + _clock(spans)
    sibling = W.partitionBy("trace_id", "parent_id").orderBy(*order)
    paths = _chained(spans, "path", F.array(F.row_number().over(sibling) - 1), F.concat)
    ordered = W.partitionBy("trace_id").orderBy("path")
    return paths.withColumns({"depth": F.size("path") - 1, "dfs_index": F.row_number().over(ordered) - 1})


def clock_order(spans: DataFrame) -> DataFrame:
    """spans with clock_index: their order in time over all branches, but none before its parent.

    It is the order in which spans come out of a queue that always gives the earliest one whose parent is out. A span
    waits for the latest span on its way from the root, then for the latest after that one, and so on: these, latest
    first, are its sorting key. Of two parts of a way, the lower one's hide what is earlier in the upper one's. A missing start comes first.
    """
    key = F.array(F.struct(*_clock(spans)))
    waits = _chained(spans, "_waits", key, lambda above, below: F.concat(F.filter(above, lambda x: x > F.get(below, F.lit(0))), below))
    ordered = W.partitionBy("trace_id").orderBy("_waits")
    return waits.withColumn("clock_index", F.row_number().over(ordered) - 1).drop("_waits")


def cyclic(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id) of spans from which no root can be reached; parents must exist."""
    above = kept(spans.select("trace_id", "span_id", F.col("parent_id").alias("top")).where(F.col("top").isNotNull()))
    before, left = None, above.count()
    while left and left != before:
        up = above.select(F.col("trace_id").alias("_t"), F.col("span_id").alias("_s"), F.col("top").alias("_top"))
        # Spans whose top is a root aren't listed any more.
        above = kept(above.join(up, (F.col("trace_id") == F.col("_t")) & (F.col("top") == F.col("_s"))).select("trace_id", "span_id", F.col("_top").alias("top")))
        before, left = left, above.count()
    return above.select("trace_id", "span_id")


def in_order(*columns: str):
    return W.partitionBy("trace_id").orderBy(*columns)


def carried_text(text: Column, *order: str) -> Column:
    """The last non-empty text so far in the trace, this row's included."""
    return F.last(F.nullif(text, F.lit("")), ignorenulls=True).over(in_order(*order).rowsBetween(W.unboundedPreceding, 0))


def prior_texts(text: Column, *order: str) -> Column:
    """All earlier texts of the trace, one per line; a trace's rows are one group, which its own size bounds."""
    return F.array_join(F.collect_list(text).over(in_order(*order).rowsBetween(W.unboundedPreceding, -1)), "\n")


def last_agent_excerpt(steps: DataFrame, limit: int = 520) -> DataFrame:
    """(trace_id, excerpt) of the latest agent step with content, of steps (trace_id, step_index, step_type, content)."""
    said = steps.where(F.col("step_type").isin(AGENT_STEPS) & (F.coalesce("content", F.lit("")) != ""))
    text = one_line(F.max_by("content", "step_index"))
    last = said.groupBy("trace_id").agg(text.alias("text"))
    short = F.concat(F.rtrim(F.substring("text", 1, limit - 1)), F.lit(ELLIPSIS))
    return last.select("trace_id", F.when(F.length("text") > limit, short).otherwise(F.col("text")).alias("excerpt"))


def fold_lines(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, folded): runs of lines that are equal up to white space become the first and a note how often it repeats.

    A text's lines are handled within its row, so nothing is shuffled.
    """
    lines = F.split(F.col(text), "\n")
    marked = F.transform(lines, lambda x: F.struct(x.alias("line"), one_line(x).alias("same")))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("last"), F.lit(0).alias("n"))

    def note(n: Column) -> Column:
        return F.when(n > 0, F.array(F.concat(F.lit("<previous line repeated "), n, F.lit(" times>")))).otherwise(F.array().cast("array<string>"))

    def step(state: Column, x: Column) -> Column:
        repeated = F.coalesce(x["same"] == state["last"], F.lit(False))
        return F.when(repeated, F.struct(state["out"].alias("out"), state["last"].alias("last"), (state["n"] + 1).alias("n"))).otherwise(
            F.struct(F.concat(state["out"], note(state["n"]), F.array(x["line"])).alias("out"), x["same"].alias("last"), F.lit(0).alias("n"))
        )

    folded = F.aggregate(marked, start, step, lambda s: F.array_join(F.concat(s["out"], note(s["n"])), "\n"))
    return texts.select(key, folded.alias("folded"))
