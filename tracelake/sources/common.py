"""What the readers of trace exports share: the flat target tables, files by line, checks of trees.

A reader gives a Snapshot of two DataFrames. traces: trace_id, case_id, source_url, cost_usd, latency_ms, tokens, results
and attributes (variants). spans: trace_id, span_id, parent_id, kind, subtype, name, tool, start, end, input, output
(variants; NULL is `not recorded`, JSON null is a recorded null), error, cost_usd, duration_ms, model, tokens, tool_call and
attributes (variants), sibling (place among its siblings where the source has an order, else NULL: by start, tie and id),
tie (the source's own order of spans that start together). Readers of sources that number no calls add clock_index.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.json_values import kind
from tracelake.functions.tables import bucketed, kept, read_bucketed
from tracelake.operators.evidence import corpus_description
from tracelake.operators.projections import visits
from tracelake.operators.trees import clock_order, cyclic, detach_orphans

KINDS = ["LLM", "TOOL", "AGENT", "CHAIN", "RETRIEVER", "EMBEDDING", "RERANKER", "EVALUATOR", "GUARDRAIL", "UNKNOWN"]
#: A time with an offset; times without one are refused.
ZONED = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:?\d{2})$"
TOKENS = "struct<input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint>"
#: Columns of the two tables with their types; readers fill what they lack with nulls.
SPANS = {
    "trace_id": "string", "span_id": "string", "parent_id": "string", "kind": "string", "subtype": "string", "name": "string", "tool": "string", "start": "timestamp",
    "end": "timestamp", "input": "variant", "output": "variant", "error": "string", "cost_usd": "double", "duration_ms": "double", "model": "string", "tokens": TOKENS,
    "tool_call": "variant", "sibling": "long", "tie": "string", "attributes": "variant",
}
TRACES = {
    "trace_id": "string", "case_id": "string", "source_url": "string", "cost_usd": "double", "latency_ms": "double", "tokens": TOKENS, "results": "variant",
    "attributes": "variant", "position": "long",
}


def completed(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """rows with exactly these columns; missing ones are null."""
    return rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()))


class TraceLoadError(ValueError):
    """An export that can't be read as traces; the message names the file and line or the trace."""


@dataclass
class Snapshot:
    """traces and spans; buckets: of how many buckets by trace_id the tables are, None if they aren't."""

    traces: DataFrame
    spans: DataFrame
    buckets: int | None = None

    def describe(self) -> DataFrame:
        return corpus_description(self.spans, self.traces)

    def save(self, path: str, buckets: int | None = None) -> None:
        """Both tables as Parquet in buckets by trace_id, spans in depth-first order; a failed write leaves nothing behind.

        A later session reads them without parsing anything, and its passes join, group and order by trace without a
        shuffle. The trees are walked once, here. buckets: as many as there are shuffle partitions, if not given; some
        hundred MB each do well.
        """
        spark = self.traces.sparkSession
        buckets = buckets or self.buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(folder):
            raise FileExistsError(path)
        try:
            bucketed(self.traces, f"{path}/traces", "trace_id", buckets)
            bucketed(visits(self.spans), f"{path}/spans", "trace_id", buckets, "dfs_index")
            spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.json(f"{path}/layout")
        except BaseException:
            files.delete(folder, True)
            raise

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Snapshot:
        buckets = spark.read.schema("buckets int").json(f"{path}/layout").first().buckets
        return cls(*(read_bucketed(spark, f"{path}/{t}", "trace_id", buckets) for t in ("traces", "spans")), buckets)

    def kept(self, df: DataFrame) -> DataFrame:
        """A table by trace of this snapshot's analysis, stored as the snapshot itself is."""
        return kept(df, "trace_id", self.buckets)

    def ordered(self) -> DataFrame:
        """Traces in the order of their source."""
        return self.traces.orderBy("position", "trace_id")

    def sorted_by(self, *keys: Column | str) -> Snapshot:
        """The same snapshot with positions by the keys."""
        # A sort by ranges, a number within each range, and the sizes of the ranges before it.
        rows = kept(self.traces.select("trace_id", *keys).orderBy(*keys, "trace_id").select("trace_id", F.monotonically_increasing_id().alias("id")))
        part, place = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit(2**33 - 1))
        sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
        before = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a range
        at = rows.withColumn("part", part).join(F.broadcast(before), "part").select("trace_id", (F.col("before") + place + 1).alias("position"))
        return Snapshot(self.traces.drop("position").join(at, "trace_id").select(*TRACES), self.spans, self.buckets)

    def lookup(self, *trace_ids: str) -> Snapshot:
        """Only these traces; KeyError for ids that aren't there."""
        found = self.traces.where(F.col("trace_id").isin(*trace_ids))
        lost = set(trace_ids) - {r.trace_id for r in found.select("trace_id").collect()}
        if lost:
            raise KeyError(", ".join(sorted(lost)))
        return Snapshot(found, self.spans.where(F.col("trace_id").isin(*trace_ids)), self.buckets)


def lines_of(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(file, line, text) of the non-blank lines of text files; lines count from 1.

    Files are read in splits. A first pass counts the lines of each split, a second adds what lies before it in its file.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    rows = spark.read.options(**options).text(path).select(F.col("value").alias("text"), place.alias("split"), F.monotonically_increasing_id().alias("id"))
    splits = rows.groupBy("split").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.sum("n").over(W.partitionBy("split.file").orderBy("split.at").rowsBetween(W.unboundedPreceding, -1))
    splits = splits.select(F.col("split").alias("_split"), "first", F.coalesce(before, F.lit(0)).alias("before"))
    out = rows.where(F.btrim("text") != "").join(splits, F.col("split") == F.col("_split"))
    return out.select("split.file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "text")


def documents_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text, value) of JSON Lines files (.jsonl), and of other files that hold one JSON value, a list or lines.

    Only files that aren't lines by name are read as one row each.
    """
    lines = lines_of(spark, path, pathGlobFilter="*.jsonl").withColumn("value", F.try_parse_json("text"))
    whole = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")).where(~F.endswith("file", F.lit(".jsonl")))
    whole = whole.withColumn("value", F.try_parse_json("text"))
    is_list = F.schema_of_variant("value").startswith("ARRAY")
    single = whole.where("value IS NOT NULL").select("file", F.posexplode(F.when(is_list, F.col("value").cast("array<variant>")).otherwise(F.array("value"))).alias("line", "value"))
    single = single.select("file", (F.col("line") + 1).cast("long").alias("line"), F.to_json("value").alias("text"), "value")
    split = whole.where("value IS NULL").select("file", F.posexplode(F.split("text", "\r?\n")).alias("line", "text")).where(F.btrim("text") != "")
    split = split.select("file", (F.col("line") + 1).cast("long").alias("line"), "text", F.try_parse_json("text").alias("value"))
    return lines.select("file", F.col("line").cast("long").alias("line"), "text", "value").unionByName(single).unionByName(split)


def all_nodes(first: Column, following: Callable[[Column], Column], rounds: Column) -> Column:
    """All nodes of a row's tree as an array: the first ones, and level after level what follows from each (nodes of the same fields).

    rounds is no less than the number of levels below the first. A tree stays in its row, so however deep it is, one plan
    walks it; rounds after the last level do nothing.
    """
    start = F.struct(first.alias("all"), first.alias("last"))

    def step(state: Column, _: Column) -> Column:
        level = F.flatten(F.transform(state["last"], following))
        return F.when(F.size(level) > 0, F.struct(F.concat(state["all"], level).alias("all"), level.alias("last"))).otherwise(F.struct(state["all"].alias("all"), F.slice(state["last"], 1, 0).alias("last")))

    return F.aggregate(F.sequence(F.lit(0), F.greatest(rounds, F.lit(0))), start, step, lambda state: state["all"])


def filled_lists(value: Column, name: str) -> Column:
    """How many lists of this name a variant holds that aren't empty: no fewer than it has levels of them."""
    return F.regexp_count(F.to_json(value), F.lit(f'"{name}":\\[[^\\]]'))


def require(rows: DataFrame, message: Column, problem: Column) -> None:
    """Raise with up to five messages if a row has the problem."""
    bad = rows.where(F.coalesce(problem, F.lit(False))).select(message.alias("m")).limit(5).collect()
    if bad:
        raise TraceLoadError("; ".join(r.m for r in bad))


def require_all(rows: DataFrame, who: Column, problems: dict[str, Column]) -> None:
    """Raise with up to five messages if rows have any of the problems; the rows are looked at once."""
    first = F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(what)) for what, c in problems.items()))
    require(rows.withColumn("_problem", first), F.concat(who, F.lit(": "), "_problem"), F.col("_problem").isNotNull())


def unique(rows: DataFrame, keys: list[str], what: str) -> None:
    """Raise if two rows have equal keys."""
    again = rows.groupBy(*keys).count().where("count > 1")
    require(again, F.concat(F.lit(f"duplicate {what} "), F.concat_ws(" in ", *keys[::-1])), F.lit(True))


def prompt_tokens(prompt: Column, cached: Column, output: Column) -> Column:
    """Counts with cached tokens taken out of the prompt's; NULL unless all three are there and cached isn't more than the prompt."""
    whole = prompt.isNotNull() & cached.isNotNull() & output.isNotNull() & (cached <= prompt) & (cached >= 0) & (output >= 0)
    return F.when(whole, F.struct((prompt - cached).alias("input_tokens"), cached.alias("cached_input_tokens"), output.alias("output_tokens"))).cast(TOKENS)


def chosen_cost(*given: Column) -> Column:
    """The first recorded cost that isn't negative."""
    return F.coalesce(*(F.when(c >= 0, c) for c in given))


def span_latency(start: Column, end: Column) -> Column:
    """Milliseconds from the first start to the last end; an aggregate."""
    return (F.unix_micros(F.max(end)) - F.unix_micros(F.min(start))) / 1000.0


def within(time: Column, since: str | None, until: str | None, closed: bool = False) -> Column:
    """Whether a time lies from since up to until (itself only if closed); both need an offset and have to be in order."""
    for bound in (since, until):
        if bound is not None and not re.match(ZONED, bound):
            raise ValueError(f"{bound} has no offset")
    moment = lambda t: datetime.fromisoformat(t.replace("Z", "+00:00"))
    if since and until and not (moment(since) <= moment(until) if closed else moment(since) < moment(until)):
        raise ValueError(f"{since} isn't before {until}")
    out = F.lit(True)
    if since:
        out &= time >= F.to_timestamp(F.lit(since))
    if until:
        out &= (time <= F.to_timestamp(F.lit(until))) if closed else (time < F.to_timestamp(F.lit(until)))
    return out


def zoned_time(text: Column) -> Column:
    """A timestamp, NULL for text without an offset."""
    return F.when(text.rlike(ZONED), F.try_to_timestamp(text))


def kind_of(name: Column, aliases: dict[str, str] | None = None) -> tuple[Column, Column]:
    """(kind, subtype): the upper-case name if it is a kind or has an alias, else UNKNOWN; other names stay as subtype."""
    upper = F.upper(F.coalesce(F.nullif(name, F.lit("")), F.lit("UNKNOWN")))
    kind = F.when(upper.isin(KINDS), upper)
    for alias, target in (aliases or {}).items():
        kind = kind.when(upper == alias, F.lit(target))
    return kind.otherwise(F.lit("UNKNOWN")), F.when(~upper.isin(KINDS), upper)


def text_payload(text: Column) -> Column:
    """JSON text as its value, other text as a string, NULL as not recorded."""
    return F.coalesce(F.try_parse_json(text), text.cast("variant"))


def checked(traces: DataFrame, spans: DataFrame, detach: bool, clock: bool = False) -> Snapshot:
    """Unique ids, existing parents (or detached ones, if allowed), no cycles, no span that ends before it starts.

    clock: calls are numbered by time over all branches, not depth first.
    """
    traces, spans = completed(traces, TRACES), kept(completed(spans, SPANS))
    unique(traces, ["trace_id"], "trace")
    unique(spans, ["trace_id", "span_id"], "span")
    attached = detach_orphans(spans)
    who = F.concat(F.lit("trace "), "trace_id", F.lit(", span "), "span_id")
    problems = {
        "it ends before it starts": F.col("end") < F.col("start"), "negative or infinite cost": (F.col("cost_usd") < 0) | F.isnan("cost_usd") | (F.col("cost_usd") == float("inf")),
        "tool_call on a span that is no tool": (kind(F.col("tool_call")) == "OBJECT") & (F.col("kind") != "TOOL"),
    }
    if not detach:
        problems["parent not found"] = F.col("unresolved_parent").isNotNull()
    require_all(attached, who, problems)
    require(cyclic(attached), F.concat(F.lit("parent cycle at "), "span_id"), F.lit(True))
    attached = attached.select(*SPANS, "unresolved_parent")
    return Snapshot(traces, clock_order(attached) if clock else attached)
