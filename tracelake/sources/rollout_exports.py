"""Gym rollouts (JSON or JSON Lines) with an `ng_trajectory` of version 1.0: invocations, captured model calls, observed
tools and turns, joined by what they name. What can't be joined becomes a root and a gap; ambiguity is an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.json_values import at, kind, plain_text, text_at
from tracelake.functions.tables import kept
from tracelake.functions.urls import file_page
from tracelake.sources.atif_exports import message_text
from tracelake.sources.common import Snapshot, TraceLoadError, checked, documents_of, prompt_tokens, require, require_all, unique

#: Statuses that are errors, and items of a conversation (fixed by the format).
FAILED = ["failed", "timeout", "cancelled"]
ITEMS = ["message", "reasoning", "function_call", "function_call_output"]
#: Places of children: invocations, model calls, conversation tools, observed tools, turns; ordered by time first.
PLACE = {"invocation": 0, "model": 1, "tool": 2, "observed": 3, "turn": 4}


def _rows(table: DataFrame, field: str, value: str = "g") -> DataFrame:
    """(trace_id, n, x) of a list in each row's value."""
    return table.select("trace_id", F.posexplode(F.try_variant_get(value, f"$.{field}", "array<variant>")).alias("n", "x"))


def _time(value: Column) -> Column:
    """Seconds since 1970, with fractions."""
    return F.timestamp_micros((F.try_variant_get(value, "$", "double") * 1_000_000).cast("long"))


def _error(row: Column, key: str = "status") -> Column:
    code = F.try_variant_get(row, "$.status_code", "long")
    http = F.when((F.lit(key) == "response_status") & (code >= 400), F.concat(F.lit("HTTP "), code))
    status = text_at(row, f"$.{key}")
    return F.coalesce(F.nullif(text_at(row, "$.error_type"), F.lit("")), F.nullif(text_at(row, "$.error_category"), F.lit("")), http, F.when(status.isin(FAILED), status))


def _named(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def _sibling(what: str, n: Column, start: Column | None = None) -> Column:
    """Timed children first, by time; the others, and equal ones, in the order of the source."""
    time = F.lit(None).cast("long") if start is None else F.unix_micros(start)
    return F.struct(time.isNull().alias("untimed"), time.alias("time"), F.lit(PLACE[what]).alias("of"), n.cast("long").alias("n")).alias("order")


def _conversations(invocations: DataFrame) -> DataFrame:
    """(trace_id, owner, call_id, nth, name, arguments, output, results, prior_user_text, span): calls of conversations with their results."""
    x = F.col("item")
    items = invocations.select("trace_id", "owner", "span_id", F.posexplode(F.try_variant_get("x", "$.conversation", "array<variant>")).alias("place", "item"))
    what = F.coalesce(text_at(x, "$.type"), F.lit("message"))
    said = F.when(text_at(x, "$.role") == "user", message_text(at(x, "$.content"), ("input_text", "text")))
    so_far = F.last(said, ignorenulls=True).over(W.partitionBy("trace_id", "owner").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    items = kept(items.select("*", what.alias("what"), text_at(x, "$.call_id").alias("call_id"), so_far.alias("prior_user_text")))
    where = F.concat(F.lit("trace "), "trace_id", F.lit(", invocation "), "owner", F.lit(", item "), "place")
    calls = items.where("what = 'function_call'")
    given = at(x, "$.arguments")
    arguments = F.when(kind(given) == "STRING", F.try_parse_json(plain_text(given))).otherwise(given)
    require_all(items, where, {
        "unknown item": ~F.col("what").isin(ITEMS), "no call_id": F.startswith("what", F.lit("function_call")) & ~_named(F.col("call_id")),
        "a namespaced function": (F.col("what") == "function_call") & F.coalesce(kind(at(x, "$.namespace")) != "VOID", F.lit(False)),
        "arguments are no object": (F.col("what") == "function_call") & given.isNotNull() & (kind(given) != "VOID") & (F.coalesce(kind(arguments), F.lit("")) != "OBJECT"),
    })
    unique(calls, ["trace_id", "owner", "call_id"], "tool call")
    results = items.where("what = 'function_call_output'").select("trace_id", "owner", "call_id", F.col("place").alias("result_place"), at(x, "$.output").alias("output"))
    unique(results, ["trace_id", "owner", "call_id"], "tool result")
    early = results.join(calls.select("trace_id", "owner", "call_id", "place"), ["trace_id", "owner", "call_id"], "left")
    require(early, F.concat(F.lit("trace "), "trace_id", F.lit(": result without a call before it "), "call_id"), F.col("place").isNull() | (F.col("place") > F.col("result_place")))
    nth = F.row_number().over(W.partitionBy("trace_id", "owner").orderBy("place")) - 1
    out = calls.select("trace_id", "owner", "call_id", nth.alias("nth"), text_at(x, "$.name").alias("name"), arguments.alias("arguments"), "prior_user_text", "span_id", x.alias("call"))
    out = out.join(results.withColumn("results", F.lit(1)), ["trace_id", "owner", "call_id"], "left")
    return out.withColumn("results", F.coalesce("results", F.lit(0)))


def _model_owners(models: DataFrame, invocations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trace_id, n, owner) of captured calls that an invocation refers to, and gaps for references that lead nowhere.

    References with an id join by it, others by response and model: two equi-joins instead of one with OR.
    """
    r = F.col("r")
    refs = invocations.select("trace_id", "owner", F.posexplode(F.try_variant_get("x", "$.model_calls", "array<variant>")).alias("ref", "r"))
    refs = kept(refs.select("trace_id", "owner", "ref", F.nullif(text_at(r, "$.model_call_id"), F.lit("")).alias("model_id"), text_at(r, "$.response_id").alias("response_id"), F.to_json(at(r, "$.model_ref")).alias("model_ref")))
    by_pair = F.col("model_id").isNull()
    require(refs, F.concat(F.lit("trace "), "trace_id", F.lit(": model reference without a key")), by_pair & (~_named(F.col("response_id")) | F.coalesce("model_ref", F.lit("null")).isin("null")))
    m = F.col("x")
    keys = models.select("trace_id", "n", text_at(m, "$.model_call_id").alias("model_id"), text_at(m, "$.response_metadata.response_id").alias("response_id"), F.to_json(at(m, "$.response_metadata.model_ref")).alias("model_ref"))
    found = refs.where(~by_pair).join(keys.select("trace_id", "n", "model_id"), ["trace_id", "model_id"], "left").select("trace_id", "owner", "ref", "n")
    found = kept(found.unionByName(refs.where(by_pair).join(keys.drop("model_id"), ["trace_id", "response_id", "model_ref"], "left").select("trace_id", "owner", "ref", "n")))
    many = found.groupBy("trace_id", "owner", "ref").count().where("count > 1")
    require(many, F.concat(F.lit("trace "), "trace_id", F.lit(": ambiguous model reference of "), "owner"), F.lit(True))
    owners = found.where("n IS NOT NULL").select("trace_id", "n", "owner").distinct()
    unique(owners, ["trace_id", "n"], "owner of model call")
    gaps = found.where("n IS NULL").select("trace_id", F.lit("model_reference_unresolved").alias("code"), F.col("owner").alias("of"))
    return owners, gaps


def read(spark: SparkSession, path: str) -> tuple[Snapshot, DataFrame]:
    """All rollouts of a file or folder, and gaps (trace_id, code, of): the source's own and those of the joins."""
    v, g, x = F.col("value"), F.col("g"), F.col("x")
    found = kept(documents_of(spark, path).withColumn("g", at(v, "$.ng_trajectory")))
    if not found.head(1):
        raise TraceLoadError(f"no traces in {path}")
    place = F.concat_ws(":", "file", "line")
    require_all(found, place, {
        "malformed JSON": v.isNull(), "no ng_trajectory": F.coalesce(kind(g), F.lit("")) != "OBJECT", "unknown schema_version": F.coalesce(text_at(g, "$.schema_version"), F.lit("")) != "1.0",
        "no rollout_id or task_id": ~_named(text_at(g, "$.rollout_id")) | ~_named(text_at(g, "$.task_id")),
    })
    found = found.withColumns({"trace_id": text_at(g, "$.rollout_id"), "task": text_at(g, "$.task_id")})
    where = F.concat(F.lit("trace "), "trace_id", F.lit(", row "), "n")

    invocations = _rows(found, "invocations").select("*", text_at(x, "$.invocation_id").alias("owner"), text_at(x, "$.parent_invocation_id").alias("up"), F.concat(F.lit("gym/invocation/"), "n").alias("span_id"))
    invocations = kept(invocations)
    require_all(invocations, where, {"no invocation_id": ~_named(F.col("owner"))})
    unique(invocations, ["trace_id", "owner"], "invocation")
    ids = invocations.select("trace_id", "owner", F.col("span_id").alias("owner_span"))
    under = lambda rows, column: rows.join(ids.withColumnRenamed("owner", column), ["trace_id", column], "left")
    agents = under(invocations, "up")
    is_message = F.filter(F.try_variant_get(x, "$.conversation", "array<variant>"), lambda i: F.coalesce(text_at(i, "$.type"), F.lit("message")) == "message")
    spans = [agents.select(
        "trace_id", "span_id", F.col("owner_span").alias("parent_id"), F.lit("AGENT").alias("kind"), _error(x).alias("error"), _sibling("invocation", F.col("n")),
        F.when(at(x, "$.conversation").isNotNull(), F.to_variant_object(F.struct(is_message.alias("messages")))).alias("input"), F.to_variant_object(F.struct(x.alias("gym"))).alias("attributes"),
    )]
    gaps = [agents.where("up IS NOT NULL AND owner_span IS NULL").select("trace_id", F.lit("missing_parent_invocation").alias("code"), F.col("owner").alias("of"))]

    models = kept(_rows(found, "model_calls"))
    unique(models.select("trace_id", text_at(x, "$.model_call_id").alias("id")).where("id IS NOT NULL"), ["trace_id", "id"], "model call")
    owners, lost = _model_owners(models, invocations)
    stats = at(x, "$.token_stats")
    counts = [F.try_variant_get(stats, f"$.{k}_tokens", "long") for k in ("prompt", "cached", "completion")]
    require_all(models, where, {"more cached tokens than prompt tokens": counts[1] > counts[0], "negative token count": F.least(*counts) < 0})
    called = under(models.join(owners, ["trace_id", "n"], "left"), "owner")
    start = _time(at(x, "$.started_at"))
    spans.append(called.select(
        "trace_id", F.concat(F.lit("gym/model/"), "n").alias("span_id"), F.col("owner_span").alias("parent_id"), F.lit("LLM").alias("kind"), at(x, "$.request").alias("input"), at(x, "$.response").alias("output"),
        start.alias("start"), _time(at(x, "$.completed_at")).alias("end"), prompt_tokens(*counts).alias("tokens"), text_at(x, "$.response_metadata.model").alias("model"),
        _error(at(x, "$.response_metadata"), "response_status").alias("error"), _sibling("model", F.col("n"), start), F.to_variant_object(F.struct(x.alias("gym"))).alias("attributes"),
    ))
    gaps += [lost, called.where("owner_span IS NULL").select("trace_id", F.lit("model_call_owner_unrecorded").alias("code"), F.col("n").cast("string").alias("of"))]

    # Calls of conversations and observed tools meet in a full outer join.
    seen = _rows(found, "tool_calls").select("trace_id", "n", text_at(x, "$.invocation_id").alias("owner"), text_at(x, "$.tool_call_id").alias("call_id"), x.alias("seen"))
    seen = kept(seen)
    require_all(seen, where, {"no invocation or call id": ~_named(F.col("owner")) | ~_named(F.col("call_id"))})
    unique(seen, ["trace_id", "owner", "call_id"], "tool observation")
    o = F.col("seen")
    both = kept(_conversations(invocations).join(seen, ["trace_id", "owner", "call_id"], "full_outer"))
    observed_name = F.nullif(text_at(o, "$.tool_name"), F.lit(""))
    require(both, F.concat(F.lit("trace "), "trace_id", F.lit(": two names of tool call "), "call_id"), F.col("name") != observed_name)
    both = under(both.drop("span_id"), "owner")
    start, own = _time(at(o, "$.started_at")), F.col("nth").isNotNull()
    late = F.col("output").isNull() & at(o, "$.output").isNotNull()
    result = F.when((F.coalesce("results", F.lit(0)) > 0) | (late & (kind(at(o, "$.output")) != "VOID")), 1).otherwise(0)
    spans.append(both.select(
        "trace_id", F.when(own, F.concat("owner_span", F.lit("/tool/"), "nth")).otherwise(F.concat(F.lit("gym/observed-tool/"), "n")).alias("span_id"), F.col("owner_span").alias("parent_id"),
        F.lit("TOOL").alias("kind"), F.coalesce("name", observed_name).alias("tool"), F.col("arguments").alias("input"), F.when(late, at(o, "$.output")).otherwise(F.col("output")).alias("output"),
        start.alias("start"), _time(at(o, "$.completed_at")).alias("end"), _error(o).alias("error"), _sibling("tool", F.coalesce("nth", F.col("n") + 1_000_000), start),
        F.to_variant_object(F.struct("call_id", F.col("nth").alias("index"), F.when(result > 0, F.col("call_id")).alias("result_id"), result.alias("result_count"), "prior_user_text")).alias("tool_call"),
        F.to_variant_object(F.struct(F.struct(F.col("call").alias("call")).alias("gym"), o.alias("gym_observation"))).alias("attributes"),
    ))
    gaps.append(both.where("owner_span IS NULL").select("trace_id", F.lit("tool_owner_unrecorded").alias("code"), F.col("owner").alias("of")))

    turns = kept(_rows(found, "turns").join(found.select("trace_id", "task"), "trace_id").select("*", text_at(x, "$.invocation_id").alias("owner"), F.try_variant_get(x, "$.turn_no", "long").alias("number")))
    require_all(turns, where, {
        "turn of another rollout": ~F.coalesce((text_at(x, "$.task_id") == F.col("task")) & (text_at(x, "$.rollout_id") == F.col("trace_id")), F.lit(False)),
        "invalid turn number": ~F.coalesce(F.col("number") >= 1, F.lit(False)),
        "no timestamp or step count": ~F.coalesce((F.try_variant_get(x, "$.step_count", "long") >= 0) & _time(at(x, "$.timestamp")).isNotNull(), F.lit(False)),
    })
    unique(turns, ["trace_id", "owner", "number"], "turn")
    turns = under(turns, "owner")
    start = _time(at(x, "$.timestamp"))
    spans.append(turns.select(
        "trace_id", F.concat(F.lit("gym/turn/"), "n").alias("span_id"), F.col("owner_span").alias("parent_id"), F.lit("CHAIN").alias("kind"), start.alias("start"), at(x, "$.question").alias("input"),
        at(x, "$.answer").alias("output"), _sibling("turn", F.col("n"), start), F.to_variant_object(F.struct(x.alias("gym"))).alias("attributes"),
    ))
    gaps.append(turns.where("owner_span IS NULL").select("trace_id", F.lit("turn_owner_unrecorded").alias("code"), F.col("owner").alias("of")))
    gaps.append(_rows(found, "gaps").select("trace_id", F.coalesce(text_at(x, "$.code"), F.lit("source_gap")).alias("code"), F.lit(None).cast("string").alias("of")))

    all_spans = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), spans)
    nth = F.row_number().over(W.partitionBy("trace_id", "parent_id").orderBy("order"))
    all_spans = all_spans.withColumn("sibling", nth.cast("long")).drop("order")
    all_gaps = kept(reduce(DataFrame.unionByName, gaps))
    counts = all_gaps.groupBy("trace_id").agg(F.count("*").alias("gaps"))
    rewards = F.filter(F.array(*(F.struct(F.lit(f"gym.{k}").alias("key"), at(v, f"$.{k}").alias("value")) for k in ("reward", "reward_components"))), lambda e: e["value"].isNotNull())
    traces = found.join(counts, "trace_id", "left").select(
        "trace_id", F.col("task").alias("case_id"), file_page(F.col("file"), F.col("line")).alias("source_url"), F.when(F.size(rewards) > 0, F.to_variant_object(F.map_from_entries(rewards))).alias("results"),
        F.col("line").alias("position"), F.to_variant_object(F.struct(F.col("task").alias("logical_case_id"), F.coalesce("gaps", F.lit(0)).alias("gym_gap_count"), v.alias("gym"))).alias("attributes"),
    )
    return checked(traces, all_spans, detach=False), all_gaps
