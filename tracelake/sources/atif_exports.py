"""ATIF trajectories (JSON Lines): steps of an agent with tool calls and observations, and sub-agents inside.

A trajectory becomes an AGENT span, a step an LLM or CHAIN span below it, a tool call a TOOL span below its step. Results
belong to the call that they name, others are CHAIN spans of their own. A sub-agent hangs where a result refers to it,
else below its trajectory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracelake.functions.json_values import at, kind, plain_text, text_at
from tracelake.functions.tables import kept
from tracelake.functions.urls import file_page
from tracelake.sources.common import Snapshot, TraceLoadError, all_nodes, checked, filled_lists, lines_of, prompt_tokens, require, require_all, unique, zoned_time

VERSION = r"^ATIF-v1\.[0-8]$"
#: What only an agent's steps may have, and what a step without a model call may not.
AGENT_ONLY = ["model_name", "tool_calls", "metrics", "reasoning_content", "reasoning_effort"]
MODEL_ONLY = ["metrics", "reasoning_content"]
#: Places after all steps, or after all tool calls of a step.
AFTER = 1_000_000


def _array(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "array<variant>")


def _has(value: Column, path: str) -> Column:
    return F.coalesce(kind(at(value, path)) != "VOID", F.lit(False))


def message_text(message: Column, types: tuple[str, ...] = ("text",)) -> Column:
    """A string itself, else the text parts of a list, one per line."""
    parts = F.filter(F.try_variant_get(message, "$", "array<variant>"), lambda p: text_at(p, "$.type").isin(*types) & text_at(p, "$.text").isNotNull())
    return F.coalesce(plain_text(message), F.array_join(F.transform(parts, lambda p: text_at(p, "$.text")), "\n"))


def _tokens(metrics: Column, prefix: str = "") -> Column:
    return prompt_tokens(*(F.try_variant_get(metrics, f"$.{prefix}{k}", "long") for k in ("prompt_tokens", "cached_tokens", "completion_tokens")))


def _token_problems(metrics: Column, prefix: str = "") -> dict[str, Column]:
    keys = [prefix + k for k in ("prompt_tokens", "cached_tokens", "completion_tokens")]
    n = {k: F.try_variant_get(metrics, f"$.{k}", "long") for k in keys}
    return {
        "token counts aren't whole numbers": F.lit(False) | sum((_has(metrics, f"$.{k}") & ((kind(at(metrics, f"$.{k}")) != "BIGINT") | (n[k] < 0))).cast("int") for k in keys).cast("boolean"),
        "more cached tokens than prompt tokens": n[keys[1]] > n[keys[0]],
    }


def _trajectories(lines: DataFrame) -> DataFrame:
    """(trace_id, span_id, above, own_id, sibling, v): all trajectories, by the span of the one that holds them, walked in their row."""
    none = F.lit(None).cast("string")
    first = F.array(F.struct(F.lit("trajectory").alias("span_id"), none.alias("above"), none.alias("own_id"), F.lit(0).alias("sibling"), F.col("v").alias("v")))
    empty = F.array().cast("array<struct<span_id:string,above:string,own_id:string,sibling:int,v:variant>>")

    def inner(n: Column) -> Column:
        made = F.transform(_array(n["v"], "$.subagent_trajectories"), lambda v, i: F.struct(
            F.concat(n["span_id"], F.lit("/subagent/"), i).alias("span_id"), n["span_id"].alias("above"), text_at(v, "$.trajectory_id").alias("own_id"), (i + AFTER).alias("sibling"), v.alias("v"),
        ))
        return F.coalesce(made, empty)

    return lines.select("trace_id", F.explode(all_nodes(first, inner, filled_lists(F.col("v"), "subagent_trajectories"))).alias("n")).select("trace_id", "n.*")


def read(spark: SparkSession, path: str) -> Snapshot:
    """All trajectories of a file or folder. Raises TraceLoadError with file and line, or the span, for what isn't valid."""
    v, s = F.col("v"), F.col("s")
    lines = kept(lines_of(spark, path).withColumn("v", F.try_parse_json("text")).drop("text"))
    if not lines.head(1):
        raise TraceLoadError(f"no traces in {path}")
    place = F.concat_ws(":", "file", "line")
    names = [F.nullif(text_at(v, f"$.{k}"), F.lit("")) for k in ("trajectory_id", "session_id")]
    require_all(lines, place, {"malformed JSON": v.isNull(), "no trajectory_id and no session_id": F.coalesce(*names).isNull()})
    lines = lines.withColumn("trace_id", F.coalesce(*names))
    all_of = kept(_trajectories(lines))
    where = F.concat(F.lit("trace "), "trace_id", F.lit(", "), "span_id")
    require_all(all_of, where, {
        "unknown schema_version": ~F.coalesce(text_at(v, "$.schema_version").rlike(VERSION), F.lit(False)), "no agent name and version": text_at(v, "$.agent.name").isNull() | text_at(v, "$.agent.version").isNull(),
        "steps is no list": _array(v, "$.steps").isNull(), "it continues elsewhere": F.coalesce(text_at(v, "$.continued_trajectory_ref"), F.lit("")) != "",
        "an embedded sub-agent has no trajectory_id": F.col("above").isNotNull() & (F.coalesce("own_id", F.lit("")) == ""),
    })
    unique(all_of.where("above IS NOT NULL"), ["trace_id", "above", "own_id"], "sub-agent")

    step_rows = all_of.select("trace_id", F.col("span_id").alias("parent_id"), text_at(v, "$.agent.model_name").alias("agent_model"), F.posexplode(_array(v, "$.steps")).alias("sibling", "s"))
    source = text_at(s, "$.source")
    step_rows = step_rows.select("*", F.concat("parent_id", F.lit("/step/"), F.col("sibling") + 1).alias("span_id"), source.alias("source"))
    is_agent = F.col("source") == "agent"
    is_llm = is_agent & (F.coalesce(F.try_variant_get(s, "$.llm_call_count", "long"), F.lit(1)) != 0)
    any_of = lambda keys: F.coalesce(*(F.when(_has(s, f"$.{k}"), True) for k in keys), F.lit(False))
    metrics = at(s, "$.metrics")
    cost = at(metrics, "$.cost_usd")
    require_all(step_rows, where, {
        "step_id isn't sequential from 1": ~F.coalesce(F.try_variant_get(s, "$.step_id", "long") == F.col("sibling") + 1, F.lit(False)),
        "unknown source": ~F.coalesce(F.col("source").isin("system", "user", "agent"), F.lit(False)), "no message": ~F.coalesce(kind(at(s, "$.message")).isin("STRING", "ARRAY"), F.lit(False)),
        "only an agent's step has a model, tool calls, reasoning or metrics": ~is_agent & any_of(AGENT_ONLY),
        "a step without a model call has no metrics or reasoning": is_agent & ~is_llm & any_of(MODEL_ONLY), "cost is no number": _has(metrics, "$.cost_usd") & kind(cost).isin("STRING", "BOOLEAN", "OBJECT", "ARRAY"),
        **_token_problems(metrics),
    })
    said = F.when(F.col("source") == "user", message_text(at(s, "$.message")))
    so_far = F.last(said, ignorenulls=True).over(W.partitionBy("trace_id", "parent_id").orderBy("sibling").rowsBetween(W.unboundedPreceding, 0))
    step_rows = kept(step_rows.withColumn("prior_user_text", so_far))
    message = F.to_json(at(s, "$.message"))
    told = F.parse_json(F.concat(F.lit('{"messages":[{"role":"'), "source", F.lit('","content":'), message, F.lit("}]}")))
    step_spans = step_rows.select(
        "trace_id", "span_id", "parent_id", F.col("sibling").cast("long").alias("sibling"), F.when(is_llm, "LLM").otherwise("CHAIN").alias("kind"),
        zoned_time(text_at(s, "$.timestamp")).alias("start"), F.when(~is_agent, told).alias("input"),
        F.when(is_agent, F.parse_json(F.concat(F.lit('{"role":"assistant","content":'), message, F.lit("}")))).alias("output"),
        F.when(is_llm, F.coalesce(F.nullif(text_at(s, "$.model_name"), F.lit("")), "agent_model")).alias("model"), F.try_variant_get(cost, "$", "double").alias("cost_usd"),
        _tokens(metrics).alias("tokens"), F.to_variant_object(F.struct(s.alias("atif"))).alias("attributes"),
    )

    # Calls and their results, by step and call id.
    call, result = F.col("call"), F.col("result")
    calls = step_rows.select("trace_id", F.col("span_id").alias("parent_id"), "prior_user_text", F.posexplode(_array(s, "$.tool_calls")).alias("sibling", "call"))
    calls = calls.select("*", F.concat("parent_id", F.lit("/tool/"), "sibling").alias("span_id"), text_at(call, "$.tool_call_id").alias("call_id"))
    require_all(calls, where, {"no call id or function": (F.coalesce("call_id", F.lit("")) == "") | (F.coalesce(text_at(call, "$.function_name"), F.lit("")) == "")})
    unique(calls, ["trace_id", "parent_id", "call_id"], "tool call")
    results = step_rows.select("trace_id", F.col("span_id").alias("step"), F.posexplode(_array(s, "$.observation.results")).alias("place", "result"))
    results = kept(results.withColumn("call_id", text_at(result, "$.source_call_id")))
    owners = calls.select("trace_id", F.col("parent_id").alias("step"), "call_id", F.col("span_id").alias("owner"))
    owned = results.where("call_id IS NOT NULL").join(owners, ["trace_id", "step", "call_id"], "left")
    require(owned, F.concat(F.lit("trace "), "trace_id", F.lit(", "), "step", F.lit(": result of an unknown call "), "call_id"), F.col("owner").isNull())
    lists = owned.groupBy("trace_id", F.col("owner").alias("span_id")).agg(F.sort_array(F.collect_list(F.struct("place", F.to_json("result").alias("r")))).alias("rs"))
    first = F.try_parse_json(F.get("rs", F.lit(0))["r"])
    several = F.parse_json(F.concat(F.lit("["), F.array_join(F.transform("rs", lambda x: x["r"]), ","), F.lit("]")))
    tool_spans = calls.join(lists, ["trace_id", "span_id"], "left").withColumn("n", F.coalesce(F.size("rs"), F.lit(0))).select(
        "trace_id", "span_id", "parent_id", F.col("sibling").cast("long").alias("sibling"), F.lit("TOOL").alias("kind"), text_at(call, "$.function_name").alias("tool"), at(call, "$.arguments").alias("input"),
        F.when(F.col("n") == 1, at(first, "$.content")).when(F.col("n") > 1, several).alias("output"),
        F.to_variant_object(F.struct("call_id", F.when(F.col("n") > 0, F.col("call_id")).alias("result_id"), F.col("n").alias("result_count"), "prior_user_text")).alias("tool_call"),
        F.to_variant_object(F.struct(F.struct(call.alias("call"), F.when(F.col("n") > 0, several).alias("results")).alias("atif"))).alias("attributes"),
    )
    loose = results.where("call_id IS NULL").withColumn("nth", F.row_number().over(W.partitionBy("trace_id", "step").orderBy("place")) - 1)
    loose = loose.withColumn("owner", F.concat("step", F.lit("/observation/"), "nth"))
    loose_spans = loose.select(
        "trace_id", F.col("owner").alias("span_id"), F.col("step").alias("parent_id"), (F.col("nth") + AFTER).cast("long").alias("sibling"), F.lit("CHAIN").alias("kind"),
        at(result, "$.content").alias("output"), F.to_variant_object(F.struct(result.alias("atif"))).alias("attributes"),
    )

    # Sub-agents below the result that refers to them; a reference is looked up in its own trajectory.
    with_owner = owned.select("trace_id", "step", "owner", "place", "result").unionByName(loose.select("trace_id", "step", "owner", "place", "result"))
    refs = with_owner.select("trace_id", F.regexp_replace("step", r"/step/\d+$", "").alias("above"), "owner", "place", F.posexplode(_array(result, "$.subagent_trajectory_ref")).alias("nth", "r"))
    refs = refs.select("trace_id", "above", "owner", F.coalesce(text_at(F.col("r"), "$.trajectory_id"), F.lit("")).alias("own_id"), (F.col("place") * 1000 + F.col("nth")).alias("at"))
    agents = all_of.select("trace_id", "above", "own_id", "span_id")
    unknown = refs.join(agents, ["trace_id", "above", "own_id"], "left_anti")
    require(unknown, F.concat(F.lit("trace "), "trace_id", F.lit(": no embedded sub-agent "), "own_id"), F.lit(True))
    unique(refs, ["trace_id", "above", "own_id"], "reference to sub-agent")
    agent_spans = all_of.join(refs, ["trace_id", "above", "own_id"], "left").select(
        "trace_id", "span_id", F.coalesce("owner", "above").alias("parent_id"), F.coalesce("at", "sibling").cast("long").alias("sibling"), F.lit("AGENT").alias("kind"),
        text_at(v, "$.agent.name").alias("name"), F.to_variant_object(F.struct(F.struct(at(v, "$.schema_version").alias("schema_version"), at(v, "$.agent").alias("agent"), at(v, "$.final_metrics").alias("final_metrics")).alias("atif"))).alias("attributes"),
    )
    totals = at(v, "$.final_metrics")
    require_all(lines, place, _token_problems(totals, "total_"))
    traces = lines.select(
        "trace_id", names[1].alias("case_id"), file_page(F.col("file"), F.col("line")).alias("source_url"), F.try_variant_get(totals, "$.total_cost_usd", "double").alias("cost_usd"),
        _tokens(totals, "total_").alias("tokens"), F.col("line").alias("position"), F.to_variant_object(F.struct(names[1].alias("logical_case_id"), at(v, "$.agent").alias("agent"), totals.alias("final_metrics"))).alias("attributes"),
    )
    spans = step_spans
    for more in (tool_spans, loose_spans, agent_spans):
        spans = spans.unionByName(more, allowMissingColumns=True)
    return checked(traces, spans, detach=False)
