"""Fixed adapters from the generic test tables to traces, calls, steps and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tool calls: a trace per user, the tool and the arguments from props, errors as failed calls."""
    k = F.regexp_extract("props", r"\d+", 0).cast("int")
    index = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    failed = F.col("event_type") == "error"
    text = F.concat(F.lit("Error: request "), F.col("event_id"), F.lit(" failed after "), F.col("value").cast("decimal(18,2)"), F.lit(" s at /srv/app/mod"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("trace_id"), (F.col("user_id") % 50).alias("case_id"), F.col("event_id").alias("call_id"), index.cast("long").alias("call_index"),
        F.concat(F.lit("op_"), k % 5).alias("tool"), k.alias("k"), F.parse_json("props").alias("arguments"), failed.alias("failed"),
        F.when(failed, text).otherwise(F.lit("done")).cast("variant").alias("output"), F.when(failed, text).alias("error_text"),
        F.lit(None).cast("string").alias("error"), F.col("value").alias("duration_ms"), "ts", "event_type",
    )


def audit_calls(calls: DataFrame) -> DataFrame:
    """calls with the columns that the audit needs and an adapter lacks, empty."""
    empty = {
        "result_count": "int", "result_id": "string", "alias_of": "string", "explicit_error": "boolean", "outcome_marker": "string", "prior_user_text": "string",
        "complete_provenance": "boolean", "has_catalog": "boolean", "schema": "string", "arguments": "variant", "output": "variant",
    }
    return calls.withColumns({c: F.lit(None).cast(t) for c, t in empty.items() if c not in calls.columns})


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as tool calls: a trace per order, the line number as call id."""
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    order = W.partitionBy("l_orderkey").orderBy(*columns[1:])
    count = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("trace_id"), F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").cast("long").alias("call_id"),
        (F.row_number().over(order) - 1).cast("long").alias("call_index"), F.concat(F.lit("T"), F.col("l_suppkey") % 8).alias("tool"),
        (F.col("l_partkey") % 7).alias("result_id"), count.alias("result_count"), F.lit("ok").cast("variant").alias("output"),
    )


def order_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.concat_ws(" ", "o_orderstatus", "o_orderpriority")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("trace_id"), F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("position"), verdict.alias("verdict"), F.col("o_totalprice").alias("cost"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as spans: user and system turns are roots, an assistant turn is a child of the turn before it."""
    parent = F.when(F.col("role") == "assistant", F.lag("turn").over(W.partitionBy("conv_id").orderBy("turn")))
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("trace_id"), F.col("turn").alias("span_id"), parent.alias("parent_id"), F.col("turn").alias("start"), "role", "text"
    )
