"""A training corpus from raw documents, in five stages; each works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import bpe, decontaminate, jaccard_join, kneser_ney, line_dedup
from tracelake.llm.common import small, stored

#: Near duplicates: words of a shingle, and similarity in percent.
SHINGLE, PERCENT = 5, 80


def _without(docs: DataFrame, dropped: DataFrame, name: str) -> DataFrame:
    """docs but for the rows whose doc_id and text are those of dropped (doc_id, text_hash). Names beginning with `_cp_` are reserved."""
    gone = small(stored(dropped.select(F.col("doc_id").alias("_cp_id"), F.col("text_hash").alias("_cp_hash")).distinct(), name))
    same = F.col("doc_id").eqNullSafe(F.col("_cp_id")) & (F.xxhash64("text") == F.col("_cp_hash"))
    return docs.join(gone, same, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like trusted ones of their language; null and wordless texts go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = kneser_ney.classify(docs, kneser_ney.trusted_documents(labels))
    return _without(docs, judged.where(~F.col("keep")), "pipeline-rejected")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site boilerplate lines; one that consisted of such lines alone goes."""
    done = line_dedup.remove_boilerplate(docs)
    done = done.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates; of equal ids the text with the smallest hash.

    Rows go by doc_id and text, so different texts under one doc_id, or under none, are judged each by itself. Of repeated
    rows one stays. A null doc_id is larger than all others.
    """
    rows = stored(jaccard_join.link_documents(docs, SHINGLE, PERCENT, more=True).select("doc_id", "text_hash", "group"), "pipeline-groups")
    again = rows.groupBy("doc_id", "text_hash").count().where("count > 1").head(1)
    grouped = rows.where(F.col("group").isNotNull())
    # Nulls last: the smallest number of its kind stands for a null doc_id, behind a flag.
    row = F.struct(F.col("doc_id").isNull().alias("_cp_null"), "doc_id", "text_hash")
    winners = grouped.groupBy("group").agg(F.min(row).alias("w"), F.count_distinct(row).alias("n")).where("n > 1")
    losers = grouped.join(winners, "group").where(row != F.col("w"))
    kept = _without(docs, losers, "pipeline-duplicates")
    return kept.withColumn("_cp_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_cp_hash"]).drop("_cp_hash") if again else kept


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item; those without a doc_id included."""
    copies = decontaminate.find_copies(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, copies, "pipeline-contaminated")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document."""
    return bpe.digests(docs, bpe.default_tokenizer())


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("BPE encoding and decoding", tokens),
]

#: Perplexities and merges have no SQL form; tests hold the pipeline against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-stage-{i}")
    return docs
