"""Line dedup: lines that spread over many distinct sites are boilerplate.

A HyperLogLog sketch of the sites is kept per line hash; sketches merge by aggregation, so a line that is in a third
of all documents costs one small sketch per task. Where the estimate lies near the threshold, the distinct sites of
just those lines are counted exactly. Everything runs as DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import same_row, small, stored

#: Distinct sites from which on a line is boilerplate.
MIN_SITES = 10
#: log2 of the registers of a sketch; its relative standard error is 1.04 / sqrt(2 ** LG_K).
LG_K = 12


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    """128 bits that stand for a line without its outer spaces."""
    bare = F.trim(line)
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit("line"), bare).alias("b"))


def boilerplate_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(key, owner) of each line on min_sites or more distinct sites; owner is the smallest doc_id that has it."""
    lines = docs.select(
        F.col("doc_id").alias("doc"), F.col(site).alias("site"), F.explode(_lines(F.col("text"))).alias("line")
    ).where(F.trim("line") != "")
    lines = lines.select("doc", "site", _key(F.col("line")).alias("key"))
    spread = lines.groupBy("key").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min("doc").alias("owner"))
    spread = spread.select("key", "owner", F.hll_sketch_estimate("sketch").alias("sites"))
    margin = max(1.0, 4 * 1.04 / 2 ** (LG_K / 2) * min_sites)
    spread = stored(spread.where(F.col("sites") >= min_sites - margin), "line-spread")
    clear = spread.where(F.col("sites") > min_sites + margin).select("key", "owner")
    near = spread.where(F.col("sites") <= min_sites + margin).select("key", "owner")
    exact = (
        lines.join(small(near), "key")
        .groupBy("key", "owner", "site").agg(F.lit(1).alias("seen"))
        .groupBy("key", "owner").agg(F.count("site").alias("sites"))
        .where(F.col("sites") >= min_sites)
        .select("key", "owner")
    )
    return clear.unionByName(exact)


def remove_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """docs with cross-site boilerplate lines taken out of text, and columns n_lines and n_removed added.

    The first occurrence of a boilerplate line in the document with the smallest doc_id stays, so no content vanishes
    from the corpus. Lines count as equal if they are equal without outer spaces; blank lines always stay.

    Nulls: a null text stays null (n_lines and n_removed 0); a null site is no site; null doc_ids count as one
    document. An empty text has one (blank) line. Repeated rows stay repeated; of rows with one doc_id and different texts
    each keeps its own first occurrence. An empty table gives an empty table. Other columns pass through; columns of docs
    named n_lines or n_removed are replaced, and names that begin with `_ld_` are reserved.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    docs = docs.select(*columns, F.xxhash64("text").alias("_ld_hash"))
    found = small(stored(boilerplate_lines(docs, site, min_sites), "line-boilerplate"))
    hits = docs.select(F.col("doc_id").alias("_ld_doc"), F.col("_ld_hash").alias("_ld_of"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    hits = hits.select("_ld_doc", "_ld_of", "pos", _key(F.col("line")).alias("key")).join(found, "key")
    # Places of boilerplate lines in their text; of a document's own lines all but the first.
    per_line = hits.groupBy("_ld_doc", "_ld_of", "key", "owner").agg(F.collect_set("pos").alias("places"))
    own = same_row(F.col("_ld_doc"), F.col("owner"))
    drop = F.when(own, F.array_except("places", F.array(F.array_min("places")))).otherwise(F.col("places"))
    per_doc = per_line.groupBy("_ld_doc", "_ld_of").agg(F.flatten(F.collect_list(drop)).alias("_ld_drop"))
    out = docs.join(per_doc, same_row(F.col("doc_id"), F.col("_ld_doc")) & (F.col("_ld_hash") == F.col("_ld_of")), "left")
    out = out.withColumn("_ld_lines", _lines(F.col("text")))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("_ld_lines")).cast("long")
    gone = F.coalesce(F.size("_ld_drop"), F.lit(0))
    # Both array functions hash, so a text of many lines takes time in proportion to them.
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_ld_lines") - 1), "_ld_drop"), lambda p: F.get(F.col("_ld_lines"), p))
    out = out.withColumns({
        "n_lines": n, "n_removed": F.when(F.col("text").isNull() | (gone < 0), 0).otherwise(gone).cast("long"),
        "text": F.when(gone > 0, F.array_join(kept, "\n")).otherwise(F.col("text")),
    })
    return out.select(*columns, "n_lines", "n_removed")


ORACLE = f"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
b AS (
  SELECT trim(line, ' ') AS k, min(doc_id) AS own FROM l WHERE trim(line, ' ') <> ''
  GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}),
m AS (
  SELECT l.doc_id, l.pos, l.line, b.k IS NOT NULL AND (b.own <> l.doc_id OR row_number() OVER (PARTITION BY l.doc_id, trim(l.line, ' ') ORDER BY l.pos) > 1) AS gone
  FROM l LEFT JOIN b ON trim(l.line, ' ') = b.k),
g AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY 1)
SELECT d.doc_id, coalesce(g.n_lines, 0)::BIGINT AS n_lines, coalesce(g.n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(g.kept, '') END AS text
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_boilerplate(docs).select("doc_id", "n_lines", "n_removed", "text")
