"""Helpers on whole tables: cutting lineage, columns that are worked out once, exact quantiles of long columns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Share of rows on each side of its place that an exact quantile looks at, and the accuracy of the quantiles that bound it.
MIDDLE, ACCURACY = 0.002, 2000


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own where it is unset (local masters only)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tracelake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def bucketed(df: DataFrame, path: str, key: str, buckets: int, *order: str) -> DataFrame:
    """Write df to a new folder as a Parquet table of buckets by key, one sorted file each, and read it."""
    name = f"tracelake_{uuid.uuid4().hex}"
    rows = df.repartition(buckets, key)
    rows.write.format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key, *order).saveAsTable(name)
    return df.sparkSession.table(name)


def read_bucketed(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    """A table that bucketed() wrote, maybe in another session: joins, windows and groups by key need no shuffle."""
    name = f"tracelake_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
    place = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{place}'")
    return spark.table(name)


def kept(df: DataFrame, key: str | None = None, buckets: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, lost executors don't matter, later reads prune columns. forget() deletes it.

    With a key and buckets it is a table of buckets.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tracelake-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    if key and buckets:
        return bucketed(df, path, key, buckets)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Delete all that kept() wrote for this application. Tables that still read it can't be used afterwards."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/tracelake-{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def settled(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """rows with the columns, each worked out once per row however often later expressions use it.

    A generator with one row stands between, through which the optimiser doesn't move expressions; long chains of
    decoders would otherwise be expanded into each other.
    """
    made = F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    return rows.select(*(c for c in rows.columns if c not in columns), made)


def exact_quantiles(rows: DataFrame, key: str, value: str, name: str, share: float) -> DataFrame:
    """(key, name): per key the value below which a share of the values lies, between neighbouring values in proportion; nulls left out.

    Approximate quantiles bound it; the exact ranks of the few values between the bounds tell the rest, so no task holds
    all values of a key. Equal values count as one. rows are read twice.
    """
    rows = rows.where(F.col(value).isNotNull()).select(key, value)
    ends = [max(0.0, share - MIDDLE), min(1.0, share + MIDDLE)]
    bounds = rows.groupBy(key).agg(F.percentile_approx(value, ends, ACCURACY).alias("b"), F.count("*").alias("n"))
    bounds = bounds.select(key, F.col("b")[0].alias("low"), F.col("b")[1].alias("high"), "n")
    # What lies below the bounds counts as one value, the largest of them, and what lies above as the smallest: in short columns
    # a neighbour of the place can be just outside.
    x = F.col(value)
    zone = F.when(x < F.col("low"), -1).when(x > F.col("high"), 1).otherwise(0)
    zoned = rows.join(bounds, key).groupBy(key, "n", zone.alias("zone"), F.when(zone == 0, x).alias("v")).agg(F.count("*").alias("c"), F.min(x).alias("least"), F.max(x).alias("most"))
    counts = zoned.withColumn("v", F.when(F.col("zone") < 0, F.col("most")).otherwise(F.col("least")))
    up_to = F.sum("c").over(W.partitionBy(key).orderBy("zone", "v").rowsBetween(W.unboundedPreceding, 0))
    ranked = counts.withColumn("last", up_to)
    # Ranks from 1 of the two values around the place.
    place = (F.col("n") - 1) * F.lit(share)
    holds = lambda rank: (F.col("last") >= rank) & (F.col("last") - F.col("c") < rank)
    around = ranked.groupBy(key).agg(
        F.max(F.when(holds(F.floor(place) + 1), F.col("v"))).alias("a"), F.max(F.when(holds(F.ceil(place) + 1), F.col("v"))).alias("b"), F.max(place - F.floor(place)).alias("w")
    )
    between = F.when(F.col("w") == 0.5, (F.col("a") + F.col("b")) / 2).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("w"))
    return around.select(key, between.alias(name))


def exact_medians(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, name): the median of value per key; see exact_quantiles()."""
    return exact_quantiles(rows, key, value, name, 0.5)
