"""Approximate nearest neighbours by cosine: multi-index hashing of learned binary codes, reranked on the vectors.

Codes: vectors of length one are centred and turned to their principal axes; rotations are then learned by turns with the
signs they give (iterative quantisation), as many as BITS take. Signs after the rotation are the code.

Index: rows go to shards of bounded size by a hash, so no shard is hot. A shard cuts its codes into substrings of about as
many bits as the logarithm of its rows and keeps one inverted list per substring. All codes within a radius of r bits
differ by r // m bits at most in one of their m substrings, so the lists of all values that near a query's substring hold
every one of them (pigeonhole); whole codes then settle it, and cosines in double precision rank what is left.

Search: every query goes to every shard in two passes. The first takes a small radius and gives each query a lower bound of its
k-th best cosine. What radius vectors above a cosine stay within is measured when the codes are learned, so the second pass
asks for exactly that radius (and narrows it as it finds better ones); queries whose bound is within the first radius are
done. Vectors that have close neighbours touch few lists, vectors without any get a wide radius and not a worse answer.

Only learning uses a sample, of SAMPLE vectors at most by hash; all rows are indexed. Equal vectors are searched once and
indexed k + 1 times at most, by their smallest ids: no further ones can be among the k best. A task holds one shard and
streams any number of queries past it.

Defined results: vectors that are null, empty, zero, or hold null, NaN or infinity take no part, nor those of another length
than most have, nor rows without a vec_id. Repeated rows (same id and vector) count once; different vectors under one id are
rows of their own. Equal cosines go by the smaller vec_id. A query without candidates has no rows. Other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import stored
from tracelake.llm.vectors import matrix, usable, usual_length

#: Bits of a code, vectors that it is learned from, and rounds of learning a rotation.
BITS, SAMPLE, ROUNDS = 128, 10_000, 40
#: Share of the vectors above a cosine whose codes are within the radius for it.
RECALL = 0.99
#: Entries of a shard's vectors at most, and rows of a shard at least while there are fewer shards than shuffle partitions.
SHARD_CELLS, SHARD_ROWS = 8_000_000, 4_096
#: Cosines for which a radius is measured.
GRID = np.linspace(-1, 1, 201)
#: Candidates that are reranked before a query's radius is narrowed.
FIRST = 512


@dataclass
class Codes:
    """Learned codes: code = signs((unit vector - mean) @ planes); radius[i] holds for cosines from GRID[i] on."""

    mean: np.ndarray
    planes: np.ndarray
    radius: np.ndarray

    def encode(self, unit: np.ndarray) -> np.ndarray:
        """One row of bits for each vector of length one."""
        return ((unit - self.mean) @ self.planes > 0).astype(np.uint8)

    def within(self, cosine: float) -> int:
        return int(self.radius[max(0, np.searchsorted(GRID, cosine, "right") - 1)])


def unit_of(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as doubles and their lengths. Where squares would leave the range of doubles, vectors are scaled first: no cosine changes."""
    vectors = vectors.astype(float)
    most = np.abs(vectors).max(axis=1, keepdims=True, initial=0)
    vectors = np.where((most > 1e150) | (most < 1e-150), vectors / np.where(most, most, 1), vectors)
    return vectors, np.sqrt((vectors * vectors).sum(axis=1))


def learn(vectors: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, recall: float = RECALL, seed: int = 11) -> Codes:
    """Codes from a sample of vectors, one in each row."""
    rng = np.random.default_rng(seed)
    vectors, length = unit_of(vectors)
    unit = vectors / length[:, None]
    mean = unit.mean(axis=0)
    _, axes = np.linalg.eigh(np.cov(unit - mean, rowvar=False, bias=True).reshape(unit.shape[1], -1))
    planes = []
    while sum(p.shape[1] for p in planes) < bits:
        main = axes[:, ::-1][:, : bits - sum(p.shape[1] for p in planes)]
        turned = (unit - mean) @ main
        rotation = np.linalg.qr(rng.normal(size=(main.shape[1],) * 2))[0]
        for _ in range(rounds):
            signs = np.where(turned @ rotation > 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(turned.T @ signs)
            rotation = left @ right
        planes.append(main @ rotation)
    codes = Codes(mean, np.concatenate(planes, axis=1), np.full(len(GRID), bits))
    # Pairs at each cosine: a vector, and its mixture with what another one has at right angles to it.
    one, other = unit[rng.integers(0, len(unit), 1000)], unit[rng.integers(0, len(unit), 1000)] + rng.normal(scale=1e-6, size=(1000, unit.shape[1]))
    across = other - (other * one).sum(1, keepdims=True) * one
    size = np.linalg.norm(across, axis=1, keepdims=True)
    across /= np.where(size, size, 1)
    own = codes.encode(one)
    for i, cosine in enumerate(GRID):
        near = codes.encode(cosine * one + np.sqrt(max(0, 1 - cosine * cosine)) * across)
        codes.radius[i] = int(np.ceil(np.quantile((own != near).sum(1), recall)))
    codes.radius[0] = bits  # a query whose bound says nothing asks for all
    codes.radius = np.minimum.accumulate(codes.radius)
    return codes


class Shard:
    """One inverted list per substring of the codes of a shard's rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: Codes):
        self.ids, self.vectors, self.codes = ids, vectors, codes
        wide, self.length = unit_of(vectors)
        bits = codes.encode(wide / self.length[:, None])
        self.scaled = wide if not np.array_equal(wide, vectors) else None
        self.packed = np.packbits(bits, axis=1)
        self.width = int(min(16, max(4, round(np.log2(len(ids) + 1)))))
        self.cuts = list(range(0, bits.shape[1], self.width))
        self.lists = []
        for values in self.substrings(bits):
            order = np.argsort(values, kind="stable")
            found, starts = np.unique(values[order], return_index=True)
            self.lists.append((found, starts, np.append(starts[1:], len(order)), order))

    def substrings(self, bits: np.ndarray):
        for at in self.cuts:
            part = bits[:, at : at + self.width].astype(np.uint32)
            yield part @ (np.uint32(1) << np.arange(part.shape[1], dtype=np.uint32))

    def probe(self, parts: list[int], code: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of every code within a radius, nearest first. With radius = a m + b it is enough that one of the first
        b + 1 substrings is within a bits, or one of the others within a - 1."""
        a, b = divmod(radius, len(self.cuts))
        spans, total = [], 0
        for i, (part, (found, starts, ends, order)) in enumerate(zip(parts, self.lists, strict=True)):
            near = a - (i > b)
            if near >= 0 and total < len(self.ids):
                hit = np.bitwise_count(found ^ np.uint32(part)) <= near
                spans.append((order, starts[hit], ends[hit]))
                total += int((ends[hit] - starts[hit]).sum())
        if total >= len(self.ids):
            rows = np.arange(len(self.ids))  # the lists touched are longer than all rows together
        else:
            rows = np.unique(np.concatenate([order[s:e] for order, starts, ends in spans for s, e in zip(starts, ends, strict=True)] or [np.empty(0, np.int64)]))
        distance = np.bitwise_count(self.packed[rows] ^ code).sum(axis=1)
        near = distance <= radius
        rows, distance = rows[near], distance[near]
        order = np.argsort(distance, kind="stable")
        return rows[order], distance[order]

    def cosines(self, rows: np.ndarray, query: np.ndarray, length: float) -> np.ndarray:
        """Each row's sum is added up in the same order, so equal vectors get equal cosines wherever they are."""
        vectors = (self.vectors if self.scaled is None else self.scaled)[rows].astype(float)
        return (vectors * query).sum(axis=1) / (self.length[rows] * length)

    def search(self, query: np.ndarray, length: float, bits: np.ndarray, parts: list[int], k: int, bound: float | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of up to k rows, the best first. Without a bound, of codes that differ by one bit in some substring."""
        radius = 2 * len(self.cuts) - 1 if bound is None else self.codes.within(bound)
        rows, distance = self.probe(parts, np.packbits(bits), radius)
        scores = self.cosines(rows[:FIRST], query, length)
        if len(rows) > FIRST:
            reached = np.partition(scores, -k)[-k] if len(scores) >= k else -1.0
            rest = rows[FIRST:][distance[FIRST:] <= self.codes.within(max(reached, -1.0 if bound is None else bound))]
            scores = np.concatenate([scores, self.cosines(rest, query, length)])
            rows = np.concatenate([rows[:FIRST], rest])
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][best], scores[best]


def _runs(batch: pa.RecordBatch):
    """(shard, is a query, rows) for each run of a sorted batch."""
    if batch.num_rows:
        key = batch.column("shard").to_numpy() * 2 + batch.column("query").to_numpy()
        cuts = np.flatnonzero(np.diff(key)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(key)], strict=True):
            yield int(key[start] >> 1), bool(key[start] & 1), batch.slice(start, end - start)


def _pass(index: DataFrame, queries: DataFrame, shards: int, codes: Codes, length: int, k: int) -> DataFrame:
    """(query, vec_id, score): the k best of each query (query, embedding, bound) within its radius.

    Rows of a shard come first in their partition, then its queries, a batch at a time.
    """
    rows = index.select("shard", F.lit(0).alias("query"), F.col("vec_id").alias("id"), "embedding", F.lit(None).cast("double").alias("bound"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("query"), F.col("query").alias("id"), "embedding", "bound")
    stream = rows.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "query")

    def work(batches):
        at, ids, vectors, shard = None, [], [], None
        for batch in batches:
            for number, is_query, run in _runs(batch):
                if number != at:
                    at, ids, vectors, shard = number, [], [], None
                if not is_query:
                    ids.append(run.column("id").to_numpy())
                    vectors.append(matrix(run.column("embedding"), length))
                    continue
                if shard is None and ids:
                    shard, ids, vectors = Shard(np.concatenate(ids), np.concatenate(vectors), codes), [0], []
                if shard is None:
                    continue
                wide, sizes = unit_of(matrix(run.column("embedding"), length))
                bits = codes.encode(wide / sizes[:, None])
                parts = np.stack(list(shard.substrings(bits)), axis=1)
                found = [
                    shard.search(wide[i], sizes[i], bits[i], parts[i].tolist(), k, bound)
                    for i, bound in enumerate(run.column("bound").to_pylist())
                ]
                names = np.repeat(run.column("id").to_numpy(), [len(f[0]) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))], ["query", "vec_id", "score"])

    found = stream.mapInArrow(work, "query long, vec_id long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _some(rows: DataFrame, n: int, count: int) -> np.ndarray:
    """About `count` of n vectors by a hash, as a matrix."""
    share = min(1.0, count / max(1, n))
    picked = rows.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1_000_003)) <= int(share * 1_000_003)).select("embedding").limit(2 * count)
    return np.array([r["embedding"] for r in picked.collect()], float)


def search(rows: DataFrame, is_query, k: int = 5, bits: int = BITS, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of every row for which the condition on vec_id holds."""
    spark = rows.sparkSession
    rows = rows.select(F.col("vec_id").cast("long"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding"), zero=False))
    length = usual_length(rows, "embedding")
    rows = rows.where(F.size("embedding") == length).dropDuplicates(["vec_id", "embedding"])
    # A vector's k + 1 smallest ids are all that can be answers; Spark limits them before the shuffle.
    first = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    index = stored(rows.withColumn("rank", first).where(F.col("rank") <= k + 1).drop("rank"), "neighbours-rows")
    n = index.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    codes = learn(_some(index, n, sample), bits)
    least = -(-n // max(1, min(SHARD_ROWS, SHARD_CELLS // length)))
    shards = max(-(-n * length // SHARD_CELLS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), least))
    index = index.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    asking = rows.where(is_query)
    queries = stored(asking.select("embedding").distinct().withColumn("query", F.monotonically_increasing_id()).withColumn("bound", F.lit(None).cast("double")), "neighbours-queries")
    early = stored(_pass(index, queries, shards, codes, length, k + 1), "neighbours-early")
    reached = early.where(F.col("rank") == k + 1).select("query", F.col("score").alias("reached"))
    # The first radius is that of the widest substrings a shard can have; a bound within it leaves nothing to look for.
    least_radius = 2 * -(-bits // 16) - 1
    done = F.element_at(F.array(*[F.lit(int(r)) for r in codes.radius]), F.greatest(F.lit(1), F.floor((F.col("reached") + 1) * 100).cast("int") + 1)) <= least_radius
    bounds = stored(queries.drop("bound").join(reached, "query", "left").select("query", "embedding", F.coalesce("reached", F.lit(-1.0)).alias("bound"), F.coalesce(done, F.lit(False)).alias("done")), "neighbours-bounds")
    late = _pass(index, bounds.where(~F.col("done")), shards, codes, length, k + 1)
    answers = late.unionByName(early.join(bounds.where("done").select("query"), "query", "left_semi"))
    # Back from vectors to the rows that ask: a row's own id goes.
    asked = asking.join(queries.select("query", "embedding"), "embedding").select(F.col("vec_id").alias("query_id"), "query")
    own = asked.join(answers, "query").withColumn("own", F.col("vec_id") == F.col("query_id"))
    return _ranked(own, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query and vector but for the row itself, which is the first of its id among equal cosines."""
    by = Window.partitionBy("query_id", "query")
    others = found.withColumn("self", F.col("own") & (F.row_number().over(by.orderBy(F.desc("own"), F.desc("score"))) == 1)).where(~F.col("self"))
    rank = F.row_number().over(by.orderBy(F.desc("score"), "vec_id"))
    return others.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
