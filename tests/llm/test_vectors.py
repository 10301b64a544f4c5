"""Whitening and nearest neighbours against plain numpy versions over all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import neighbours, whitening

SCHEMA = "vec_id long, embedding array<double>, label int, n long, shard int, query long, score double, component int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, 3, 4, 5.0, 6) for i, v in rows], SCHEMA).repartition(3)


def odd_rows(dim):
    """Rows that take no part in either operator."""
    return [(900, None), (950, []), (1000, [None] + [1.0] * (dim - 1)), (1050, [math.nan] + [1.0] * (dim - 1)), (1100, [math.inf] * dim), (1150, [1.0] * (dim + 1))]


def check_whitening(rows, got, k):
    """rows: those that take part."""
    x = np.array([[int(math.floor(64 * c)) + 1_000_000 for c in v] for _, v in rows], object)
    n, sums = len(x), x.sum(0)
    deviations = ((n * x - sums) ** 2).sum(1)
    centred = (n * x - sums).astype(float) / n
    cov = centred.T @ centred / n
    values = np.linalg.eigvalsh(cov)[::-1]
    wide = sum(v > 1e-12 * values.sum() for v in values[:k])
    got = got.assign(copy=got.groupby(["vec_id", "deviation", "component"]).cumcount()).sort_values(["vec_id", "deviation", "copy", "component"])
    assert len(got) == n * wide and set(got.n) == {n} and got.component.tolist() == list(range(1, wide + 1)) * n
    ids = [-1 if i is None else i for i, _ in rows]
    order = sorted(range(n), key=lambda i: (ids[i], deviations[i]))
    assert got.deviation.tolist() == [int(deviations[i]) for i in order for _ in range(wide)]
    white = got.whitened.to_numpy().reshape(n, wide)
    # Each component's coordinates are centred, of unit variance, uncorrelated, and give back an eigenvector of V.
    assert np.abs(white.T @ white / n - np.eye(wide)).max() < 1e-8
    back = centred[order].T @ white / n
    vectors = back / np.linalg.norm(back, axis=0)
    assert np.abs(cov @ vectors - vectors * values[:wide]).max() < 1e-10 * values[0]
    explained = got.explained.to_numpy().reshape(n, wide)
    assert np.allclose(explained, values[:wide] / values.sum(), rtol=1e-9) and (explained == explained[0]).all()
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-8


@pytest.mark.parametrize("kind", ["flat", "steep", "narrow", "large"])
def test_whitening(spark, kind):
    rng = np.random.default_rng(3)
    dim = 6 if kind == "narrow" else 40
    scale = {"flat": np.ones(dim), "steep": 3.0 ** -np.arange(dim) * 1e4, "narrow": np.arange(1, dim + 1), "large": np.ones(dim) * 1e9}[kind]
    vectors = rng.normal(size=(90, dim)) * scale
    rows = [(None if i == 5 else i, v) for i, v in enumerate(vectors)] + [(3, vectors[3]), (4, vectors[9])]
    df = table(spark, rows + odd_rows(dim) + [(1200, [2.0**47] * dim)])
    fitted = whitening.fit(df, 8, oversample=4, power=6)
    assert fitted.full == (kind != "steep") and fitted.n == 92
    got = whitening.whiten(df, 8, oversample=4, power=6).toPandas()
    if kind == "large":  # beyond 64 bits
        assert got.deviation.isna().all()
        got["deviation"] = None
        assert got.identity_error.max() < 1e-8 and len(got) == 92 * 8
        return
    got["vec_id"] = got.vec_id.fillna(-1).astype(int)
    check_whitening(rows, got, 8)


def test_whitening_of_little(spark):
    assert whitening.whiten(table(spark, odd_rows(4)[:1])).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0])]).limit(0)).count() == 0
    assert whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no variance
    line = [(i, [i, 2 * i, 0.0]) for i in range(10)]
    got = whitening.whiten(table(spark, line)).toPandas()
    check_whitening(line, got, 1)
    assert set(got.component) == {1}


def test_whitening_of_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    check_whitening([(r.vec_id, r.embedding) for r in rows], whitening.query(spark, "/root/testdata/sf0.001").toPandas(), 32)


def brute_force(rows, asks, k):
    """{(query id, its vector): [(score, id)]} of distinct rows."""
    rows = sorted({(i, tuple(map(float, v))) for i, v in rows})
    vectors, out = np.array([v for _, v in rows]), {}
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    size = np.sqrt((vectors * vectors).sum(axis=1))
    for at, (i, v) in enumerate(rows):
        if asks(i):
            scores = (vectors * vectors[at]).sum(axis=1) / (size * size[at])
            found = sorted((-s, j) for n, (s, (j, _)) in enumerate(zip(scores.tolist(), rows, strict=True)) if n != at)
            out[i, v] = found[:k]
    return out


def recall(got, want):
    hits = total = 0
    for (i, _), found in want.items():
        ids = {r.vec_id for r in got if r.query_id == i}
        hits, total = hits + sum(j in ids for _, j in found), total + len(found)
    return hits / total


def test_neighbours_are_found(spark):
    """Clusters, lone vectors, a third of all rows near copies of one vector and another many exact copies."""
    rng = np.random.default_rng(5)
    dim, rows = 24, []
    rows += [(i, v) for i, v in enumerate(rng.normal(size=(600, dim)))]
    centres = rng.normal(size=(20, dim))
    rows += [(600 + i, centres[i % 20] + 0.2 * rng.normal(size=dim)) for i in range(400)]
    rows += [(1000 + i, centres[0] * 3 + 0.001 * rng.normal(size=dim)) for i in range(700)]
    rows += [(1700 + i, rows[7][1]) for i in range(300)]
    rows += [(rows[100][0], rows[100][1]), (2050, rng.normal(size=dim) * 1e200), (2100, rng.normal(size=dim) * 1e-200)]
    df = table(spark, rows + odd_rows(dim) + [(2200, [0.0] * dim), (None, rows[1][1])])
    got = neighbours.search(df, F.col("vec_id") % 50 == 0).collect()
    want = brute_force(rows, lambda i: i % 50 == 0, 5)
    assert recall(got, want) >= 0.97
    for (i, _), found in want.items():
        mine = sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and i not in {r.vec_id for r in mine}
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        scores = {j: -s for s, j in brute_force(rows, lambda x, i=i: x == i, 10**6)[next(k for k in want if k[0] == i)]} if i in (0, 50, 1000, 1750) else {}
        assert all(abs(scores[r.vec_id] - r.score) < 1e-12 for r in mine if scores)
        if 1700 <= i < 2000:  # exact copies: the smallest ids but for its own
            assert [r.vec_id for r in mine] == [x for x in (7, *range(1700, 1710)) if x != i][:5]


def test_few_rows_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, -1.0]), (3, [-1.0, 0.0])]
    got = neighbours.search(table(spark, rows), F.col("vec_id") == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 3, -1.0)]
    assert neighbours.search(table(spark, rows[:1]), F.col("vec_id") == 0).count() == 0
    assert neighbours.search(table(spark, rows).limit(0), F.col("vec_id") == 0).count() == 0
    both = neighbours.search(table(spark, [(0, [1.0, 0.0]), (0, [1.0, 0.1]), (1, [1.0, 1.0])]), F.col("vec_id") == 0).collect()
    assert sorted((r["rank"], r.vec_id) for r in both) == [(1, 0), (1, 0), (2, 1), (2, 1)]


def test_neighbours_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got = neighbours.query(spark, "/root/testdata/sf0.1").collect()
    assert recall(got, brute_force(rows, lambda i: i % 50 == 0, 5)) >= 0.97


def test_pigeonhole_finds_every_code():
    """The lists give exactly the codes within a radius, for every radius."""
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 16))
    codes = neighbours.learn(vectors, bits=40)
    shard = neighbours.Shard(np.arange(300), vectors, codes)
    bits = codes.encode(vectors / np.linalg.norm(vectors, axis=1, keepdims=True))
    parts = np.stack(list(shard.substrings(bits)), axis=1)
    for i in range(0, 300, 37):
        distance = (bits != bits[i]).sum(1)
        for radius in range(41):
            rows, found = shard.probe(parts[i].tolist(), np.packbits(bits[i]), radius)
            assert set(rows) == set(np.flatnonzero(distance <= radius)) and (found == distance[rows]).all()


def test_close_vectors_touch_few_lists():
    """In clustered data the radius for a near neighbour selects: most rows aren't candidates."""
    rng = np.random.default_rng(4)
    vectors = np.repeat(rng.normal(size=(100, 32)), 30, axis=0) + 0.02 * rng.normal(size=(3000, 32))
    codes = neighbours.learn(vectors)
    shard = neighbours.Shard(np.arange(3000), vectors, codes)
    bits = codes.encode(vectors / np.linalg.norm(vectors, axis=1, keepdims=True))
    parts = np.stack(list(shard.substrings(bits)), axis=1)
    assert max(len(shard.probe(parts[i].tolist(), np.packbits(bits[i]), codes.within(0.998))[0]) for i in range(0, 3000, 100)) <= 60
