"""Neighbours where most points lie in one spot."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointloom.operators import points as P


def frame(spark, xyz, cloud="c"):
    return spark.createDataFrame(pd.DataFrame({"cloud_id": cloud, "point_id": np.arange(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]}))


def brute(xyz, asked, radius, k, exclude=False):
    out = {}
    for q in asked:
        d = (xyz[:, 0] - xyz[q, 0]) ** 2 + (xyz[:, 1] - xyz[q, 1]) ** 2 + (xyz[:, 2] - xyz[q, 2]) ** 2
        near = np.flatnonzero(d <= radius * radius)
        if exclude:
            near = near[near != q]
        out[q] = near[np.lexsort((near, d[near]))][:k].tolist()
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.point_id)
    return out


def test_a_hundred_thousand_points_in_one_spot(spark):
    rng = np.random.default_rng(0)
    xyz = np.concatenate((rng.uniform(-1, 1, (3000, 3)), 0.31 + rng.normal(0, 2e-3, (100_000, 3))))
    near = np.flatnonzero(np.abs(xyz[:3000] - 0.31).max(1) < 0.25)[:20]  # sparse points beside the spot
    asked = sorted({*range(0, 3000, 100), *near.tolist(), *range(3000, len(xyz), 1000)})
    p = frame(spark, xyz)
    q = p.where(F.col("point_id").isin([int(a) for a in asked]))
    k, crowd = 8, 512
    got = found(P.neighbors(p, q, 0.2, k, crowd=crowd))
    want = brute(xyz, asked, 0.2, k)
    assert got == {a: w for a, w in want.items() if w}
    tried = P.crowded_cells(P._cells(p, 0.2), q.select("cloud_id", F.col("point_id").alias("query_id"), *[F.col(c).alias(f"q{c}") for c in "xyz"]), 0.2, k, crowd)
    assert tried.groupBy("query_id").count().agg(F.max("count")).first()[0] < 30 * crowd  # of 100,000
    assert tried.count() < len(asked) * 12 * crowd


@pytest.mark.parametrize("exclude", [False, True])
def test_points_at_one_place_and_several_clouds(spark, exclude):
    rng = np.random.default_rng(1)
    xyz = np.concatenate((np.full((300, 3), 0.5), rng.uniform(0, 1, (60, 3)), 0.5 + rng.normal(0, 1e-6, (120, 3)), [[-0.2, -0.2, -0.2]] * 3))
    both = frame(spark, xyz).union(frame(spark, xyz[::-1].copy(), "d"))
    asked = [0, 7, 299, 310, 330, 400, 470, 480]
    q = both.where(F.col("point_id").isin(asked))
    got = P.neighbors(both, q, 0.4, 5, exclude, crowd=16)
    for cloud, points in (("c", xyz), ("d", xyz[::-1])):
        assert found(got.where(F.col("cloud_id") == cloud)) == {a: w for a, w in brute(points, asked, 0.4, 5, exclude).items() if w}
    assert found(P.knn(both, q, 6, 0.05).where("cloud_id = 'c'")) == brute(xyz, asked, 9.0, 6)


def test_all_neighbours_of_a_full_cell_are_shared_among_tasks(spark, monkeypatch):
    monkeypatch.setattr(P, "SLICE", 50)
    rng = np.random.default_rng(3)
    xyz = np.concatenate((rng.uniform(0, 1, (300, 3)), 0.5 + rng.normal(0, 1e-3, (2000, 3))))
    p, asked = frame(spark, xyz), list(range(0, len(xyz), 50))
    q = p.where(F.col("point_id").isin(asked))
    got = {}
    for r in P.neighbors(p, q, 0.2, None).collect():
        got.setdefault(r.query_id, set()).add(r.point_id)
    assert got == {a: set(w) for a, w in brute(xyz, asked, 0.2, None).items()}
    met = P._meet(P._around(q.select("cloud_id", F.col("point_id").alias("query_id"), *[F.col(c).alias(f"q{c}") for c in "xyz"]), 0.2), P._cells(p, 0.2))
    assert met.groupBy(*P.CELL, "_slice", "query_id").count().agg(F.max("count")).first()[0] < 100  # of 2,000


def test_tasks_follow_the_pairs(spark, monkeypatch):
    """Pairs of crowded cells are shared among more tasks the more there are, with the same result."""
    pts = spark.range(3000).selectExpr("'a' cloud_id", "id point_id", "(id * 37 % 1009) / 1009D x", "(id * 71 % 1013) / 1013D y", "(id * 13 % 997) / 997D z")
    queries = pts.where("point_id % 100 = 0")
    few = sorted(tuple(r) for r in P.neighbors(pts, queries, 0.5, 7, crowd=64).collect())
    monkeypatch.setattr(P, "PAIRS", 1000, raising=False)
    q = queries.select("cloud_id", F.col("point_id").alias("query_id"), *[F.col(c).alias(f"q{c}") for c in "xyz"])
    pairs = P.crowded_cells(P._cells(pts, 0.5), q, 0.5, 7, 64)
    assert pairs.rdd.getNumPartitions() > 4
    assert few == sorted(tuple(r) for r in P.neighbors(pts, queries, 0.5, 7, crowd=64).collect())
