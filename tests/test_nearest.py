"""Sums over nearest points and over balls, without a row for each pair."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pointloom.functions.eigen import eigen3, eigen3_rows
from pointloom.operators import frames3d as E
from pointloom.operators import nearest as N


def frame(spark, xyz, cloud="c"):
    return spark.createDataFrame(pd.DataFrame({"cloud_id": cloud, "point_id": np.arange(len(xyz)) * 7919 % 100_003, "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]}))


def some_points():
    rng = np.random.default_rng(5)
    lattice = np.stack(np.meshgrid(*[np.arange(7) * 0.0625] * 3), -1).reshape(-1, 3) - 0.7  # many ties
    return np.concatenate((rng.normal(0, 0.13, (900, 3)), np.full((60, 3), 0.31), 0.4 + rng.normal(0, 1e-4, (200, 3)), lattice, [[3.0, 0.0, 0.0]]))


def brute(xyz, ids, radius, k):
    out = {}
    for q in xyz:
        d2 = (xyz[:, 0] - q[0]) ** 2 + (xyz[:, 1] - q[1]) ** 2 + (xyz[:, 2] - q[2]) ** 2
        near = np.flatnonzero(d2 <= radius * radius)
        near = near[np.lexsort((ids[near], d2[near]))][:k]
        out[tuple(q)] = np.cov(xyz[near].T, bias=True)[np.triu_indices(3)] if len(near) > 1 else np.zeros(6)
    return out


def test_covariances_in_one_and_in_many_blocks(spark, monkeypatch):
    xyz = some_points()
    both = frame(spark, xyz).union(frame(spark, xyz[::-1] * 0.5, "d")).union(spark.createDataFrame([("c", 200_000, float("nan"), 0.0, 0.0)], "cloud_id string, point_id long, x double, y double, z double"))
    for block in (1 << 15, 100):
        monkeypatch.setattr(N, "BLOCK", block)
        monkeypatch.setattr(N, "BOX", min(N.BOX, block // 4))
        got = N.neighbour_covariances(both, 0.15, 12).collect()
        for cloud, some in (("c", xyz), ("d", xyz[::-1] * 0.5)):
            want = brute(some, np.arange(len(some)) * 7919 % 100_003, 0.15, 12)
            mine = {(r.x, r.y, r.z): [r.sxx, r.sxy, r.sxz, r.syy, r.syz, r.szz] for r in got if r.cloud_id == cloud}
            assert len(mine) == len(want) == sum(r.cloud_id == cloud for r in got)
            np.testing.assert_allclose([mine[p] for p in want], list(want.values()), rtol=1e-9, atol=1e-15)


def test_what_is_dealt_out_grows_with_the_points_not_with_the_pairs(spark, monkeypatch):
    """4,000 points within reach of one another: no step has a row for each pair, nor for each of the nearest."""
    monkeypatch.setattr(N, "BLOCK", 500)
    rows = []
    from pointloom.operators import rounds

    save = rounds.save
    monkeypatch.setattr(rounds, "save", lambda df: (out := save(df), rows.append(out.count()))[0])
    xyz = np.random.default_rng(6).uniform(0, 0.08, (4000, 3))
    got = E.estimate_normals(frame(spark, xyz), 0.15, 30, (0.0, 0.0, 2.0), 1e-4)
    assert got.count() == 4000
    assert max(rows) < 5 * 4000
    assert sum(len(p.split("Generate")) - 1 for p in [got._jdf.queryExecution().optimizedPlan().toString()]) == 0  # no chain of rotations in the plan


def test_sums_in_balls(spark, monkeypatch):
    monkeypatch.setattr(N, "PART", 256)
    monkeypatch.setattr(N, "CHUNK", 16)
    xyz = some_points()
    p = frame(spark, xyz).withColumn("v", F.col("x") * 3 + 1)
    got = {r.query_id: r for r in N.ball_sums(p, p.where("point_id % 10 = 0"), 0.2, ["v"]).collect()}
    ids = np.arange(len(xyz)) * 7919 % 100_003
    assert sorted(got) == sorted(ids[ids % 10 == 0].tolist())
    for q, i in zip(xyz[ids % 10 == 0], ids[ids % 10 == 0], strict=True):
        near = ((xyz[:, 0] - q[0]) ** 2 + (xyz[:, 1] - q[1]) ** 2 + (xyz[:, 2] - q[2]) ** 2) <= 0.2 * 0.2
        assert got[i].n == near.sum()
        assert abs(got[i].v - (xyz[near, 0] * 3 + 1).sum()) < 1e-9


def test_rotations_in_numpy_equal_those_of_columns(spark):
    rng = np.random.default_rng(7)
    m = rng.normal(0, 1, (300, 3, 3))
    m = m @ m.transpose(0, 2, 1)
    m[0], m[1], m[2] = 0, np.eye(3), np.diag((1, 0, 0))
    df = spark.createDataFrame([(i, *map(float, (a[0, 0], a[1, 1], a[2, 2], a[0, 1], a[0, 2], a[1, 2]))) for i, a in enumerate(m)], "i long, sxx double, syy double, szz double, sxy double, sxz double, syz double")
    one, two = (sorted(map(tuple, f(df, ["i"]).collect())) for f in (eigen3, eigen3_rows))
    np.testing.assert_allclose(one, two, rtol=1e-12, atol=1e-14)
