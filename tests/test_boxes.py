"""Counts of points in turned boxes."""

import numpy as np
import pandas as pd
import pytest

from pointloom.operators import boxes as B
from pointloom.operators import grasps as G


def turned(rng, n):
    q, _ = np.linalg.qr(rng.normal(size=(n, 3, 3)))
    return q


@pytest.mark.parametrize("n_boxes", [1, 3])
def test_tally_equals_all_pairs(n_boxes):
    rng = np.random.default_rng(n_boxes)
    xyz, centre, axes = np.concatenate((rng.normal(0, 0.3, (4000, 3)), np.full((500, 3), 0.1))), rng.normal(0, 0.3, (60, 3)), turned(rng, 60)
    lo = -rng.uniform(0, 0.4, (n_boxes, 3, 60))
    hi = lo + rng.uniform(0, 0.8, lo.shape)
    own = np.einsum("hac,hpc->hpa", axes, xyz[None] - centre[:, None])
    want = np.array([((own > lo[b].T[:, None]) & (own < hi[b].T[:, None])).all(2).sum(1) for b in range(n_boxes)])
    assert (B.tally(xyz, centre, axes, lo, hi) == want).all()
    some = B.tally(xyz, centre, axes, lo, hi, lambda c: c[0] >= 5)
    ended = some[0] >= 5
    assert (ended == (want[0] >= 5)).all() and (some[:, ~ended] == want[:, ~ended]).all() and (some <= want).all()


def test_parts_and_chunks_add_up(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 100)
    monkeypatch.setattr(B, "CHUNK", 7)
    rng = np.random.default_rng(5)
    p = pd.DataFrame(rng.normal(0, 0.2, (700, 3)), columns=list("xyz")).assign(cloud_id=["a", "b"] * 350, point_id=range(700))
    p.loc[3, "x"], p.loc[5, "y"] = np.nan, np.inf
    a = turned(rng, 30)[:, 0]
    g = pd.DataFrame(rng.normal(0, 0.1, (30, 3)), columns=["cx", "cy", "cz"]).assign(ax=a[:, 0], ay=a[:, 1], az=a[:, 2], width=0.4, angle=0.3, cloud_id=["a", "b", "none"] * 10, grasp_id=range(30))
    points, grasps = spark.createDataFrame(p), spark.createDataFrame(g)
    for mode in ("train", "online"):
        want = {r.grasp_id: r["count"] for r in G.crop(points, grasps, mode).groupBy("grasp_id").count().collect()}
        assert want and {r.grasp_id: r.n for r in G.crop_counts(points, grasps, mode).collect()} == want
    n = {r.grasp_id: r for r in G.hand_counts(points, grasps).collect()}
    flags = {r.grasp_id: r for r in G.collisions(points, grasps).collect()}
    assert set(n) == set(flags) == set(range(30)) and all((n[k][r] > 0) == flags[k][r] for k in n for r in G.REGIONS)
    free = {r.grasp_id: r for r in G.free_hands(points, grasps).collect()}
    assert all(free[k].free == (n[k].left + n[k].right + n[k].bottom == 0) and (not free[k].free or free[k].n == n[k].open) for k in n)


def test_no_row_for_each_pair(spark):
    plan = G.crop_counts(spark.createDataFrame([("a", 0, 0.0, 0.0, 0.0)], "cloud_id string, point_id long, x double, y double, z double"),
        spark.createDataFrame([(0, "a", 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.4, 0.0)], "grasp_id long, cloud_id string, cx double, cy double, cz double, ax double, ay double, az double, width double, angle double"))
    assert plan.first().n == 1
    assert "CoGroup" in plan._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [3, 60])
def test_samples_are_those_of_all_points(spark, n):
    from pointloom.operators.points import resample

    rng = np.random.default_rng(7)
    points = spark.createDataFrame(pd.DataFrame(rng.normal(0, 0.2, (1500, 3)), columns=list("xyz")).assign(cloud_id="a", point_id=range(1500)))
    a = turned(rng, 12)[:, 0]
    grasps = spark.createDataFrame(pd.DataFrame(rng.normal(0, 0.2, (12, 3)), columns=["cx", "cy", "cz"]).assign(ax=a[:, 0], ay=a[:, 1], az=a[:, 2], width=np.linspace(0.05, 0.9, 12), angle=0.3, cloud_id="a", grasp_id=range(12)))
    want = {(r.grasp_id, r.slot, r.point_id) for r in resample(G.crop(points, grasps), n, 4, "grasp_id").collect()}
    got = {(r.grasp_id, r.slot, r.point_id) for r in G.sample_inside(points, grasps, n, 4).collect()}
    assert want and got == want


@pytest.mark.parametrize("block", [1 << 21, 700])
def test_images_equal_those_of_cropped_points(spark, monkeypatch, block):
    from pointloom.operators import frames3d as E

    monkeypatch.setattr(B, "IMAGE_BLOCK", block, raising=False)
    monkeypatch.setattr(B, "IMAGE_CHUNK", 16, raising=False)
    rnd = np.random.default_rng(6)
    p = [("ab"[i % 2], i, *map(float, rnd.normal(0, 0.3, 3)), *(None if i % 11 == 0 else float(x) for x in rnd.integers(-3, 4, 3))) for i in range(3000)]
    g = [(i, "ab"[i % 2], *map(float, rnd.normal(0, 0.2, 3)), *map(float, rnd.normal(0, 1, 3)), float(rnd.uniform(0.2, 0.9)), float(rnd.uniform(-3, 3))) for i in range(40)]
    points = spark.createDataFrame(p, "cloud_id string, point_id long, x double, y double, z double, nx double, ny double, nz double")
    grasps = spark.createDataFrame(g, "grasp_id long, cloud_id string, cx double, cy double, cz double, ax double, ay double, az double, width double, angle double")
    cropped = G.crop(points, grasps).join(grasps.select("grasp_id", "width"), "grasp_id").join(points.select("point_id", "nx", "ny", "nz"), "point_id")
    rows = lambda df: sorted(tuple("-" if r[c] is None else f"{r[c] + 0:.9g}" for c in sorted(df.columns)) for r in df.collect())
    got = E.box_images(points, grasps, 8, cap=4)
    assert "width" not in got.columns and rows(got) == rows(E.project_image(cropped, 8, cap=4))
    assert rows(E.box_images12(points, grasps, 8)) == rows(E.project_image12(cropped, 8))
