"""Sweeps whose hands mostly meet a few points only."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointloom.operators import boxes as B
from pointloom.operators import grasps as G


def tables(spark):
    rng = np.random.default_rng(3)
    xyz, g = rng.normal(0, 0.12, (3000, 3)), rng.normal(0, 0.2, (25, 3))
    a = rng.normal(0, 1, (25, 3))
    a /= np.linalg.norm(a, axis=1)[:, None]
    points = spark.createDataFrame(pd.DataFrame(xyz, columns=list("xyz")).assign(cloud_id="a", point_id=range(3000)))
    points = points.union(points.select("x", "y", "z", F.lit("same"), F.lit(1)))  # one id for all: no look at a part of them
    grasps = pd.DataFrame(g, columns=["cx", "cy", "cz"]).assign(ax=a[:, 0], ay=a[:, 1], az=a[:, 2], width=0.3, angle=rng.uniform(-3, 3, 25))
    return points, spark.createDataFrame(pd.concat((grasps.assign(cloud_id="a", grasp_id=np.arange(25) - 7), grasps.assign(cloud_id="same", grasp_id=np.arange(25) + 100))))


@pytest.mark.parametrize(("least", "steep"), [(1, None), (2, -0.5)])
def test_sweep_equals_counts_of_all_hands(spark, monkeypatch, least, steep):
    """With a look at some points first, the sweep gives what counting all points in all hands gives, from few hands."""
    from pointloom.operators import rounds

    points, grasps = tables(spark)
    want = sorted(map(tuple, G.sweep_grasps(points, grasps, 3, 5, 0.08, least=least, steep=steep).collect()))
    monkeypatch.setattr(B, "LOOK", 200)
    monkeypatch.setattr(B, "LOOK_CHUNK", 64)
    monkeypatch.setattr(B, "BLOCK", 1000)
    saved, save = [], rounds.save
    monkeypatch.setattr(rounds, "save", lambda df: (out := save(df), saved.append(out.groupBy("cloud_id").count().collect()))[0])
    got = sorted(map(tuple, G.sweep_grasps(points, grasps, 3, 5, 0.08, least=least, steep=steep).collect()))
    assert got == want
    assert got
    kept = {r.cloud_id: r["count"] for r in saved[0]}
    assert kept["a"] < 25 * 15 * 0.9
    free = {r.grasp_id for r in sweep_brute(points, grasps, least)}
    assert {w[3] for w in want} <= free


def sweep_brute(points, grasps, least):
    """Free hands, of counts that stop nowhere."""
    g = grasps.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("sample", F.col("grasp_id"))
    g = g.withColumn("grasp_id", (F.col("sample") * 3 + F.col("turn")) * 5 + F.col("shift")).withColumn("angle", F.col("angle") + F.radians(-90.0 + F.col("turn") * 90.0))
    for c in "xyz":
        g = g.withColumn(f"c{c}", F.col(f"c{c}") + F.col(f"a{c}") * (F.col("shift") - 2.0) * 0.08)
    names = g.columns
    g = G.grasp_frame(g)
    g = g.select(*[(F.col(n) - 0.01 * F.col(f"ap{n[1]}")).alias(n) if n in ("cx", "cy", "cz") else F.col(n) for n in names])
    return G.hand_counts(points, g).where("left = 0 and right = 0 and bottom = 0").where(F.col("open") >= least).collect()
