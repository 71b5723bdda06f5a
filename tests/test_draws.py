"""Draws of many pairs at once, and samples taken with them."""

import hashlib

import numpy as np
import pandas as pd
import pytest

from pointloom.functions.digests import Draws
from pointloom.operators import boxes as B
from pointloom.operators import grasps as G


def test_draws_are_first_digits_of_the_digest():
    rng = np.random.default_rng(0)
    prefixes = [b"1:%d:" % x for x in rng.integers(0, 10 ** rng.integers(1, 19), 200)] + [b"7:x" * k for k in (1, 5, 12, 16, 20)] + [b"", "grüße:".encode()]
    endings = [b"%d" % x for x in rng.integers(-(10**9), 10**9, 300)] + [b"", b"0", "ä\0".encode()]
    i, j = rng.integers(0, len(prefixes), 20_000), rng.integers(0, len(endings), 20_000)
    want = [int(hashlib.md5(prefixes[a] + endings[b]).hexdigest()[:8], 16) for a, b in zip(i, j, strict=True)]
    assert Draws(prefixes, endings)(i, j).tolist() == want


@pytest.mark.parametrize(("block", "chunk"), [(1 << 21, 1 << 12), (400, 5)])
def test_samples_leave_no_row_for_each_pair(spark, monkeypatch, block, chunk):
    """The rows that a task gives are at most n a hand and part, and the samples are those of all points."""
    from pointloom.operators import rounds
    from pointloom.operators.points import resample

    monkeypatch.setattr(B, "IMAGE_BLOCK", block)
    monkeypatch.setattr(B, "IMAGE_CHUNK", chunk)
    saved, save = [], rounds.save
    monkeypatch.setattr(rounds, "save", lambda df: (out := save(df), saved.append((out.count(), df._jdf.queryExecution().executedPlan().toString())))[0])
    rng = np.random.default_rng(7)
    points = spark.createDataFrame(pd.DataFrame(rng.normal(0, 0.2, (1500, 3)), columns=list("xyz")).assign(cloud_id="a", point_id=range(1500)))
    a = rng.normal(0, 1, (12, 3))
    grasps = spark.createDataFrame(pd.DataFrame(rng.normal(0, 0.2, (12, 3)), columns=["cx", "cy", "cz"]).assign(ax=a[:, 0], ay=a[:, 1], az=a[:, 2], width=np.linspace(0.05, 0.9, 12), angle=0.3, cloud_id="a", grasp_id=range(12)))
    got = {(r.grasp_id, r.slot, r.point_id) for r in G.sample_inside(points, grasps, 20, 4).collect()}
    assert len(saved) == 1 and saved[0][0] <= 12 * 20
    assert "CoGroup" in saved[0][1] and "Generate explode(sequence(floor" not in saved[0][1]
    assert got == {(r.grasp_id, r.slot, r.point_id) for r in resample(G.crop(points, grasps), 20, 4, "grasp_id").collect()}
