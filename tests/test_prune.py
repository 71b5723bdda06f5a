"""Grasps pruned block by block against the plain loop, without a table of all near pairs."""

import math
import random

from pointloom.operators import grasps as G
from pointloom.operators import rounds

COLUMNS = "grasp_id long, cloud_id string, cx double, cy double, cz double, ax double, ay double, az double"


def plain(rows, threshold, alpha=0.05):
    kept = []
    for i, cloud, *p in sorted(rows):
        gap = lambda q: math.dist(p[:3], q[:3]) + alpha * 2 / math.pi * math.acos(min(abs(sum(a * b for a, b in zip(p[3:], q[3:], strict=True))), 1.0))
        if all(c != cloud or gap(q) >= threshold for _, c, q in kept):
            kept.append((i, cloud, p))
    return {i for i, _, _ in kept}


def test_crowded_grasps_are_pruned_without_all_pairs(spark, monkeypatch):
    rnd = random.Random(4)
    rows = []
    for i in range(1500):
        axis = [rnd.gauss(0, 1) for _ in range(3)]
        n = math.hypot(*axis)
        spread = 1.0 if i % 5 == 0 else 0.05
        rows.append((i * 7 % 1500, "ab"[i % 2], *[rnd.gauss(0, spread) for _ in range(3)], *[a / n for a in axis]))
    saved = []

    def save(df, real=rounds.save):
        out = real(df)
        saved.append(out.count())
        return out

    monkeypatch.setattr(rounds, "save", save)
    monkeypatch.setattr(G, "FIRST", 64, raising=False)
    got = [r.grasp_id for r in G.prune_near(spark.createDataFrame(rows, COLUMNS), 0.35).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, 0.35)
    assert max(saved) <= 4 * len(rows)  # all near pairs are some 400,000
