"""Rays by cells against all rays with all faces."""

import math

import numpy as np
from pyspark.sql import functions as F

from pointloom.operators import rays

CORNERS = "mesh_id long, fid long, " + ", ".join(f"{c}{n} double" for n in (1, 2, 3) for c in "xyz")
RAYS = "mesh_id long, ray_id long, ox double, oy double, oz double, dx double, dy double, dz double"


def brute(rays_, faces, reach, beyond=0.0):
    out = {}
    for m, r, *od in rays_:
        o, d = np.array(od[:3]), np.array(od[3:])
        for n, f, *c in faces:
            if n != m:
                continue
            p1, p2, p3 = np.array(c).reshape(3, 3)
            e1, e2 = p2 - p1, p3 - p1
            p = np.cross(d, e2)
            det = e1 @ p
            if abs(det) <= 1e-12:
                continue
            t = o - p1
            q = np.cross(t, e1)
            u, v, at = (t @ p) / det, (d @ q) / det, (e2 @ q) / det
            if u >= 0 and v >= 0 and u + v <= 1 and beyond < at <= reach:
                out[m, r, f] = at
    return out


def scene(seed=3, n=150):
    rng = np.random.default_rng(seed)
    faces = []
    for m in (1, 2):
        for f in range(n):
            size = rng.choice((0.02, 0.3, 5.0)) if m == 1 else 0.5
            at = rng.uniform(-4, 4, 3)
            faces.append((m, f, *(at + rng.normal(0, size, (3, 3))).ravel().tolist()))
    lines = []
    for m in (1, 2, 3):  # mesh 3 has no faces
        for r in range(60):
            d = rng.normal(0, 1, 3)
            if r % 10 == 0:
                d = np.eye(3)[r // 10 % 3] * (1 if r % 20 else -1)  # along an axis
            lines.append((m, r, *rng.uniform(-6, 6, 3).tolist(), *d.tolist()))
    return lines, faces


def test_hits_are_those_of_all_pairs(spark):
    lines, faces = scene()
    got = rays.ray_hits(spark.createDataFrame(lines, RAYS), spark.createDataFrame(faces, CORNERS), 7.0, 0.5).collect()
    want = brute(lines, faces, 7.0, 0.5)
    assert len(want) > 80 and {(r.mesh_id, r.ray_id, r.fid) for r in got} == set(want)
    assert len(got) == len(want) and all(math.isclose(r.t, want[r.mesh_id, r.ray_id, r.fid], rel_tol=1e-9) for r in got)


def test_closest_hits_by_rings(spark):
    lines, faces = scene(8)
    want = {}
    for (m, r, f), t in brute(lines, faces, 20.0).items():
        want[m, r] = min(want.get((m, r), (math.inf, 0)), (t, f))
    for rings in (1, 2, 4):
        got = {(r.mesh_id, r.ray_id): (r.t, r.fid) for r in rays.closest_hits(spark.createDataFrame(lines, RAYS), spark.createDataFrame(faces, CORNERS), 20.0, rings).collect()}
        assert got.keys() == want.keys() and all(got[k][1] == want[k][1] for k in want)


def test_odd_rays_and_faces(spark):
    flat = (1, 0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    faces = [flat, (1, 1, *[0.5] * 9), (1, 2, None, *[0.5] * 8)]
    lines = [(1, 0, 0.25, 0.25, 1.0, 0.0, 0.0, -1.0), (1, 1, 0.25, 0.25, 0.0, 1.0, 0.0, 0.0), (1, 2, 0.25, 0.25, 1.0, 0.0, 0.0, 0.0), (1, 3, None, 0.25, 1.0, 0.0, 0.0, -1.0), (1, 4, 0.25, 0.25, 1.0, 0.0, 0.0, 1.0), (1, 5, 0.0, 0.0, 1.0, 0.0, 0.0, -1.0)]
    r, c = spark.createDataFrame(lines, RAYS), spark.createDataFrame(faces, CORNERS)
    assert sorted((x.ray_id, x.fid, x.t) for x in rays.ray_hits(r, c, 5.0).collect()) == [(0, 0, 1.0), (5, 0, 1.0)]
    assert rays.ray_hits(r.limit(0), c, 5.0).count() == rays.ray_hits(r, c.limit(0), 5.0).count() == 0


def field(spark, n):
    """A height field of 2 n x n faces over the unit square."""
    at = lambda i, j: F.sin(7 * i / n) * F.cos(5 * j / n) / 4
    cells = spark.range(n * n).select(F.floor(F.col("id") / n).cast("double").alias("i"), (F.col("id") % n).cast("double").alias("j"), "id")
    i, j = F.col("i"), F.col("j")
    corners = [((i, j), (i + 1, j), (i, j + 1)), ((i + 1, j), (i + 1, j + 1), (i, j + 1))]
    parts = [F.struct((F.col("id") * 2 + k).alias("fid"), *[x.alias(f"{c}{m}") for m, (p, q) in enumerate(tri, 1) for c, x in zip("xyz", (p / n, q / n, at(p, q)), strict=True)]) for k, tri in enumerate(corners)]
    return cells.select(F.lit(1).cast("long").alias("mesh_id"), F.explode(F.array(*parts)).alias("e")).select("mesh_id", "e.*")


def test_rows_tried_do_not_grow_with_rays_times_faces(spark):
    rng = np.random.default_rng(1)
    lines = [(1, k, *rng.uniform(0.2, 0.8, 2).tolist(), 2.0, *rng.normal(0, 0.02, 2).tolist(), -1.0) for k in range(200)]
    r = spark.createDataFrame(lines, RAYS)
    small, large = (rays.candidates(r, field(spark, n), 9.0).count() for n in (20, 40))
    assert large < 2 * small  # four times the faces
    assert large < 200 * 3200 / 50  # all pairs
    assert rays.closest_hits(r, field(spark, 40), 9.0).count() == 200
