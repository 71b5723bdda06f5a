"""Poses of level faces whose covariance is zero but for rounding."""

from pointloom.operators import compose as C
from pointloom.operators import mesh as M


def test_level_faces_dont_turn_with_rounding(spark):
    """Five copies of a mesh longer along y, each summed in an order of its own, have the same x axis."""
    at = [(0.1 * u, 0.1 * v, float(u == 3 and v == 7)) for v in range(90) for u in range(7)]
    rows = [(m, i, *at[i]) for m in range(5) for i in sorted(range(len(at)), key=lambda i, m=m: (i * (2 * m + 1)) % 631)]
    v = spark.createDataFrame(rows, "mesh_id int, vid long, x double, y double, z double")
    f = spark.createDataFrame([(m, 0, 0, 1, 7) for m in range(5)], "mesh_id int, fid long, a long, b long, c long")
    for some in (v, v.repartition(3)):
        got = C.face_basis(M.face_corners(some, f), some).collect()
        assert len(got) == 5
        assert {tuple(round(x, 6) + 0.0 for x in (r.r0x, r.r0y, r.r0z)) for r in got} == {(0.0, 1.0, 0.0)}
