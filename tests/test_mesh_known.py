"""Known answers on a tetrahedron."""

import pytest

from pointloom.operators import frames3d as E
from pointloom.operators import mesh as M

CORNERS = [(-1.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]


@pytest.fixture(scope="module")
def tetra(spark):
    v = spark.createDataFrame([("t", i, *p) for i, p in enumerate(CORNERS)], "mesh_id string, vid long, x double, y double, z double")
    f = spark.createDataFrame([("t", 0, 0, 2, 1), ("t", 1, 0, 1, 3), ("t", 2, 1, 2, 3), ("t", 3, 0, 3, 2)], "mesh_id string, fid long, a long, b long, c long")
    return v, f


def extents(v):
    b = M.mesh_bounds(v).first()
    return [(b[f"lo_{c}"], b[f"hi_{c}"]) for c in "xyz"]


def test_bounds_box_and_support(spark, tetra):
    assert extents(tetra[0]) == [(-1, 1), (0, 1), (0, 1)]
    bv, bf = M.box_mesh(tetra[0])
    assert bv.count() == 8 and bf.count() == 12 and M.is_watertight(bf).first().watertight
    b = M.mesh_bounds(bv).first()
    assert (b.mean_x, b.mean_y, b.mean_z) == (0.0, 0.5, 0.5)
    directions = spark.createDataFrame([(0, 1.0, 0.0, 0.0), (1, 0.0, 0.0, 1.0)], "dir_id int, dx double, dy double, dz double")
    assert {(r.dir_id, r.vid, r.h) for r in M.support(tetra[0], directions).collect()} == {(0, 1, 1.0), (1, 3, 1.0)}


def test_volume_and_covariance(tetra):
    corners = M.face_corners(*tetra)
    assert M.mesh_volume(corners).first().volume == pytest.approx(1 / 3)
    com = M.mesh_com(corners).first()
    assert (com.com_x, com.com_y, com.com_z) == pytest.approx((0, 0.25, 0.25))
    c = M.mesh_inertia(corners).first()  # about the mass centre; about the origin by the parallel-axis rule
    origin = {k: c[f"c{k}"] + com[f"com_{k[0]}"] * com[f"com_{k[1]}"] / 3 for k in ("xx", "yy", "zz", "xy", "xz", "yz")}
    assert origin == pytest.approx({"xx": 1 / 30, "yy": 1 / 30, "zz": 1 / 30, "xy": 0, "xz": 0, "yz": 1 / 60}, abs=1e-12)


def test_normals_and_middles_of_faces(tetra):
    corners = M.face_corners(*tetra).collect()
    middle = {tuple(round(sum(r[f"{c}{n}"] for n in (1, 2, 3)) / 3, 9) for c in "xyz") for r in corners}
    assert (0.0, round(1 / 3, 9), 0.0) in middle
    normal = {r.vid: (r.nx, r.ny, r.nz) for r in M.vertex_normals(M.face_corners(*tetra)).collect()}
    assert normal[3][2] > 0 and normal[2][1] > 0 and normal[0][0] < 0 < normal[1][0]  # all outward


def test_bad_faces_and_unused_vertices(spark, tetra):
    v = tetra[0].union(spark.createDataFrame([("t", 4, 9.0, 9.0, 9.0), ("t", 5, 8.0, 8.0, 8.0)], tetra[0].schema))
    f = tetra[1].union(spark.createDataFrame([("t", 4, 0, 1, 6), ("t", 5, 7, 2, 3)], tetra[1].schema))
    kept, faces = M.compact_vertices(v, M.drop_bad_faces(f, v))
    assert faces.count() == 4 and kept.count() == 4 and M.is_watertight(faces).first().watertight


def test_centring_and_scaling(tetra):
    at = lambda v: {(r.x, r.y, r.z) for r in v.collect()}
    assert (0, -0.25, 0.75) in at(M.center_mesh(tetra[0], "mean"))
    assert (0, -0.5, 0.5) in at(M.center_mesh(tetra[0], "box"))
    for size, mode in ((0.5, "min"), (0.5, "relative"), (1.0, "max"), (0.5, "median")):
        assert extents(M.rescale_mesh(tetra[0], size, mode)) == [(-0.5, 0.5), (0, 0.5), (0, 0.5)], mode


def test_four_landings(tetra):
    """With the middle of the vertices as mass centre every face is a landing."""
    corners = M.face_corners(*tetra)
    p = E.stable_pose_probabilities(corners, M.mesh_com(corners)).collect()
    assert len(p) == 4 and all(r.p > 0 for r in p) and sum(r.p for r in p) == pytest.approx(1.0)
