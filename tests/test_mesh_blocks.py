"""Meshes of several blocks of vertices, with faces within and across them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pointloom.operators import mesh as M


@pytest.fixture(scope="module")
def strip(spark):
    """Vertices 0..9999 without every 17th, and faces of neighbours and of vertices far apart."""
    draw = random.Random(3)
    faces = [(m, i, i * 7, i * 7 + 1, i * 7 + 2) for m in (0, 1) for i in range(1400)] + [(0, 2000 + i, *draw.sample(range(10000), 3)) for i in range(300)]
    at = lambda i: (float(i % 83), float(i % 101), float(i * i % 97))
    verts = [(m, i, *at(i)) for m in (0, 1) for i in range(10000) if i % 17]
    return spark.createDataFrame(verts, "mesh_id int, vid long, x double, y double, z double"), spark.createDataFrame(faces, "mesh_id int, fid long, a long, b long, c long"), faces, at


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_corners_within_and_across_blocks(strip):
    v, f, faces, at = strip
    got = {(r.mesh_id, r.fid): ((r.x1, r.y1, r.z1), (r.x2, r.y2, r.z2), (r.x3, r.y3, r.z3)) for r in M.face_corners(v, f).collect()}
    assert got == {(m, i): tuple(at(k) for k in abc) for m, i, *abc in faces if all(k % 17 for k in abc)}


def test_numbers_go_on_from_block_to_block(strip):
    v, f, faces, _ = strip
    new, out = M.compact_vertices(v, f.where("mesh_id = 0"))
    used = sorted({k for m, _, *abc in faces if m == 0 for k in abc if k % 17})
    number = {k: n for n, k in enumerate(used)}
    assert sorted(r.vid for r in new.collect()) == list(range(len(used)))
    assert {r.fid: (r.a, r.b, r.c) for r in out.collect()} == {i: tuple(number[k] for k in abc) for m, i, *abc in faces if m == 0 and all(k % 17 for k in abc)}


def test_no_task_takes_a_whole_mesh(spark, strip):
    """Faces aren't dealt out or put into a window by their mesh alone."""
    v, f, _, _ = strip
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        c = M.face_corners(v, f)
        plans = [_plan(x) for x in (M.face_areas(c), M.vertex_normals(c), M.subdivide_until(c, 40.0), M.sample_surface(c, 5, 1).select("fid"))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for p in plans:
        assert not re.search(r"hashpartitioning\(mesh_id#\d+L?, \d+\)", p)
        assert not re.search(r"windowspecdefinition\(mesh_id#\d+L?, fid", p)


def test_draws_take_the_first_face_beyond_them(strip):
    v, f, _, _ = strip
    c = M.face_corners(v, f)
    areas = sorted((r.mesh_id, r.fid, r.share) for r in M.face_areas(c).collect())
    from pointloom.functions import uniform

    got = M.sample_surface(c, 40, 4).withColumn("u", uniform(4, F.col("mesh_id"), F.col("slot"))).collect()
    assert len(got) == 80
    for r in got:
        top = 0.0
        for m, fid, share in areas:
            top += share if m == r.mesh_id else 0.0
            if m == r.mesh_id and top > r.u:
                assert fid == r.fid
                break
