"""Antipodal grasps on a sphere, meshes of images, subdivision to a longest edge, and the catalog's swap."""

import math

import pytest
from pyspark.sql import functions as F

from pointloom.operators import compose as C
from pointloom.operators import mesh as M
from pointloom.sources.catalog import Catalog


def sphere(spark, radius, n=16):
    middle = (n - 1) / 2
    cells = spark.range(n * n * n).selectExpr("0 mesh_id", f"cast(floor(id / {n * n}) as int) i", f"cast(floor(id / {n}) % {n} as int) j", f"cast(id % {n} as int) k")
    return cells.selectExpr("*", f"sqrt(pow(i-{middle},2)+pow(j-{middle},2)+pow(k-{middle},2)) - {radius} val")


def test_antipodal_grasps_on_a_sphere(spark):
    """Contacts lie on the sphere, and the line between them passes near its middle, as force closure asks."""
    got = C.generate("antipodal", sdf=sphere(spark, 4.0), n=3, seed=1, mu=0.4, max_width=12.0, min_width=1.0).collect()
    assert len(got) > 50 and len({r.grasp_id for r in got}) == len(got)
    for r in got:
        c, a = [r.cx - 7.5, r.cy - 7.5, r.cz - 7.5], [r.ax, r.ay, r.az]
        assert abs(sum(x * x for x in a) - 1) < 1e-9 and 1 < r.width <= 12
        for s in (-1, 1):
            assert abs(math.dist([x + s * r.width / 2 * y for x, y in zip(c, a)], [0, 0, 0]) - 4) < 0.4
        # a chord within the friction cone of both ends passes the middle at most radius * sin(atan(mu)) away
        assert math.dist(c, [0, 0, 0]) < 4 * math.sin(math.atan(0.4)) + 0.6


def test_a_full_image_makes_a_closed_mesh(spark):
    mask = spark.range(30).selectExpr("0 frame_id", "cast(floor(id / 6) as int) v", "cast(id % 6 as int) u")
    vertices, faces = C.image_to_mesh(mask, 2.0)
    assert vertices.count() == 60 and faces.count() == 2 * 2 * 4 * 5 + 2 * 18
    assert M.is_watertight(faces.withColumn("fid", F.monotonically_increasing_id())).first().watertight
    corners = M.face_corners(vertices, faces.withColumn("fid", F.monotonically_increasing_id()))
    assert abs(M.mesh_volume(corners).first().volume - 4 * 5 * 2) < 1e-9


def test_subdivide_until(spark):
    v = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 8.0, 0.0, 0.0), (0, 2, 0.0, 6.0, 0.0), (1, 0, 0.0, 0.0, 0.0), (1, 1, 1.0, 0.0, 0.0), (1, 2, 0.0, 1.0, 0.0)], "mesh_id int, vid long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 0, 1, 2), (1, 0, 0, 1, 2)], "mesh_id int, fid long, a long, b long, c long")
    got = M.subdivide_until(M.face_corners(v, f), 2.5)
    assert {r.mesh_id: r["count"] for r in got.groupBy("mesh_id").count().collect()} == {0: 16, 1: 1}
    assert all(r.longest <= 2.5 for r in M.longest_edges(got).collect())
    with pytest.raises(ValueError):
        M.subdivide_until(M.face_corners(v, f), 0)


def test_a_failed_swap_keeps_the_table(spark, tmp_path):
    c = Catalog(spark, str(tmp_path), "d")
    rows = spark.createDataFrame([(1, "n", 1.0)], "object_id long, name string, value double")
    c.store("metadata", rows)
    with pytest.raises(Exception):  # noqa: B017
        c._replace("metadata", rows.withColumn("value", F.raise_error(F.lit("x")).cast("double")))
    assert c.read("metadata").count() == 1
    c.store("metadata", rows.withColumn("value", F.lit(2.0)), force_overwrite=True)
    assert c.read("metadata").first().value == 2.0
