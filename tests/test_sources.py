import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import mesh as M
from pointloom.sources import formats as S
from pointloom.sources.catalog import Catalog

TETRA = "v 0 0 0\nv 1 0 0\nv -1 1 1\nv 0 1 0\nvn 0 0 1\n\nf 1//1 3//1 2//1\nf 1 2 4\nf 1/1/1 4/2/2 3/3/3\nf 2 3 4\n"


def test_obj_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/tetra.obj").write_text(TETRA)
    v, f, n = S.read_obj(spark, str(tmp_path / "in/tetra.obj"))
    assert [tuple(r) for r in f.orderBy("fid").collect()] == [("tetra", 0, 0, 2, 1), ("tetra", 1, 0, 1, 3), ("tetra", 2, 0, 3, 2), ("tetra", 3, 1, 2, 3)]
    assert n.count() == 1 and v.count() == 4
    assert M.is_watertight(f).first().watertight
    S.write_obj(v, f, str(tmp_path / "out"))
    back = S.read_obj(spark, [str(p) for p in (tmp_path / "out/mesh_id=tetra").glob("*.txt")])
    assert [r[1:] for r in back[1].orderBy("fid").collect()] == [r[1:] for r in f.orderBy("fid").collect()]
    assert [r[2:] for r in back[0].orderBy("vid").collect()] == [r[2:] for r in v.orderBy("vid").collect()]


def test_off_sdf_transforms(spark, tmp_path):
    (tmp_path / "a.off").write_text("OFF 3 1 0\n0 0 0\n1 0 0\n0 1 0\n3 0 1 2\n")
    (tmp_path / "bad.off").write_text("OFF\n4 1 0\n0 0 0\n1 0 0\n0 1 0\n0 0 1\n4 0 1 2 3\n")
    v, f = S.read_off(spark, str(tmp_path / "a.off"))
    assert v.count() == 3 and tuple(f.first()) == ("a", 0, 0, 1, 2)
    with pytest.raises(Exception, match="triangle"):
        S.read_off(spark, str(tmp_path / "bad.off"))[1].collect()
    (tmp_path / "s.sdf").write_text("2 2 3\n0 0 1\n0.5\n" + "\n".join(map(str, range(12))))
    g, h = S.read_sdf(spark, str(tmp_path / "s.sdf"))
    assert {(r.i, r.j, r.k): r.val for r in g.collect()} == {(p % 2, p // 2 % 2, p // 4): float(p) for p in range(12)}
    assert h.first().res == 0.5 and h.first().oz == 1.0
    (tmp_path / "t.csv").write_text("obj1,1,2,3,4,5,6,7,8,9,10,11,12,1\n")
    assert S.read_transforms(spark, str(tmp_path / "t.csv")).first().h[:8] == [1, 2, 3, 10, 4, 5, 6, 11]
    assert S.read_transforms(spark, str(tmp_path / "t.csv"), "column").first().h[:4] == [1, 4, 7, 10]


def test_clouds_poses_arrays(spark, tmp_path):
    p = spark.createDataFrame([("c", i, i / 2, 0.0, 1.0, 1, 2, 3) for i in range(5)], "cloud_id string, point_id long, x double, y double, z double, r int, g int, b int")
    S.write_pcd(p, str(tmp_path / "pcd"), True)
    text = next((tmp_path / "pcd/cloud_id=c").glob("*.txt")).read_text().splitlines()
    assert "POINTS 5" in text and text[11] == "0.000000 0.000000 1.000000 66051" and len(text) == 16
    S.write_ply(p, str(tmp_path / "ply"), True)
    assert "element vertex 5" in next((tmp_path / "ply/cloud_id=c").glob("*.txt")).read_text()
    poses = spark.createDataFrame([("m", 0, 0.7, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], [0.0, 0.0, 0.5]), ("m", 1, 0.1, [0.0] * 9, [0.0] * 3)], "mesh_id string, pose_id int, p double, r array<double>, x0 array<double>")
    S.write_stp(poses, str(tmp_path / "stp"), 0.2)
    back = S.read_stp(spark, [str(x) for x in (tmp_path / "stp/mesh_id=m").glob("*.txt")]).collect()
    assert len(back) == 1 and back[0].p == 0.7 and back[0].r[4] == 1.0 and back[0].x0 == [0, 0, 0.5]
    np.save(tmp_path / "a.npy", np.arange(12.0).reshape(4, 3))
    assert S.read_npy(spark, str(tmp_path / "a.npy"), ["x", "y", "z"]).agg(F.sum("z")).first()[0] == 2 + 5 + 8 + 11
    (tmp_path / "v/obj7").mkdir(parents=True)
    (tmp_path / "v/obj7/NP3_30.npy").write_bytes(b"x")
    assert tuple(S.list_views(spark, str(tmp_path / "v")).first())[1:] == ("obj7", "NP3", "30")


def test_pieces(spark):
    lines = ["o one", "v 0 0 0", "v 1 0 0", "v 0 1 0", "f 1 2 3", "o two", "v 0 0 1", "v 1 0 1", "v 0 1 1", "f 4//1 5//1 6//1"]
    got = S.split_pieces(spark.createDataFrame([("m", i, x) for i, x in enumerate(lines)], "mesh_id string, k long, line string")).orderBy("k").collect()
    assert [r.piece for r in got] == [1] * 5 + [2] * 5 and got[9].line == "f 1 2 3" and got[4].line == "f 1 2 3"


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path), "d1")
    g = spark.createDataFrame([(1, "r", 0, 0.5), (1, "r", 1, 0.6), (2, "s", 0, 0.7)], "object_id long, gripper string, grasp_id long, q double")
    c.store("grasps", g)
    with pytest.raises(ValueError, match="stored"):
        c.store("grasps", g.limit(1))
    c.store("grasps", spark.createDataFrame([(1, "r", 1, 9.0), (3, "r", 0, 1.0)], g.schema), force_overwrite=True)
    assert sorted(r.q for r in c.read("grasps").collect()) == [0.5, 0.7, 1.0, 9.0]
    c.delete("grasps", spark.createDataFrame([(1,)], "object_id long"))
    assert c.grasps(1, "r").count() == 0 and c.grasps(2, "s").count() == 1 and c.grasps(2, "none").count() == 0
