import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import mesh as M
from pointloom.operators import points as P
from pointloom.operators.frames3d import until_target
from pointloom.sources import formats as S
from pointloom.sources.arrays import read_arrays
from pointloom.sources.catalog import Catalog


def rows(df):
    return np.array([[r[c] for c in df.columns if c not in ("path", "member", "row")] for r in df.orderBy("row").collect()])


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("kind", ["float64", ">f4", "int16", "bool"])
def test_one_file_is_shared_among_tasks(spark, tmp_path, order, kind):
    a = np.asarray(np.random.default_rng(0).normal(0, 50, (1000, 5)).astype(kind), order=order)
    np.save(tmp_path / "a.npy", a)
    df = read_arrays(spark, str(tmp_path / "a.npy"), ["p", "q", "r"], part_bytes=900 * a.itemsize)
    assert df.rdd.getNumPartitions() > 4
    assert (rows(df) == a[:, :3]).all()
    assert [r.row for r in df.orderBy("row").collect()] == list(range(1000))


def test_members_of_archives(spark, tmp_path):
    a, b = np.arange(60.0).reshape(20, 3), np.asfortranarray(np.arange(40).reshape(20, 2))
    np.savez(tmp_path / "s.npz", first=a, second=b, line=np.arange(7))
    np.savez_compressed(tmp_path / "c.npz", first=a, second=b)
    for name in ("s.npz", "c.npz"):
        assert (rows(read_arrays(spark, str(tmp_path / name), ["x", "y", "z"], "first", 100)) == a).all()
        assert (rows(read_arrays(spark, str(tmp_path / name), ["x", "y"], "second", 100)) == b).all()
        assert {r.member for r in read_arrays(spark, str(tmp_path / name), ["x"]).collect()} >= {"first", "second"}
    assert rows(read_arrays(spark, str(tmp_path / "s.npz"), ["x"], "line")).ravel().tolist() == list(range(7))
    np.save(tmp_path / "deep.npy", np.arange(24.0).reshape(2, 3, 4))
    assert rows(read_arrays(spark, str(tmp_path / "deep.npy"), list("abcdefghijkl"))).tolist() == np.arange(24.0).reshape(2, 12).tolist()
    np.save(tmp_path / "none.npy", np.zeros((0, 3)))
    assert read_arrays(spark, str(tmp_path / "none.npy"), ["x"]).count() == 0


def test_pickles_and_narrow_arrays_are_refused(spark, tmp_path):
    np.save(tmp_path / "o.npy", np.array([{"a": 1}], dtype=object), allow_pickle=True)
    np.save(tmp_path / "n.npy", np.zeros((3, 2)))
    with pytest.raises(Exception, match="plain numbers"):
        read_arrays(spark, str(tmp_path / "o.npy"), ["x"]).count()
    with pytest.raises(Exception, match="not a matrix"):
        read_arrays(spark, str(tmp_path / "n.npy"), ["x", "y", "z"]).count()


def test_grids_are_read_in_splits(spark, tmp_path):
    n = 12
    values = [str(i * 0.5) for i in range(n**3)]
    lines, k = [], 0
    while k < len(values):
        step = 1 + k % 7
        lines.append("  ".join(values[k : k + step]))
        k += step
    (tmp_path / "g.sdf").write_text(f"{n} {n} {n}\n0 0 1\n\n0.25\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    try:
        grid, head = S.read_sdf(spark, str(tmp_path / "g.sdf"))
        assert spark.read.text(str(tmp_path / "g.sdf")).rdd.getNumPartitions() > 3
        got = {(r.i, r.j, r.k): r.val for r in grid.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {(p % n, p // n % n, p // (n * n)): p * 0.5 for p in range(n**3)}
    assert tuple(head.first()) == ("g", n, n, n, 0.0, 0.0, 1.0, 0.25)


def test_ply_with_faces(spark, tmp_path):
    v = spark.createDataFrame([("t", 0, 0.0, 0.0, 0.0), ("t", 1, 1.0, 0.0, 0.0), ("t", 2, -1.0, 1.0, 1.0), ("t", 3, 0.0, 1.0, 0.0)], "mesh_id string, vid long, x double, y double, z double")
    f = spark.createDataFrame([("t", 0, 0, 2, 1), ("t", 1, 0, 1, 3), ("t", 2, 0, 3, 2), ("t", 3, 1, 2, 3)], "mesh_id string, fid long, a long, b long, c long")
    S.write_ply_mesh(v, f, str(tmp_path / "ply"))
    bv, bf = S.read_ply(spark, [str(x) for x in (tmp_path / "ply/mesh_id=t").glob("*.txt")])
    assert sorted(r[1:] for r in bv.collect()) == sorted(r[1:] for r in v.collect())
    assert sorted(r[1:] for r in bf.collect()) == sorted(r[1:] for r in f.collect())


def test_organised_frames_and_a_batch_that_comes_again(spark, tmp_path):
    p = spark.createDataFrame([(1, 0, 0, 1.0, 2.0, 3.0), (1, 1, 2, 4.0, 5.0, 6.0), (2, 0, 1, 7.0, 8.0, 9.0), (2, 9, 9, 0.0, 0.0, 0.0)], "frame_id long, v int, u int, x double, y double, z double")
    p = p.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("frame_id"))).withColumn("source", F.lit(5).cast("long"))
    frames = S.organised(p, 2, 3)
    assert {(r.frame_id, r.height, r.width, len(r.points)) for r in frames.collect()} == {(1, 2, 3, 6), (2, 2, 3, 6)}
    key = lambda d: sorted(tuple(r) for r in d.select("frame_id", "ts", "source", "v", "u", "x", "y", "z").collect())
    assert key(S.pixels_of(frames)) == key(p.where("v < 2"))
    frames.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = S.read_frames(spark, str(tmp_path / "in"), stream=True, organised=True)
    S.write_frames(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination(120)
    back = S.read_frames(spark, str(tmp_path / "out"), organised=True)
    assert key(S.pixels_of(back)) == key(p.where("v < 2"))
    S.write_frames_batch(frames.withColumn("is_dense", F.lit(False)), str(tmp_path / "out"), "0", 0)  # the same batch again
    assert key(S.pixels_of(S.read_frames(spark, str(tmp_path / "out"), organised=True))) == key(p.where("v < 2"))


def test_catalog_puts_back_what_was_left_aside(spark, tmp_path):
    c = Catalog(spark, str(tmp_path), "d")
    g = spark.createDataFrame([(1, "n", 0.5)], "object_id long, name string, value double")
    c.store("metadata", g)
    (tmp_path / "metadata/dataset=d").rename(tmp_path / "_metadata-d-old")  # as if the driver died between two renames
    again = Catalog(spark, str(tmp_path), "d")
    with pytest.raises(ValueError, match="stored"):
        again.store("metadata", g)
    assert again.read("metadata").count() == 1


def test_draws_until_there_are_enough(spark):
    made = []

    def draw(r, n):
        made.append(n)
        return spark.range(n // 2).select((F.col("id") + 1000 * r).alias("k"))

    got = [x.k for x in until_target(draw, 10).collect()]
    assert made == [10, 20] and got == [0, 1, 2, 3, 4, 1000, 1001, 1002, 1003, 1004]


def test_refusals(spark):
    p = spark.createDataFrame([("c", 0, 0.0, 0.0, 0.0)], "cloud_id string, point_id long, x double, y double, z double")
    with pytest.raises(ValueError, match="positive"):
        P.knn(p, p, 1, 0.0)
    v = p.select(F.col("cloud_id").alias("mesh_id"), F.col("point_id").alias("vid"), "x", "y", "z")
    many = spark.range(100_001).select(F.col("id").alias("dir_id"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(0.0).alias("dz"))
    with pytest.raises(ValueError, match="paired"):
        M.support(v, many)
