"""Components and running sums against plain ones; crops with one wide box; neighbours far away."""

import random

from pyspark.sql import functions as F

from pointloom.operators import grasps as G
from pointloom.operators import learn as L
from pointloom.operators import mesh as M
from pointloom.operators import points as P
from pointloom.operators import rounds


def plain_components(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for g, a, b in edges:
        p, q = root((g, a)), root((g, b))
        up[max(p, q)] = min(p, q)
    return {x: root(x)[1] for x in up}


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(3), rnd.randrange(400), rnd.randrange(400)) for _ in range(420)] + [(9, i, i + 1) for i in range(300)]
    want = plain_components(edges)
    got = {(r.group, r.node): r.label for r in rounds.components(spark.createDataFrame(edges, "group int, a int, b long")).collect()}
    assert got == {k: v for k, v in want.items() if k[1] != v}


def test_faces_on_one_edge(spark):
    """A thousand faces share an edge: one component, without a pair for each two of them."""
    faces = [(0, i, 0, 1, i + 2) for i in range(1000)] + [(0, 2000, 5000, 5001, 5002)]
    got = M.components(spark.createDataFrame(faces, "mesh_id int, fid long, a long, b long, c long")).collect()
    assert {r.label for r in got if r.fid < 2000} == {0} and len(got) == 1001


def test_running_sums(spark):
    rnd = random.Random(1)
    values = [(rnd.random(), rnd.randrange(5)) for _ in range(500)]
    got = rounds.running(spark.createDataFrame(values, "k double, v long"), [F.desc("k")], {"s": F.col("v"), "n": F.lit(1)}).collect()
    total = 0
    for place, (k, v) in enumerate(sorted(values, reverse=True), 1):
        total += v
        assert any(r.k == k and r.s == total and r.n == place for r in got)


def test_all_distinct_scores(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.random(), rnd.randrange(2)) for i in range(400)]
    got = L.average_precision(spark.createDataFrame(rows, "row_id long, score double, label int")).first()
    tp, ap, pos = 0, 0.0, sum(r[2] for r in rows)
    wrong = right = 0
    for n, (_, _, y) in enumerate(sorted(rows, key=lambda r: -r[1]), 1):
        tp += y
        ap += y / pos * tp / n
        right += (1 - y) * tp
    assert abs(got.average_precision - ap) < 1e-9 and abs(got.roc_auc - right / pos / (len(rows) - pos)) < 1e-9


def test_one_wide_grasp(spark):
    rnd = random.Random(5)
    points = [("a", i, rnd.random(), rnd.random(), rnd.random()) for i in range(2000)]
    grasps = [(i, "a", rnd.random(), rnd.random(), rnd.random(), 1.0, 0.0, 0.0, 0.02, 0.0) for i in range(50)] + [(99, "a", 0.5, 0.5, 0.5, 0.0, 1.0, 0.0, 500.0, 0.3)]
    p = spark.createDataFrame(points, "cloud_id string, point_id long, x double, y double, z double")
    g = spark.createDataFrame(grasps, "grasp_id long, cloud_id string, cx double, cy double, cz double, ax double, ay double, az double, width double, angle double")
    n = {r.grasp_id: r["count"] for r in G.crop(p, g).groupBy("grasp_id").count().collect()}
    assert n[99] == 2000
    for i, _, cx, cy, cz, *_ in grasps[:50]:
        inside = sum(abs(x - cx) < 0.01 and abs(y - cy) < 0.005 and abs(z - cz) < 0.005 for _, _, x, y, z in points)
        assert n.get(i, 0) == inside


def test_far_neighbours(spark):
    p = spark.createDataFrame([("a", 0, 0.0, 0.0, 0.0), ("a", 1, 1.0, 0.0, 0.0), ("a", 2, 1e7, 0.0, 0.0), ("a", 3, float("nan"), 0.0, 0.0)], "cloud_id string, point_id long, x double, y double, z double")
    got = P.knn(p, p.where("point_id = 0"), 3, 0.01).collect()
    assert sorted((r.rank, r.point_id) for r in got) == [(1, 0), (2, 1), (3, 2)]


def test_stars_are_made_piece_by_piece(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(rounds, "PIECE", 50, raising=False)
    rnd = random.Random(7)
    edges = [(g, max(a, b), min(a, b)) for g, a, b in ((rnd.randrange(2), rnd.randrange(300), rnd.randrange(300)) for _ in range(700)) if a != b]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["group", "a", "b"])
    out = list(rounds._stars(batch(edges[i : i + 120]) for i in range(0, len(edges), 120)))
    assert len(out) > 10 and max(b.num_rows for b in out) <= 200
    got = plain_components([tuple(r.values()) for b in out for r in b.to_pylist()])
    want = plain_components(edges)
    assert {k: v for k, v in got.items() if k[1] != v} == {k: v for k, v in want.items() if k[1] != v}
