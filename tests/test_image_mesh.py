"""Meshes of images against all their triangles and edges, one by one."""

import random
import re
from collections import Counter

from pointloom.operators import compose as C


def faces_of(on):
    """Faces of the pixels (v, u), corners as (v, u, back)."""
    front = []
    for v, u in on:
        has = lambda a, b, v=v, u=u: (v + a, u + b) in on
        if has(-1, 0) and has(0, -1):
            front.append(((v, u), (v - 1, u), (v, u - 1)))
        elif has(0, -1) and has(-1, -1) and v > 1 and u > 1:
            front.append(((v, u), (v - 1, u - 1), (v, u - 1)))
        if has(1, 0) and has(0, 1):
            front.append(((v, u), (v + 1, u), (v, u + 1)))
        elif has(0, 1) and has(1, 1):
            front.append(((v, u), (v + 1, u + 1), (v, u + 1)))
    sides = [e for a, b, c in front for e in ((a, b), (b, c), (c, a))]
    n = Counter(frozenset(e) for e in sides)
    walls = [e for e in sides if n[frozenset(e)] == 1]
    whole = [((*a, 0), (*b, 0), (*c, 0)) for a, b, c in front] + [((*a, 1), (*c, 1), (*b, 1)) for a, b, c in front]
    return whole + [f for p, q in walls for f in (((*q, 0), (*p, 0), (*p, 1)), ((*q, 0), (*p, 1), (*q, 1)))]


def masks():
    draw = random.Random(6)
    where = [(range(9), range(9)), (range(-2, 6), range(58, 72)), (range(4), range(-70, -58)), (range(3), range(124, 132)), (range(1, 40), range(3))]
    return {k: {(v, u) for v in vs for u in us if draw.random() < 0.45 + 0.1 * (k % 4)} for k, (vs, us) in enumerate(where * 4)}


def test_faces_are_those_of_all_pixels(spark):
    images = masks()
    mask = spark.createDataFrame([(k, v, u) for k, on in images.items() for v, u in [*on, *list(on)[:3]]], "frame_id int, v long, u int").repartition(5)
    vertices, faces = C.image_to_mesh(mask)
    number = lambda p: p[0] * (1 << 32) + p[1] * 2 + p[2]
    want = Counter((k, *map(number, f)) for k, on in images.items() for f in faces_of(on))
    assert len(want) > 2000
    assert Counter(tuple(r) for r in faces.select("mesh_id", "a", "b", "c").collect()) == want
    assert Counter(tuple(r) for r in vertices.select("mesh_id", "vid").collect()) == Counter({(k, x) for k, *abc in want for x in abc})


def test_pixels_and_edges_are_not_dealt_out(spark):
    """Only words of 64 pixels go to other tasks, and none are sorted."""
    _, faces = C.image_to_mesh(spark.createDataFrame([(0, 1, 1)], "frame_id int, v long, u int"))
    plan = faces._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"hashpartitioning\(([^)]*)\)", re.sub(r"#\d+L?", "", plan))) == {"frame_id, v, w, 4"}
    assert "SortAggregate" not in plan
