"""Triangle meshes as rows: vertices (mesh_id, vid, x, y, z) and faces (mesh_id, fid, a, b, c)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import add, cross, dot, named, norm, once, scale, sub, uniform, vec
from .rounds import running_within, save, small, with_few


#: Vertices of consecutive numbers that go into one task together.
BLOCK = 4096


def _block(vid: str) -> Column:
    return F.floor(F.col(vid) / BLOCK)


def _at_corners(faces: DataFrame, table: DataFrame, values: list[str]) -> DataFrame:
    """Faces with the values of a table by (mesh_id, vid) at their corners, as <value>1 to <value>3; faces that name a missing vertex go.

    The table's rows are shuffled once, by blocks of vertices, and so are faces whose corners lie in one block; the others are
    shuffled for each corner.
    """
    low, high = F.least("a", "b", "c"), F.greatest("a", "b", "c")
    one = F.floor(low / BLOCK) == F.floor(high / BLOCK)
    near = faces.where(one).withColumn("_block", _block("a")).repartition("mesh_id", "_block")
    rows = table.select("mesh_id", _block("vid").alias("_block"), "vid", *values).repartition("mesh_id", "_block")
    far = faces.where(~one)
    for n, k in enumerate("abc", 1):
        named_ = [F.col("vid").alias(k), *[F.col(c).alias(f"{c}{n}") for c in values]]
        near = near.join(rows.select("mesh_id", "_block", *named_), ["mesh_id", "_block", k])
        far = far.withColumn("_block", _block(k)).repartition("mesh_id", "_block").join(rows.select("mesh_id", "_block", *named_), ["mesh_id", "_block", k]).drop("_block")
    return near.drop("_block").unionByName(far)


def face_corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with the coordinates of their corners as x1..z3; faces that name a missing vertex go."""
    return _at_corners(faces, vertices, list("xyz"))


def corner(n: int):
    return tuple(F.col(f"{c}{n}") for c in "xyz")


def _normal() -> tuple[Column, Column, Column]:
    return cross(sub(corner(2), corner(1)), sub(corner(3), corner(1)))


def mesh_bounds(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy("mesh_id").agg(*[f(c).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg)) for c in "xyz"])


def _areas(corners: DataFrame) -> DataFrame:
    return once(corners, *named(_normal(), "n")).select("mesh_id", "fid", (norm(vec("n")) / 2).alias("area"))


def face_areas(corners: DataFrame) -> DataFrame:
    """Area of each face, and its share of the mesh's."""
    a = save(_areas(corners))
    return with_few(a, a.groupBy("mesh_id").agg(F.sum("area").alias("whole")), "mesh_id").select("mesh_id", "fid", "area", (F.col("area") / F.col("whole")).alias("share"))


def _volume() -> Column:
    return dot(corner(1), cross(corner(2), corner(3))) / 6


def mesh_volume(corners: DataFrame, density: float = 1.0) -> DataFrame:
    v = F.abs(F.sum(_volume()))
    return corners.groupBy("mesh_id").agg(v.alias("volume"), (v * density).alias("mass"))


def mesh_com(corners: DataFrame) -> DataFrame:
    """Volume-weighted centre."""
    f = once(corners, _volume().alias("_v"))
    whole = F.nullif(F.sum("_v"), F.lit(0.0))
    return f.groupBy("mesh_id").agg(*[(F.sum(F.col("_v") * (F.col(f"{c}1") + F.col(f"{c}2") + F.col(f"{c}3")) / 4) / whole).alias(f"com_{c}") for c in "xyz"])


def mesh_inertia(corners: DataFrame, density: float = 1.0) -> DataFrame:
    """Covariance about the mass centre (1/60 on, 1/120 off the tetrahedron's diagonal) and inertia from its trace."""
    com = mesh_com(corners)
    f = with_few(corners, com, "mesh_id").select("mesh_id", "fid", *[(F.col(f"{c}{n}") - F.col(f"com_{c}")).alias(f"{c}{n}") for n in (1, 2, 3) for c in "xyz"])
    f = once(f, (6 * _volume()).alias("_d"))
    sums = []
    for p, q in ("xx", "yy", "zz", "xy", "xz", "yz"):
        same = sum((F.col(f"{p}{n}") * F.col(f"{q}{n}") for n in (2, 3)), F.col(f"{p}1") * F.col(f"{q}1")) / 60
        mixed = sum((F.col(f"{p}{n}") * F.col(f"{q}{m}") for n in (1, 2, 3) for m in (1, 2, 3) if n != m and (n, m) != (1, 2)), F.col(f"{p}1") * F.col(f"{q}2")) / 120
        sums.append(F.sum(F.col("_d") * (same + mixed)).alias(f"c{p}{q}"))
    c = f.groupBy("mesh_id").agg(*sums)
    trace = F.col("cxx") + F.col("cyy") + F.col("czz")
    return c.select("*", *[(density * (trace - F.col(f"c{a}{a}"))).alias(f"i{a}{a}") for a in "xyz"], *[(-density * F.col(f"c{a}")).alias(f"i{a}") for a in ("xy", "xz", "yz")])


def _edges(faces: DataFrame) -> DataFrame:
    e = F.array(*[F.struct(F.least(a, b).alias("p"), F.greatest(a, b).alias("q")) for a, b in (("a", "b"), ("b", "c"), ("c", "a"))])
    return faces.select("mesh_id", "fid", F.explode(e).alias("e")).select("mesh_id", "fid", "e.p", "e.q")


def is_watertight(faces: DataFrame) -> DataFrame:
    """Whether each edge belongs to exactly two faces."""
    return _edges(faces).groupBy("mesh_id", "p", "q").count().groupBy("mesh_id").agg(F.bool_and(F.col("count") == 2).alias("watertight"))


def components(faces: DataFrame) -> DataFrame:
    """Label of each face: the least fid it is linked to over shared edges.

    Each face is linked with the least face of each of its edges, so an edge of n faces gives n links.
    """
    from .rounds import components as linked

    e = _edges(faces)
    least = e.groupBy("mesh_id", "p", "q").agg(F.min("fid").alias("low"), F.count("*").alias("n")).where("n > 1")
    found = linked(e.join(least, ["mesh_id", "p", "q"]).select(F.col("mesh_id").alias("group"), F.col("fid").alias("a"), F.col("low").alias("b")))
    found = found.select(F.col("group").alias("mesh_id"), F.col("node").alias("fid"), "label")
    return faces.select("mesh_id", "fid").join(found, ["mesh_id", "fid"], "left").select("mesh_id", "fid", F.coalesce("label", "fid").alias("label"))


def drop_bad_faces(faces: DataFrame, vertices: DataFrame, strict: bool = False) -> DataFrame:
    """Faces whose indices are within 0 .. V - 1; strict: and differ."""
    n = vertices.groupBy("mesh_id").agg(F.count("*").alias("_v"))
    out = faces.join(n, "mesh_id").where("least(a, b, c) >= 0 and greatest(a, b, c) < _v").drop("_v")
    return out.where("a <> b and b <> c and a <> c") if strict else out


def flip_faces(faces: DataFrame) -> DataFrame:
    return faces.select("mesh_id", "fid", "a", F.col("c").alias("b"), F.col("b").alias("c"))


def flip_normals(normals: DataFrame) -> DataFrame:
    return normals.select(*[c for c in normals.columns if c not in ("nx", "ny", "nz")], *[(-F.col(c)).alias(c) for c in ("nx", "ny", "nz")])


def compact_vertices(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices that a face uses, numbered densely in their order, and the faces with new numbers."""
    faces = save(faces.select("mesh_id", "fid", "a", "b", "c"))
    used = faces.select("mesh_id", F.explode(F.array("a", "b", "c")).alias("vid")).distinct()
    new = save(vertices.join(used, ["mesh_id", "vid"], "left_semi").withColumn("_block", _block("vid")))
    before = Window.partitionBy("mesh_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each block
    blocks = new.groupBy("mesh_id", "_block").agg(F.count("*").alias("_n")).select("mesh_id", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("mesh_id", "_block").orderBy("vid")) - 1
    new = new.withColumn("_at", place).join(blocks, ["mesh_id", "_block"]).withColumn("to", (F.col("_at") + F.col("_before")).cast("long"))
    out = _at_corners(faces, new, ["to"])
    return new.select("mesh_id", F.col("to").alias("vid"), "x", "y", "z"), out.select("mesh_id", "fid", *[F.col(f"to{n}").alias(k) for n, k in enumerate("abc", 1)])


def support(vertices: DataFrame, directions: DataFrame) -> DataFrame:
    """For each mesh and direction (dir_id, dx, dy, dz; a small table): the farthest vertex, the first of equals."""
    pairs = vertices.crossJoin(small(directions)).withColumn("_h", F.round(dot(vec(), vec("d")), 9))
    best = pairs.groupBy("mesh_id", "dir_id").agg(F.max(F.struct("_h", (-F.col("vid")).alias("n"))).alias("m"))
    return best.select("mesh_id", "dir_id", (-F.col("m.n")).alias("vid"), F.col("m._h").alias("h"))


def extreme_points(vertices: DataFrame, directions: DataFrame) -> DataFrame:
    return support(vertices, directions).select("mesh_id", "vid").distinct()


def vertex_normals(corners: DataFrame) -> DataFrame:
    """Sum over a vertex's faces of unit normal times area times corner angle, normalised; (1, 0, 0) when zero; turned
    outward for meshes of positive volume."""
    f = once(corners, *named(_normal(), "n"), _volume().alias("_v"))

    def angle(i: int, j: int, k: int) -> Column:
        p, q = sub(corner(j), corner(i)), sub(corner(k), corner(i))
        return F.acos(F.greatest(F.least(dot(p, q) / F.nullif(norm(p) * norm(q), F.lit(0.0)), F.lit(1.0)), F.lit(-1.0)))

    # a face's volume goes with its first corner, so that the mesh's can be summed from the vertices
    each = F.array(*[F.struct(F.col(k).alias("vid"), angle(*order).alias("w"), (F.col("_v") if k == "a" else F.lit(0.0)).alias("v")) for k, order in zip("abc", ((1, 2, 3), (2, 3, 1), (3, 1, 2)), strict=True)])
    s = f.select("mesh_id", "nx", "ny", "nz", F.explode(each).alias("e")).groupBy("mesh_id", F.col("e.vid").alias("vid")).agg(*[F.sum(F.col(f"n{c}") / 2 * F.col("e.w")).alias(f"s{c}") for c in "xyz"], F.sum("e.v").alias("_v"))
    s = save(s)
    sign = s.groupBy("mesh_id").agg(F.when(F.sum("_v") < 0, -1.0).otherwise(1.0).alias("_s"))
    n = F.nullif(norm(vec("s")), F.lit(0.0))
    return with_few(s, sign, "mesh_id").select("mesh_id", "vid", *[F.coalesce(F.col(f"s{c}") / n * F.col("_s"), F.lit(1.0 if c == "x" else 0.0)).alias(f"n{c}") for c in "xyz"])


def center_mesh(vertices: DataFrame, by: str = "mean") -> DataFrame:
    """Vertices about their mean, or the centre of their box."""
    b = mesh_bounds(vertices)
    at = {c: F.col(f"mean_{c}") if by == "mean" else (F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2 for c in "xyz"}
    return vertices.join(b, "mesh_id").select("mesh_id", "vid", *[(F.col(c) - at[c]).alias(c) for c in "xyz"])


def rescale_mesh(vertices: DataFrame, size: float, mode: str = "max") -> DataFrame:
    """Scale so that the least, median or largest extent, or a third of the diagonal, is ``size``; relative: times size."""
    ext = [F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in "xyz"]
    now = {"min": F.least(*ext), "max": F.greatest(*ext), "median": F.sort_array(F.array(*ext))[1], "diag": F.sqrt(ext[0] ** 2 + ext[1] ** 2 + ext[2] ** 2) / 3, "relative": F.lit(1.0)}[mode]
    b = mesh_bounds(vertices).select("mesh_id", (size / F.nullif(now, F.lit(0.0))).alias("_k"))
    return vertices.join(b, "mesh_id").select("mesh_id", "vid", *[(F.col(c) * F.col("_k")).alias(c) for c in "xyz"])


def rest_on_table(vertices: DataFrame, delta: float = 0.0) -> DataFrame:
    low = vertices.groupBy("mesh_id").agg(F.min("z").alias("_z"))
    return vertices.join(low, "mesh_id").select("mesh_id", "vid", "x", "y", (F.col("z") - F.col("_z") + delta).alias("z"))


def box_mesh(vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bounding boxes as meshes: eight vertices (x slowest, z fastest), twelve faces turned outward."""
    b = mesh_bounds(vertices)
    at = [F.struct(F.lit(n).cast("long").alias("vid"), *[F.col(f"{'hi' if n >> s & 1 else 'lo'}_{c}").alias(c) for s, c in ((2, "x"), (1, "y"), (0, "z"))]) for n in range(8)]
    quads = ((0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3))
    tri = [t for q in quads for t in ((q[0], q[1], q[2]), (q[0], q[2], q[3]))]
    f = [F.struct(F.lit(n).cast("long").alias("fid"), *[F.lit(x).cast("long").alias(k) for x, k in zip(t, "abc", strict=True)]) for n, t in enumerate(tri)]
    one = lambda a: b.select("mesh_id", F.explode(F.array(*a)).alias("e")).select("mesh_id", "e.*")
    return one(at), one(f)


def subdivide(corners: DataFrame, *keep: str) -> DataFrame:
    """Each face as four, by the middles of its edges: part 0-2 at the corners, 3 in the middle. Corners in, corners out, with the columns to keep."""
    m = {(i, j): scale(add(corner(i), corner(j)), 0.5) for i, j in ((1, 2), (2, 3), (1, 3))}
    parts = ((corner(1), m[1, 2], m[1, 3]), (m[1, 2], corner(2), m[2, 3]), (m[1, 3], m[2, 3], corner(3)), (m[1, 2], m[2, 3], m[1, 3]))
    each = [F.struct(F.lit(n).alias("part"), *[p[k].alias(f"{'xyz'[k]}{i}") for i, p in enumerate(t, 1) for k in range(3)]) for n, t in enumerate(parts)]
    return corners.select("mesh_id", "fid", *keep, F.explode(F.array(*each)).alias("e")).select("mesh_id", "fid", *keep, "e.*")


def longest_edges(corners: DataFrame) -> DataFrame:
    """Length of each mesh's longest edge."""
    sides = [norm(sub(corner(j), corner(i))) for i, j in ((1, 2), (2, 3), (1, 3))]
    return corners.groupBy("mesh_id").agg(F.max(F.greatest(*sides)).alias("longest"))


def subdivide_until(corners: DataFrame, max_edge: float) -> DataFrame:
    """All faces of a mesh subdivided until its longest edge is at most ``max_edge``; each round halves every edge, so the
    number of rounds of a mesh is known before the first."""
    if max_edge <= 0:
        raise ValueError("max_edge must be positive")
    names = ["mesh_id", "fid", *[f"{c}{i}" for i in (1, 2, 3) for c in "xyz"]]
    corners = save(corners.select(*names))
    rounds = save(longest_edges(corners).select("mesh_id", F.greatest(F.ceil(F.log2(F.col("longest") / max_edge) - 1e-12), F.lit(0)).cast("int").alias("_r")))
    left = with_few(corners, rounds, "mesh_id")
    out = left.where("_r = 0").select(*names)
    for turn in range(1, (rounds.agg(F.max("_r")).first()[0] or 0) + 1):
        left = subdivide(left.where(F.col("_r") >= turn), "_r").drop("part")
        out = out.union(left.where(F.col("_r") == turn).select(*names))
    return out


def merge_meshes(first: tuple[DataFrame, DataFrame], second: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """One mesh from two of the same mesh_id: the second's vertices and faces are numbered after the first's."""
    n = first[0].groupBy("mesh_id").agg((F.max("vid") + 1).alias("_n"))
    m = first[1].groupBy("mesh_id").agg((F.max("fid") + 1).alias("_m"))
    v = second[0].join(n, "mesh_id", "left").select("mesh_id", (F.col("vid") + F.coalesce("_n", F.lit(0))).alias("vid"), "x", "y", "z")
    f = second[1].join(n, "mesh_id", "left").join(m, "mesh_id", "left").select("mesh_id", (F.col("fid") + F.coalesce("_m", F.lit(0))).alias("fid"), *[(F.col(k) + F.coalesce("_n", F.lit(0))).alias(k) for k in "abc"])
    return first[0].select("mesh_id", "vid", "x", "y", "z").union(v), first[1].select("mesh_id", "fid", "a", "b", "c").union(f)


def sample_surface(corners: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n points of each mesh, faces drawn by their area, places within them evenly. Draws depend on seed, mesh and slot.

    A cumulative share per mesh gives each face an interval; each draw is joined with its interval by the bucket it
    falls in, so a mesh's faces are never paired with all draws. The shares are summed by ranges of faces, and draws go to
    the faces wherever they are few.
    """
    buckets, slack = 256, 1e-9
    corners = save(corners)  # used three times
    areas = running_within(_areas(corners), ["mesh_id"], [F.col("fid")], {"_upto": F.col("area")}, {"_whole": F.col("area")})
    shares = areas.select("mesh_id", "fid", (F.col("_upto") / F.col("_whole")).alias("top"), (F.col("area") / F.col("_whole")).alias("share"))
    low = F.greatest(F.col("top") - F.col("share") - slack, F.lit(0.0))
    spans = shares.withColumn("bucket", F.explode(F.sequence(F.floor(low * buckets), F.floor(F.least(F.col("top"), F.lit(0.9999999)) * buckets))))
    draws = areas.select("mesh_id").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("u", uniform(seed, F.col("mesh_id"), F.col("slot")))
    draws = draws.withColumn("bucket", F.floor(F.col("u") * buckets))
    # the first face whose running share is beyond the draw; its own share tells which faces come into question
    hit = with_few(spans, draws, ["mesh_id", "bucket"]).where(F.col("u") < F.col("top")).where(F.col("u") >= F.col("top") - F.col("share") - slack)
    hit = hit.groupBy("mesh_id", "slot").agg(F.min("fid").alias("fid"))
    hit = with_few(corners, hit, ["mesh_id", "fid"]).select("mesh_id", "slot", "fid", *[f"{c}{i}" for i in (1, 2, 3) for c in "xyz"])
    r, t = F.sqrt(uniform(seed, F.col("mesh_id"), F.col("slot"), F.lit("r"))), uniform(seed, F.col("mesh_id"), F.col("slot"), F.lit("t"))
    hit = once(hit, r.alias("_r"), t.alias("_t"))
    place = lambda c: (1 - F.col("_r")) * F.col(f"{c}1") + F.col("_r") * (1 - F.col("_t")) * F.col(f"{c}2") + F.col("_r") * F.col("_t") * F.col(f"{c}3")
    return hit.select("mesh_id", "slot", "fid", *[place(c).alias(c) for c in "xyz"])
