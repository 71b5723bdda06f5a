"""Operators made of others: gripper poses, hand poses, resampled grids, surface windows, piece masses, choices by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import uniform
from . import grasps as G
from . import learn as L
from . import mesh as M
from . import random_views as R
from . import sdf as S
from .quality import contact_frame
from .rays import closest_hits


def gripper_pose(grasps: DataFrame, rotation: list[float], shift: list[float]) -> DataFrame:
    """Each grasp's frame (columns approach, binormal, minor axis; origin the centre) times the gripper's own transform."""
    g = G.grasp_frame(grasps)
    cols = ("ap", "b", "m")
    out = []
    for c in "xyz":
        for j in range(3):
            out.append(sum((F.col(f"{cols[k]}{c}") * float(rotation[3 * k + j]) for k in (1, 2)), F.col(f"ap{c}") * float(rotation[j])).alias(f"r{c}{j}"))
        out.append((F.col(f"c{c}") + sum((F.col(f"{cols[k]}{c}") * float(shift[k]) for k in (1, 2)), F.col(f"ap{c}") * float(shift[0]))).alias(f"t{c}"))
    return g.select("grasp_id", *out)


def hand_pose(projected: DataFrame, cx: float, cy: float) -> DataFrame:
    """Seven numbers: pixel, depth, turn, pixel less the principal point, width."""
    return projected.select("grasp_id", F.array("u", "v", "depth", "turn", F.col("u") - cx, F.col("v") - cy, "width").alias("pose"))


def window_features(windows: DataFrame, weights: tuple[float, float, float, float]) -> DataFrame:
    """Projection, gradients along both axes and curvature (arrays proj, gx, gy, curv) in one weighted vector."""
    times = lambda w: lambda x: x * w
    parts = [F.transform(c, times(w)) for c, w in zip(("proj", "gx", "gy", "curv"), weights, strict=True)]
    return windows.select("id", F.concat(*parts).alias("features"))


def resample_sdf(sdf: DataFrame, rotation: list[float], shift: list[float], n: int) -> DataFrame:
    """The grid under a rigid motion: each cell takes the value of the nearest cell of its moved place, clamped to the grid."""
    middle = (n - 1) / 2
    at = [F.col(c) - middle for c in "ijk"]
    moved = [sum((at[k] * float(rotation[3 * r + k]) for k in (1, 2)), at[0] * float(rotation[3 * r])) + middle + float(shift[r]) for r in range(3)]
    near = [F.least(F.greatest(F.floor(m + 0.5), F.lit(0)), F.lit(n - 1)).cast("int").alias(f"_{c}") for m, c in zip(moved, "ijk", strict=True)]
    q = sdf.select("mesh_id", "i", "j", "k", *near)
    return q.join(sdf.select("mesh_id", *[F.col(c).alias(f"_{c}") for c in "ijk"], "val"), ["mesh_id", "_i", "_j", "_k"]).select("mesh_id", "i", "j", "k", "val")


def resample_sdf_detailed(sdf: DataFrame, rotation: list[float], shift: list[float], n: int) -> DataFrame:
    """The grid under a rigid motion, each cell with the interpolated value at its moved place (``sdf.signed_distance``)."""
    middle = (n - 1) / 2
    at = [F.col(c) - middle for c in "ijk"]
    moved = [(sum((at[k] * float(rotation[3 * r + k]) for k in (1, 2)), at[0] * float(rotation[3 * r])) + middle + float(shift[r])).alias(c) for r, c in enumerate("xyz")]
    q = sdf.select("mesh_id", "i", "j", "k", ((F.col("i").cast("long") * n + F.col("j")) * n + F.col("k")).alias("query_id"), *moved)
    return q.select("mesh_id", "i", "j", "k", "query_id").join(S.signed_distance(sdf, q.select("mesh_id", "query_id", "x", "y", "z")), ["mesh_id", "query_id"]).select("mesh_id", "i", "j", "k", "val")


#: What a projection is where nothing is hit.
NO_CONTACT = 0.2


def projection_window(contacts: DataFrame, corners: DataFrame, width: float, n: int, max_projection: float = 0.1, back_up: float = 0.0) -> DataFrame:
    """n x n distances from each contact's tangent plane (grasp_id, side, mesh_id, p*, d*) along its direction to the
    nearest face of its mesh, from ``back_up`` before the plane on; at most ``max_projection``, NO_CONTACT where none is hit."""
    res = width / n
    steps = lambda: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = contact_frame(contacts).withColumn("wi", steps()).withColumn("wj", steps())
    a, b = (F.col("wi") + 0.5) * res - width / 2, (F.col("wj") + 0.5) * res - width / 2
    ray = ((F.col("grasp_id") * 2 + F.col("side")) * n * n + F.col("wi") * n + F.col("wj")).alias("ray_id")
    rays = c.select("grasp_id", "side", "mesh_id", "wi", "wj", ray, *[(F.col(f"p{x}") + F.col(f"t1{x}") * a + F.col(f"t2{x}") * b - back_up * F.col(f"d{x}")).alias(f"o{x}") for x in "xyz"], "dx", "dy", "dz")
    hit = closest_hits(rays, corners, max_projection + back_up)
    out = rays.join(hit, ["mesh_id", "ray_id"], "left")
    return out.select("grasp_id", "side", "wi", "wj", F.when(F.col("t").isNull(), NO_CONTACT).otherwise(F.least(F.col("t") - back_up, F.lit(max_projection))).alias("val"))


def antipodal_grasps(sdf: DataFrame, n: int, seed: int, mu: float, max_width: float, min_width: float, backup: float = 3.0) -> DataFrame:
    """Grasps (mesh_id, grasp_id, c*, a*, width; in grid units) from n draws at each surface cell.

    The cell is moved by up to half a cell, an axis is drawn from the friction cone about the inward normal there, and the
    line through both is searched from either end for the surface. Kept are grasps whose contacts are further apart than
    ``min_width``, at most ``max_width``, and in force closure. Draws depend on seed, mesh, cell and slot alone.
    """
    from ..functions import add, dot, named, norm, once, scale, sub, unit, vec
    from .quality import force_closure

    key = [F.col(x) for x in ("mesh_id", "i", "j", "k", "slot")]
    field = S.grid_gradient(sdf).select("mesh_id", "i", "j", "k", "gi", "gj", "gk")
    size = sdf.groupBy("mesh_id").agg((F.max("i") + 1).alias("_n"))
    flat = (F.col("i").cast("long") * F.col("_n") + F.col("j")) * F.col("_n") + F.col("k")
    d = S.surface_points(sdf).join(size, "mesh_id").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    d = d.withColumn("draw", F.col("mesh_id").cast("long") * (1 << 36) + flat * n + F.col("slot"))
    d = d.join(field, ["mesh_id", "i", "j", "k"])
    d = once(d, *[(F.col(i) + uniform(seed, *key, F.lit(i)) - 0.5).alias(f"s{c}") for i, c in zip("ijk", "xyz", strict=True)], *named(unit((F.col("gi"), F.col("gj"), F.col("gk"))), "n")).where("nx is not null")
    d = contact_frame(d.select("mesh_id", "draw", "_n", "i", "j", "k", "slot", "sx", "sy", "sz", "nx", "ny", "nz", *named(scale(vec("n"), F.lit(-1.0)), "d")))
    turn, far = 6.283185307179586 * uniform(seed, *key, F.lit("t")), mu * uniform(seed, *key, F.lit("r"))
    sign = F.when(uniform(seed, *key, F.lit("f")) > 0.5, 1.0).otherwise(-1.0)
    d = once(d, *named(scale(unit(add(vec("n"), add(scale(vec("t1"), far * F.cos(turn)), scale(vec("t2"), far * F.sin(turn))))), -sign), "v"))
    # two lines: from behind the drawn point on, and from the other end of the opening back
    ends = F.array(F.struct(F.lit(0).alias("end"), F.lit(-backup).alias("from"), F.lit(1.0).alias("way")), F.struct(F.lit(1).alias("end"), F.lit(max_width - backup).alias("from"), F.lit(-1.0).alias("way")))
    lines = d.select("mesh_id", "draw", "_n", "sx", "sy", "sz", "vx", "vy", "vz", F.inline(ends)).withColumn("line_id", F.col("draw") * 2 + F.col("end"))
    idx = F.explode(F.sequence(F.lit(0), F.lit(int(2 * max_width))))
    at = F.col("from") + F.col("way") * F.col("idx") / 2
    spots = lines.withColumn("idx", idx).withColumn("query_id", F.col("line_id") * 4096 + F.col("idx"))
    spots = once(spots, *named(add(vec("s"), scale(vec("v"), at)), "")).where("x >= 0 and y >= 0 and z >= 0 and x <= _n - 1 and y <= _n - 1 and z <= _n - 1")
    seen = S.sdf_lookup(sdf, spots.select("mesh_id", "query_id", "x", "y", "z"))
    hit = R.first_contact(seen.select(F.floor(F.col("query_id") / 4096).alias("line_id"), (F.col("query_id") % 4096).alias("idx"), "val"))
    c = once(lines.join(hit, "line_id"), *named(add(vec("s"), scale(vec("v"), F.col("from") + F.col("way") * F.col("at") / 2)), "p"))
    near = [F.least(F.greatest(F.floor(F.col(f"p{x}") + 0.5), F.lit(0)), F.col("_n") - 1).cast("int").alias(i) for x, i in zip("xyz", "ijk", strict=True)]
    c = c.select("mesh_id", F.col("draw").alias("grasp_id"), F.col("end").alias("side"), "px", "py", "pz", *near).join(field, ["mesh_id", "i", "j", "k"])
    c = c.select("mesh_id", "grasp_id", "side", "px", "py", "pz", F.col("gi").alias("nx"), F.col("gj").alias("ny"), F.col("gk").alias("nz"))
    closed = force_closure(c, mu).where("closed").select("grasp_id")
    side = lambda k: c.where(F.col("side") == k).select("mesh_id", "grasp_id", *[F.col(f"p{x}").alias(f"p{k}{x}") for x in "xyz"])
    both = once(side(0).join(side(1), ["mesh_id", "grasp_id"]), norm(sub(vec("p1"), vec("p0"))).alias("width"))
    both = both.where((F.col("width") > min_width) & (F.col("width") <= max_width)).join(closed, "grasp_id", "left_semi")
    return both.select("mesh_id", "grasp_id", *named(scale(add(vec("p0"), vec("p1")), 0.5), "c"), *named(scale(sub(vec("p1"), vec("p0")), 1 / F.col("width")), "a"), "width")


def image_to_mesh(mask: DataFrame, extrusion: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Meshes (vertices, faces) of the occupied pixels (frame_id, v, u) of each image.

    Each pixel is a vertex in front and one behind. It is the right-angled corner of a triangle with its neighbours before
    it in v and u, and of one with those after it; where the neighbour in v is missing, the diagonal one takes its place.
    Edges of a single front triangle get a wall of two triangles. The other side's triangles are the same, turned.
    """
    # rows of 64 pixels are one number each; each tells those around it what it holds, so no later step meets the pixels again
    words = mask.selectExpr("frame_id", "v", "shiftright(u, 6) w", "shiftleft(1L, cast(u & 63 as int)) x").groupBy("frame_id", "v", "w").agg(F.bit_or("x").alias("x"))
    told = F.array(*[F.struct((F.col("v") - a).alias("v"), (F.col("w") - b).alias("w"), F.lit(3 * a + b).alias("k")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    lines = words.select("frame_id", "x", F.inline(told)).where("k % 3 = 0 or x & if(pmod(k, 3) = 1, 3L, shiftleft(-1L, 62)) <> 0")
    names = {3 * a + b: f"{'abc'[a + 1]}{b + 1}" for a in (-1, 0, 1) for b in (-1, 0, 1)}
    lines = lines.groupBy("frame_id", "v", "w").agg(*[F.coalesce(F.bit_or(F.when(F.col("k") == k, F.col("x"))), F.lit(0).cast("long")).alias(n) for k, n in names.items()])
    known = lines.where("b1 <> 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(63)))).where("shiftright(b1, i) & 1 = 1")

    def window(n: str) -> Column:
        """Bits u - 2 to u + 2 of a line, from the lowest on."""
        low = lambda e: f"({e}) & 3"
        here = f"if(i >= 2, shiftrightunsigned({n}1, i - 2), shiftleft({n}1, 2 - i))"
        before, after = f"if(i < 2, shiftrightunsigned({n}0, 62 + i), 0L)", f"if(i > 61, shiftleft({low(f'{n}2')}, 66 - i), 0L)"
        return F.expr(f"(({here}) | ({before}) | ({after})) & 31").alias(n)

    known = known.select("frame_id", "v", (F.col("w") * 64 + F.col("i")).cast(dict(mask.dtypes)["u"]).alias("u"), *[window(n) for n in "abc"])
    on = lambda a, b: F.col("abc"[a + 1]).bitwiseAND(F.lit(1 << (b + 2))) != 0
    # whether the pixel at a step has a triangle: with its neighbours before it (straight, slanted), with those after it
    b1 = lambda a, b: on(a, b) & on(a - 1, b) & on(a, b - 1)
    b2 = lambda a, b: on(a, b) & ~on(a - 1, b) & on(a, b - 1) & on(a - 1, b - 1) & (F.col("v") + a > 1) & (F.col("u") + b > 1)
    a1 = lambda a, b: on(a, b) & on(a + 1, b) & on(a, b + 1)
    a2 = lambda a, b: on(a, b) & ~on(a + 1, b) & on(a, b + 1) & on(a + 1, b + 1)
    here = lambda a, b: F.struct((F.col("v") + a).alias("v"), (F.col("u") + b).alias("u"))

    def triangle(p, q, r, *shared: Column) -> Column:
        """The corners and which of the sides p-q, q-r, r-p are of this triangle alone."""
        return F.struct(*[here(*x).alias(n) for x, n in zip((p, q, r), "abc", strict=True)], F.array(*[~x for x in shared]).alias("alone"))

    past, next_ = b1(0, 1) | b2(0, 1), a1(0, -1) | a2(0, -1)
    before = F.when(b1(0, 0), triangle((0, 0), (-1, 0), (0, -1), b2(0, 1) | a1(-1, 0), a1(-1, -1), next_))
    before = before.when(b2(0, 0), triangle((0, 0), (-1, -1), (0, -1), a2(-1, -1), b1(0, -1) | a2(-1, -2), next_))
    after = F.when(a1(0, 0), triangle((0, 0), (1, 0), (0, 1), b1(1, 0) | a2(0, -1), b1(1, 1), past))
    after = after.when(a2(0, 0), triangle((0, 0), (1, 1), (0, 1), b2(1, 1), b2(1, 2) | a1(0, 1), past))
    front = known.select("frame_id", F.inline(F.array_compact(F.array(before, after))))
    side = lambda k, p, q: F.when(F.col("alone")[k], F.struct(F.col(p).alias("p"), F.col(q).alias("q")))
    edges = front.select("frame_id", F.inline(F.array_compact(F.array(*[side(k, p, q) for k, (p, q) in enumerate((("a", "b"), ("b", "c"), ("c", "a")))]))))
    at = lambda x, back: F.struct(F.col(f"{x}.v").alias("v"), F.col(f"{x}.u").alias("u"), F.lit(back).alias("back"))
    face = lambda *p: F.struct(*[at(*x).alias(n) for x, n in zip(p, "abc", strict=True)])
    sides = front.select("frame_id", F.inline(F.array(face(("a", 0), ("b", 0), ("c", 0)), face(("a", 1), ("c", 1), ("b", 1)))))
    walls = edges.select("frame_id", F.inline(F.array(face(("q", 0), ("p", 0), ("p", 1)), face(("q", 0), ("p", 1), ("q", 1)))))
    faces = sides.union(walls)
    used = faces.select("frame_id", F.explode(F.array("a", "b", "c")).alias("w")).select("frame_id", "w.v", "w.u", "w.back").distinct()
    used = used.select(F.col("frame_id").alias("mesh_id"), (F.col("v").cast("long") * (1 << 31) * 2 + F.col("u") * 2 + F.col("back")).alias("vid"), F.col("v").cast("double").alias("x"), F.col("u").cast("double").alias("y"), (extrusion * (0.5 - F.col("back"))).alias("z"))
    number = lambda x: (F.col(f"{x}.v").cast("long") * (1 << 31) * 2 + F.col(f"{x}.u") * 2 + F.col(f"{x}.back")).alias(x)
    return used, faces.select(F.col("frame_id").alias("mesh_id"), number("a"), number("b"), number("c"))


def surface_window(contacts: DataFrame, sdf: DataFrame, width: float, n: int, outside: float = -0.01) -> DataFrame:
    """n x n values of the grid on each contact's tangent plane (grasp_id, side, mesh_id, p*, d*); ``outside`` off the grid."""
    size = sdf.groupBy("mesh_id").agg((F.max("i") + 1).alias("_n"))
    c = contact_frame(contacts).withColumn("wi", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("wj", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    step = width / (n - 1)
    a, b = (F.col("wi") - (n - 1) / 2) * step, (F.col("wj") - (n - 1) / 2) * step
    q = c.select("grasp_id", "side", "mesh_id", "wi", "wj", ((F.col("grasp_id") * 2 + F.col("side")) * n * n + F.col("wi") * n + F.col("wj")).alias("query_id"), *[(F.col(f"p{x}") + F.col(f"t1{x}") * a + F.col(f"t2{x}") * b).alias(x) for x in "xyz"])
    found = S.sdf_lookup(sdf, q.select("mesh_id", "query_id", "x", "y", "z"))
    off = F.expr("x < 0 or y < 0 or z < 0 or x >= _n or y >= _n or z >= _n")
    return q.join(found, ["mesh_id", "query_id"]).join(size, "mesh_id").select("grasp_id", "side", "wi", "wj", F.when(off, outside).otherwise(F.col("val")).alias("val"))


def piece_inertia(pieces: DataFrame, whole: DataFrame, density: float) -> DataFrame:
    """Mass of each piece (corners with a column piece): the density is raised so that the pieces weigh what the whole does."""
    each = pieces.groupBy("mesh_id", "piece").agg(F.abs(F.sum(M._volume())).alias("v"))
    sums = each.groupBy("mesh_id").agg(F.sum("v").alias("s")).join(M.mesh_volume(whole), "mesh_id")
    return each.join(sums, "mesh_id").select("mesh_id", "piece", (F.col("v") * density * F.col("volume") / F.col("s")).alias("mass"))


def choose(state: DataFrame, policy: str, seed: int) -> DataFrame:
    """The next arm of (arm, alpha, beta, mean): by chance, the largest mean, or the largest draw from each Beta.

    A draw is the quantile of a number that depends on seed and arm alone.
    """
    if policy == "uniform":
        return state.withColumn("draw", uniform(seed, F.col("arm"))).orderBy(F.desc("draw"), "arm").limit(1).select("arm")
    if policy == "greedy":
        return state.orderBy(F.desc("mean"), "arm").limit(1).select("arm")
    draw = uniform(seed, F.col("arm"))
    drawn = L.with_quantile(L.may_be_largest(state, draw), draw, "draw")
    return drawn.orderBy(F.desc("draw"), "arm").limit(1).select("arm")


def generate(method: str, **config) -> DataFrame:
    """Grasps by the sampler's name: uniform, gaussian, sweep or antipodal."""
    by_name = {"uniform": R.uniform_grasps, "gaussian": R.gaussian_grasps, "sweep": G.sweep_grasps, "antipodal": antipodal_grasps}
    if method not in by_name:
        raise ValueError(f"no sampler named {method}")
    return by_name[method](**config)


def logistic_terms(df: DataFrame, xs: list[str], y: str, beta: list[float]) -> DataFrame:
    """Gradient and Hessian sums of a logistic fit at beta: (i, j, s), j = -1 for the gradient, which carries 2 beta_i more."""
    z = sum((F.col(x) * b for x, b in zip(xs[1:], beta[1:], strict=True)), F.col(xs[0]) * beta[0])
    p = 1 / (1 + F.exp(-z))
    e = df.select(*xs, p.alias("_p"), (F.col(y) - p).alias("_r"))
    terms = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.col(a) * F.col(b) * F.col("_p") * (1 - F.col("_p"))).alias("v")) for i, a in enumerate(xs) for j, b in enumerate(xs)] + [F.struct(F.lit(i).alias("i"), F.lit(-1).alias("j"), (F.col(a) * F.col("_r")).alias("v")) for i, a in enumerate(xs)]
    s = e.select(F.explode(F.array(*terms)).alias("e")).groupBy("e.i", "e.j").agg(F.sum("e.v").alias("s"))
    two = F.element_at(F.array(*[F.lit(2.0 * b) for b in beta]), F.col("i") + 1)
    return s.withColumn("s", F.col("s") + F.when(F.col("j") == -1, two).otherwise(0.0))


def face_basis(corners: DataFrame, vertices: DataFrame) -> DataFrame:
    """Rotation of each face's stable pose: z along the normal on the side that holds the mesh's middle, x the principal
    axis of the vertices seen along z, y = z cross x. Rows r0 (x), r1 (y), r2 (z) as x, y, z columns.

    A covariance that is zero but for rounding counts as zero, so that x doesn't turn round with the order of the sums."""
    from ..functions import cross, dot, named, once, sub, unit, vec

    mid = vertices.groupBy("mesh_id").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    cov = vertices.groupBy("mesh_id").agg(*[F.covar_pop(a, b).alias(f"s{a}{b}") for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")])
    at = lambda n: tuple(F.col(f"{c}{n}") for c in "xyz")
    f = once(corners.join(mid, "mesh_id").join(cov, "mesh_id"), *named(unit(cross(sub(at(2), at(1)), sub(at(3), at(1)))), "n"))
    side = F.when(dot(vec("n"), sub(vec("m"), at(1))) < 0, -1.0).otherwise(1.0)
    f = once(f, *[(F.col(f"n{c}") * side).alias(f"r2{c}") for c in "xyz"]).where("r2x is not null")
    # any two axes across z: the one closest to x (or y), and its partner
    ref = F.abs(F.col("r2x")) > 0.9
    e = (F.when(ref, 0.0).otherwise(1.0), F.when(ref, 1.0).otherwise(0.0), F.lit(0.0))
    f = once(f, dot(e, vec("r2")).alias("_d"))
    f = once(f, *named(unit(tuple(a - F.col("_d") * b for a, b in zip(e, vec("r2"), strict=True))), "u"))
    f = once(f, *named(cross(vec("r2"), vec("u")), "v"))
    s = {a + b: F.col(f"s{min(a, b)}{max(a, b)}") for a in "xyz" for b in "xyz"}
    form = lambda p, q: sum((F.col(f"{p}{a}") * s[a + b] * F.col(f"{q}{b}") for a in "xyz" for b in "xyz"), F.lit(0.0))
    f = once(f, form("u", "u").alias("_a"), form("u", "v").alias("_b"), form("v", "v").alias("_c"))
    solid = lambda c: F.when(F.abs(c) > 1e-12 * (F.col("_a") + F.col("_c")), c).otherwise(0.0)
    f = once(f, (F.atan2(2 * solid(F.col("_b")), solid(F.col("_a") - F.col("_c"))) / 2).alias("_t"))
    f = once(f, *[(F.cos("_t") * F.col(f"u{c}") + F.sin("_t") * F.col(f"v{c}")).alias(f"r0{c}") for c in "xyz"])
    f = once(f, *named(cross(vec("r2"), vec("r0")), "r1"))
    return f.select("mesh_id", "fid", *[f"r{k}{c}" for k in range(3) for c in "xyz"])


def perturb_objects(meshes: DataFrame, n: int, seed: int, shift: float, size: float) -> DataFrame:
    """n copies of each mesh's placement (mesh_id): a scale (at least 0.01) and a shift of its mass centre."""
    from ..functions import gauss

    g = meshes.select("mesh_id").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    key = lambda k: (F.col("mesh_id"), F.col("copy"), F.lit(k))
    return g.select("mesh_id", "copy", F.greatest(1 + size * gauss(seed, *key("s")), F.lit(0.01)).alias("scale"), *[(shift * gauss(seed, *key(c))).alias(f"d{c}") for c in "xyz"])


def candidates(grasps: DataFrame, poses: DataFrame, min_p: float, max_deg: float, points: DataFrame) -> DataFrame:
    """Grasps with their object's stable poses (cloud_id, pose_id, p) of p above the minimum whose approach is within the
    angle of the pose's normal (here the table's z), flagged free if their hand meets no point; colliding ones stay."""
    near = G.table_angles(grasps).where(F.least("approach_angle", F.pi() - F.col("approach_angle")) <= F.radians(F.lit(max_deg))).select("grasp_id")
    free = G.free_hands(points, grasps).select("grasp_id", "free")
    return grasps.join(near, "grasp_id", "left_semi").join(poses.where(F.col("p") > min_p), "cloud_id").join(free, "grasp_id").select("grasp_id", "pose_id", "p", "free")
