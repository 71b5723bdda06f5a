"""Draws of cameras, grasps and perturbations; each depends on its seed and keys alone."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import add, dot, gauss, named, norm, once, rot_axis_angle, scale, sph_to_cart, sub, uniform, unit, vec


def view_grid(spark: SparkSession, radii: tuple[float, float, int], elevations: tuple[float, float, int], azimuths: tuple[float, float, int], rolls: tuple[float, float, int]) -> DataFrame:
    """Cameras on spheres: (first, last, number) of each; radius and elevation take both ends, azimuth and roll the first only."""
    def steps(name: str, r: tuple[float, float, int], both: bool) -> DataFrame:
        n = max(1, r[2] - 1 if both else r[2])
        return spark.range(r[2]).select((r[0] + F.col("id") * ((r[1] - r[0]) / n)).alias(name))

    g = steps("radius", radii, True).crossJoin(steps("elevation", elevations, True)).crossJoin(steps("azimuth", azimuths, False)).crossJoin(steps("roll", rolls, False))  # a small table by its arguments
    return g.select("*", *named(sph_to_cart(F.col("radius"), F.col("azimuth"), F.col("elevation")), "c"))


def object_views(objects: DataFrame, radii: int, elevations: int, azimuths: int, seed: int) -> DataFrame:
    """Cameras on spheres about each object (object_id, r_lo, r_hi, e_lo, e_hi): all steps of radius and elevation (both ends
    taken) and of azimuth, and for each a camera drawn evenly from the same ranges (drawn is true)."""
    part = lambda lo, hi, i, n: F.col(lo) + (F.col(hi) - F.col(lo)) * F.col(i) / max(1, n - 1)
    step = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    g = objects.withColumn("a", step(radii)).withColumn("b", step(elevations)).withColumn("c", step(azimuths)).withColumn("drawn", F.explode(F.array(F.lit(False), F.lit(True))))
    key = [F.col(x) for x in ("object_id", "a", "b", "c")]
    draw = lambda lo, hi, k: F.col(lo) + (F.col(hi) - F.col(lo)) * uniform(seed, *key, F.lit(k))
    turn = 2 * math.pi
    g = g.withColumn("radius", F.when(F.col("drawn"), draw("r_lo", "r_hi", "r")).otherwise(part("r_lo", "r_hi", "a", radii)))
    g = g.withColumn("elevation", F.when(F.col("drawn"), draw("e_lo", "e_hi", "e")).otherwise(part("e_lo", "e_hi", "b", elevations)))
    g = g.withColumn("azimuth", F.when(F.col("drawn"), turn * uniform(seed, *key, F.lit("z"))).otherwise(turn * F.col("c") / azimuths))
    return g.select("object_id", "a", "b", "c", "drawn", "radius", "elevation", "azimuth", *named(sph_to_cart(F.col("radius"), F.col("azimuth"), F.col("elevation")), "c"))


def sample_views(spark: SparkSession, n: int, ranges: dict[str, tuple[float, float]], seed: int) -> DataFrame:
    """n cameras, each parameter even in its range, with its place for radius, azimuth and elevation."""
    out = spark.range(n).withColumnRenamed("id", "view")
    for name, (lo, hi) in ranges.items():
        out = out.withColumn(name, lo + (hi - lo) * uniform(seed, F.col("view"), F.lit(name)))
    return out.select("*", *named(sph_to_cart(F.col("radius"), F.col("azimuth"), F.col("elevation")), "c")) if {"radius", "azimuth", "elevation"} <= set(ranges) else out


def uniform_grasps(surface: DataFrame, n: int, seed: int, least: float, most: float) -> DataFrame:
    """Grasps between random pairs of a cloud's points whose distance is strictly between the bounds.

    Pairs are drawn by place (hash of seed, cloud and slot), then joined: n pairs a cloud, never all.
    """
    from pyspark.sql import Window

    size = surface.groupBy("cloud_id").agg(F.count("*").alias("_n"))
    ranked = surface.withColumn("_at", F.row_number().over(Window.partitionBy("cloud_id").orderBy("point_id")) - 1)
    d = size.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    for k in (1, 2):
        d = d.withColumn(f"_a{k}", F.floor(uniform(seed, F.col("cloud_id"), F.col("slot"), F.lit(k)) * F.col("_n")))
        d = d.join(ranked.select("cloud_id", F.col("_at").alias(f"_a{k}"), *[F.col(c).alias(f"p{k}{c}") for c in "xyz"]), ["cloud_id", f"_a{k}"])
    v = sub(vec("p2"), vec("p1"))
    d = once(d, norm(v).alias("width")).where((F.col("width") > least) & (F.col("width") < most))
    return d.select("cloud_id", "slot", *named(scale(add(vec("p1"), vec("p2")), 0.5), "c"), *named(scale(v, 1 / F.col("width")), "a"), "width")


def gaussian_grasps(bounds: DataFrame, n: int, seed: int, width: float) -> DataFrame:
    """Grasps about the middle of each mesh (mesh_id, lo_*, hi_*, mean_*): centres normal with a deviation of a fifth of
    the extent, axes even on the sphere."""
    g = bounds.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    key = lambda k: (F.col("mesh_id"), F.col("slot"), F.lit(k))
    c = [(F.col(f"mean_{a}") + (F.col(f"hi_{a}") - F.col(f"lo_{a}")) / 5 * gauss(seed, *key(a))).alias(f"c{a}") for a in "xyz"]
    axis = sph_to_cart(F.lit(1.0), 2 * math.pi * uniform(seed, *key("t")), F.acos(1 - 2 * uniform(seed, *key("p"))))
    return g.select("mesh_id", "slot", *c, *named(axis, "a"), F.lit(width).alias("width"))


def perturb_grasps(grasps: DataFrame, n: int, seed: int, turn: float, shift: float, width: float) -> DataFrame:
    """n copies of each grasp, turned about a random vector, shifted and with another width (at least 0)."""
    g = grasps.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    key = lambda k: (F.col("grasp_id"), F.col("copy"), F.lit(k))
    g = once(g, *[(turn * gauss(seed, *key(f"r{a}"))).alias(f"r{a}") for a in "xyz"])
    g = once(g, norm(vec("r")).alias("_t"))
    g = once(g, *named(tuple(F.coalesce(x, F.lit(float(i == 2))) for i, x in enumerate(unit(vec("r")))), "k"))
    m = rot_axis_angle(vec("k"), F.col("_t"))
    axis = [sum((m[i][j] * F.col(f"a{'xyz'[j]}") for j in (1, 2)), m[i][0] * F.col("ax")) for i in range(3)]
    return g.select("grasp_id", "copy", *[(F.col(f"c{a}") + shift * gauss(seed, *key(f"c{a}"))).alias(f"c{a}") for a in "xyz"], *named(tuple(axis), "a"), F.greatest(F.col("width") + width * gauss(seed, *key("w")), F.lit(0.0)).alias("width"))


def first_contact(samples: DataFrame, thresh: float = 0.5) -> DataFrame:
    """Along each line (line_id, idx, val): the first sample within the threshold of the surface, moved to the zero of the
    parabola through it and its neighbours if that lies within one step; rejected when the next value is nearer."""
    from pyspark.sql import Window

    w = Window.partitionBy("line_id").orderBy("idx")
    s = samples.withColumn("p", F.lag("val").over(w)).withColumn("n", F.lead("val").over(w))
    hit = s.where(F.abs("val") < thresh).groupBy("line_id").agg(F.min(F.struct("idx", "val", "p", "n")).alias("h")).select("line_id", "h.*")
    a, b, c = (F.col("p") + F.col("n")) / 2 - F.col("val"), (F.col("n") - F.col("p")) / 2, F.col("val")
    root = F.sqrt(F.greatest(b * b - 4 * a * c, F.lit(0.0)))
    flat = F.abs(a) < 1e-12
    x1, x2 = (-b + root) / F.nullif(2 * a, F.lit(0.0)), (-b - root) / F.nullif(2 * a, F.lit(0.0))
    t = F.when(flat, -c / F.nullif(b, F.lit(0.0))).when(F.abs(x1) <= F.abs(x2), x1).otherwise(x2)
    return once(hit, t.alias("t")).where((F.abs("t") <= 1) & ((F.abs("n") >= F.abs("val")) | (F.col("n") * F.col("val") <= 0))).select("line_id", (F.col("idx") + F.col("t")).alias("at"))


def inside_tray(corners: DataFrame, points: DataFrame, keys: tuple[int, ...] = (1, 2, 5, 6, 9, 10, 13, 14)) -> DataFrame:
    """Whether the chosen hand corners of a grasp (grasp_id, cloud_id, point, x, y) are within its cloud's bounds in x and y."""
    b = points.groupBy("cloud_id").agg(*[f(c).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xy"])
    ok = (F.col("x") > F.col("lo_x")) & (F.col("x") < F.col("hi_x")) & (F.col("y") > F.col("lo_y")) & (F.col("y") < F.col("hi_y"))
    return corners.where(F.col("point").isin(*keys)).join(b, "cloud_id").groupBy("grasp_id").agg(F.bool_and(ok).alias("inside"))


def table_collision(corners: DataFrame, normal: tuple[float, float, float], offset: float, clearance: float) -> DataFrame:
    """Whether any hand corner of a grasp is nearer to the table's plane than the clearance."""
    h = dot(vec(), tuple(F.lit(c) for c in normal)) - offset
    return corners.groupBy("grasp_id").agg((F.min(h) < clearance).alias("collides"))


def same_pose(a: str, b: str, within: float = 1e-5):
    """Whether two rotations (array columns of nine) are equal up to a turn about the vertical: equal third rows."""
    out = F.lit(True)
    for i in (6, 7, 8):
        out = out & (F.abs(F.get(F.col(a), F.lit(i)) - F.get(F.col(b), F.lit(i))) <= within)
    return out


def approach_until_collision(points: DataFrame, grasps: DataFrame, step: float, n: int, back: int = 1, gripper: dict | None = None) -> DataFrame:
    """Move each hand forward step by step to the first collision, then ``back`` steps: (grasp_id, steps); null if it
    never collides within n steps."""
    from .grasps import GRIPPER, free_hands, grasp_frame

    g = grasp_frame(grasps).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    g = g.select((F.col("grasp_id") * n + F.col("step")).alias("grasp_id"), "cloud_id", *[(F.col(f"c{c}") + F.col(f"ap{c}") * F.col("step") * step).alias(f"c{c}") for c in "xyz"], "ax", "ay", "az", "width", "angle")
    hit = free_hands(points, g, gripper or GRIPPER).select(F.floor(F.col("grasp_id") / n).alias("grasp_id"), (F.col("grasp_id") % n).alias("step"), (~F.col("free")).alias("hit"))
    first = hit.groupBy("grasp_id").agg(F.min(F.when(F.col("hit"), F.col("step"))).alias("first"))
    return first.select("grasp_id", (F.col("first") - back).alias("steps"))


