"""Contacts, friction cones, wrenches and closure of grasps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import add, cross, dot, named, norm, once, scale, sub, unit, vec
from ..functions.eigen import eigenvalues
from .rounds import small


def contact_frame(contacts: DataFrame) -> DataFrame:
    """Adds tangents t1* (the one closest to +x, or +y where the direction is along x) and t2* = direction x t1."""
    d = unit(vec("d"))
    c = once(contacts, *named(d, "_d"))
    along_x = F.abs(F.abs(F.col("_dx")) - 1) < 1e-9
    t = (1 - F.col("_dx") ** 2, -F.col("_dx") * F.col("_dy"), -F.col("_dx") * F.col("_dz"))
    t = tuple(F.when(along_x, F.lit(float(i == 1))).otherwise(x / F.nullif(F.sqrt(1 - F.col("_dx") ** 2), F.lit(0.0))) for i, x in enumerate(t))
    c = once(c, *named(t, "t1"))
    return once(c, *named(cross(vec("_d"), vec("t1")), "t2")).drop("_dx", "_dy", "_dz")


def friction_cone(contacts: DataFrame, mu: float = 0.5, n: int = 8) -> DataFrame:
    """n edges of each contact's cone: inward direction + mu times a tangent. ``valid`` is whether the contact's own
    direction lies in the cone about the inward normal."""
    c = contact_frame(contacts).withColumn("edge", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    a = F.col("edge") * (2 * 3.141592653589793 / n)
    inward = scale(vec("n"), F.lit(-1.0))
    along = dot(vec("d"), inward)
    c = once(c, along.alias("_a"), norm(sub(vec("d"), scale(inward, along))).alias("_t"))
    f = add(vec("d"), add(scale(vec("t1"), F.cos(a) * mu), scale(vec("t2"), F.sin(a) * mu)))
    return c.select("grasp_id", "side", "edge", *named(f, "f"), (F.col("_t") <= mu * F.col("_a")).alias("valid"))


def wrenches(contacts: DataFrame, cone: DataFrame, com: DataFrame) -> DataFrame:
    """Forces of the cone with their torques about the grasp's centre of mass (grasp_id, com_x..z), each force times the
    normal component of its contact."""
    inward = F.greatest(-dot(vec("d"), vec("n")), F.lit(0.0))
    c = contacts.join(com, "grasp_id").select("grasp_id", "side", *[(F.col(f"p{k}") - F.col(f"com_{k}")).alias(f"r{k}") for k in "xyz"], inward.alias("_w"))
    w = cone.join(c, ["grasp_id", "side"]).select("grasp_id", "side", "edge", *[(F.col(f"f{k}") * F.col("_w")).alias(f"f{k}") for k in "xyz"], "rx", "ry", "rz")
    return w.select("grasp_id", "side", "edge", "fx", "fy", "fz", *named(cross(vec("r"), vec("f")), "t"))


def force_closure(contacts: DataFrame, mu: float, use_abs: bool = True) -> DataFrame:
    """Whether at both contacts the line to the other is within the friction cone; equal points or no normals: not."""
    side = lambda k: contacts.where(F.col("side") == k).select("grasp_id", *[F.col(f"{a}{c}").alias(f"{a}{k}{c}") for a in "pn" for c in "xyz"])
    both = once(side(0).join(side(1), "grasp_id"), *named(sub(vec("p1"), vec("p0")), "l"))
    length = norm(vec("l"))
    one = -dot(vec("n0"), vec("l")) / F.nullif(length * norm(vec("n0")), F.lit(0.0))
    two = dot(vec("n1"), vec("l")) / F.nullif(length * norm(vec("n1")), F.lit(0.0))
    if use_abs:
        one, two = F.abs(one), F.abs(two)
    limit = F.atan(F.lit(mu))
    angle = lambda c: F.acos(F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0)))
    return both.select("grasp_id", F.coalesce((angle(one) <= limit) & (angle(two) <= limit), F.lit(False)).alias("closed"))


W6 = ("fx", "fy", "fz", "tx", "ty", "tz")


def grasp_gram(w: DataFrame) -> DataFrame:
    """The 21 different numbers of the sum of outer products of each grasp's wrenches."""
    return w.groupBy("grasp_id").agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(W6) for b in W6[i:]])


def grasp_spectrum(gram: DataFrame) -> DataFrame:
    """Smallest singular value, volume and isotropy of the grasp map, from its Gram matrix.

    Eigenvalues below 1e-12 of the largest are 0 (two contacts never have full rank); isotropy is 0 where all are.
    """
    m = F.array(*[F.col(f"{min(a, b, key=W6.index)}_{max(a, b, key=W6.index)}") for a in W6 for b in W6])
    e = once(gram.select("grasp_id", m.alias("m")), eigenvalues(F.col("m"), 6).alias("l"))
    e = once(e, F.transform("l", lambda x: F.when(x > 1e-12 * F.element_at("l", 6), F.sqrt(x)).otherwise(0.0)).alias("s"))
    least, most = F.element_at("s", 1), F.element_at("s", 6)
    volume = F.sqrt(F.aggregate("s", F.lit(1.0), lambda a, x: a * x))
    return e.select("grasp_id", least.alias("min_singular"), volume.alias("volume"), F.coalesce(least / F.nullif(most, F.lit(0.0)), F.lit(0.0)).alias("isotropy"))


def epsilon_directions(w: DataFrame, directions: DataFrame) -> DataFrame:
    """Upper bound of the epsilon quality: least over the directions (dir_id, u0..u5; a small table) of the farthest
    wrench along them, at least 0."""
    reach = sum((F.col(a) * F.col(f"u{i}") for i, a in enumerate(W6) if i), F.col("fx") * F.col("u0"))
    far = w.crossJoin(small(directions)).groupBy("grasp_id", "dir_id").agg(F.max(reach).alias("h"))
    return far.groupBy("grasp_id").agg(F.greatest(F.min("h"), F.lit(0.0)).alias("epsilon"))


def epsilon_force(w: DataFrame) -> DataFrame:
    """Epsilon quality of the forces alone: distance from the origin to the nearest facet of their hull, 0 unless it is
    strictly inside. All triples of a grasp's few forces are tried as facets; the group's size is set by the cone."""
    f = w.select("grasp_id", (F.col("side") * 1000 + F.col("edge")).alias("k"), "fx", "fy", "fz")
    one = lambda n: f.select("grasp_id", *[F.col(c).alias(f"{c[-1] if c != 'k' else 'k'}{n}") for c in ("k", "fx", "fy", "fz")])
    at = lambda n: tuple(F.col(f"{c}{n}") for c in "xyz")
    t = one(1).join(one(2), "grasp_id").where("k1 < k2").join(one(3), "grasp_id").where("k2 < k3")
    t = once(t, *named(cross(sub(at(2), at(1)), sub(at(3), at(1))), "m")).where(norm(vec("m")) > 1e-12)
    t = once(t, *named(unit(vec("m")), "u"))
    t = once(t, dot(vec("u"), at(1)).alias("off"))
    gaps = t.select("grasp_id", "k1", "k2", "k3", "ux", "uy", "uz", "off").join(f, "grasp_id").withColumn("gap", dot(vec("u"), vec("f")) - F.col("off"))
    planes = gaps.groupBy("grasp_id", "k1", "k2", "k3").agg(F.max("gap").alias("hi"), F.min("gap").alias("lo"), F.first("off").alias("off"))
    facets = planes.where("hi <= 1e-9 or lo >= -1e-9").select("grasp_id", F.when(F.col("hi") <= 1e-9, F.col("off")).otherwise(-F.col("off")).alias("dist"))
    best = facets.groupBy("grasp_id").agg(F.min("dist").alias("d"))
    return f.select("grasp_id").distinct().join(best, "grasp_id", "left").select("grasp_id", F.greatest(F.coalesce("d", F.lit(0.0)), F.lit(0.0)).alias("epsilon"))


def expected_quality(samples: DataFrame) -> DataFrame:
    """Mean and population variance of the quality over a grasp's samples."""
    return samples.groupBy("grasp_id").agg(F.avg("quality").alias("mean"), F.var_pop("quality").alias("variance"), F.count("*").alias("n"))


def quality(contacts: DataFrame, method: str, **config) -> DataFrame:
    """Quality by name, with its required settings checked. force_closure needs exactly two contacts of each grasp."""
    needs = {"force_closure": {"mu"}, "epsilon_force": {"mu", "n"}, "epsilon": {"mu", "n", "directions", "com"}}
    if method not in needs:
        raise ValueError(f"no quality named {method}")
    if missing := needs[method] - set(config):
        raise ValueError(f"{method} needs {', '.join(sorted(missing))}")
    if method == "force_closure":
        two = contacts.groupBy("grasp_id").agg(F.count("*").alias("n")).where("n = 2").select("grasp_id")
        return force_closure(contacts.join(two, "grasp_id", "left_semi"), config["mu"], config.get("use_abs", True)).select("grasp_id", F.col("closed").cast("double").alias("quality"))
    cone = friction_cone(contacts, config["mu"], config["n"])
    if method == "epsilon_force":
        return epsilon_force(cone).withColumnRenamed("epsilon", "quality")
    return epsilon_directions(wrenches(contacts, cone, config["com"]), config["directions"]).withColumnRenamed("epsilon", "quality")
