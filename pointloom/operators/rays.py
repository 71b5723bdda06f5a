"""Rays against triangle meshes, by grid cells that both pass through.

Faces go by the size of their box, in powers of two; those of one size share a grid whose cells are at least as wide as
they are, so each lies in at most eight. A ray lists the cells that it passes within the box of each size's faces. Rays
and faces meet by an equi-join on cells, so a ray is tried with the faces along its way alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cross, dot, named, once, sub, vec
from .mesh import corner
from .rounds import save

#: A grid has at least so many cells along its longest side before its cells are made wider than its faces are.
LEAST_ACROSS = 64


def _sized(corners: DataFrame) -> DataFrame:
    """Faces with their boxes and the power of two that their longest side fits in."""
    lo, hi = ([f(*[F.col(f"{c}{n}") for n in (1, 2, 3)]).alias(f"_{k}{c}") for c in "xyz"] for k, f in (("lo", F.least), ("hi", F.greatest)))
    boxed = once(corners, *lo, *hi)
    longest = F.greatest(*[F.col(f"_hi{c}") - F.col(f"_lo{c}") for c in "xyz"])
    return boxed.withColumn("_size", F.ceil(F.log2(F.greatest(longest, F.lit(1e-300)))).cast("int"))


def grids(sized: DataFrame) -> DataFrame:
    """A grid for each mesh and size of faces: box, cell side, and how far beyond its box a face is listed against rounding.

    Cells are widened where the faces of a size are few and far apart: a ray passes some four times the root of the
    number of faces at most, or ``LEAST_ACROSS`` cells if that is more.
    """
    ends = [f(f"_{k}{c}").alias(f"{k}{c}") for k, f in (("lo", F.min), ("hi", F.max)) for c in "xyz"]
    g = sized.groupBy("mesh_id", "_size").agg(F.count("*").alias("n"), *ends)
    across = F.greatest(*[F.col(f"hi{c}") - F.col(f"lo{c}") for c in "xyz"])
    side = F.greatest(F.pow(F.lit(2.0), F.col("_size")), across / F.greatest(F.lit(float(LEAST_ACROSS)), 4 * F.sqrt("n")))
    far = F.greatest(*[F.abs(f"{k}{c}") for k in ("lo", "hi") for c in "xyz"])
    return once(g, side.alias("side")).withColumn("pad", 1e-6 * F.col("side") + 1e-12 * far).drop("n")


def _range(low: Column, high: Column) -> Column:
    """Whole numbers from low to high; none if high is below low."""
    return F.when(high >= low, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<bigint>"))


def face_cells(sized: DataFrame, grid: DataFrame) -> DataFrame:
    """A row for each cell that a face's box touches."""
    out = sized.join(grid.select("mesh_id", "_size", "side", "pad"), ["mesh_id", "_size"])
    for c in "xyz":
        out = out.withColumn(f"_c{c}", F.explode(_range(F.floor((F.col(f"_lo{c}") - F.col("pad")) / F.col("side")), F.floor((F.col(f"_hi{c}") + F.col("pad")) / F.col("side")))))
    return out


def _distance(o: Column, d: Column):
    return lambda plane: (plane * F.col("side") - o) / d


def ray_cells(rays: DataFrame, grid: DataFrame, beyond: float, max_dist: float) -> DataFrame:
    """A row for each cell that a ray passes at distances from ``beyond`` to ``max_dist``, within the box of each grid of its mesh."""
    r = rays.select("mesh_id", "ray_id", *[f"{k}{c}" for k in "od" for c in "xyz"]).join(grid, "mesh_id")
    enter, leave = [F.lit(max(0.0, float(beyond)))], [F.lit(float(max_dist))]
    inf = F.lit(float("inf"))
    for c in "xyz":
        o, d = F.col(f"o{c}"), F.nullif(F.col(f"d{c}"), F.lit(0.0))
        lo, hi = F.col(f"lo{c}") - F.col("pad"), F.col(f"hi{c}") + F.col("pad")
        inside = (o >= lo) & (o <= hi)  # a ray along the box's side is within its bounds all the way, or nowhere
        enter.append(F.when(d.isNull(), F.when(inside, -inf).otherwise(inf)).otherwise(F.least((lo - o) / d, (hi - o) / d)))
        leave.append(F.when(d.isNull(), F.when(inside, inf).otherwise(-inf)).otherwise(F.greatest((lo - o) / d, (hi - o) / d)))
    r = once(r, F.greatest(*enter).alias("_t0"), F.least(*leave).alias("_t1")).where("_t0 <= _t1")
    turns = [F.array("_t0")]
    for c in "xyz":  # distances at which the ray passes from cell to cell
        o, d = F.col(f"o{c}"), F.nullif(F.col(f"d{c}"), F.lit(0.0))
        a, b = (o + F.col(f"d{c}") * F.col(t) for t in ("_t0", "_t1"))
        planes = _range(F.floor(F.least(a, b) / F.col("side")) + 1, F.floor(F.greatest(a, b) / F.col("side")))
        turns.append(F.when(d.isNull(), F.array().cast("array<double>")).otherwise(F.transform(planes, _distance(o, d))))
    r = once(r, F.array_sort(F.concat(*turns, F.array("_t1"))).alias("_turns"))
    middle = F.transform(F.sequence(F.lit(1), F.size("_turns") - 1), lambda i: (F.element_at("_turns", i) + F.element_at("_turns", i + 1)) / 2)
    cell = F.transform(middle, lambda t: F.struct(*[F.floor((F.col(f"o{c}") + F.col(f"d{c}") * t) / F.col("side")).alias(f"_c{c}") for c in "xyz"]))
    r = r.withColumn("_cell", F.explode(F.array_distinct(cell)))
    return r.select("mesh_id", "ray_id", *[f"{k}{c}" for k in "od" for c in "xyz"], "_size", "_cell.*")


def candidates(rays: DataFrame, corners: DataFrame, max_dist: float, beyond: float = 0.0) -> DataFrame:
    """Rays with the faces that share a cell with them: a row for each such cell."""
    sized = _sized(corners.select("mesh_id", "fid", *[f"{c}{n}" for n in (1, 2, 3) for c in "xyz"]))
    grid = grids(sized)
    return ray_cells(rays, grid, beyond, max_dist).join(face_cells(sized, grid), ["mesh_id", "_size", "_cx", "_cy", "_cz"])


def _hits(rays: DataFrame, corners: DataFrame, max_dist: float, beyond: float) -> DataFrame:
    e1, e2 = sub(corner(2), corner(1)), sub(corner(3), corner(1))
    both = once(candidates(rays, corners, max_dist, beyond), *named(cross(vec("d"), e2), "_p"))
    both = once(both, dot(e1, vec("_p")).alias("_det"), *named(sub(vec("o"), corner(1)), "_t")).where(F.abs("_det") > 1e-12)
    both = once(both, *named(cross(vec("_t"), e1), "_q"))
    both = once(both, (dot(vec("_t"), vec("_p")) / F.col("_det")).alias("bu"), (dot(vec("d"), vec("_q")) / F.col("_det")).alias("bv"), (dot(e2, vec("_q")) / F.col("_det")).alias("t"))
    return both.where((F.col("bu") >= 0) & (F.col("bv") >= 0) & (F.col("bu") + F.col("bv") <= 1) & (F.col("t") > beyond) & (F.col("t") <= max_dist)).select("mesh_id", "ray_id", "fid", "t")


def ray_hits(rays: DataFrame, corners: DataFrame, max_dist: float, beyond: float = 0.0) -> DataFrame:
    """Hits of rays (mesh_id, ray_id, ox.., dx..) with the faces of their mesh, at distances in (beyond, max_dist].

    Distances are in lengths of the ray's direction. Parallel faces are skipped; rays and faces with null or not finite
    numbers hit nothing.
    """
    return _hits(rays, corners, max_dist, beyond).dropDuplicates(["mesh_id", "ray_id", "fid"])


def closest_hits(rays: DataFrame, corners: DataFrame, max_dist: float, rings: int = 2) -> DataFrame:
    """(mesh_id, ray_id, t, fid) of each ray's nearest hit, the least fid of equals.

    Goes outwards in rings, each four times as far as the one before, the last to ``max_dist``. A ray that has hit
    something leaves, so the far rings' cells are listed for the others alone.
    """
    corners = save(corners.select("mesh_id", "fid", *[f"{c}{n}" for n in (1, 2, 3) for c in "xyz"]))
    left, beyond, out = rays.select("mesh_id", "ray_id", *[f"{k}{c}" for k in "od" for c in "xyz"]), 0.0, None
    for ring in range(rings):
        reach = max_dist / 4 ** (rings - 1 - ring)
        near = _hits(left, corners, reach, beyond).groupBy("mesh_id", "ray_id").agg(F.min(F.struct("t", "fid")).alias("h")).select("mesh_id", "ray_id", "h.t", "h.fid")
        if ring < rings - 1:
            near = save(near)
            left = save(left.join(near.select("mesh_id", "ray_id"), ["mesh_id", "ray_id"], "left_anti"))
        out, beyond = near if out is None else out.union(near), reach
    return out
