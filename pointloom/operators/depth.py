"""Depth images as rows (frame_id, v, u, d)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import mat_apply, mat_mul, named, rigid_inverse, vec


def scale_depth(depth: DataFrame, scale: float = 1.0) -> DataFrame:
    return depth.withColumn("depth", F.col("d") * scale * 1e-4)


def mask_depth(depth: DataFrame, mask: DataFrame) -> DataFrame:
    """Depth 0 where the mask has the pixel."""
    m = mask.select("frame_id", "v", "u", F.lit(True).alias("_m"))
    return depth.join(m, ["frame_id", "v", "u"], "left").withColumn("d", F.when(F.col("_m"), 0).otherwise(F.col("d"))).drop("_m")


def depth_to_points(depth: DataFrame, calib: DataFrame) -> DataFrame:
    """Pinhole back-projection of depths above 0, then the frame's rigid transform."""
    p = scale_depth(depth.where("d > 0"), 10.0).join(calib, "frame_id")
    z = F.col("depth")
    p = p.select("frame_id", "v", "u", "h", ((F.col("u") - F.col("cx")) * z / F.col("fx")).alias("x"), ((F.col("v") - F.col("cy")) * z / F.col("fy")).alias("y"), z.alias("z"))
    return p.select("frame_id", "v", "u", *named(mat_apply(F.col("h"), vec()), ""))


def organized_points(depth: DataFrame, calib: DataFrame, height: int, width: int) -> DataFrame:
    """All pixels of the grid; those without depth have null coordinates."""
    grid = depth.select("frame_id").distinct().withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return grid.join(depth_to_points(depth, calib), ["frame_id", "v", "u"], "left")


def compose_calibration(calib: DataFrame) -> DataFrame:
    """Adds ``hi``, the inverse of the rigid transform, and ``hh``, the transform applied twice."""
    return calib.withColumn("hi", rigid_inverse(F.col("h"))).withColumn("hh", mat_mul(F.col("h"), F.col("h")))


def transform_points(points: DataFrame, transforms: DataFrame, key: str, kind: str = "point") -> DataFrame:
    """Apply each key's transform: points with its shift, directions without."""
    both = points.join(transforms.select(key, "h"), key)
    return both.select(*[c for c in points.columns if c not in "xyz"], *named(mat_apply(F.col("h"), vec(), 1.0 if kind == "point" else 0.0), ""))


def register_depth(depth: DataFrame, calib: DataFrame, height: int, width: int, keep: str = "far") -> DataFrame:
    """Project each depth into the colour image: pixel by truncation of (u + 0.5), outside dropped; of several that meet
    the farthest stays (or the nearest)."""
    p = depth_to_points(depth, calib).where("z > 0").join(calib.select("frame_id", "fx", "fy", "cx", "cy"), "frame_id")
    p = p.withColumn("pu", (F.col("fx") * F.col("x") / F.col("z") + F.col("cx") + 0.5).cast("int")).withColumn("pv", (F.col("fy") * F.col("y") / F.col("z") + F.col("cy") + 0.5).cast("int"))
    pick = F.max if keep == "far" else F.min
    return p.where((F.col("pu") >= 0) & (F.col("pu") < width) & (F.col("pv") >= 0) & (F.col("pv") < height)).groupBy("frame_id", "pv", "pu").agg(pick("z").alias("z"))


def filter_discontinuities(depth: DataFrame, size: int = 7, thresh: int = 1000) -> DataFrame:
    """Depth 0 where the window's least or largest depth is farther than the threshold from the middle; missing depth
    counts as 0 and the border stays. Least and largest are taken along rows, then along columns."""
    h = size // 2
    rows = Window.partitionBy("frame_id", "v").orderBy("u").rangeBetween(-h, h)
    cols = Window.partitionBy("frame_id", "u").orderBy("v").rangeBetween(-h, h)
    size_of = depth.groupBy("frame_id").agg(F.max("v").alias("mv"), F.max("u").alias("mu"))
    d = depth.withColumn("lo", F.min("d").over(rows)).withColumn("hi", F.max("d").over(rows))
    d = d.withColumn("lo", F.min("lo").over(cols)).withColumn("hi", F.max("hi").over(cols)).join(size_of, "frame_id")
    inside = F.expr(f"u >= {h} and v >= {h} and u <= mu - {h} and v <= mv - {h}")
    jump = F.greatest(F.abs(F.col("lo") - F.col("d")), F.abs(F.col("hi") - F.col("d"))) > thresh
    return d.select("frame_id", "v", "u", F.when(inside & jump, 0).otherwise(F.col("d")).alias("d"))
