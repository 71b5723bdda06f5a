"""Signed-distance grids as rows (mesh_id, i, j, k, val)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def grid(spark: SparkSession, nx: int, ny: int, nz: int) -> DataFrame:
    """All cells in C order, with their flat id."""
    return spark.range(nx * ny * nz).select(F.floor(F.col("id") / (ny * nz)).alias("i"), F.floor(F.col("id") / nz).alias("_j"), (F.col("id") % nz).alias("k"), "id").select("i", (F.col("_j") % ny).alias("j"), "k", "id")


def to_grid(points: DataFrame, origin: tuple[float, float, float], resolution: float, n: int) -> DataFrame:
    """Grid coordinates, and whether any is below 0 or at least n."""
    g = points.select(*[c for c in points.columns if c not in "xyz"], *[((F.col(c) - o) / resolution).alias(f"g{c}") for c, o in zip("xyz", origin, strict=True)])
    return g.withColumn("outside", F.expr(f"gx < 0 or gy < 0 or gz < 0 or gx >= {n} or gy >= {n} or gz >= {n}"))


def to_object(points: DataFrame, origin: tuple[float, float, float], resolution: float) -> DataFrame:
    return points.select(*[c for c in points.columns if c not in ("gx", "gy", "gz")], *[(F.col(f"g{c}") * resolution + o).alias(c) for c, o in zip("xyz", origin, strict=True)])


def surface_points(sdf: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Cells whose distance is under resolution times sqrt(2) / 2."""
    return sdf.where(F.abs("val") < resolution * 2**0.5 / 2)


def sdf_lookup(sdf: DataFrame, queries: DataFrame) -> DataFrame:
    """Trilinear values at real coordinates (mesh_id, query_id, x, y, z): the eight corners by equi-join; those outside
    the grid count 0."""
    q = queries
    for c, i in zip("xyz", "ijk", strict=True):
        q = q.withColumn(i, F.explode(F.array(F.floor(c).cast("int"), F.floor(c).cast("int") + 1)))
    w = (1 - F.abs(F.col("x") - F.col("i"))) * (1 - F.abs(F.col("y") - F.col("j"))) * (1 - F.abs(F.col("z") - F.col("k")))
    return q.join(sdf, ["mesh_id", "i", "j", "k"], "left").groupBy("mesh_id", "query_id").agg(F.sum(F.coalesce("val", F.lit(0.0)) * w).alias("val"))


def signed_distance(sdf: DataFrame, queries: DataFrame, resolution: float = 1.0) -> DataFrame:
    """As ``sdf_lookup`` for queries within their mesh's grid; others get the distance to the nearest surface cell (all of
    them are searched; ties go to the first) plus that cell's value. Queries of meshes without a grid have no row."""
    from .points import knn

    n = sdf.groupBy("mesh_id").agg(*[(F.max(c) + 1).alias(f"_n{c}") for c in "ijk"])
    q = queries.join(n, "mesh_id")
    off = F.expr("x < 0 or y < 0 or z < 0 or x >= _ni or y >= _nj or z >= _nk")
    within = sdf_lookup(sdf, q.where(~off).select("mesh_id", "query_id", "x", "y", "z"))
    cell = (F.col("i").cast("long") * 1_048_576 + F.col("j")) * 1_048_576 + F.col("k")
    cells = surface_points(sdf, resolution).select(F.col("mesh_id").alias("cloud_id"), cell.alias("point_id"), *[F.col(i).cast("double").alias(c) for i, c in zip("ijk", "xyz", strict=True)], "val")
    asked = q.where(off).select(F.col("mesh_id").alias("cloud_id"), F.col("query_id").alias("point_id"), "x", "y", "z")
    near = knn(cells, asked, 1, 4.0).join(cells.select("cloud_id", "point_id", "val"), ["cloud_id", "point_id"])
    return within.union(near.select(F.col("cloud_id").alias("mesh_id"), "query_id", (F.sqrt("d2") * resolution + F.col("val")).alias("val")))


def grid_curvature(sdf: DataFrame) -> DataFrame:
    """At cells with neighbours on all sides: the symmetric matrix of gradient differences, (g(+1) - g(-1)) / 4 plus its
    transpose (hxx .. hyz), and its determinant. Differences come from windows along each axis."""
    g = grid_gradient(sdf)
    for c in "ijk":
        w = Window.partitionBy("mesh_id", *[x for x in "ijk" if x != c]).orderBy(c)
        g = g.select("*", *[((F.lead(f"g{b}").over(w) - F.lag(f"g{b}").over(w)) / 4).alias(f"c{c}{b}") for b in "ijk"])
    h = lambda a, b: F.col(f"c{a}{b}") + F.col(f"c{b}{a}")
    g = g.select("mesh_id", "i", "j", "k", h("i", "i").alias("hxx"), h("j", "j").alias("hyy"), h("k", "k").alias("hzz"), h("i", "j").alias("hxy"), h("i", "k").alias("hxz"), h("j", "k").alias("hyz"))
    g = g.where("hxx is not null and hyy is not null and hzz is not null")
    return g.withColumn("det", F.expr("hxx*(hyy*hzz-hyz*hyz) - hxy*(hxy*hzz-hyz*hxz) + hxz*(hxy*hyz-hyy*hxz)"))


def grids(sizes: DataFrame) -> DataFrame:
    """All cells of each mesh's grid (mesh_id, nx, ny, nz) in C order, with their flat id."""
    out = sizes.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") * F.col("ny") * F.col("nz") - 1)).alias("id")).where("nx > 0 and ny > 0 and nz > 0")
    return out.select("mesh_id", F.floor(F.col("id") / (F.col("ny") * F.col("nz"))).alias("i"), (F.floor(F.col("id") / F.col("nz")) % F.col("ny")).alias("j"), (F.col("id") % F.col("nz")).alias("k"), "id")


def grid_gradient(sdf: DataFrame) -> DataFrame:
    """Central differences inside and one-sided ones at the edges (and beside missing cells); a window along each axis."""
    out = sdf
    for c in "ijk":
        w = Window.partitionBy("mesh_id", *[x for x in "ijk" if x != c]).orderBy(c)
        after, before = (F.when(f(c).over(w) == F.col(c) + step, f("val").over(w)) for f, step in ((F.lead, 1), (F.lag, -1)))
        both = F.when(after.isNull() | before.isNull(), 1).otherwise(2)
        out = out.withColumn(f"g{c}", (F.coalesce(after, "val") - F.coalesce(before, "val")) / both)
    return out
