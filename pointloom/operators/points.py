"""Point clouds as rows: filters, colours, voxels, neighbours, samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import uniform

XYZ = ("x", "y", "z")


def finite_points(points: DataFrame) -> DataFrame:
    """Rows whose coordinates are numbers and not infinite."""
    inf = float("inf")
    return points.where(" and ".join(f"{c} is not null and not isnan({c})" for c in XYZ)).where(reduce(lambda a, b: a & b, [F.abs(c) < inf for c in XYZ]))


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def unpack_rgb(rgb: Column) -> list[Column]:
    return [F.shiftright(rgb, s).bitwiseAND(255) for s in (16, 8, 0)]


def drop_white(points: DataFrame, limit: int = 210) -> DataFrame:
    return points.where((F.col("r") < limit) & (F.col("g") < limit) & (F.col("b") < limit))


def above_table(points: DataFrame, z: float = 0.010) -> DataFrame:
    return points.where(F.col("z") > z)


def drop_objects(df: DataFrame, keys: DataFrame, key: str = "cloud_id") -> DataFrame:
    """Anti join; Spark broadcasts the keys if they are small."""
    return df.join(keys, key, "left_anti")


def bins(points: DataFrame, n: int, cube: bool = True) -> DataFrame:
    """Adds i, j, k of n right-closed bins along each axis; the least value is in bin 0. cube: equal sides, centred."""
    lo = [F.min(c).alias(f"lo_{c}") for c in XYZ]
    hi = [F.max(c).alias(f"hi_{c}") for c in XYZ]
    box = points.groupBy("cloud_id").agg(*lo, *hi)
    side = F.greatest(*[F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in XYZ])
    for c in XYZ:
        own = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        box = box.withColumn(f"step_{c}", (side if cube else own) / n).withColumn(f"from_{c}", F.col(f"lo_{c}") - (side - own) / 2 if cube else F.col(f"lo_{c}"))
    box = box.select("cloud_id", *[f"{p}_{c}" for p in ("step", "from") for c in XYZ])
    out = points.join(box, "cloud_id")
    for c, i in zip(XYZ, "ijk", strict=True):
        place = F.ceil((F.col(c) - F.col(f"from_{c}")) / F.nullif(F.col(f"step_{c}"), F.lit(0.0))) - 1
        out = out.withColumn(i, F.least(F.greatest(F.coalesce(place, F.lit(0)), F.lit(0)), F.lit(n - 1)).cast("int"))
    return out


def voxel_features(points: DataFrame, n: int = 10, cube: bool = True) -> DataFrame:
    """Of each occupied voxel: count, share of the cloud, largest (at least 0) and mean coordinates."""
    total = points.groupBy("cloud_id").agg(F.count("*").alias("total"))
    voxels = bins(points, n, cube).groupBy("cloud_id", "i", "j", "k").agg(
        F.count("*").alias("count"), *[F.greatest(F.max(c), F.lit(0.0)).alias(f"max_{c}") for c in XYZ], *[F.avg(c).alias(f"mean_{c}") for c in XYZ])
    return voxels.join(total, "cloud_id").withColumn("density", F.col("count") / F.col("total")).drop("total")


def voxel_centers(points: DataFrame, n: int = 10) -> DataFrame:
    b = bins(points, n)
    return b.select("cloud_id", "i", "j", "k", *[(F.col(f"from_{c}") + (F.col(i) + 0.5) * F.col(f"step_{c}")).alias(c) for c, i in zip(XYZ, "ijk", strict=True)]).distinct()


def voxel_downsample(points: DataFrame, leaf: float) -> DataFrame:
    """Mean of the points of each cell of a fixed grid."""
    cells = points.select("cloud_id", *XYZ, *[F.floor(F.col(c) / leaf).alias(i) for c, i in zip(XYZ, "ijk", strict=True)])
    return cells.groupBy("cloud_id", "i", "j", "k").agg(*[F.avg(c).alias(c) for c in XYZ])


def voxel_neighbors(voxels: DataFrame) -> DataFrame:
    """Occupied voxels among the 27 around each, itself included."""
    steps = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    around = voxels.select("cloud_id", "i", "j", "k")
    for c in "ijk":
        around = around.withColumn(f"d{c}", F.explode(steps)).withColumn(f"n{c}", F.col(c) + F.col(f"d{c}")).drop(f"d{c}")
    there = voxels.select(F.col("cloud_id"), *[F.col(c).alias(f"n{c}") for c in "ijk"]).distinct()
    return around.join(there, ["cloud_id", "ni", "nj", "nk"], "left_semi").select("cloud_id", "i", "j", "k", "ni", "nj", "nk")


def drop_sparse_columns(voxels: DataFrame, n: int = 3) -> DataFrame:
    """Voxels whose (i, j) column holds at least n of them; counted by aggregation, so no column is sorted."""
    enough = voxels.groupBy("cloud_id", "i", "j").count().where(F.col("count") >= n).select("cloud_id", "i", "j")
    return voxels.join(enough, ["cloud_id", "i", "j"], "left_semi")


def cap_per_group(df: DataFrame, keys: list[str], order: list, n: int = 50) -> DataFrame:
    """The first n rows of each group; Spark keeps n rows of a group in each task before it shuffles."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def resample(points: DataFrame, n: int, seed: int = 0, key: str = "cloud_id", point: str = "point_id") -> DataFrame:
    """n points of each group: without repeats if it has at least n, else n draws with repeats.

    Draws depend on seed, group and slot alone. Returns key, slot (from 0) and the chosen point.
    """
    sizes = points.groupBy(key).agg(F.count("*").alias("_size"))
    ranked = points.select(key, point, uniform(seed, F.col(key), F.col(point)).alias("_u"))
    many = cap_per_group(ranked.join(sizes.where(F.col("_size") >= n), key), [key], ["_u", point], n)
    many = many.withColumn("slot", F.row_number().over(Window.partitionBy(key).orderBy("_u", point)) - 1).select(key, "slot", point)
    few = sizes.where(F.col("_size") < n).select(key, "_size", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot"))
    few = few.select(key, "slot", F.floor(uniform(seed, F.col(key), F.col("slot")) * F.col("_size")).alias("_at"))
    small = points.join(sizes.where(F.col("_size") < n), key).withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(point)) - 1).select(key, point, "_at")
    return many.union(few.join(small, [key, "_at"]).select(key, "slot", point))


def _cells(df: DataFrame, side: float, spread: int = 0) -> DataFrame:
    """Adds the grid cell of each row; with spread, a row for each cell around it."""
    for c in XYZ:
        cell = F.floor(F.col(c) / side).cast("long")
        df = df.withColumn(f"_c{c}", F.explode(F.sequence(cell - spread, cell + spread)) if spread else cell)
    return df


#: Points that a cell may hold before it is split, and times that it is split at most.
CROWD, DEEPEST = 512, 40
#: Pairs of a query and a point that a task tries on average where cells are split.
PAIRS = 1 << 20


def neighbors(points: DataFrame, queries: DataFrame, radius: float, max_nn: int | None, exclude_self: bool = False, crowd: int = CROWD) -> DataFrame:
    """At most max_nn (None: all) nearest points within the radius of each query, nearest first; ties go by point_id.

    Points stay in their cell (as wide as the radius); each query visits 27 cells. Where one of them holds more than
    ``crowd`` points and only the nearest are wanted, cells are split first; see ``crowded_cells``.
    """
    p, q = _cells(points.select("cloud_id", "point_id", *XYZ), radius), queries.select("cloud_id", F.col("point_id").alias("query_id"), *[F.col(c).alias(f"q{c}") for c in XYZ])
    around = _around(q, radius)
    if max_nn is not None:
        full = p.groupBy("cloud_id", *CELL).count().where(F.col("count") > crowd).select("cloud_id", *CELL)
        if full.head(1):
            from .rounds import save

            full = save(full)
            hot = around.join(full, ["cloud_id", *CELL], "left_semi").select("cloud_id", "query_id").distinct()
            hot = save(hot)
            apart = around.join(hot, ["cloud_id", "query_id"], "left_anti").join(p, ["cloud_id", *CELL])
            close = crowded_cells(p, q.join(hot, ["cloud_id", "query_id"], "left_semi"), radius, max_nn + exclude_self, crowd)
            return _nearest(apart.select(*close.columns).union(close), radius, max_nn, exclude_self)
    return _nearest(_meet(around, p), radius, max_nn, exclude_self)


#: Points of a cell that one task tries at most where all neighbours are wanted.
SLICE = 8192


def _meet(around: DataFrame, points: DataFrame) -> DataFrame:
    """Queries with the points of their cells; cells of more than SLICE points are dealt out in slices, so that tasks share them."""
    slices = points.groupBy("cloud_id", *CELL).agg(F.ceil(F.count("*") / SLICE).cast("int").alias("_n"))
    p = points.join(slices, ["cloud_id", *CELL]).withColumn("_slice", F.pmod(F.xxhash64("point_id"), F.col("_n")).cast("int")).drop("_n")
    q = around.join(slices, ["cloud_id", *CELL]).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    return q.join(p, ["cloud_id", *CELL, "_slice"])


CELL = [f"_c{c}" for c in XYZ]


def _around(queries: DataFrame, side: float) -> DataFrame:
    """A row for each of the 27 cells around a query."""
    for c in XYZ:
        cell = F.floor(F.col(f"q{c}") / side).cast("long")
        queries = queries.withColumn(f"_c{c}", F.explode(F.sequence(cell - 1, cell + 1)))
    return queries


def _nearest(pairs: DataFrame, radius: float, max_nn: int | None, exclude_self: bool) -> DataFrame:
    d2 = sum(((F.col(c) - F.col(f"q{c}")) ** 2 for c in XYZ[1:]), (F.col("x") - F.col("qx")) ** 2)
    pairs = pairs.withColumn("d2", d2).where(F.col("d2") <= radius * radius)
    if exclude_self:
        pairs = pairs.where("point_id <> query_id")
    if max_nn is None:
        return pairs.select("cloud_id", "query_id", "point_id", "d2")
    rank = F.row_number().over(Window.partitionBy("cloud_id", "query_id").orderBy("d2", "point_id"))
    return pairs.select("cloud_id", "query_id", "point_id", "d2", rank.alias("rank")).where(F.col("rank") <= max_nn)


def crowded_cells(points: DataFrame, queries: DataFrame, radius: float, k: int, crowd: int) -> DataFrame:
    """Pairs of queries with the points that may be among their k nearest, where cells hold many points.

    Cells of more than ``crowd`` points are halved along each axis, again and again. A query starts with the cells around
    it and keeps, level by level, those that come closer than the k-th nearest point can be: the distance within which
    whole boxes of the cells it has hold k points. So it meets the points of a few cells of at most ``crowd`` points, how
    ever many lie in one spot. Of points all at one place, the k with the least ids stand for all.
    """
    from .rounds import save

    box = [f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in XYZ]
    key = ["cloud_id", "_level", *CELL]
    level, side = 0, radius
    here = points.select("cloud_id", "point_id", *XYZ, F.lit(0).alias("_level"), *CELL)
    size = lambda c: F.col(f"hi{c}") - F.col(f"lo{c}")
    open_ = (F.col("n") > crowd) & (F.greatest(*[size(c) for c in XYZ]) > 0)
    settled, held = [], None
    left = _around(queries, radius)
    far2 = [F.greatest(F.abs(F.col(f"q{c}") - F.col(f"lo{c}")), F.abs(F.col(f"q{c}") - F.col(f"hi{c}"))) for c in XYZ]
    near2 = [F.greatest(F.col(f"lo{c}") - F.col(f"q{c}"), F.col(f"q{c}") - F.col(f"hi{c}"), F.lit(0.0)) for c in XYZ]
    square = lambda parts: parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]
    query = ["cloud_id", "query_id", *[f"q{c}" for c in XYZ]]
    while True:
        cells = save(here.groupBy(*key).agg(F.count("*").alias("n"), *box).withColumn("_open", open_ & F.lit(level < DEEPEST)))
        rows = left.withColumn("_level", F.lit(level)).join(cells, key).select(*query, "_level", *CELL, "n", "_open", square(far2).alias("_far"), square(near2).alias("_near"))
        rows = rows if held is None else held.drop("_bound").unionByName(rows)
        upto = Window.partitionBy("cloud_id", "query_id").orderBy("_far", "_level", *CELL).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_sum", F.sum("n").over(upto))
        bound = F.min(F.when(F.col("_sum") >= k, F.col("_far"))).over(Window.partitionBy("cloud_id", "query_id"))
        rows = rows.withColumn("_bound", F.least(F.coalesce(bound, F.lit(radius * radius)), F.lit(radius * radius)))
        rows = save(rows.where(F.col("_near") <= F.col("_bound") * (1 + 1e-9)).drop("_sum"))
        shut = cells.where("not _open").select(*key, (F.greatest(*[size(c) for c in XYZ]) == 0).alias("_spot"))
        settled.append(here.join(shut, key))
        held = rows.where("not _open")
        if not rows.where("_open").head(1):
            break
        parents = rows.where("_open").select(*query, *CELL)
        here = save(here.join(cells.where("_open").select(*key), key, "left_semi"))
        level, side = level + 1, side / 2
        for c in XYZ:
            here = here.withColumn(f"_c{c}", F.floor(F.col(c) / side).cast("long"))
            # rounding may put a point into the next cell but one half: both halves of its parent are asked, and no others
            parents = parents.withColumn(f"_c{c}", F.explode(F.array(F.col(f"_c{c}") * 2, F.col(f"_c{c}") * 2 + 1)))
        here, left = here.withColumn("_level", F.lit(level)), parents
    members = reduce(DataFrame.unionByName, settled)
    least = Window.partitionBy(*key).orderBy("point_id")
    spots = members.where("_spot").withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= k).drop("_n")
    members = members.where("not _spot").unionByName(spots)
    # by the number of pairs, as the join's tables say little about what comes out of it
    tried = held.agg(F.sum(F.least(F.col("n"), F.lit(max(crowd, k))))).first()[0] or 0
    tasks = max(-(-tried // PAIRS), points.sparkSession.sparkContext.defaultParallelism)
    pairs = held.select(*query, "_level", *CELL, "_bound").repartition(tasks, *key).join(members, key)
    d2 = square([F.col(c) - F.col(f"q{c}") for c in XYZ])
    return pairs.where(d2 <= F.col("_bound") * (1 + 1e-9)).select(*query, "point_id", *XYZ)  # before they are sorted


def knn(points: DataFrame, queries: DataFrame, k: int, radius: float) -> DataFrame:
    """The k nearest points of each query: neighbours within a radius that doubles for queries that have too few.

    The rounds end when every query has k points or all of its cloud, so none is lost however far away the points are.
    Points and queries without finite coordinates have no neighbours; queries in clouds without points have none.
    """
    from .rounds import save

    if radius <= 0:
        raise ValueError("the first radius must be positive")
    finite = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < 1e300" for c in XYZ)
    points = points.where(finite)
    size = points.groupBy("cloud_id").agg(F.count("*").alias("_size"))
    left, out = save(queries.where(finite).join(size, "cloud_id", "left_semi")), None
    while True:
        found = save(neighbors(points, left, radius, k))
        full = found.groupBy("cloud_id", "query_id").agg(F.max("rank").alias("n")).join(size, "cloud_id").where((F.col("n") >= k) | (F.col("n") >= F.col("_size"))).select("cloud_id", "query_id")
        done = found.join(full, ["cloud_id", "query_id"], "left_semi")
        out = done if out is None else out.union(done)
        left = save(left.join(full.withColumnRenamed("query_id", "point_id"), ["cloud_id", "point_id"], "left_anti"))
        if not left.head(1):
            return out
        radius *= 2


def nearest_height(points: DataFrame, height: float, n: int = 10) -> DataFrame:
    return cap_per_group(points.withColumn("gap", F.abs(F.col("z") - height)), ["cloud_id"], ["gap", "point_id"], n)


def merge_clouds(*views: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, views)


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows in an order that depends on seed and key alone."""
    return df.withColumn("_u", uniform(seed, F.col(key))).orderBy("_u", key).limit(n).drop("_u")


def torque_scale(points: DataFrame) -> DataFrame:
    """1 / median of the largest coordinates of each cloud."""
    return points.groupBy("cloud_id").agg(*[F.max(c).alias(c) for c in XYZ]).select("cloud_id", (1 / F.sort_array(F.array(*XYZ))[1]).alias("scale"))
