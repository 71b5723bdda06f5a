"""Grasp geometry: frames, hand points, boxes, labels, friction levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import add, cross, dot, named, norm, once, scale, sub, uniform, unit, vec
from .boxes import count_inside, samples_inside

#: Lengths of a gripper, as in a parameter row.
GRIPPER = {"hand_depth": 0.125, "hand_outer_diameter": 0.218, "finger_width": 0.0255, "hand_height": 0.0225, "init_bite": 0.01}


def check_grasps(grasps: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Adds ``ok``: the axis has norm 1 within the tolerance and all numbers are there."""
    return grasps.withColumn("ok", F.coalesce(F.abs(norm(vec("a")) - 1) <= tolerance, F.lit(False)))


def pack_grasp(grasps: DataFrame, jaw: float = 0.0, least: float = 0.0) -> DataFrame:
    """grasp_id and the ten numbers: centre, axis, width, angle, jaw width, least width."""
    return grasps.select("grasp_id", F.array("cx", "cy", "cz", "ax", "ay", "az", "width", "angle", F.lit(jaw), F.lit(least)).alias("g"))


def unpack_grasp(packed: DataFrame, strict: bool = True) -> DataFrame:
    """The columns of packed grasps of nine or ten numbers; strict: another length or a bad axis is an error."""
    names = ["cx", "cy", "cz", "ax", "ay", "az", "width", "angle", "jaw"]
    out = packed.select("grasp_id", F.size("g").alias("_n"), *[F.get("g", F.lit(i)).alias(c) for i, c in enumerate(names)], F.when(F.size("g") == 10, F.get("g", F.lit(9))).otherwise(0.0).alias("least"))
    good = F.col("_n").isin(9, 10) & (F.abs(norm(vec("a")) - 1) <= 1e-5)
    out = out.withColumn("cx", F.when(good, F.col("cx")).otherwise(F.raise_error(F.lit("not a grasp")).cast("double"))) if strict else out.where(good)
    return out.drop("_n")


def endpoints(grasps: DataFrame) -> DataFrame:
    half = F.col("width") / 2
    return grasps.select("grasp_id", *named(sub(vec("c"), scale(vec("a"), half)), "p1"), *named(add(vec("c"), scale(vec("a"), half)), "p2"))


def from_endpoints(ends: DataFrame) -> DataFrame:
    """Centre, axis and width; an axis of length 0 stays as it is."""
    d = sub(vec("p2"), vec("p1"))
    w = norm(d)
    return ends.select("grasp_id", *named(scale(add(vec("p1"), vec("p2")), 0.5), "c"), *named(tuple(F.when(w > 0, x / w).otherwise(x) for x in d), "a"), w.alias("width"))


def grasp_frame(grasps: DataFrame) -> DataFrame:
    """Adds binormal (b*), approach (ap*) and minor axis (m*) of each grasp."""
    y = unit(vec("a"))
    flat = F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2)
    x = (F.when(flat > 0, F.col("ay") / flat).otherwise(1.0), F.when(flat > 0, -F.col("ax") / flat).otherwise(0.0), F.lit(0.0))
    out = once(grasps, *named(y, "b"), *named(x, "_x"))
    out = once(out, *named(cross(vec("_x"), vec("b")), "_z"))
    out = once(out, *named(add(scale(vec("_x"), F.cos("angle")), scale(vec("_z"), F.sin("angle"))), "ap"))
    return once(out, *named(cross(vec("b"), vec("ap")), "m")).drop(*[f"_{a}{c}" for a in "xz" for c in "xyz"])


def _boxed(points: DataFrame, framed: DataFrame, half: tuple[Column, Column, Column], keep: list[str]) -> DataFrame:
    """Points that share a grid cell with the bounds of a grasp's box, in the grasp's frame (bx, by_, bz).

    Each box has cells of the power of two at or above its own size, so it covers at most eight, however wide others are;
    a point has a cell in each size that its cloud's grasps need.
    """
    axes = (vec("ap"), vec("b"), vec("m"))
    g = once(framed, *[sum((F.abs(a[i]) * h for a, h in zip(axes[1:], half[1:], strict=True)), F.abs(axes[0][i]) * half[0]).alias(f"_e{c}") for i, c in enumerate("xyz")])
    g = once(g, F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(2 * F.greatest("_ex", "_ey", "_ez"), F.lit(1e-9))))).alias("_side"))
    p = points.join(g.select("cloud_id", "_side").distinct(), "cloud_id")
    for c in "xyz":
        g = g.withColumn(f"_c{c}", F.explode(F.sequence(F.floor((F.col(f"c{c}") - F.col(f"_e{c}")) / F.col("_side")), F.floor((F.col(f"c{c}") + F.col(f"_e{c}")) / F.col("_side")))))
        p = p.withColumn(f"_c{c}", F.floor(F.col(c) / F.col("_side")))
    cells = ["cloud_id", "_side", "_cx", "_cy", "_cz"]
    both = g.select(*cells, *keep, *[f"{a}{c}" for a in ("c", "ap", "b", "m") for c in "xyz"]).join(p.select(*cells, "point_id", "x", "y", "z"), cells)
    d = sub(vec(), vec("c"))
    return both.select(*keep, "point_id", *[dot(d, a).alias(n) for a, n in zip(axes, ("bx", "by_", "bz"), strict=True)])


def crop(points: DataFrame, grasps: DataFrame, mode: str = "train", gripper: dict = GRIPPER, keep: tuple[str, ...] = ()) -> DataFrame:
    """Points inside each grasp's box: |x| < w/4, |y| < w/2, |z| < w/4 (train), or 0 < x < hand depth with the
    opening between the fingers as w (online). All strict. ``keep``: columns of the grasps that go with their points."""
    g = grasp_frame(grasps)
    if mode == "train":
        w = F.col("width")
        cand = _boxed(points, g, (w / 4, w / 2, w / 4), ["grasp_id", "width", *keep])
        return cand.where((F.abs("bx") < w / 4) & (F.abs("by_") < w / 2) & (F.abs("bz") < w / 4)).drop("width")
    w = gripper["hand_outer_diameter"] - 2 * gripper["finger_width"]
    deep = gripper["hand_depth"]
    cand = _boxed(points, g, (F.lit(deep), F.lit(w / 2), F.lit(w / 4)), ["grasp_id", *keep])
    return cand.where((F.col("bx") > 0) & (F.col("bx") < deep) & (F.abs("by_") < w / 2) & (F.abs("bz") < w / 4))


def crop_counts(points: DataFrame, grasps: DataFrame, mode: str = "train", gripper: dict = GRIPPER) -> DataFrame:
    """(grasp_id, n): how many points ``crop`` gives to each grasp that gets any, without a row for each of them."""
    w = F.col("width") if mode == "train" else F.lit(gripper["hand_outer_diameter"] - 2 * gripper["finger_width"])
    box = (((-w / 4, w / 4) if mode == "train" else (0.0, gripper["hand_depth"])), (-w / 2, w / 2), (-w / 4, w / 4))
    return count_inside(points, grasp_frame(grasps), {"n": box}).where("n > 0")


def sample_inside(points: DataFrame, grasps: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``points.resample`` of each grasp's cropped points: (grasp_id, slot, point_id, bx, by_, bz).

    A task draws for all points of its hands' boxes, and only the ``n`` least of each leave it.
    """
    from .points import resample
    from .rounds import save

    found = save(samples_inside(points, grasp_frame(grasps), n, seed))
    out = found.where(F.col("_size") >= n).select("grasp_id", F.col("_slot").alias("slot"), "point_id", "bx", "by_", "bz")
    few = found.where(F.col("_size") < n).select("grasp_id", "point_id", "bx", "by_", "bz")  # fewer than n points a box
    return out.union(resample(few, n, seed, "grasp_id").join(few, ["grasp_id", "point_id"]).select("grasp_id", "slot", "point_id", "bx", "by_", "bz"))


def enough_inside(points: DataFrame, grasps: DataFrame, least: int = 50) -> DataFrame:
    """Whether each grasp's box holds at least ``least`` points; counting a box ends there."""
    w = F.col("width")
    box = {"n": ((-w / 4, w / 4), (-w / 2, w / 2), (-w / 4, w / 4))}
    n = count_inside(points, grasp_frame(grasps), box, lambda counts: counts[0] >= least).where(F.col("n") >= least)
    return grasps.select("grasp_id").join(n, "grasp_id", "left").select("grasp_id", F.col("n").isNotNull().alias("enough"))


def box_counts(grasps: DataFrame, cropped: DataFrame, least: int = 50) -> DataFrame:
    """Points in each grasp's box, zeros included, and whether there are enough; cropped: a row for each point, or for each grasp with its n."""
    n = cropped.select("grasp_id", "n") if "n" in cropped.columns else cropped.groupBy("grasp_id").agg(F.count("*").alias("n"))
    return grasps.select("grasp_id").join(n, "grasp_id", "left").select("grasp_id", F.coalesce("n", F.lit(0)).alias("n")).withColumn("enough", F.col("n") >= least)


REGIONS = ("open", "left", "right", "bottom")


def region_boxes(gripper: dict = GRIPPER) -> dict:
    """Bounds of a hand's regions along its approach, binormal and minor axis; all strict."""
    deep, out, w = gripper["hand_depth"], gripper["hand_outer_diameter"] / 2, gripper["hand_outer_diameter"] / 2 - gripper["finger_width"]
    along, flat = (0.0, deep), (-gripper["hand_height"] / 2, gripper["hand_height"] / 2)
    return {"open": (along, (-w, w), flat), "left": (along, (w, out), flat), "right": (along, (-out, -w), flat), "bottom": ((-gripper["hand_height"], 0.0), (-out, out), flat)}


def blocked(counts):
    """Whether a hand's fingers or palm have met a point, of counts by region: nothing else matters to it then."""
    return (counts[1:] > 0).any(0)


def hand_counts(points: DataFrame, grasps: DataFrame, gripper: dict = GRIPPER, done=None) -> DataFrame:
    """Points in each region of each hand, zeros included; ``done`` as in ``boxes.count_inside``."""
    n = count_inside(points, grasp_frame(grasps), region_boxes(gripper), done)
    return grasps.select("grasp_id").join(n, "grasp_id", "left").select("grasp_id", *[F.coalesce(r, F.lit(0)).alias(r) for r in REGIONS])


def region_counts(points: DataFrame, grasps: DataFrame, gripper: dict = GRIPPER) -> DataFrame:
    """(grasp_id, region, n): points in each region of each hand that has any."""
    return hand_counts(points, grasps, gripper).unpivot("grasp_id", list(REGIONS), "region", "n").where("n > 0")


def free_hands(points: DataFrame, grasps: DataFrame, gripper: dict = GRIPPER) -> DataFrame:
    """grasp_id, whether fingers and palm are clear of points (``free``), and the points between the fingers if so (``n``)."""
    return hand_counts(points, grasps, gripper, blocked).select("grasp_id", F.expr("left = 0 and right = 0 and bottom = 0").alias("free"), F.col("open").alias("n"))


def collisions(points: DataFrame, grasps: DataFrame, gripper: dict = GRIPPER) -> DataFrame:
    """Whether any point is in the open, left, right or bottom region of each grasp's hand, in one pass; all strict."""
    n = hand_counts(points, grasps, gripper, lambda counts: (counts > 0).all(0))
    return n.select("grasp_id", *[(F.col(r) > 0).alias(r) for r in REGIONS]).withColumn("usable", F.expr("open and not left and not right and not bottom"))


def hand_points(grasps: DataFrame, gripper: dict = GRIPPER) -> DataFrame:
    """Twenty corner points of the hand of each grasp, numbered from 1.

    1-8: the opening (near, then far from the palm; +y before -y; up before down), 9-16: the outer sides of the
    fingers in the same order, 17-20: the back of the palm.
    """
    deep, out, w, high = gripper["hand_depth"], gripper["hand_outer_diameter"] / 2, gripper["hand_outer_diameter"] / 2 - gripper["finger_width"], gripper["hand_height"] / 2
    corners = [(x, y, z) for half in (w, out) for x in (0.0, deep) for y in (half, -half) for z in (high, -high)] + [(-gripper["hand_height"], y, z) for y in (out, -out) for z in (high, -high)]
    g = grasp_frame(grasps)
    at = [F.struct(F.lit(i + 1).alias("point"), *[(F.col(f"c{c}") + F.col(f"ap{c}") * x + F.col(f"b{c}") * y + F.col(f"m{c}") * z).alias(c) for c in "xyz"]) for i, (x, y, z) in enumerate(corners)]
    return g.select("grasp_id", F.explode(F.array(*at)).alias("p")).select("grasp_id", "p.*")


def score_of(level: str = "level", refine: str = "refine") -> Column:
    return F.col(level) + 0.01 * F.col(refine)


def label_2(grasps: DataFrame, good: float = 0.6, bad: float = 0.6) -> DataFrame:
    """0 at or above bad, else 1 at or below good; other rows go."""
    s = score_of()
    return grasps.withColumn("label", F.when(s >= bad, 0).when(s <= good, 1)).where("label is not null")


def label_3(grasps: DataFrame, good: float = 0.5, bad: float = 1.2) -> DataFrame:
    s = score_of()
    return grasps.withColumn("label", F.when(s >= bad, 0).when(s <= good, 2).otherwise(1))


def grasp_distance(pairs: DataFrame, alpha: float = 0.05) -> Column:
    """Of columns c1*, a1*, c2*, a2*: centre distance and alpha times the angle of the axes, scaled to 1 at 90 degrees."""
    turn = F.acos(F.least(F.abs(dot(vec("a1"), vec("a2"))), F.lit(1.0)))
    return norm(sub(vec("c1"), vec("c2"))) + alpha * 2 / F.pi() * turn


def unravel(index: Column, dims: tuple[int, int, int]) -> list[Column]:
    return [F.floor(index / (dims[1] * dims[2])).cast("long"), F.floor(index / dims[2]).cast("long") % dims[1], index % dims[2]]


def ravel(i: Column, j: Column, k: Column, dims: tuple[int, int, int]) -> Column:
    return (i * dims[1] + j) * dims[2] + k


def table_angles(grasps: DataFrame, normal: tuple[float, float, float] = (0.0, 0.0, 1.0)) -> DataFrame:
    """Angles of the axis and of the approach to the table's normal."""
    n = tuple(F.lit(c) for c in normal)
    angle = lambda a: F.acos(F.greatest(F.least(dot(a, n), F.lit(1.0)), F.lit(-1.0)))
    return grasp_frame(grasps).select("grasp_id", angle(vec("b")).alias("axis_angle"), angle(vec("ap")).alias("approach_angle"))


def approach_offsets(grasps: DataFrame, max_deg: float, n: int) -> DataFrame:
    """n offsets from -max to max in radians; one of 0 when n is 1."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    out = grasps.withColumn("step", steps)
    return out.withColumn("offset", F.radians(F.lit(-max_deg) + F.col("step") * (2 * max_deg / (n - 1)) if n > 1 else F.lit(0.0) * F.col("step")))


def align_to_table(grasps: DataFrame, mode: str = "perpendicular") -> DataFrame:
    """The angle at which the approach is most (perpendicular, 64 steps) or least (parallel, 1000 steps) along z.

    On ties the last step wins; step 0 is where the search starts.
    """
    n = 64 if mode == "perpendicular" else 1000
    # z of the approach is sin(angle) times z of the frame's third axis, which is -sqrt(ax^2 + ay^2) or 0 when flat
    y = unit(vec("a"))
    flat = F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2)
    third = F.when(flat > 0, F.col("ay") / flat).otherwise(1.0) * y[1] - F.when(flat > 0, -F.col("ax") / flat).otherwise(0.0) * y[0]
    g = grasps.select("grasp_id", third.alias("zz"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("step")).withColumn("theta", F.col("step") * (2 * 3.141592653589793 / n))
    value = F.round(F.sin("theta") * F.col("zz"), 9)
    best = F.struct(value.alias("v"), "step") if mode == "perpendicular" else F.struct((-F.abs(value)).alias("v"), "step")
    return g.groupBy("grasp_id").agg(F.max_by("theta", best).alias("theta"))


def line_of_action(grasps: DataFrame, n: int, min_width: float = 0.0) -> DataFrame:
    """At least three points along the axis from either end inward."""
    n = max(n, 3)
    g = grasps.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("t", F.col("step") * (F.col("width") - min_width) / 2 / (n - 1))
    start = sub(vec("c"), scale(vec("a"), F.col("width") / 2))
    return g.select("grasp_id", "step", *named(add(start, scale(vec("a"), F.col("t"))), "l"))


def friction_level(closure: DataFrame) -> DataFrame:
    """Of levels tested from high to low: the one just before the first change from closed to open, or the lowest when it
    is closed and nothing changed before; other grasps have none."""
    w = Window.partitionBy("grasp_id").orderBy(F.desc("level"))
    steps = closure.withColumn("before", F.lag("closed").over(w)).withColumn("high", F.lag("level").over(w))
    found = steps.groupBy("grasp_id").agg(F.max(F.when(F.col("before") & ~F.col("closed"), F.col("high"))).alias("change"), F.min("level").alias("low"), F.min_by("closed", "level").alias("last"))
    return found.select("grasp_id", F.coalesce("change", F.when(F.col("last"), F.col("low"))).alias("level")).where("level is not null")


def quota(grasps: DataFrame, keys: list[str], order: str, q: int = 20) -> DataFrame:
    from .points import cap_per_group

    return cap_per_group(grasps, keys, [order], q)


def middle_of_group(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Row number ceil(n / 2) of each group."""
    w = Window.partitionBy(*keys)
    return df.withColumn("_k", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w)).where("_k = ceil(_n / 2)").drop("_k", "_n")


def sweep_grasps(points: DataFrame, grasps: DataFrame, angles: int = 19, shifts: int = 5, step: float = 0.05, gripper: dict = GRIPPER, least: int = 1, steep: float | None = None) -> DataFrame:
    """Turn and shift each grasp, keep those whose hand is free and holds at least ``least`` points, and of each angle the middle shift.

    steep: of the middle ones, keep those whose approach points down by more than this (0.5: 30 degrees below the table's plane).
    """
    g = grasps.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(angles - 1)))).withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(shifts - 1))))
    g = g.withColumn("sample", F.col("grasp_id")).withColumn("grasp_id", (F.col("sample") * angles + F.col("turn")) * shifts + F.col("shift"))
    turned = F.col("angle") + F.radians(-90.0 + F.col("turn") * (180.0 / max(1, angles - 1)))
    g = g.withColumn("angle", turned)
    for c in "xyz":
        g = g.withColumn(f"c{c}", F.col(f"c{c}") + F.col(f"a{c}") * (F.col("shift") - (shifts - 1) / 2) * step)
    names = g.columns
    g = grasp_frame(g)  # the hand stands back by a bite along its approach
    g = g.select(*[(F.col(n) - gripper["init_bite"] * F.col(f"ap{n[1]}")).alias(n) if n in ("cx", "cy", "cz") else F.col(n) for n in names])
    n = count_inside(points, grasp_frame(g), region_boxes(gripper), blocked, drop=True)
    free = n.where("left = 0 and right = 0 and bottom = 0").where(F.col("open") >= max(1, least)).select("grasp_id")
    # turn and shift come from the number of a swept grasp, so that not all of them are dealt out again
    own = grasps.select(F.col("grasp_id").alias("sample"), *[f"a{c}" for c in "xyz"], "angle")
    free = free.selectExpr("grasp_id", f"cast(pmod(grasp_id, {shifts}) as int) shift", f"(grasp_id - pmod(grasp_id, {shifts})) div {shifts} _at")
    free = free.selectExpr("grasp_id", "shift", f"cast(pmod(_at, {angles}) as int) turn", f"cast((_at - pmod(_at, {angles})) div {angles} as {dict(own.dtypes)['sample']}) sample")
    middle = middle_of_group(free, ["sample", "turn"], ["shift"])
    if steep is not None:
        middle = grasp_frame(middle.join(own, "sample").withColumn("angle", turned)).where(F.col("apz") < -steep)
    return middle.select("sample", "turn", "shift", "grasp_id")


#: Grasps of the first block of ``prune_near``, how much larger each is than all before it, and pairs that a block may try.
FIRST, GROW, MOST_TRIED = 4096, 3, 1 << 25


def _near(one: DataFrame, two: DataFrame, threshold: float, alpha: float) -> DataFrame:
    """g1 of one and g2 of two that are closer than the threshold; each of one is dealt out to the 27 cells around it."""
    from .points import _cells

    side = lambda df, n: df.select("cloud_id", F.col("grasp_id").alias(f"g{n}"), *[F.col(f"{k}{c}").alias(f"{k}{n}{c}") for k in "ca" for c in "xyz"], *[F.col(f"c{c}").alias(c) for c in "xyz"])
    both = _cells(side(one, 1), threshold, 1).drop("x", "y", "z").join(_cells(side(two, 2), threshold).drop("x", "y", "z"), ["cloud_id", "_cx", "_cy", "_cz"])
    return both.where(grasp_distance(both, alpha) < threshold).select("g1", "g2")


def _tried(grasps: DataFrame, threshold: float) -> int:
    """Pairs of grasps in the same or in adjoining cells."""
    from .points import CELL, _cells

    at = grasps.select("cloud_id", *[F.col(f"c{c}").alias(c) for c in "xyz"])
    n = lambda spread: _cells(at, threshold, spread).groupBy("cloud_id", *CELL)
    both = n(0).agg(F.count("*").alias("n")).join(n(1).agg(F.count("*").alias("m")), ["cloud_id", *CELL])
    return both.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0


def _prune_block(grasps: DataFrame, threshold: float, alpha: float) -> DataFrame:
    """Rounds over tables: keep those without an undecided or kept neighbour before them, drop the neighbours of kept ones."""
    from .rounds import save

    edges = save(_near(grasps, grasps, threshold, alpha).where("g1 < g2"))
    left, kept = grasps.select(F.col("grasp_id").alias("g")), None
    while True:
        blocked = edges.join(left, edges["g1"] == left["g"], "left_semi").select(F.col("g2").alias("g"))
        new = save(left.join(blocked, "g", "left_anti"))
        kept = new if kept is None else kept.union(new)
        gone = edges.join(new, edges["g1"] == new["g"], "left_semi").select(F.col("g2").alias("g"))
        left = save(left.join(new, "g", "left_anti").join(gone, "g", "left_anti"))
        if not left.head(1):
            return kept.select(F.col("g").alias("grasp_id"))


def prune_near(grasps: DataFrame, threshold: float, alpha: float = 0.05) -> DataFrame:
    """Keep a grasp if it is at least the threshold away from every kept one before it (by grasp_id, within a cloud).

    Grasps are decided block by block in their order. Each block's kept ones drop all later grasps near them, so the
    next block, though larger, has few pairs left, and no table of all near pairs is made; a block that would try more
    than MOST_TRIED pairs is halved.
    """
    from .rounds import running, save

    if threshold <= 0:
        return grasps.select("grasp_id")
    names = ["cloud_id", "grasp_id", *[f"{k}{c}" for k in "ca" for c in "xyz"]]
    left = save(running(grasps.select(*names), [F.col("grasp_id")], {"_place": F.lit(1).cast("long")}))
    done, size, kept = 0, FIRST, None
    while left.head(1):
        block = save(left.where(F.col("_place") <= done + size))
        while size > FIRST and _tried(block, threshold) > MOST_TRIED:
            size //= 2
            block = save(block.where(F.col("_place") <= done + size))
        done += size
        new = save(block.join(_prune_block(block, threshold, alpha), "grasp_id", "left_semi"))
        kept = new if kept is None else kept.union(new)
        left = left.where(F.col("_place") > done)
        left = save(left.join(_near(new, left, threshold, alpha).select(F.col("g2").alias("grasp_id")).distinct(), "grasp_id", "left_anti"))
        size = GROW * done
    return grasps.select("grasp_id").limit(0) if kept is None else kept.select("grasp_id")
