"""Sums over the nearest points of all points, and over the points of balls, without a row for each pair.

Places are dealt out into blocks along a curve through the cells of their cloud, so a block's points lie close together.
Each block finds the nearest points of its own places. Where a place's ball, as far as its block knows, reaches into boxes
of other blocks, these are asked; they answer with the few points that may count, and the place's own block looks again.
What is dealt out grows with the number of points, however many of them a ball holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import once
from .boxes import BLOCK as PART
from .boxes import TILE, _dealt, tiles

#: Places of a block, points of a tile, places of a box that stands for a block, and places whose sums are taken at once.
BLOCK, LEAF, BOX, BATCH = 1 << 15, 32, 2048, 1 << 12
SIX = ("xx", "yy", "zz", "xy", "xz", "yz")
XYZ = ("x", "y", "z")


def nearest(xyz: np.ndarray, ids: np.ndarray, at: np.ndarray, bound2: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of the places ``at``, some at a time: their numbers, pairs of a place (among these) and a point, being its k nearest
    points within bound2 of the squared distance (ties by id), and the squared distance beyond which no further point counts."""
    order = tiles(xyz, LEAF) if len(xyz) else []
    size = np.array([len(t) for t in order], np.int64)
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    p, start = xyz[order], np.cumsum(size) - size
    lo, hi = (f.reduceat(p, start) if len(p) else p for f in (np.minimum, np.maximum))
    for q in tiles(at, LEAF):
        here = at[q]
        far = bound2[q]
        gap = np.maximum(np.maximum(lo - here.max(0), here.min(0) - hi), 0)
        gap2 = (gap * gap).sum(1)

        def away(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            place = np.concatenate([np.arange(start[t], start[t] + size[t]) for t in some]) if len(some) else np.zeros(0, np.int64)
            x = p[place]
            d = [x[:, i] - here[:, i, None] for i in range(3)]
            return place, d[0] * d[0] + d[1] * d[1] + d[2] * d[2]

        def limit(d2: np.ndarray) -> np.ndarray:
            return np.minimum(far, np.partition(d2, k - 1, axis=1)[:, k - 1]) if d2.shape[1] >= k else far

        first = np.argpartition(gap2, 7)[:8] if len(gap2) > 8 else np.arange(len(gap2))
        reach = limit(away(first)[1]).max()
        place, d2 = away(np.flatnonzero(gap2 <= reach * (1 + 1e-9)))
        end = limit(d2)
        row, col = np.nonzero(d2 <= end[:, None])
        over = np.flatnonzero(np.bincount(row, minlength=len(q)) > k)
        if len(over):  # ties at the last place
            tied = np.isin(row, over)
            r, c = row[tied], col[tied]
            by = np.lexsort((ids[order[place[c]]], d2[r, c], r))
            r, c = r[by], c[by]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            row, col = np.concatenate((row[~tied], r[rank < k])), np.concatenate((col[~tied], c[rank < k]))
        yield q, row, order[place[col]], end


def _covariances(xyz: np.ndarray, row: np.ndarray, point: np.ndarray, n: int) -> np.ndarray:
    """Population covariances (n, 6) of the points of each row."""
    count = np.maximum(np.bincount(row, minlength=n), 1)
    d = xyz[point]
    d = d - np.stack([np.bincount(row, d[:, i], n) / count for i in range(3)], 1)[row]
    return np.stack([np.bincount(row, d[:, "xyz".index(s[0])] * d[:, "xyz".index(s[1])], n) / count for s in SIX], 1)


def _sums(xyz: np.ndarray, ids: np.ndarray, at: np.ndarray, bound2: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Covariances of the nearest points of each place, and the squared distance beyond which no further point counts."""
    out, end = np.zeros((len(at), 6)), np.full(len(at), bound2)
    held: list[tuple] = []

    def flush() -> None:
        if held:
            q, n = np.concatenate([h[0] for h in held]), np.cumsum([0, *[len(h[0]) for h in held]])
            out[q] = _covariances(xyz, np.concatenate([h[1] + m for h, m in zip(held, n, strict=False)]), np.concatenate([h[2] for h in held]), len(q))
            held.clear()

    for q, row, point, last in nearest(xyz, ids, at, end.copy(), k):
        end[q] = last
        held.append((q, row, point))
        if sum(len(h[0]) for h in held) >= BATCH:
            flush()
    flush()
    return out, end


def _get(t: pa.Table, names) -> np.ndarray:
    return np.stack([t.column(c).to_numpy().astype(float) for c in names], 1)


def _clouds(table: pa.Table) -> Iterator[tuple]:
    """A table's rows, cloud by cloud."""
    clouds = table.column("cloud_id").combine_chunks().dictionary_encode() if table.num_rows else None
    if clouds is not None:
        clouds = clouds.combine_chunks() if isinstance(clouds, pa.ChunkedArray) else clouds
        code = clouds.indices.to_numpy()
        for n, cloud in enumerate(clouds.dictionary):
            yield cloud, table.take(pa.array(np.flatnonzero(code == n)))


def _in_blocks(points: DataFrame, k: int) -> tuple[DataFrame, int]:
    """Places with at most ``k`` points each, those with the least ids, in blocks (column ``_block``, a partition each), saved."""
    from .rounds import save

    here = Window.partitionBy("cloud_id", *XYZ).orderBy("point_id")
    p = save(points.withColumn("_n", F.row_number().over(here)).where(F.col("_n") <= k).select("cloud_id", "point_id", *XYZ, (F.col("_n") == 1).alias("_first")))
    box = p.groupBy("cloud_id").agg(F.count("*").alias("_n"), *[f(c).alias(f"_{n}{c}") for n, f in (("l", F.min), ("h", F.max)) for c in XYZ])
    rows = p.count()
    n = max(-(-rows // BLOCK), min(points.sparkSession.sparkContext.defaultParallelism, -(-rows // 4096)), 1)
    side = F.nullif(F.greatest(*[F.col(f"_h{c}") - F.col(f"_l{c}") for c in XYZ]), F.lit(0.0))
    names = [*p.columns]
    z = once(p.join(box, "cloud_id"), *[F.coalesce(F.floor((F.col(c) - F.col(f"_l{c}")) / side * ((1 << 21) - 1)).cast("long"), F.lit(0).cast("long")).alias(f"_z{c}") for c in XYZ])
    for shift, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
        z = once(z.select(*names, *[F.col(f"_z{c}").alias(f"_y{c}") for c in XYZ]), *[F.col(f"_y{c}").bitwiseOR(F.shiftleft(f"_y{c}", shift)).bitwiseAND(F.lit(mask)).alias(f"_z{c}") for c in XYZ])
    z = z.withColumn("_z", F.col("_zx").bitwiseOR(F.shiftleft("_zy", 1)).bitwiseOR(F.shiftleft("_zz", 2)))
    z = z.repartitionByRange(n, "cloud_id", "_z", *XYZ).select(*names, F.spark_partition_id().alias("_block"))
    return save(z), n


def _boxes(blocks: DataFrame) -> dict:
    """Of each cloud that lies in several blocks: numbers of the blocks and bounds of boxes around some of their points."""
    kind = dict(blocks.dtypes)["cloud_id"]
    cut = blocks.groupBy("cloud_id").agg(F.min("_block").alias("_a"), F.max("_block").alias("_b")).where("_a < _b").select("cloud_id")  # two of a block at most

    def bound(batches):
        table = _whole(batches)
        if table is None:
            return
        for cloud, t in _clouds(table):
            xyz, block = _get(t, XYZ), t.column("_block").to_numpy()
            for b in np.unique(block):
                own = xyz[block == b]
                for q in tiles(own, BOX):
                    yield pa.RecordBatch.from_arrays([pa.array([cloud.as_py()], table.schema.field("cloud_id").type), pa.array([int(b)], pa.int32()), *[pa.array([v]) for v in (*own[q].min(0), *own[q].max(0))]], names=["cloud_id", "_block", *[f"{n}{c}" for n in "lh" for c in XYZ]])

    rows = blocks.join(F.broadcast(cut), "cloud_id", "left_semi").mapInArrow(bound, f"cloud_id {kind}, _block int, lx double, ly double, lz double, hx double, hy double, hz double").collect()
    found: dict = {}
    for r in rows:
        found.setdefault(r.cloud_id, []).append(tuple(r)[1:])
    return {c: (np.array([r[0] for r in v]), np.array([r[1:4] for r in v]), np.array([r[4:7] for r in v])) for c, v in found.items()}


def _whole(batches) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


def neighbour_covariances(points: DataFrame, radius: float, k: int) -> DataFrame:
    """Of each place with points (cloud_id, x, y, z): covariances sxx .. syz of the ``k`` points nearest to it within the
    radius, ties by point_id; the place's own points are among them.

    Points of one place beyond the ``k`` with the least ids change nothing, so they are left out first. Null ids, null clouds
    and coordinates that aren't finite have no place.
    """
    from .rounds import save

    fine = "cloud_id is not null and point_id is not null and " + " and ".join(f"abs({c}) < double('infinity')" for c in XYZ)
    p = points.where(fine).select("cloud_id", "point_id", *[F.col(c).cast("double").alias(c) for c in XYZ])
    blocks, n = _in_blocks(p, k)
    kinds = {c: t for c, t in blocks.dtypes}
    boxes, r2 = _boxes(blocks) if n > 1 else {}, float(radius) * float(radius)
    sums = [f"s{s}" for s in SIX]
    made = pa.schema([*[(c, pa.float64()) for c in (*XYZ, *sums)], ("_from", pa.int32()), ("_to", pa.int32()), ("_end", pa.float64())])

    def table(cloud: pa.Array, *columns: np.ndarray) -> pa.Table:
        return pa.Table.from_arrays([cloud, *[pa.array(c, f.type) for c, f in zip(columns, made, strict=True)]], names=["cloud_id", *made.names])

    def own(batches):
        whole = _whole(batches)
        if whole is None:
            return
        for cloud, t in _clouds(whole):
            block = t.column("_block").to_numpy()
            for b in np.unique(block):
                here = t.take(pa.array(np.flatnonzero(block == b)))
                xyz, ids = _get(here, XYZ), here.column("point_id").to_numpy()
                at = xyz[here.column("_first").to_numpy(zero_copy_only=False)]
                found, end = _sums(xyz, ids, at, r2, k)
                asked = _asked(at, end, int(b), boxes.get(cloud.as_py()))
                done = np.ones(len(at), bool)
                done[asked[0]] = False
                rows = np.concatenate((np.flatnonzero(done), asked[0]))
                to = np.concatenate((np.full(done.sum(), -1), asked[1]))
                name = pa.array([cloud.as_py()] * len(rows), whole.schema.field("cloud_id").type)
                yield from table(name, *at[rows].T, *found[rows].T, np.full(len(rows), b), to, end[rows]).to_batches()

    form = ", ".join([f"cloud_id {kinds['cloud_id']}", *[f"{c} double" for c in (*XYZ, *sums)], "_from int", "_to int", "_end double"])
    first = save(blocks.mapInArrow(own, form))
    out = first.where("_to < 0").select("cloud_id", *XYZ, *sums)
    if not boxes:
        return out
    asks = first.where("_to >= 0").select("cloud_id", *XYZ, "_from", "_to", "_end")
    tasks = min(n, 4000)

    def answer(mine: pa.Table, asking: pa.Table) -> pa.Table:
        """Points of this block that may be among the nearest of another's places, once for each block."""
        rows, to = [], []
        block, cloud = mine.column("cloud_id").to_pylist(), asking.column("cloud_id").to_pylist()
        for c in set(cloud):
            a, b = (np.flatnonzero([x == c for x in names]) for names in (block, cloud))
            own, theirs = mine.take(pa.array(a)), asking.take(pa.array(b))
            xyz, ids, by = _get(own, XYZ), own.column("point_id").to_numpy(), theirs.column("_from").to_numpy()
            for f in np.unique(by):
                some = by == f
                got = [p for _, _, p, _ in nearest(xyz, ids, _get(theirs, XYZ)[some], theirs.column("_end").to_numpy()[some], k)]
                got = np.unique(np.concatenate(got)) if got else np.zeros(0, np.int64)
                rows.append(a[got])
                to.append(np.full(len(got), f))
        rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        return mine.take(pa.array(rows)).select(["cloud_id", "point_id", *XYZ]).append_column("_from", pa.array(np.concatenate(to) if to else rows, pa.int32()))

    def again(mine: pa.Table, others: pa.Table) -> pa.Table:
        """Sums of the block's places that asked others, with the points that these sent."""
        out, kind = [], mine.schema.field("cloud_id").type
        block, cloud, sent = mine.column("cloud_id").to_pylist(), others.column("cloud_id").to_pylist(), others.column("point_id").is_valid().to_numpy()
        for c in set(cloud):
            own = mine.take(pa.array(np.flatnonzero([x == c for x in block])))
            theirs = np.array([x == c for x in cloud])
            new, asking = (others.take(pa.array(np.flatnonzero(theirs & x))) for x in (sent, ~sent))
            xyz = np.concatenate((_get(own, XYZ), _get(new, XYZ)))
            ids = np.concatenate((own.column("point_id").to_numpy(), new.column("point_id").to_numpy()))
            at = np.unique(_get(asking, XYZ), axis=0)
            found, _ = _sums(xyz, ids, at, r2, k)
            out.append(pa.Table.from_arrays([pa.array([c] * len(at), kind), *[pa.array(v) for v in (*at.T, *found.T)]], names=["cloud_id", *XYZ, *sums]))
        return pa.concat_tables(out)

    to = blocks.select("_block", "cloud_id", "point_id", *XYZ).repartition(tasks, "_block").groupBy("_block")
    point = f"cloud_id {kinds['cloud_id']}, point_id {kinds['point_id']}, x double, y double, z double"
    sent = to.cogroup(asks.withColumnRenamed("_to", "_block").repartition(tasks, "_block").groupBy("_block")).applyInArrow(lambda a, b: answer(a, b), f"{point}, _from int")
    both = sent.unionByName(asks.select("cloud_id", F.lit(None).cast(kinds["point_id"]).alias("point_id"), *XYZ, "_from")).withColumnRenamed("_from", "_block")
    later = to.cogroup(both.repartition(tasks, "_block").groupBy("_block")).applyInArrow(lambda a, b: again(a, b), f"cloud_id {kinds['cloud_id']}, " + ", ".join(f"{c} double" for c in (*XYZ, *sums)))
    return out.unionByName(later)


def _asked(at: np.ndarray, end: np.ndarray, block: int, boxes: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a place and another block, a box of which lies within the place's squared distance."""
    none = np.zeros(0, np.int64)
    if boxes is None or not (boxes[0] != block).any():
        return none, none
    other = boxes[0] != block
    number, lo, hi = (b[other] for b in boxes)
    place, to = [none], [none]
    for q in tiles(at, LEAF):
        here, far = at[q], end[q]
        gap = np.maximum(np.maximum(lo - here.max(0), here.min(0) - hi), 0)
        some = np.flatnonzero((gap * gap).sum(1) <= far.max() * (1 + 1e-9))
        if len(some):
            gap = np.maximum(np.maximum(lo[some] - here[:, None], here[:, None] - hi[some]), 0)
            row, col = np.nonzero((gap * gap).sum(2) <= far[:, None] * (1 + 1e-9))
            pair = np.unique(np.stack((q[row], number[some[col]])), axis=1)
            place.append(pair[0])
            to.append(pair[1])
    return np.concatenate(place), np.concatenate(to)


def ball_sums(points: DataFrame, queries: DataFrame, radius: float, values: list[str]) -> DataFrame:
    """(cloud_id, query_id, n and the sums of the columns ``values`` of the points at most ``radius`` away) of each query that has any.

    Parts of PART points meet chunks of queries; a tile of points that is wholly in a ball counts by its sum.
    """
    fine = "cloud_id is not null and " + " and ".join(f"abs({c}) < 1e300" for c in XYZ)
    p = points.where(fine).select("cloud_id", "point_id", *[F.col(c).cast("double").alias(c) for c in (*XYZ, *values)])
    h = queries.where(fine).select(F.col("cloud_id").alias("cloud_id"), F.col("point_id").alias("grasp_id"), *[F.col(c).cast("double").alias(c) for c in XYZ])
    kinds = dict(h.dtypes)
    key, p, h, groups, _ = _dealt(p, h, [*XYZ, *values], PART, CHUNK)
    r2 = float(radius) * float(radius)

    def run(near: pa.Table, mine: pa.Table) -> pa.Table:
        xyz, at, own = _get(near, XYZ), _get(mine, XYZ), _get(near, values)
        order = tiles(xyz, TILE) if len(xyz) else []
        size = np.array([len(t) for t in order], np.int64)
        start, order = np.cumsum(size) - size, np.concatenate(order) if order else np.zeros(0, np.int64)
        xyz, own = xyz[order], own[order]
        lo, hi, total = (f.reduceat(a, start) if len(a) else a for f, a in ((np.minimum, xyz), (np.maximum, xyz), (np.add, own)))
        n, found = np.zeros(len(at), np.int64), np.zeros((len(at), len(values)))
        for i, q in enumerate(at):
            gap, far = np.maximum(np.maximum(lo - q, q - hi), 0), np.maximum(np.abs(lo - q), np.abs(hi - q))
            whole = (far * far).sum(1) <= r2 * (1 - 1e-9)
            n[i], found[i] = size[whole].sum(), total[whole].sum(0)
            k = np.flatnonzero(np.repeat(((gap * gap).sum(1) <= r2 * (1 + 1e-9)) & ~whole, size))
            dx, dy, dz = (xyz[k, c] - q[c] for c in range(3))
            k = k[dx * dx + dy * dy + dz * dz <= r2]
            n[i] += len(k)
            found[i] += own[k].sum(0)
        return pa.Table.from_arrays([mine.column("cloud_id"), mine.column("grasp_id"), pa.array(n), *[pa.array(c) for c in found.T]], names=["cloud_id", "query_id", "n", *values])

    tasks = min(2 * groups, 4000)
    pairs = p.repartition(tasks, *key).groupBy(*key).cogroup(h.repartition(tasks, *key).groupBy(*key))
    each = pairs.applyInArrow(run, ", ".join([f"cloud_id {kinds['cloud_id']}", f"query_id {kinds['grasp_id']}", "n long", *[f"{v} double" for v in values]]))
    return each.groupBy("cloud_id", "query_id").agg(*[F.sum(c).alias(c) for c in ("n", *values)]).where("n > 0")


#: Queries of a chunk of balls.
CHUNK = 1 << 11
