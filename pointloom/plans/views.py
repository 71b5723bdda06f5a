"""Views of the shared tables in the shapes that the operators take: for Spark, and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _e(i: int) -> str:
    return f"cast(element_at(embedding, {i + 1}) as double)"


def points(spark: SparkSession, d: str) -> DataFrame:
    """cloud_id, point_id, x, y, z and colours: 21 points of each embedding."""
    p = table(spark, d, "embeddings").selectExpr("label", "vec_id", "embedding", "explode(sequence(0, 20)) as i")
    p = p.selectExpr("cast(label as string) cloud_id", "vec_id * 21 + i as point_id", *[f"cast(element_at(embedding, 3 * i + {k + 1}) as double) {c}" for k, c in enumerate("xyz")])
    return p.selectExpr("*", "cast(point_id * 37 % 256 as int) r", "cast(point_id * 59 % 256 as int) g", "cast(point_id * 83 % 256 as int) b")


def depth(spark: SparkSession, d: str) -> DataFrame:
    """frame_id, v, u, d: an image of each label."""
    t = table(spark, d, "embeddings")
    t = t.selectExpr("label frame_id", "cast(row_number() over (partition by label order by vec_id) - 1 as long) v", "embedding")
    t = t.selectExpr("frame_id", "v", "posexplode(embedding) as (u, e)")
    return t.selectExpr("frame_id", "v", "u", "case when cast(e as double) > 0.4 then 0 else cast(floor((cast(e as double) + 1) * 800) as int) end d")


def calib(spark: SparkSession, d: str) -> DataFrame:
    """One row for each frame: pinhole numbers and a rigid transform."""
    return table(spark, d, "embeddings").selectExpr("label frame_id").distinct().selectExpr(
        "frame_id", "70.0D fx", "70.0D fy", "32.0D cx", "25.0D cy",
        "array(0.8D, -0.6D, 0.0D, 0.1D, 0.6D, 0.8D, 0.0D, -0.2D, 0.0D, 0.0D, 1.0D, 0.3D, 0.0D, 0.0D, 0.0D, 1.0D) h")


def grasps(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "embeddings").selectExpr("*", f"sqrt({_e(3)}*{_e(3)}+{_e(4)}*{_e(4)}+{_e(5)}*{_e(5)}) n")
    return t.selectExpr(
        "vec_id grasp_id", "cast(label as string) cloud_id", *[f"{_e(i)} c{c}" for i, c in enumerate("xyz")], *[f"{_e(3 + i)}/n a{c}" for i, c in enumerate("xyz")],
        f"0.3D+abs({_e(6)}) width", f"{_e(7)}*pi() angle", "case vec_id%3 when 0 then 2.0D when 1 then 1.6D else 0.6D end level", f"abs({_e(8)}) refine")


def contacts(spark: SparkSession, d: str) -> DataFrame:
    """Two contacts of each grasp: point, unit normal, direction into the body."""
    g = table(spark, d, "embeddings").selectExpr("vec_id grasp_id", *[f"{_e(10 + i)} o{c}" for i, c in enumerate("xyz")]).join(grasps(spark, d), "grasp_id")
    g = g.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("s", 1.0 - 2.0 * F.col("side"))
    g = g.selectExpr("grasp_id", "side", *[f"c{c} - s * width / 2 * a{c} p{c}" for c in "xyz"], *[f"-s * a{c} + 0.5D * o{c} m{c}" for c in "xyz"], *[f"s * a{c} d{c}" for c in "xyz"])
    return g.selectExpr("grasp_id", "side", "px", "py", "pz", *[f"m{c} / sqrt(mx*mx+my*my+mz*mz) n{c}" for c in "xyz"], "dx", "dy", "dz")


def vertices(spark: SparkSession, d: str) -> DataFrame:
    return depth(spark, d).selectExpr("frame_id mesh_id", "v * 64 + u vid", "cast(u as double) x", "cast(v as double) y", "d / 800.0D z")


def faces(spark: SparkSession, d: str) -> DataFrame:
    """Two triangles for each grid cell."""
    t = depth(spark, d)
    last = t.groupBy("frame_id").agg(F.max("v").alias("mv"))
    t = t.join(last, "frame_id").where("u < 63 and v < mv").selectExpr("frame_id mesh_id", "v * 64 + u k")
    return t.selectExpr("mesh_id", "explode(array(struct(k * 2 as fid, k as a, k + 1 as b, k + 64 as c), struct(k * 2 + 1 as fid, k + 1 as a, k + 65 as b, k + 64 as c))) f").select("mesh_id", "f.*")


def sdf(spark: SparkSession, d: str) -> DataFrame:
    """A 12-cubed grid for each label: distance to a sphere whose radius comes from the label's data."""
    r = table(spark, d, "embeddings").groupBy(F.col("label").alias("mesh_id")).agg((2 + F.count("*") % 3).cast("double").alias("r"))
    ax = lambda c: f"explode(sequence(0, 11)) {c}"
    return r.selectExpr("mesh_id", "r", ax("i")).selectExpr("*", ax("j")).selectExpr("*", ax("k")).selectExpr("mesh_id", "i", "j", "k", "sqrt((i-5.5D)*(i-5.5D)+(j-5.5D)*(j-5.5D)+(k-5.5D)*(k-5.5D)) - r val")


def preds2(spark: SparkSession, d: str) -> DataFrame:
    """row_id, label, score of class 1."""
    return table(spark, d, "events").selectExpr("event_id row_id", "cast(event_type = 'purchase' as int) label", "least(value / 500, 1.0D) score")


def preds10(spark: SparkSession, d: str) -> DataFrame:
    """row_id, label, probs: softmax of the first ten numbers."""
    t = table(spark, d, "embeddings").selectExpr("vec_id row_id", "label % 10 label", "transform(slice(embedding, 1, 10), x -> exp(cast(x as double))) e")
    return t.selectExpr("row_id", "label", "transform(e, x -> x / aggregate(e, 0.0D, (a, y) -> a + y)) probs")


def rewards(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr("user_id arm", "event_id seq", "least(value / 100, 1.0D) v")


def catalog_grasps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("l_partkey object_id", "l_returnflag gripper", "l_orderkey * 10 + l_linenumber grasp_id").distinct()


def catalog_metrics(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").selectExpr("l_partkey object_id", "l_orderkey * 10 + l_linenumber grasp_id", "l_quantity", "l_discount", "l_tax")
    t = t.groupBy("object_id", "grasp_id").agg(*[F.max(c).alias(c[2:]) for c in ("l_quantity", "l_discount", "l_tax")])
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("quantity", "discount", "tax")])
    return t.select("object_id", "grasp_id", F.inline(each))  # unlike unpivot, keeps the rows' partitioning


def closure(spark: SparkSession, d: str) -> DataFrame:
    return grasps(spark, d).selectExpr("grasp_id", "refine", "explode(array(2.0D, 1.6D, 0.6D)) level").selectExpr("grasp_id", "level", "refine * 10 <= level closed")


def states(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type in ('signup', 'error')").selectExpr("event_id", "ts", "user_id source", "event_type = 'signup' home")


def frames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type not in ('signup', 'error')").selectExpr("event_id frame_id", "ts", "user_id source", "value")


def joints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr("event_id", "user_id source", "transform(sequence(1, 6), i -> value * i % 7 / 4) j")


_D = "cast(embedding[{}] as double)"
SQL = {
    "points": "select *, cast(point_id*37 % 256 as int) r, cast(point_id*59 % 256 as int) g, cast(point_id*83 % 256 as int) b from (select cast(label as varchar) cloud_id, vec_id*21+i as point_id, cast(embedding[3*i+1] as double) x, cast(embedding[3*i+2] as double) y, cast(embedding[3*i+3] as double) z from embeddings, range(21) r(i))",
    "depth": "select label frame_id, v, cast(i as int) u, case when e>0.4 then 0 else cast(floor((e+1)*800) as int) end d from (select label, row_number() over(partition by label order by vec_id)-1 v, embedding from embeddings) q, range(64) r(i), lateral (select cast(embedding[i+1] as double) e) w",
    "calib": "select distinct label frame_id, 70.0::double fx, 70.0::double fy, 32.0::double cx, 25.0::double cy, [0.8,-0.6,0.0,0.1,0.6,0.8,0.0,-0.2,0.0,0.0,1.0,0.3,0.0,0.0,0.0,1.0]::double[] h from embeddings",
    "grasps": f"select vec_id grasp_id, cast(label as varchar) cloud_id, {_D.format(1)} cx, {_D.format(2)} cy, {_D.format(3)} cz, {_D.format(4)}/n ax, {_D.format(5)}/n ay, {_D.format(6)}/n az, 0.3+abs({_D.format(7)}) width, {_D.format(8)}*pi() angle, cast(case vec_id%3 when 0 then 2.0 when 1 then 1.6 else 0.6 end as double) as level, abs({_D.format(9)}) as refine from (select *, sqrt({_D.format(4)}*{_D.format(4)}+{_D.format(5)}*{_D.format(5)}+{_D.format(6)}*{_D.format(6)}) n from embeddings)",
    "gframe": "select *, case when nx > 0 then ay/nx else 1 end xx, case when nx > 0 then -ax/nx else 0 end xy, 0.0::double xz, ax yx, ay yy, az yz from (select *, sqrt(ax*ax+ay*ay) nx from grasps)",
    "gframe2": "select *, xy*yz-xz*yy zx, xz*yx-xx*yz zy, xx*yy-xy*yx zz from gframe",
    "gaxes": "select *, cos(angle)*xx+sin(angle)*zx apx, cos(angle)*xy+sin(angle)*zy apy, cos(angle)*xz+sin(angle)*zz apz from gframe2",
    "gpose": "select *, yy*apz-yz*apy mx, yz*apx-yx*apz my, yx*apy-yy*apx mz from gaxes",
    "boxed": "select * from (select g.grasp_id, p.point_id, (x-cx)*apx+(y-cy)*apy+(z-cz)*apz bx, (x-cx)*yx+(y-cy)*yy+(z-cz)*yz by_, (x-cx)*mx+(y-cy)*my+(z-cz)*mz bz, width from points p join gpose g using (cloud_id)) where abs(bx) < width/4 and abs(by_) < width/2 and abs(bz) < width/4",
    "contacts": "select grasp_id, side, px, py, pz, mx/l nx, my/l ny, mz/l nz, dx, dy, dz from (select *, sqrt(mx*mx+my*my+mz*mz) l from (select g.grasp_id, cast(side as int) side, "
    + ", ".join(f"c{c}-(1.0-2*side)*width/2*a{c} p{c}, -(1.0-2*side)*a{c}+0.5*cast(embedding[{11 + i}] as double) m{c}, (1.0-2*side)*a{c} d{c}" for i, c in enumerate("xyz"))
    + " from grasps g join embeddings on vec_id = g.grasp_id, range(2) s(side)))",
    "vertices": "select frame_id mesh_id, v*64+u vid, cast(u as double) x, cast(v as double) y, d/800.0::double z from depth",
    "faces": "select mesh_id, unnest([{fid: k*2, a: k, b: k+1, c: k+64}, {fid: k*2+1, a: k+1, b: k+65, c: k+64}], recursive := true) from (select frame_id mesh_id, v*64+u k, v, u, max(v) over (partition by frame_id) mv from depth) where u < 63 and v < mv",
    "corners": "select f.*, p.x x1, p.y y1, p.z z1, q.x x2, q.y y2, q.z z2, r.x x3, r.y y3, r.z z3 from faces f join vertices p on p.mesh_id=f.mesh_id and p.vid=a join vertices q on q.mesh_id=f.mesh_id and q.vid=b join vertices r on r.mesh_id=f.mesh_id and r.vid=c",
    "sdf": "select mesh_id, cast(i as int) i, cast(j as int) j, cast(k as int) k, sqrt((i-5.5)*(i-5.5)+(j-5.5)*(j-5.5)+(k-5.5)*(k-5.5)) - r val from (select label mesh_id, cast(2 + count(*) % 3 as double) r from embeddings group by 1), range(12) a(i), range(12) b(j), range(12) c(k)",
    "preds2": "select event_id row_id, cast(event_type = 'purchase' as int) label, least(value / 500, 1.0) score from events",
    "preds10": "select row_id, label, list_transform(e, lambda x: x / list_sum(e)) probs from (select vec_id row_id, label % 10 label, list_transform(embedding[1:10], lambda x: exp(cast(x as double))) e from embeddings)",
    "rewards": "select user_id arm, event_id seq, least(value / 100, 1.0) v from events",
    "catalog_grasps": "select distinct l_partkey object_id, l_returnflag gripper, l_orderkey * 10 + l_linenumber grasp_id from lineitem",
    "catalog_metrics": "select * from (unpivot (select l_partkey object_id, l_orderkey * 10 + l_linenumber grasp_id, max(l_quantity) quantity, max(l_discount) discount, max(l_tax) tax from lineitem group by 1, 2) on quantity, discount, tax into name metric value value)",
    "closure": "select grasp_id, level, refine * 10 <= level closed from (select grasp_id, refine, unnest([2.0, 1.6, 0.6]::double[]) as level from grasps)",
    "states": "select event_id, ts, user_id source, event_type = 'signup' home from events where event_type in ('signup', 'error')",
    "frames": "select event_id frame_id, ts, user_id source, value from events where event_type not in ('signup', 'error')",
    "joints": "select event_id, user_id source, list_transform(range(1, 7), lambda i: value * i % 7 / 4) j from events",
}
