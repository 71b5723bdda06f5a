"""Queries on point clouds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import uniform
from ..operators import points as P
from . import query
from . import views as V

U = "(('0x' || substr(md5({}), 1, 8))::bigint / 4294967296.0)"


@query("p01_finite_points", "select cloud_id, count(*) n from (select cloud_id, case when point_id % 7 = 0 then 'nan'::double when point_id % 11 = 0 then 'inf'::double else x end x from points) where isfinite(x) group by 1")
def p01(s, d):
    p = V.points(s, d).withColumn("x", F.when(F.col("point_id") % 7 == 0, float("nan")).when(F.col("point_id") % 11 == 0, float("inf")).otherwise(F.col("x")))
    return P.finite_points(p).groupBy("cloud_id").agg(F.count("*").alias("n"))


@query("p02_pack_rgb", "select point_id, cast(r*65536 + g*256 + b as int) rgb, r r2, g g2, b b2 from points")
def p02(s, d):
    p = V.points(s, d).select("point_id", P.pack_rgb(F.col("r"), F.col("g"), F.col("b")).alias("rgb"))
    return p.select("point_id", "rgb", *[c.alias(n) for c, n in zip(P.unpack_rgb(F.col("rgb")), ("r2", "g2", "b2"), strict=True)])


@query("p03_drop_white", "select cloud_id, point_id from points where r < 210 and g < 210 and b < 210")
def p03(s, d):
    return P.drop_white(V.points(s, d)).select("cloud_id", "point_id")


@query("p04_above_table", "select cloud_id, count(*) n, sum(z) z from points where z > 0.01 group by 1", "z")
def p04(s, d):
    return P.above_table(V.points(s, d)).groupBy("cloud_id").agg(F.count("*").alias("n"), F.sum("z").alias("z"))


@query("p05_drop_objects", "select cloud_id, count(*) n from points where cloud_id not in ('1', '3') group by 1")
def p05(s, d):
    return P.drop_objects(V.points(s, d), s.createDataFrame([("1",), ("3",)], "cloud_id string")).groupBy("cloud_id").agg(F.count("*").alias("n"))


_BOX = "select cloud_id c, min(x) lx, max(x) hx, min(y) ly, max(y) hy, min(z) lz, max(z) hz, greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)) side, count(*) total from points group by 1"
_BINS = f"""select p.*, total, side/{{n}} step, lx-(side-(hx-lx))/2 fx, ly-(side-(hy-ly))/2 fy, lz-(side-(hz-lz))/2 fz,
  cast(least(greatest(ceil((x-(lx-(side-(hx-lx))/2))/(side/{{n}}))-1, 0), {{n}}-1) as int) i, cast(least(greatest(ceil((y-(ly-(side-(hy-ly))/2))/(side/{{n}}))-1, 0), {{n}}-1) as int) j,
  cast(least(greatest(ceil((z-(lz-(side-(hz-lz))/2))/(side/{{n}}))-1, 0), {{n}}-1) as int) k from points p join ({_BOX}) on c = cloud_id"""


@query("a02_voxel_features", f"select cloud_id, i, j, k, count(*) count, greatest(max(x),0) max_x, greatest(max(y),0) max_y, greatest(max(z),0) max_z, avg(x) mean_x, avg(y) mean_y, avg(z) mean_z, count(*)/any_value(total) density from ({_BINS.format(n=10)}) group by all", "max_x max_y max_z mean_x mean_y mean_z density")
def a02(s, d):
    return P.voxel_features(V.points(s, d), 10)


@query("a03_voxel_centers", f"select distinct cloud_id, i, j, k, fx+(i+0.5)*step x, fy+(j+0.5)*step y, fz+(k+0.5)*step z from ({_BINS.format(n=8)})", "x y z")
def a03(s, d):
    return P.voxel_centers(V.points(s, d), 8)


@query("a04_voxel_downsample", "select cloud_id, cast(floor(x/0.2) as bigint) i, cast(floor(y/0.2) as bigint) j, cast(floor(z/0.2) as bigint) k, avg(x) x, avg(y) y, avg(z) z from points group by 1, 2, 3, 4", "x y z")
def a04(s, d):
    return P.voxel_downsample(V.points(s, d), 0.2)


@query("w06_drop_sparse_columns", f"select cloud_id, i, j, k from (select *, count(*) over (partition by cloud_id, i, j) n from (select distinct cloud_id, i, j, k from ({_BINS.format(n=8)}))) where n >= 3")
def w06(s, d):
    return P.drop_sparse_columns(P.voxel_centers(V.points(s, d), 8)).select("cloud_id", "i", "j", "k")


@query("j09_voxel_neighbors", f"with vox as (select distinct cloud_id, i, j, k from ({_BINS.format(n=6)})) select a.cloud_id, a.i, a.j, a.k, b.i ni, b.j nj, b.k nk from vox a join vox b on a.cloud_id = b.cloud_id and abs(a.i-b.i) <= 1 and abs(a.j-b.j) <= 1 and abs(a.k-b.k) <= 1")
def j09(s, d):
    return P.voxel_neighbors(P.voxel_centers(V.points(s, d), 6))


_NEAR = "select p.cloud_id, q.point_id query_id, p.point_id, (p.x-q.x)**2+(p.y-q.y)**2+(p.z-q.z)**2 d2 from points p join points q using (cloud_id) where q.point_id % 100 = 0"


def _queries(s, d):
    return V.points(s, d).where("point_id % 100 = 0")


@query("j06_neighbors", f"select *, row_number() over (partition by cloud_id, query_id order by d2, point_id) rank from ({_NEAR}) where d2 <= 0.0225 qualify rank <= 30", "d2")
def j06(s, d):
    return P.neighbors(V.points(s, d), _queries(s, d), 0.15, 30).withColumn("rank", F.col("rank").cast("long"))


@query("j07_knn", f"select *, row_number() over (partition by cloud_id, query_id order by d2, point_id) rank from ({_NEAR}) qualify rank <= 10", "d2")
def j07(s, d):
    return P.knn(V.points(s, d), _queries(s, d), 10, 0.15).withColumn("rank", F.col("rank").cast("long"))


@query("j08_voxel_distance", f"select cloud_id, i, j, k, min(sqrt((p.x-v.x)**2+(p.y-v.y)**2+(p.z-v.z)**2)) d from points p join (select distinct cloud_id, i, j, k, fx+(i+0.5)*step x, fy+(j+0.5)*step y, fz+(k+0.5)*step z from ({_BINS.format(n=4)})) v using (cloud_id) group by 1, 2, 3, 4", "d")
def j08(s, d):
    v = P.voxel_centers(V.points(s, d), 4).withColumn("point_id", F.expr("(i * 4 + j) * 4 + k"))
    near = P.knn(V.points(s, d), v, 1, 0.1).select("cloud_id", F.col("query_id").alias("point_id"), F.sqrt("d2").alias("d"))
    return near.join(v, ["cloud_id", "point_id"]).select("cloud_id", "i", "j", "k", "d")


@query("t04_nearest_height", "select cloud_id, point_id, abs(z - 0.1) gap from points qualify row_number() over (partition by cloud_id order by gap, point_id) <= 10", "gap")
def t04(s, d):
    return P.nearest_height(V.points(s, d), 0.1).select("cloud_id", "point_id", "gap")


@query("w04_cap_per_voxel", f"select cloud_id, i, j, k, point_id from ({_BINS.format(n=3)}) qualify row_number() over (partition by cloud_id, i, j, k order by point_id) <= 50")
def w04(s, d):
    return P.cap_per_group(P.bins(V.points(s, d), 3), ["cloud_id", "i", "j", "k"], ["point_id"], 50).select("cloud_id", "i", "j", "k", "point_id")


_PART = "select cloud_id, point_id from points"


@query("w05_resample", f"with part as ({_PART}), n as (select cloud_id, count(*) size from part group by 1), r as (select *, row_number() over (partition by cloud_id order by {U.format("'5:' || cloud_id || ':' || point_id")}, point_id) - 1 slot, row_number() over (partition by cloud_id order by point_id) - 1 pos from part join n using (cloud_id)) select cloud_id, slot, point_id from r where size >= 1050 and slot < 1050 union all select n.cloud_id, s.slot, r.point_id from n, range(1050) s(slot), r where n.size < 1050 and r.cloud_id = n.cloud_id and r.pos = floor({U.format("'5:' || n.cloud_id || ':' || s.slot")} * n.size)")
def w05(s, d):
    return P.resample(V.points(s, d), 1050, 5).withColumn("slot", F.col("slot").cast("long"))


@query("t05_sample_n", f"select grasp_id from grasps order by {U.format("'3:' || grasp_id")}, grasp_id limit 40")
def t05(s, d):
    return P.sample_n(V.grasps(s, d), 40, 3, "grasp_id").select("grasp_id")


@query("t06_review_sample", f"with h as (select cloud_id, case when level <= 1.0 then 'low' else 'high' end k, grasp_id, row_number() over (partition by case when level <= 1.0 then 'low' else 'high' end order by grasp_id) - 1 pos, count(*) over (partition by case when level <= 1.0 then 'low' else 'high' end) n from grasps where level <= 1.0 or level >= 1.8) select k cloud_id, slot, grasp_id from h, range(25) s(slot) where pos = floor({U.format("'9:' || k || ':' || slot")} * n)")
def t06(s, d):
    """25 draws with repeats from either end of the friction levels."""
    g = V.grasps(s, d).where("level <= 1.0 or level >= 1.8").withColumn("cloud_id", F.when(F.col("level") <= 1.0, "low").otherwise("high"))
    size = g.groupBy("cloud_id").agg(F.count("*").alias("n"))
    slots = size.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(24)))).withColumn("at", F.floor(uniform(9, F.col("cloud_id"), F.col("slot")) * F.col("n")))
    from pyspark.sql import Window

    ranked = g.withColumn("at", F.row_number().over(Window.partitionBy("cloud_id").orderBy("grasp_id")) - 1)
    return slots.join(ranked, ["cloud_id", "at"]).select("cloud_id", F.col("slot").cast("long").alias("slot"), "grasp_id")


@query("u02_merge_clouds", "select cloud_id, count(*) n from (select * from points union all select * from points where z > 0) group by 1")
def u02(s, d):
    p = V.points(s, d)
    return P.merge_clouds(p, p.where("z > 0")).groupBy("cloud_id").agg(F.count("*").alias("n"))


@query("a49_torque_scale", "select cloud_id, 1 / list_sort([max(x), max(y), max(z)])[2] scale from points group by 1", "scale")
def a49(s, d):
    return P.torque_scale(V.points(s, d))


@query("p18_ravel", "select point_id, i, j, k, (i * 7 + j) * 11 + k as back from (select point_id, point_id // 77 i, point_id // 11 % 7 j, point_id % 11 k from points)")
def p18(s, d):
    p = V.points(s, d).select("point_id", *[c.alias(n) for c, n in zip(P_unravel(F.col("point_id")), "ijk", strict=True)])
    from ..operators.grasps import ravel

    return p.withColumn("back", ravel(F.col("i"), F.col("j"), F.col("k"), (0, 7, 11)))


def P_unravel(c):
    from ..operators.grasps import unravel

    return unravel(c, (0, 7, 11))
