"""Queries on the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from . import query
from . import views as V


@query("s14_insert_absent", "select object_id, gripper, grasp_id, 'old' src from catalog_grasps where object_id % 3 <> 0 union all select object_id, gripper, grasp_id, 'new' from catalog_grasps where object_id % 3 = 0")
def s14(s, d):
    g = V.catalog_grasps(s, d)
    return C.insert_absent(g.where("object_id % 3 <> 0").withColumn("src", F.lit("old")), g.withColumn("src", F.lit("new")), ["object_id", "gripper", "grasp_id"])


@query("s14_upsert", "select object_id, gripper, grasp_id, case when object_id % 5 = 0 then 'new' else 'old' end src from catalog_grasps")
def s14b(s, d):
    g = V.catalog_grasps(s, d)
    return C.upsert(g.withColumn("src", F.lit("old")), g.where("object_id % 5 = 0").withColumn("src", F.lit("new")), ["object_id", "gripper", "grasp_id"])


@query("s14_number_grasps", "select object_id, grasp_id, row_number() over (partition by object_id order by key) - 1 + coalesce(n, 0) as new_id from (select object_id, grasp_id, grasp_id key from catalog_grasps where gripper = 'A') left join (select object_id, count(*) n from catalog_grasps where gripper = 'R' group by 1) using (object_id)")
def s14c(s, d):
    g = V.catalog_grasps(s, d)
    new = g.where("gripper = 'A'").select("object_id", F.col("grasp_id").alias("key"))
    return C.number_grasps(new, g.where("gripper = 'R'"), ["object_id"], "key").select("object_id", F.col("key").alias("grasp_id"), F.col("grasp_id").alias("new_id"))


@query("s15_delete", "select object_id, gripper, grasp_id from catalog_grasps where object_id not in (select p_partkey from part where p_size < 20)")
def s15(s, d):
    keys = V.table(s, d, "part").where("p_size < 20").select(F.col("p_partkey").alias("object_id"))
    return C.delete(V.catalog_grasps(s, d), keys, ["object_id"])


@query("s16_read_grasps", "select grasp_id from catalog_grasps where object_id = 7 and gripper = 'N'")
def s16(s, d):
    return V.catalog_grasps(s, d).where("object_id = 7 and gripper = 'N'").select("grasp_id")


@query("s17_stable_poses", "select object_id, pose_id, p from (select l_partkey object_id, l_linenumber pose_id, max(l_discount) p from lineitem group by 1, 2) where p > 0.05", "p")
def s17(s, d):
    t = V.table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("object_id"), F.col("l_linenumber").alias("pose_id")).agg(F.max("l_discount").alias("p"))
    return t.where("p > 0.05")


@query("s18_subset", "select object_id, gripper, grasp_id from catalog_grasps where object_id in (select object_id from (select object_id, row_number() over (order by object_id) - 1 k from (select distinct object_id from catalog_grasps)) where k >= 10 and k < 25)")
def s18(s, d):
    return C.subset(V.catalog_grasps(s, d), "object_id", 10, 25)


@query("s19_chunked", "select event_id, cast(i as bigint) \"index\", cast(i // 100 as bigint) chunk from (select event_id, row_number() over (order by event_id) - 1 i from events)")
def s19(s, d):
    return C.chunked(V.table(s, d, "events").select("event_id"), "event_id", 100)


@query("s20_pending", "select grasp_id, cloud_id from grasps where not (grasp_id % 2 = 0 and grasp_id % 3 = 0)")
def s20(s, d):
    g = V.grasps(s, d).select("grasp_id", "cloud_id")
    done = g.where("grasp_id % 2 = 0").select("grasp_id", F.lit("cloud").alias("kind")).union(g.where("grasp_id % 3 = 0").select("grasp_id", F.lit("normals")))
    return C.pending(g, done, "grasp_id", 2)


@query("s22_passing", "select object_id from (select object_id, max(value) filter (metric = 'quantity') q, max(value) filter (metric = 'tax') t from catalog_metrics group by 1) where q between 10 and 50 and t between 0.02 and 0.08")
def s22(s, d):
    m = V.catalog_metrics(s, d).groupBy("object_id", F.col("metric").alias("name")).agg(F.max("value").alias("value"))
    return C.passing(m, {"quantity": (10.0, 50.0), "tax": (0.02, 0.08)})


@query("s23_names", "select distinct gripper from catalog_grasps")
def s23(s, d):
    return C.names(V.catalog_grasps(s, d), "gripper")


@query("j01_usable_objects", "select distinct cloud_id from grasps where cloud_id in (select cast(n_nationkey as varchar) from nation where n_nationkey % 2 = 0)")
def j01(s, d):
    t = V.table(s, d, "nation").where("n_nationkey % 2 = 0").selectExpr("cast(n_nationkey as string) cloud_id")
    return V.grasps(s, d).select("cloud_id").distinct().join(t, "cloud_id", "left_semi")


@query("j02_training_index", "select cloud_id, grasp_id, n_name from (select g.cloud_id, grasp_id, n_name, row_number() over (partition by g.cloud_id order by grasp_id) k from grasps g join nation on g.cloud_id = cast(n_nationkey as varchar)) where k <= 15")
def j02(s, d):
    t = V.table(s, d, "nation").selectExpr("cast(n_nationkey as string) cloud_id", "n_name")
    return C.training_index(V.grasps(s, d), t, 15).select("cloud_id", "grasp_id", "n_name")


@query("j14_grasp_metrics", "select object_id, grasp_id, gripper, max(value) filter (metric = 'quantity') quantity, count(value) n from catalog_grasps left join (select * from catalog_metrics where value > 0.05) using (object_id, grasp_id) group by 1, 2, 3", "quantity")
def j14(s, d):
    m = C.grasp_metrics(V.catalog_grasps(s, d), V.catalog_metrics(s, d).where("value > 0.05"))
    return m.selectExpr("object_id", "grasp_id", "gripper", "metrics['quantity'] quantity", "cast(size(metrics) as long) n")


@query("j19_metadata_conflicts", "select 'tax' metric union select 'quantity'")
def j19(s, d):
    return C.metadata_conflicts(s.createDataFrame([("tax",), ("quantity",), ("mass",)], "metric string"), C.names(V.catalog_metrics(s, d), "metric"))


@query("t01_sorted_grasps", "select object_id, grasp_id, gripper, value from catalog_grasps join catalog_metrics using (object_id, grasp_id) where metric = 'quantity'", "value")
def t01(s, d):
    return C.sorted_grasps(V.catalog_grasps(s, d), V.catalog_metrics(s, d), "quantity")


@query("t02_best_grasp", "select object_id, grasp_id, value from catalog_metrics where metric = 'quantity' qualify row_number() over (partition by object_id order by value desc, grasp_id) = 1", "value")
def t02(s, d):
    return C.best_grasp(V.catalog_metrics(s, d), "quantity")


@query("t03_rank_grasps", "select cloud_id, grasp_id, refine score from grasps where refine > 0.05 qualify row_number() over (partition by cloud_id order by refine desc, grasp_id) <= 3", "score")
def t03(s, d):
    return C.rank_grasps(V.grasps(s, d).where("refine > 0.05").select("cloud_id", "grasp_id", F.col("refine").alias("score")), "cloud_id", 3)


@query("p38_scale_metric", "select cloud_id, grasp_id, case when hi = lo then 1 else (refine-lo)/(hi-lo) end scaled from (select cloud_id, grasp_id, refine, min(refine) over w lo, max(refine) over w hi from grasps window w as (partition by cloud_id)) where refine > 0.02", "scaled")
def p38(s, d):
    return C.scale_metric(V.grasps(s, d).select("cloud_id", "grasp_id", "refine"), "cloud_id", "refine", 0.02).select("cloud_id", "grasp_id", "scaled")


@query("p43_mask_metric", "select grasp_id, case when grasp_id % 4 = 0 then 0 else refine end refine from grasps", "refine")
def p43(s, d):
    return V.grasps(s, d).select("grasp_id", F.when(F.col("grasp_id") % 4 == 0, 0.0).otherwise(F.col("refine")).alias("refine"))


@query("p33_filter_fields", "select grasp_id from grasps where width >= 0.35 and width <= 0.5 and refine >= 0.01")
def p33(s, d):
    return V.grasps(s, d).where("width >= 0.35 and width <= 0.5 and refine >= 0.01").select("grasp_id")


@query("a24_available_metrics", "select object_id, count(distinct metric) n_metrics, count(distinct grasp_id) n_grasps, array_to_string(list_sort(list(distinct metric)), ',') names from catalog_metrics group by 1")
def a24(s, d):
    return C.available_metrics(V.catalog_metrics(s, d))


@query("w09_label_entities", "select grasp_id, cloud_id, dense_rank() over (order by cloud_id) - 1 number from grasps")
def w09(s, d):
    return C.label_entities(V.grasps(s, d).select("grasp_id", "cloud_id"), "cloud_id").withColumn("number", F.col("number").cast("long"))


@query("u03_drop_empty", "select grasp_id from grasps where exists (select 1 from boxed b where b.grasp_id = grasps.grasp_id)")
def u03(s, d):
    from ..operators.grasps import enough_inside

    return enough_inside(V.points(s, d), V.grasps(s, d), 1).where("enough").select("grasp_id")


@query("x01_metadata", "select mesh_id, unnest(['n', 'height']) name_, unnest([count(*)::double, max(z)-min(z)]) as value from vertices group by 1", "value")
def x01(s, d):
    m = C.Metadata()
    m.register("n", F.count("*"))
    m.register("height", F.max("z") - F.min("z"))
    return m.compute(V.vertices(s, d), "mesh_id", ["n", "height"]).withColumnRenamed("name", "name_")
