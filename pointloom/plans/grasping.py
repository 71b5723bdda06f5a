"""Queries on grasps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grasps as G
from . import query
from . import views as V

_LABELLED = "select *, case when level + 0.01*refine >= 0.6 then 0 when level + 0.01*refine <= 0.6 then 1 end label from grasps"


@query("entry_box_share", f"select cloud_id, label, count(*) n, avg(case when c >= 50 then 1.0 else 0.0 end) share from (select l.cloud_id, l.label, l.grasp_id, count(b.point_id) c from ({_LABELLED}) l left join boxed b using (grasp_id) where label is not null group by 1, 2, 3) group by 1, 2", "share")
def entry_box_share(s, d):
    """Share of grasps with at least 50 points inside the gripper box, by object and label."""
    g = V.grasps(s, d)
    counts = G.enough_inside(V.points(s, d), g)
    return G.label_2(g).join(counts, "grasp_id").groupBy("cloud_id", "label").agg(F.count("*").alias("n"), F.avg(F.col("enough").cast("double")).alias("share"))


@query("p10_pack_grasp", "select grasp_id, cx, cy, cz, ax, ay, az, width, angle, 0.0::double jaw, 0.0::double least from grasps", "cx cy cz ax ay az width angle jaw least")
def p10(s, d):
    return G.unpack_grasp(G.pack_grasp(V.grasps(s, d)))


@query("p11_endpoints", "select grasp_id, " + ", ".join(f"c{c}-width/2*a{c} p1{c}, c{c}+width/2*a{c} p2{c}" for c in "xyz") + " from grasps", "p1x p1y p1z p2x p2y p2z")
def p11(s, d):
    return G.endpoints(V.grasps(s, d))


@query("p11_from_endpoints", "select grasp_id, cx, cy, cz, ax, ay, az, width from grasps", "cx cy cz ax ay az width")
def p11b(s, d):
    return G.from_endpoints(G.endpoints(V.grasps(s, d)))


@query("p12_grasp_frame", "select grasp_id, apx, apy, apz, yx bx, yy \"by\", yz bz, mx, my, mz from gpose", 'apx apy apz bx "by" bz mx my mz')
def p12(s, d):
    return G.grasp_frame(V.grasps(s, d)).select("grasp_id", *[f"{a}{c}" for a in ("ap", "b", "m") for c in "xyz"])


_CORNERS = ",".join(f"({i + 1},{x},{y},{z})" for i, (x, y, z) in enumerate([(x, y, z) for half in (0.0835, 0.109) for x in (0.0, 0.125) for y in (half, -half) for z in (0.01125, -0.01125)] + [(-0.0225, y, z) for y in (0.109, -0.109) for z in (0.01125, -0.01125)]))


@query("p14_hand_points", f"select grasp_id, point, cx+apx*x+yx*y+mx*z x, cy+apy*x+yy*y+my*z y, cz+apz*x+yz*y+mz*z z from gpose, (values {_CORNERS}) c(point, x, y, z)", "x y z")
def p14(s, d):
    return G.hand_points(V.grasps(s, d))


_HAND = "select grasp_id, (x-cx)*apx+(y-cy)*apy+(z-cz)*apz bx, (x-cx)*yx+(y-cy)*yy+(z-cz)*yz b_y, abs((x-cx)*mx+(y-cy)*my+(z-cz)*mz) bz from gpose join points using (cloud_id)"


@query("j05_collisions", f"""with f as (select grasp_id, bool_or(bx > 0 and bx < 0.125 and bz < 0.01125 and abs(b_y) < 0.0835) open, bool_or(bx > 0 and bx < 0.125 and bz < 0.01125 and b_y > 0.0835 and b_y < 0.109) "left",
 bool_or(bx > 0 and bx < 0.125 and bz < 0.01125 and b_y < -0.0835 and b_y > -0.109) "right", bool_or(bx > -0.0225 and bx < 0 and abs(b_y) < 0.109 and bz < 0.01125) bottom from ({_HAND}) group by 1)
 select *, open and not "left" and not "right" and not bottom usable from f""")  # fmt: skip
def j05(s, d):
    return G.collisions(V.points(s, d), V.grasps(s, d))


@query("j04_crop_train", "select grasp_id, point_id, bx, by_, bz from boxed", "bx by_ bz")
def j04(s, d):
    return G.crop(V.points(s, d), V.grasps(s, d))


@query("j04_crop_online", f"select grasp_id, count(*) n from ({_HAND}) where bx > 0 and bx < 0.125 and abs(b_y) < 0.0835 and bz < 0.04175 group by 1")
def j04b(s, d):
    return G.crop_counts(V.points(s, d), V.grasps(s, d), "online")


@query("a08_box_counts", "select grasp_id, count(point_id) n, count(point_id) >= 50 enough from grasps left join boxed using (grasp_id) group by 1")
def a08(s, d):
    g = V.grasps(s, d)
    return G.box_counts(g, G.crop_counts(V.points(s, d), g))


@query("p16_label_2", f"select grasp_id, label from ({_LABELLED}) where label is not null")
def p16(s, d):
    return G.label_2(V.grasps(s, d)).select("grasp_id", "label")


@query("p17_label_3", "select grasp_id, case when level + 0.01*refine >= 1.2 then 0 when level + 0.01*refine <= 0.5 then 2 else 1 end label from grasps")
def p17(s, d):
    return G.label_3(V.grasps(s, d)).select("grasp_id", "label")


@query("p19_grasp_distance", "select a.grasp_id, b.grasp_id other, sqrt((a.cx-b.cx)**2+(a.cy-b.cy)**2+(a.cz-b.cz)**2) + 0.05*2/pi()*acos(least(abs(a.ax*b.ax+a.ay*b.ay+a.az*b.az), 1)) dist from grasps a join grasps b on b.grasp_id = a.grasp_id + 1", "dist")
def p19(s, d):
    g = V.grasps(s, d)
    one = g.select("grasp_id", *[F.col(f"{k}{c}").alias(f"{k}1{c}") for k in "ca" for c in "xyz"])
    two = g.select(F.col("grasp_id").alias("other"), (F.col("grasp_id") - 1).alias("grasp_id"), *[F.col(f"{k}{c}").alias(f"{k}2{c}") for k in "ca" for c in "xyz"])
    both = one.join(two, "grasp_id")
    return both.select("grasp_id", "other", G.grasp_distance(both).alias("dist"))


@query("p20_align_perpendicular", "select grasp_id, arg_max(theta, step) theta from (select *, max(v) over (partition by grasp_id) m from (select grasp_id, step, step*2*pi()/64 theta, round(sin(step*2*pi()/64)*zz, 9) v from gframe2, range(64) s(step))) where v = m group by 1", "theta")
def p20(s, d):
    return G.align_to_table(V.grasps(s, d))


@query("p20_align_parallel", "select grasp_id, arg_max(theta, step) theta from (select *, min(v) over (partition by grasp_id) m from (select grasp_id, step, step*2*pi()/1000 theta, abs(round(sin(step*2*pi()/1000)*zz, 9)) v from gframe2, range(1000) s(step))) where v = m group by 1", "theta")
def p20b(s, d):
    return G.align_to_table(V.grasps(s, d), "parallel")


@query("p21_table_angles", "select grasp_id, acos(greatest(least(yz, 1), -1)) axis_angle, acos(greatest(least(apz, 1), -1)) approach_angle from gpose", "axis_angle approach_angle")
def p21(s, d):
    return G.table_angles(V.grasps(s, d))


@query("p22_approach_offsets", "select grasp_id, step, radians(-30.0 + step * 60.0 / 4) \"offset\" from gpose, range(5) s(step) where acos(greatest(least(abs(yz), 1), -1)) >= radians(30)", '"offset"')
def p22(s, d):
    ok = G.table_angles(V.grasps(s, d)).where("least(axis_angle, pi() - axis_angle) >= radians(30)")
    return G.approach_offsets(ok.select("grasp_id"), 30.0, 5).select("grasp_id", F.col("step").cast("long").alias("step"), "offset")


@query("p34_line_of_action", "select grasp_id, step, " + ", ".join(f"c{c}-a{c}*width/2+a{c}*step*(width-0.02)/2/4 l{c}" for c in "xyz") + " from grasps, range(5) s(step)", "lx ly lz")
def p34(s, d):
    g = G.line_of_action(V.grasps(s, d), 5, 0.02)
    return g.withColumn("step", F.col("step").cast("long"))


@query("w02_friction_level", "with s as (select *, lag(closed) over (partition by grasp_id order by level desc) b, lag(level) over (partition by grasp_id order by level desc) h from closure) select grasp_id, level from (select grasp_id, coalesce(max(case when b and not closed then h end), case when arg_min(closed, level) then min(level) end) level from s group by 1) where level is not null", "level")
def w02(s, d):
    return G.friction_level(V.closure(s, d))


@query("w03_quota", "select grasp_id, cloud_id, level from grasps qualify row_number() over (partition by cloud_id, level order by grasp_id) <= 20", "level")
def w03(s, d):
    return G.quota(V.grasps(s, d), ["cloud_id", "level"], "grasp_id").select("grasp_id", "cloud_id", "level")


@query("w10_middle_of_group", "select cloud_id, level, grasp_id from (select *, row_number() over (partition by cloud_id, level order by grasp_id) k, count(*) over (partition by cloud_id, level) n from grasps) where k = ceil(n / 2)", "level")
def w10(s, d):
    return G.middle_of_group(V.grasps(s, d), ["cloud_id", "level"], ["grasp_id"]).select("cloud_id", "level", "grasp_id")


@query("j13_prune_near", """with recursive ord as (select cloud_id, grasp_id, cx, cy, cz, ax, ay, az, row_number() over (partition by cloud_id order by grasp_id) r from grasps), run as (
 select cloud_id, r, [{gid: grasp_id, cx: cx, cy: cy, cz: cz, ax: ax, ay: ay, az: az}] kept from ord where r = 1
 union all select run.cloud_id, run.r + 1, case when len(list_filter(run.kept, lambda q: sqrt((q.cx-n.cx)**2+(q.cy-n.cy)**2+(q.cz-n.cz)**2) + 0.05*2/pi()*acos(least(abs(q.ax*n.ax+q.ay*n.ay+q.az*n.az), 1)) < 0.35)) = 0
  then list_append(run.kept, {gid: n.grasp_id, cx: n.cx, cy: n.cy, cz: n.cz, ax: n.ax, ay: n.ay, az: n.az}) else run.kept end from run join ord n on n.cloud_id = run.cloud_id and n.r = run.r + 1)
 select unnest(list_transform(kept, lambda q: q.gid)) grasp_id from (select cloud_id, arg_max(kept, r) kept from run group by 1)""")  # fmt: skip
def j13(s, d):
    return G.prune_near(V.grasps(s, d), 0.35)


@query("a48_yield", "select cloud_id, level, count(*) sampled, count(case when enough then 1 end) kept from grasps join (select grasp_id, count(point_id) >= 50 enough from grasps left join boxed using (grasp_id) group by 1) using (grasp_id) group by 1, 2", "level")
def a48(s, d):
    g = V.grasps(s, d)
    return g.join(G.enough_inside(V.points(s, d), g), "grasp_id").groupBy("cloud_id", "level").agg(F.count("*").alias("sampled"), F.count_if("enough").alias("kept"))


def _sweep(angles: int, shifts: int, step: float, least: int, steep: float) -> str:
    """SQL of a sweep: the poses' views over turned and shifted grasps, then the hand's regions counted."""
    names = (("gframe", "grasps", "turned"), ("gframe2", "gframe", "tframe"), ("gaxes", "gframe2", "tframe2"), ("gpose", "gaxes", "taxes"))
    views = ", ".join(f"t{v[1:]} as ({V.SQL[v].replace(f'from {source})', f'from {new})').replace(f'from {source}', f'from {new}')})" for v, source, new in names)
    wide = "bx > 0 and bx < 0.125 and bz < 0.01125"
    return f"""with turned as (select (grasp_id*{angles}+turn)*{shifts}+shift grasp_id, grasp_id sample, cast(turn as int) turn, cast(shift as int) shift, cloud_id, {", ".join(f"c{c}+a{c}*(shift-{(shifts - 1) / 2})*{step} c{c}, a{c}" for c in "xyz")}, width, angle+radians(-90.0+turn*{180.0 / (angles - 1)}) angle from grasps, range({angles}) t(turn), range({shifts}) u(shift)), {views},
 back as (select * replace ({", ".join(f"c{c}-0.01*ap{c} as c{c}" for c in "xyz")}) from tpose),
 f as (select grasp_id, count_if({wide} and abs(b_y) < 0.0835) n, bool_or({wide} and b_y > 0.0835 and b_y < 0.109) l, bool_or({wide} and b_y < -0.0835 and b_y > -0.109) r, bool_or(bx > -0.0225 and bx < 0 and abs(b_y) < 0.109 and bz < 0.01125) b from ({_HAND.replace("from gpose", "from back")}) group by 1),
 m as (select sample, turn, shift, grasp_id, apz, row_number() over (partition by sample, turn order by shift) k, count(*) over (partition by sample, turn) c from tpose join f using (grasp_id) where n >= {least} and not l and not r and not b)
 select sample, turn, shift, grasp_id from m where k = ceil(c / 2) and apz < {-steep}"""


@query("g04_sweep_grasps", _sweep(5, 5, 0.08, 1, -2.0))
def g04(s, d):
    return G.sweep_grasps(V.points(s, d), V.grasps(s, d), 5, 5, 0.08)


@query("g04_sweep_steep", _sweep(7, 5, 0.05, 11, 0.5))
def g04b(s, d):
    """Hands that hold eleven points or more, and come down on the table."""
    return G.sweep_grasps(V.points(s, d), V.grasps(s, d), 7, 5, 0.05, least=11, steep=0.5)
