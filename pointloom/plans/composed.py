"""Queries on operators made of others."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.beta import beta_quantile_sql
from ..operators import compose as C
from ..operators import learn as L
from ..operators import mesh as M
from . import query
from . import views as V
from .clouds import U
from .learning import _BETA, _FRAME2
from .surfaces import SIGNED

_ROT = [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]


@query("p13_gripper_pose", "select grasp_id, " + ", ".join(f"{b} r{c}0, -ap{c} r{c}1, m{c} r{c}2, c{c}+0.1*ap{c}-0.2*{b}+0.05*m{c} t{c}" for c, b in zip("xyz", ("yx", "yy", "yz"), strict=True)) + " from gpose", " ".join(f"r{c}0 r{c}1 r{c}2 t{c}" for c in "xyz"))
def p13(s, d):
    return C.gripper_pose(V.grasps(s, d), _ROT, [0.1, -0.2, 0.05])


@query("p24_hand_pose", "select grasp_id, 70*cx/(cz+2) du, 70*cy/(cz+2) dv, width w from grasps", "du dv w")
def p24(s, d):
    z = F.col("cz") + 2
    p = V.grasps(s, d).select("grasp_id", (70 * F.col("cx") / z + 32).alias("u"), (70 * F.col("cy") / z + 25).alias("v"), z.alias("depth"), F.lit(0.0).alias("turn"), "width")
    h = C.hand_pose(p, 32.0, 25.0)
    return h.select("grasp_id", F.get("pose", F.lit(4)).alias("du"), F.get("pose", F.lit(5)).alias("dv"), F.get("pose", F.lit(6)).alias("w"))


@query("p41_window_features", "select vec_id id, len(embedding) // 16 * 16 n, list_sum(list_transform(embedding[1:16], lambda x: x::double))*2 + list_sum(list_transform(embedding[17:32], lambda x: x::double)) + list_sum(list_transform(embedding[33:48], lambda x: x::double))*0.5 + list_sum(list_transform(embedding[49:64], lambda x: x::double))*3 total from embeddings", "total", places=5)
def p41(s, d):
    part = lambda k: f"transform(slice(embedding, {16 * k + 1}, 16), x -> cast(x as double))"
    w = V.table(s, d, "embeddings").selectExpr("vec_id id", f"{part(0)} proj", f"{part(1)} gx", f"{part(2)} gy", f"{part(3)} curv")
    f = C.window_features(w, (2.0, 1.0, 0.5, 3.0))
    return f.select("id", F.size("features").cast("long").alias("n"), F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("g10_resample_sdf", "with s as materialized (select ((cast(mesh_id as bigint)*12+i)*12+j)*12+k cell, mesh_id, i, j, k, val from sdf), q as materialized (select mesh_id, i, j, k, ((cast(mesh_id as bigint)*12+cast(least(greatest(floor(-(j-5.5)+5.5+1+0.5), 0), 11) as bigint))*12+cast(least(greatest(floor((i-5.5)+5.5+0.5), 0), 11) as bigint))*12+cast(least(greatest(floor((k-5.5)+5.5-2+0.5), 0), 11) as bigint) cell from s) select q.mesh_id, q.i, q.j, q.k, s.val from q join s using (cell)", "val")
def g10(s, d):
    return C.resample_sdf(V.sdf(s, d), _ROT, [1.0, 0.0, -2.0], 12)


@query("g11_surface_window", f"""with c as (select *, cast(grasp_id % 10 as int) mesh_id, px*4+6 qx, py*4+6 qy, pz*4+6 qz from ({_FRAME2})), q as (select grasp_id, side, mesh_id, cast(a as int) wi, cast(b as int) wj, """
    + ", ".join(f"q{x}+t1{x}*(a-2)*0.75+t2{x}*(b-2)*0.75 {x}" for x in "xyz")
    + """ from c, range(5) t(a), range(5) u(b)), v as (select q.*, coalesce((select sum(val*(1-abs(q.x-s.i))*(1-abs(q.y-s.j))*(1-abs(q.z-s.k))) from sdf s where s.mesh_id = q.mesh_id and s.i between floor(q.x) and floor(q.x)+1 and s.j between floor(q.y) and floor(q.y)+1 and s.k between floor(q.z) and floor(q.z)+1), 0) val from q)
 select grasp_id, side, wi, wj, case when x < 0 or y < 0 or z < 0 or x >= 12 or y >= 12 or z >= 12 then -0.01 else val end val from v where mesh_id in (select mesh_id from sdf)""", "val")  # fmt: skip
def g11(s, d):
    c = V.contacts(s, d).withColumn("mesh_id", (F.col("grasp_id") % 10).cast("int"))
    c = c.select("grasp_id", "side", "mesh_id", *[(F.col(f"p{x}") * 4 + 6).alias(f"p{x}") for x in "xyz"], *[f"{a}{x}" for a in "nd" for x in "xyz"])
    return C.surface_window(c, V.sdf(s, d), 3.0, 5)


_VOL = "(x1*(y2*z3-z2*y3)+y1*(z2*x3-x2*z3)+z1*(x2*y3-y2*x3))/6"


@query("a50_piece_inertia", f"with p as (select mesh_id, cast(fid % 3 as bigint) piece, abs(sum({_VOL})) v from corners group by 1, 2), w as (select mesh_id, abs(sum({_VOL})) v from corners group by 1) select p.mesh_id, piece, p.v*1.5*w.v/sum(p.v) over (partition by p.mesh_id) mass from p join w using (mesh_id)", "mass", places=3)
def a50(s, d):
    c = M.face_corners(V.vertices(s, d), V.faces(s, d))
    return C.piece_inertia(c.withColumn("piece", F.col("fid") % 3), c, 1.5)


@query("t08_choose", f"select arm from (select * from ({_BETA}) order by {U.format("'4:' || arm")} desc, arm limit 1) union all select arm from (select * from ({_BETA}) order by mean desc, arm limit 1)")
def t08(s, d):
    b = L.beta_posterior(V.rewards(s, d))
    return C.choose(b, "uniform", 4).union(C.choose(b, "greedy", 4))


@query("t08_thompson", f"with recursive {beta_quantile_sql('select arm, ' + U.format("'4:' || arm") + ' p, 1+sum(v) a, 1+count(*)-sum(v) b from rewards group by arm', 'arm')} select arm from quantiles order by q desc, arm limit 1")
def t08b(s, d):
    return C.choose(L.beta_posterior(V.rewards(s, d)), "thompson", 4)


@query("a47_logistic", "with e as (select l_tax a, l_discount b, 1/(1+exp(-(0.5*l_tax-0.25*l_discount))) p, cast(l_returnflag = 'R' as double) y from lineitem) select 0 i, 0 j, sum(a*a*p*(1-p)) s from e union all select 0, 1, sum(a*b*p*(1-p)) from e union all select 1, 0, sum(a*b*p*(1-p)) from e union all select 1, 1, sum(b*b*p*(1-p)) from e union all select 0, -1, sum(a*(y-p))+1.0 from e union all select 1, -1, sum(b*(y-p))-0.5 from e", "s", places=5)
def a47b(s, d):
    t = V.table(s, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("double"))
    return C.logistic_terms(t, ["l_tax", "l_discount"], "y", [0.5, -0.25])


@query("x03_generate", "select cloud_id, count(*) n from (with r as (select *, row_number() over (partition by cloud_id order by point_id) - 1 pos, count(*) over (partition by cloud_id) n from points), c as (select cloud_id, any_value(n) n from r group by 1), dr as (select cloud_id, slot, floor(" + U.format("'8:' || cloud_id || ':' || slot || ':1'") + "*n) a1, floor(" + U.format("'8:' || cloud_id || ':' || slot || ':2'") + "*n) a2 from c, range(30) s(slot)) select dr.cloud_id, sqrt((q.x-p.x)**2+(q.y-p.y)**2+(q.z-p.z)**2) width from dr join r p on p.cloud_id = dr.cloud_id and p.pos = a1 join r q on q.cloud_id = dr.cloud_id and q.pos = a2) where width > 0.05 and width < 0.3 group by 1")
def x03(s, d):
    return C.generate("uniform", surface=V.points(s, d), n=30, seed=8, least=0.05, most=0.3).groupBy("cloud_id").agg(F.count("*").alias("n"))


def _basis() -> str:
    """SQL of the rotation of each face's pose, by the closed form of the axis of a 2 x 2 covariance."""
    form = lambda p, q: "+".join(f"{p}{a}*s{min(a, b)}{max(a, b)}*{q}{b}" for a in "xyz" for b in "xyz")
    cross = lambda p, q, out: ", ".join(f"{p}{a}*{q}{b}-{p}{b}*{q}{a} {out}{c}" for a, b, c in ("yzx", "zxy", "xyz"))
    cov = ", ".join(f"covar_pop({a}, {b}) s{a}{b}" for a, b in ("xx", "yy", "zz", "xy", "xz", "yz"))
    return f"""with mid as (select mesh_id, avg(x) mx, avg(y) my, avg(z) mz, {cov} from vertices group by 1),
n as (select *, sqrt(nx*nx+ny*ny+nz*nz) nl from (select c.*, (y2-y1)*(z3-z1)-(z2-z1)*(y3-y1) nx, (z2-z1)*(x3-x1)-(x2-x1)*(z3-z1) ny, (x2-x1)*(y3-y1)-(y2-y1)*(x3-x1) nz from corners c) where nx <> 0 or ny <> 0 or nz <> 0),
z as (select n.mesh_id, fid, mid.* exclude (mesh_id), {", ".join(f"n{c}/nl*(case when nx*(mx-x1)+ny*(my-y1)+nz*(mz-z1) < 0 then -1 else 1 end) r2{c}" for c in "xyz")} from n join mid on mid.mesh_id = n.mesh_id),
e as (select *, case when abs(r2x) > 0.9 then r2y else r2x end d, case when abs(r2x) > 0.9 then 0 else 1 end ex, case when abs(r2x) > 0.9 then 1 else 0 end ey from z),
u as (select * exclude (ux, uy, uz), ux/l ux, uy/l uy, uz/l uz from (select *, sqrt(ux*ux+uy*uy+uz*uz) l from (select *, ex-d*r2x ux, ey-d*r2y uy, -d*r2z uz from e))),
v as (select *, {cross("r2", "u", "v")} from u),
t as (select *, atan2(2*b, a-c)/2 t from (select *, {form("u", "u")} a, {form("u", "v")} b, {form("v", "v")} c from v)),
x as (select *, {", ".join(f"cos(t)*u{c}+sin(t)*v{c} r0{c}" for c in "xyz")} from t)
select mesh_id, fid, {", ".join(f"r0{c}" for c in "xyz")}, {cross("r2", "r0", "r1")}, {", ".join(f"r2{c}" for c in "xyz")} from x"""


@query("a20_face_basis", _basis(), " ".join(f"r{k}{c}" for k in range(3) for c in "xyz"))
def a20(s, d):
    v = V.vertices(s, d)
    return C.face_basis(M.face_corners(v, V.faces(s, d)), v)


@query("g06_perturb_objects", "select mesh_id, copy_, greatest(1+0.1*(sqrt(-2*ln(1-" + U.format("'7:' || mesh_id || ':' || copy_ || ':s:u'") + "))*cos(2*pi()*" + U.format("'7:' || mesh_id || ':' || copy_ || ':s:v'") + ")), 0.01) scale from (select distinct mesh_id from vertices), range(10) t(copy_)", "scale")
def g06(s, d):
    m = V.vertices(s, d).select("mesh_id").distinct()
    return C.perturb_objects(m, 10, 7, 0.01, 0.1).select("mesh_id", F.col("copy").cast("long").alias("copy_"), "scale")


@query("g14_candidates", """with f as (select grasp_id, bool_or(bx > 0 and bx < 0.125 and bz < 0.01125 and abs(b_y) > 0.0835 and abs(b_y) < 0.109) or bool_or(bx > -0.0225 and bx < 0 and abs(b_y) < 0.109 and bz < 0.01125) hit from (select grasp_id, (x-cx)*apx+(y-cy)*apy+(z-cz)*apz bx, (x-cx)*yx+(y-cy)*yy+(z-cz)*yz b_y, abs((x-cx)*mx+(y-cy)*my+(z-cz)*mz) bz from gpose join points using (cloud_id)) group by 1)
 select grasp_id, pose_id, p, not hit free from gpose g join (select cast(n_nationkey as varchar) cloud_id, cast(k as bigint) pose_id, 0.1+0.2*k p from nation, range(4) t(k)) q using (cloud_id) join f using (grasp_id) where p > 0.2 and least(acos(greatest(least(apz, 1), -1)), pi()-acos(greatest(least(apz, 1), -1))) <= radians(50)""", "p")  # fmt: skip
def g14(s, d):
    poses = V.table(s, d, "nation").selectExpr("cast(n_nationkey as string) cloud_id", "explode(sequence(0, 3)) k").selectExpr("cloud_id", "cast(k as long) pose_id", "0.1D + 0.2D * k p")
    return C.candidates(V.grasps(s, d), poses, 0.2, 50.0, V.points(s, d))


@query("g10_resample_detailed", f"with q as materialized (select mesh_id, (i*12+j)*12+k query_id, -0.6018150231520483*(j-5.5)+0.7986355100472928*(i-5.5)+5.5+0.4137 x, 0.6018150231520483*(i-5.5)+0.7986355100472928*(j-5.5)+5.5-1.2911 y, (k-5.5)+5.5+0.2303 z from sdf) select mesh_id, cast(query_id // 144 as int) i, cast(query_id // 12 % 12 as int) j, cast(query_id % 12 as int) k, val from ({SIGNED})", "val", places=5)
def g10b(s, d):
    return C.resample_sdf_detailed(V.sdf(s, d), [0.7986355100472928, -0.6018150231520483, 0.0, 0.6018150231520483, 0.7986355100472928, 0.0, 0.0, 0.0, 1.0], [0.4137, -1.2911, 0.2303], 12)


@query("g12_projection_window", f"""with b as (select cloud_id, {", ".join(f"min({c}) l{c}, max({c}) h{c}" for c in "xyz")} from points group by 1), r as (select grasp_id, side, cast(wi as int) wi, cast(wj as int) wj, {", ".join(f"p{c}+t1{c}*((wi+0.5)*0.05-0.1)+t2{c}*((wj+0.5)*0.05-0.1)-0.1*d{c} o{c}, d{c}, l{c}, h{c}" for c in "xyz")} from ({_FRAME2}) f join (select grasp_id, cloud_id from grasps) using (grasp_id) join b using (cloud_id), range(4) i(wi), range(4) j(wj)),
 t as (select *, greatest({", ".join(f"least((l{c}-o{c})/d{c}, (h{c}-o{c})/d{c})" for c in "xyz")}) near, least({", ".join(f"greatest((l{c}-o{c})/d{c}, (h{c}-o{c})/d{c})" for c in "xyz")}) far from r), u as (select *, case when near <= far then case when near > 0 then near when far > 0 then far end end t from t)
 select grasp_id, side, wi, wj, case when t is null or t > 0.9 then 0.2 else least(t-0.1, 0.8) end val from u""", "val")  # fmt: skip
def g12(s, d):
    """Contacts before the bounding box of their cloud."""
    v, f = M.box_mesh(V.points(s, d).select(F.col("cloud_id").alias("mesh_id"), F.col("point_id").alias("vid"), "x", "y", "z"))
    c = V.contacts(s, d).join(V.grasps(s, d).select("grasp_id", F.col("cloud_id").alias("mesh_id")), "grasp_id")
    return C.projection_window(c, M.face_corners(v, f), 0.2, 4, 0.8, 0.1)


@query("g03_antipodal")
def g03(s, d):
    return C.antipodal_grasps(V.sdf(s, d), 2, 5, 0.5, 11.0, 1.0)


_OCC = "occ as materialized (select frame_id, v, u from depth where d > 500), p as (select o.frame_id, o.v, o.u, " + ", ".join(f"{n}.v is not null {n}" for n in ("up", "le", "di", "do_", "ri", "dd")) + " from occ o " + " ".join(f"left join occ {n} on {n}.frame_id = o.frame_id and {n}.v = o.v{a} and {n}.u = o.u{b}" for n, a, b in (("up", "-1", ""), ("le", "", "-1"), ("di", "-1", "-1"), ("do_", "+1", ""), ("ri", "", "+1"), ("dd", "+1", "+1"))) + ")"
_TRI = "select distinct frame_id, unnest([(v, u), {b}, {c}]) p, unnest([{b}, {c}, (v, u)]) q, (v, u, {n}) t from p where {w}"


@query("g07_image_to_mesh", f"with {_OCC}, e as (" + " union all ".join(_TRI.format(b=b, c=c, n=n, w=w) for n, (b, c, w) in enumerate((("(v-1, u)", "(v, u-1)", "up and le"), ("(v-1, u-1)", "(v, u-1)", "not up and le and di and v > 1 and u > 1"), ("(v+1, u)", "(v, u+1)", "do_ and ri"), ("(v+1, u+1)", "(v, u+1)", "not do_ and ri and dd"))))
    + "), s as (select frame_id, list_sort([t_a, t_b, t_c]) k from (select frame_id, t, list(p)[1] t_a, list(p)[2] t_b, list(p)[3] t_c from e group by 1, 2)), w as (select frame_id, count(*) n from (select frame_id, least(p, q), greatest(p, q) from e group by 1, 2, 3 having count(*) = 1) group by 1), f as (select frame_id, count(*) n from s group by 1) select frame_id mesh_id, cast(f.n*2 + w.n*2 as bigint) n from f join w using (frame_id)")
def g07(s, d):
    """Pixels further than half a unit; faces of each mesh."""
    _, f = C.image_to_mesh(V.depth(s, d).where("d > 500").select("frame_id", "v", "u"))
    return f.groupBy("mesh_id").agg(F.count("*").alias("n"))
