"""Queries on depth images, meshes and signed-distance grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import depth as D
from ..operators import mesh as M
from ..operators import rays
from ..operators import sdf as S
from . import query
from . import views as V
from .clouds import U

_H = "[0.8,-0.6,0.0,0.1,0.6,0.8,0.0,-0.2,0.0,0.0,1.0,0.3]"
_BACK = "select frame_id, v, u, 0.8*x-0.6*y+0.1 x, 0.6*x+0.8*y-0.2 y, z+0.3 z from (select frame_id, v, u, (u-32.0::double)*z/70.0::double x, (v-25.0::double)*z/70.0::double y, z from (select *, d*10.0::double*1e-4::double z from depth where d > 0))"


@query("p06_scale_mask_depth", "select frame_id, v, u, case when (u + v) % 5 = 0 then 0 else d end d, (case when (u + v) % 5 = 0 then 0 else d end)*2.0*1e-4 depth from depth", "depth")
def p06(s, d):
    x = V.depth(s, d)
    return D.scale_depth(D.mask_depth(x, x.where("(u + v) % 5 = 0")), 2.0)


@query("p07_depth_to_points", _BACK, "x y z")
def p07(s, d):
    return D.depth_to_points(V.depth(s, d), V.calib(s, d))


@query("p08_compose_calibration", "select frame_id, 0.8*0.8-0.6*0.6 h00, 0.8*0.1+0.6*0.2+0.1 h03, -(0.8*0.1+0.6*-0.2) i03, -(-0.6*0.1+0.8*-0.2) i13 from calib", "h00 h03 i03 i13")
def p08(s, d):
    return D.compose_calibration(V.calib(s, d)).select("frame_id", F.get("hh", F.lit(0)).alias("h00"), F.get("hh", F.lit(3)).alias("h03"), F.get("hi", F.lit(3)).alias("i03"), F.get("hi", F.lit(7)).alias("i13"))


@query("p09_transform_points", "select cloud_id, point_id, 0.8*x-0.6*y+0.1 x, 0.6*x+0.8*y-0.2 y, z+0.3 z from points", "x y z")
def p09(s, d):
    t = V.calib(s, d).selectExpr("cast(frame_id as string) cloud_id", "h")
    return D.transform_points(V.points(s, d).select("cloud_id", "point_id", "x", "y", "z"), t, "cloud_id")


@query("a01_register_depth", f"select frame_id, pv, pu, max(z) z from (select frame_id, cast(trunc(70*x/z+32+0.5) as int) pu, cast(trunc(70*y/z+25+0.5) as int) pv, z from ({_BACK}) where z > 0) where pu >= 0 and pu < 64 and pv >= 0 and pv < 50 group by 1, 2, 3", "z")
def a01(s, d):
    return D.register_depth(V.depth(s, d), V.calib(s, d), 50, 64)


@query("w01_filter_discontinuities", "with w as (select a.frame_id, a.v, a.u, any_value(a.d) d, min(b.d) lo, max(b.d) hi from depth a join depth b on a.frame_id = b.frame_id and b.v between a.v-3 and a.v+3 and b.u between a.u-3 and a.u+3 group by 1, 2, 3), m as (select frame_id, max(v) mv from depth group by 1) select frame_id, v, u, case when u >= 3 and v >= 3 and u <= 60 and v <= mv-3 and greatest(abs(lo-d), abs(hi-d)) > 300 then 0 else d end d from w join m using (frame_id)")
def w01(s, d):
    return D.filter_discontinuities(V.depth(s, d), 7, 300)


def _corners(s, d):
    return M.face_corners(V.vertices(s, d), V.faces(s, d))


_C = "x1, y1, z1, x2, y2, z2, x3, y3, z3"
_NORMAL = "(y2-y1)*(z3-z1)-(z2-z1)*(y3-y1) nx, (z2-z1)*(x3-x1)-(x2-x1)*(z3-z1) ny, (x2-x1)*(y3-y1)-(y2-y1)*(x3-x1) nz"
_VOL = "(x1*(y2*z3-z2*y3)+y1*(z2*x3-x2*z3)+z1*(x2*y3-y2*x3))/6"


@query("j10_face_corners", f"select mesh_id, fid, a, b, c, {_C} from corners", "x1 y1 z1 x2 y2 z2 x3 y3 z3")
def j10(s, d):
    return _corners(s, d)


@query("a09_mesh_bounds", "select mesh_id, min(x) lo_x, min(y) lo_y, min(z) lo_z, max(x) hi_x, max(y) hi_y, max(z) hi_z, avg(x) mean_x, avg(y) mean_y, avg(z) mean_z from vertices group by 1", "lo_x lo_y lo_z hi_x hi_y hi_z mean_x mean_y mean_z")
def a09(s, d):
    return M.mesh_bounds(V.vertices(s, d))


@query("a10_face_areas", f"select mesh_id, fid, area, area / sum(area) over (partition by mesh_id) share from (select mesh_id, fid, sqrt(nx*nx+ny*ny+nz*nz)/2 area from (select *, {_NORMAL} from corners))", "area share")
def a10(s, d):
    return M.face_areas(_corners(s, d))


@query("a11_mesh_volume", f"select mesh_id, abs(sum({_VOL})) volume, abs(sum({_VOL}))*1.3713 mass from corners group by 1", "volume mass", places=7)
def a11(s, d):
    return M.mesh_volume(_corners(s, d), 1.3713)


_COM = f"select mesh_id, sum(vol*(x1+x2+x3)/4)/sum(vol) com_x, sum(vol*(y1+y2+y3)/4)/sum(vol) com_y, sum(vol*(z1+z2+z3)/4)/sum(vol) com_z from (select *, {_VOL} vol from corners) group by 1"


@query("a13_mesh_com", _COM, "com_x com_y com_z", places=4)
def a13(s, d):
    return M.mesh_com(_corners(s, d))


_MOVED = ", ".join(f"{c}{n}-com_{c} {c}{n}" for n in (1, 2, 3) for c in "xyz")


def _cov(p: str, q: str) -> str:
    same = "+".join(f"{p}{n}*{q}{n}" for n in (1, 2, 3))
    mixed = "+".join(f"{p}{n}*{q}{m}" for n in (1, 2, 3) for m in (1, 2, 3) if n != m)
    return f"sum(6*{_VOL}*(({same})/60+({mixed})/120)) c{p}{q}"


@query("a12_mesh_inertia", f"select *, cyy+czz ixx, cxx+czz iyy, cxx+cyy izz, -cxy ixy, -cxz ixz, -cyz iyz from (select mesh_id, {', '.join(_cov(*pq) for pq in ('xx', 'yy', 'zz', 'xy', 'xz', 'yz'))} from (select mesh_id, {_MOVED} from corners join ({_COM}) using (mesh_id)) group by 1)", "cxx cyy czz cxy cxz cyz ixx iyy izz ixy ixz iyz", places=-1)
def a12(s, d):
    return M.mesh_inertia(_corners(s, d))


@query("a14_vertex_normals", f"""with f as (select *, {_NORMAL}, {_VOL} vol from corners), sg as (select mesh_id, case when sum(vol) < 0 then -1.0 else 1.0 end sg from f group by 1),
 w as (select mesh_id, nx, ny, nz, unnest([{{vid: a, w: acos(greatest(least(((x2-x1)*(x3-x1)+(y2-y1)*(y3-y1)+(z2-z1)*(z3-z1))/(sqrt((x2-x1)**2+(y2-y1)**2+(z2-z1)**2)*sqrt((x3-x1)**2+(y3-y1)**2+(z3-z1)**2)), 1), -1))}},
  {{vid: b, w: acos(greatest(least(((x3-x2)*(x1-x2)+(y3-y2)*(y1-y2)+(z3-z2)*(z1-z2))/(sqrt((x3-x2)**2+(y3-y2)**2+(z3-z2)**2)*sqrt((x1-x2)**2+(y1-y2)**2+(z1-z2)**2)), 1), -1))}},
  {{vid: c, w: acos(greatest(least(((x1-x3)*(x2-x3)+(y1-y3)*(y2-y3)+(z1-z3)*(z2-z3))/(sqrt((x1-x3)**2+(y1-y3)**2+(z1-z3)**2)*sqrt((x2-x3)**2+(y2-y3)**2+(z2-z3)**2)), 1), -1))}}], recursive := true) from f)
 select mesh_id, vid, sx/l*sg nx, sy/l*sg ny, sz/l*sg nz from (select *, sqrt(sx*sx+sy*sy+sz*sz) l from (select mesh_id, vid, sum(nx/2*w) sx, sum(ny/2*w) sy, sum(nz/2*w) sz from w group by 1, 2)) join sg using (mesh_id)""", "nx ny nz")  # fmt: skip
def a14(s, d):
    return M.vertex_normals(_corners(s, d))


def _directions(s):
    return s.createDataFrame([(0, 1.0, 0.0, 0.0), (1, 0.0, 1.0, 0.0), (2, 0.0, 0.0, 1.0), (3, -1.0, 0.0, 0.5), (4, 0.3, -0.7, 2.0)], "dir_id int, dx double, dy double, dz double")


_DIRS = "(values (0,1.0,0.0,0.0),(1,0.0,1.0,0.0),(2,0.0,0.0,1.0),(3,-1.0,0.0,0.5),(4,0.3,-0.7,2.0)) t(dir_id, dx, dy, dz)"


@query("a15_support", f"select mesh_id, dir_id, vid, h from (select mesh_id, dir_id, vid, round(x*dx+y*dy+z*dz, 9) h from vertices, {_DIRS}) qualify row_number() over (partition by mesh_id, dir_id order by h desc, vid) = 1", "h")
def a15(s, d):
    return M.support(V.vertices(s, d), _directions(s))


@query("a16_extreme_points", f"select distinct mesh_id, vid from (select mesh_id, dir_id, vid, round(x*dx+y*dy+z*dz, 9) h from vertices, {_DIRS} qualify row_number() over (partition by mesh_id, dir_id order by h desc, vid) = 1)")
def a16(s, d):
    return M.extreme_points(V.vertices(s, d), _directions(s))


@query("a17_is_watertight", "select mesh_id, bool_and(n = 2) watertight from (select mesh_id, least(p, q) lo, greatest(p, q) hi, count(*) n from (select mesh_id, unnest([a, b, c]) p, unnest([b, c, a]) q from faces) group by 1, 2, 3) group by 1")
def a17(s, d):
    return M.is_watertight(V.faces(s, d))


_SPLIT = "select * from faces where fid // 2 % 64 not in (9, 30, 31)"


@query("a18_components", """with recursive f as materialized (select mesh_id, fid, a, b, c from faces where fid // 2 % 64 not in (9, 30, 31)),
 s as materialized (select mesh_id, fid, least(p, q) p, greatest(p, q) q from (select mesh_id, fid, unnest([a, b, c]) p, unnest([b, c, a]) q from f)),
 e as materialized (select distinct s.mesh_id, s.fid x, t.fid y from s join s t using (mesh_id, p, q) where s.fid <> t.fid),
 l(mesh_id, fid, label) using key (mesh_id, fid) as (select mesh_id, fid, fid from f union
  select e.mesh_id, e.y, min(l.label) from l join e on e.mesh_id = l.mesh_id and e.x = l.fid join recurring.l k on k.mesh_id = e.mesh_id and k.fid = e.y where l.label < k.label group by 1, 2)
 select mesh_id, fid, label from l""")  # fmt: skip
def a18(s, d):
    """The height field with two strips cut out, which leaves three pieces."""
    return M.components(V.faces(s, d).where("floor(fid / 2) % 64 not in (9, 30, 31)"))


@query("p35_center_mesh", "select mesh_id, vid, x-avg(x) over w x, y-avg(y) over w y, z-avg(z) over w z from vertices window w as (partition by mesh_id)", "x y z")
def p35(s, d):
    return M.center_mesh(V.vertices(s, d))


@query("p35_rescale_mesh", "select mesh_id, vid, x*k x, y*k y, z*k z from vertices join (select mesh_id, 0.3737/list_sort([max(x)-min(x), max(y)-min(y), max(z)-min(z)])[2] k from vertices group by 1) using (mesh_id)", "x y z")
def p35b(s, d):
    return M.rescale_mesh(V.vertices(s, d), 0.3737, "median")


@query("p36_flip_faces", "select mesh_id, fid, a, c b, b c from faces")
def p36(s, d):
    return M.flip_faces(V.faces(s, d))


@query("p37_drop_bad_faces", "select f.mesh_id, fid, a, b, c from (select mesh_id, fid, a, b, case when fid % 10 = 0 then c + 100000 when fid % 7 = 0 then a else c end c from faces) f join (select mesh_id, count(*) n from vertices group by 1) using (mesh_id) where least(a, b, c) >= 0 and greatest(a, b, c) < n and a <> b and b <> c and a <> c")
def p37(s, d):
    f = V.faces(s, d).withColumn("c", F.expr("case when fid % 10 = 0 then c + 100000 when fid % 7 = 0 then a else c end"))
    return M.drop_bad_faces(f, V.vertices(s, d), True)


@query("p40_rest_on_table", "select mesh_id, vid, x, y, z - min(z) over (partition by mesh_id) + 0.01 z from vertices", "x y z")
def p40(s, d):
    return M.rest_on_table(V.vertices(s, d), 0.01)


@query("j12_compact_vertices", "with f as (select mesh_id, fid, a, b, c from corners where z1 > 0 and z2 > 0 and z3 > 0), n as (select mesh_id, vid, row_number() over (partition by mesh_id order by vid) - 1 k from (select distinct mesh_id, unnest([a, b, c]) vid from f)) select f.mesh_id, fid, p.k a, q.k b, r.k c from f join n p on p.mesh_id = f.mesh_id and p.vid = a join n q on q.mesh_id = f.mesh_id and q.vid = b join n r on r.mesh_id = f.mesh_id and r.vid = f.c")
def j12(s, d):
    """Faces with a depth at each corner."""
    return M.compact_vertices(V.vertices(s, d), _corners(s, d).where("z1 > 0 and z2 > 0 and z3 > 0").select("mesh_id", "fid", "a", "b", "c"))[1]


@query("j15_closest_hit", f"""with r as (select mesh_id, k ray_id, 5.3171+k*6.1093 ox, 3.2293+k*4.0517 oy from (select distinct mesh_id from vertices), range(8) t(k)), c as (select *, {_NORMAL} from corners),
 h as (select r.mesh_id, ray_id, fid, 50.0 - (z1 - (nx*(ox-x1)+ny*(oy-y1))/nz) t, ((ox-x1)*(y3-y1)-(oy-y1)*(x3-x1))/nz bu, ((x2-x1)*(oy-y1)-(y2-y1)*(ox-x1))/nz bv from r join c on c.mesh_id = r.mesh_id where abs(nz) > 1e-12)
 select mesh_id, ray_id, t, fid from h where bu >= 0 and bv >= 0 and bu + bv <= 1 and t > 0 and t <= 100 qualify row_number() over (partition by mesh_id, ray_id order by t, fid) = 1""", "t", places=8)  # fmt: skip
def j15(s, d):
    r = V.vertices(s, d).select("mesh_id").distinct().withColumn("ray_id", F.explode(F.sequence(F.lit(0), F.lit(7))))
    r = r.selectExpr("mesh_id", "cast(ray_id as long) ray_id", "5.3171D + ray_id * 6.1093D ox", "3.2293D + ray_id * 4.0517D oy", "50D oz", "0D dx", "0D dy", "-1D dz")
    return rays.closest_hits(r, _corners(s, d), 100.0)


@query("u01_merge_meshes", "with v as (select mesh_id, max(vid) + 1 n from vertices group by 1), m as (select mesh_id, max(fid) + 1 m from faces group by 1) select mesh_id, fid, a, b, c from faces union all select f.mesh_id, fid + m, a + n, b + n, c + n from faces f join v using (mesh_id) join m using (mesh_id)")
def u01(s, d):
    v, f = V.vertices(s, d), V.faces(s, d)
    return M.merge_meshes((v, f), (v, f))[1]


@query("g08_subdivide", "select mesh_id, count(*) n, sum(sqrt((x2-x1)**2+(y2-y1)**2+(z2-z1)**2)+sqrt((x3-x2)**2+(y3-y2)**2+(z3-z2)**2)+sqrt((x3-x1)**2+(y3-y1)**2+(z3-z1)**2))*2 around from corners, range(1) group by 1".replace("count(*) n", "count(*)*4 n"), "around", places=4)
def g08(s, d):
    side = lambda i, j: F.sqrt(sum(((F.col(f"{c}{i}") - F.col(f"{c}{j}")) ** 2 for c in "yz"), (F.col(f"x{i}") - F.col(f"x{j}")) ** 2))
    return M.subdivide(_corners(s, d)).groupBy("mesh_id").agg(F.count("*").alias("n"), F.sum(side(1, 2) + side(2, 3) + side(1, 3)).alias("around"))


@query("g09_box_mesh", "select mesh_id, (max(x)-min(x))*(max(y)-min(y))*(max(z)-min(z)) volume, true watertight from vertices group by 1", "volume", places=7)
def g09(s, d):
    v, f = M.box_mesh(V.vertices(s, d))
    return M.mesh_volume(M.face_corners(v, f)).select("mesh_id", "volume").join(M.is_watertight(f), "mesh_id")


@query("w12_sample_surface", f"""with a as (select *, sqrt(nx*nx+ny*ny+nz*nz)/2 area from (select *, {_NORMAL} from corners)), h as (select *, area/sum(area) over (partition by mesh_id) share from a),
 c as materialized (select *, lag(top, 1, 0) over (partition by mesh_id order by fid) low from (select *, sum(share) over (partition by mesh_id order by fid) top from h)),
 d as (select mesh_id, cast(slot as int) slot, {U.format("'4:' || mesh_id || ':' || slot")} u, sqrt({U.format("'4:' || mesh_id || ':' || slot || ':r'")}) r, {U.format("'4:' || mesh_id || ':' || slot || ':t'")} t from (select distinct mesh_id from corners), range(50) s(slot))
 select d.mesh_id, slot, fid, {", ".join(f"(1-r)*{c}1+r*(1-t)*{c}2+r*t*{c}3 {c}" for c in "xyz")} from d join c on c.mesh_id = d.mesh_id and u >= low and u < top""", "x y z")  # fmt: skip
def w12(s, d):
    return M.sample_surface(_corners(s, d), 50, 4)


@query("p31_surface_points", "select mesh_id, i, j, k from sdf where abs(val) < sqrt(2.0)/2")
def p31(s, d):
    return S.surface_points(V.sdf(s, d)).select("mesh_id", "i", "j", "k")


@query("j11_sdf_lookup", "with q as (select distinct mesh_id, q query_id, 1.3 + q*0.7 x, 2.1 + q*0.55 y, 3.7 + q*0.4 z from sdf, range(10) t(q)) select q.mesh_id, query_id, sum(val*(1-abs(x-i))*(1-abs(y-j))*(1-abs(z-k))) val from q join sdf s on s.mesh_id = q.mesh_id and i between floor(x) and floor(x)+1 and j between floor(y) and floor(y)+1 and k between floor(z) and floor(z)+1 group by 1, 2", "val")
def j11(s, d):
    q = V.sdf(s, d).select("mesh_id").distinct().withColumn("query_id", F.explode(F.sequence(F.lit(0), F.lit(9))))
    q = q.selectExpr("mesh_id", "cast(query_id as long) query_id", "1.3D + query_id * 0.7D x", "2.1D + query_id * 0.55D y", "3.7D + query_id * 0.4D z")
    return S.sdf_lookup(V.sdf(s, d), q)


_SIDE = "cast(floor({}*10) as bigint)+2"


@query("j17_grid", "select mesh_id, i, j, k, (i*ny+j)*nz+k id from (select vec_id mesh_id, " + ", ".join(f"{_SIDE.format(f'abs(cast(embedding[{n + 1}] as double))')} n{c}" for n, c in enumerate("xyz")) + " from embeddings), lateral (select unnest(range(nx)) i), lateral (select unnest(range(ny)) j), lateral (select unnest(range(nz)) k)")
def j17(s, d):
    """A grid for each embedding, of sides that its numbers tell."""
    sizes = V.table(s, d, "embeddings").selectExpr("vec_id mesh_id", *[f"{_SIDE.format(f'abs(cast(element_at(embedding, {n + 1}) as double))')} n{c}" for n, c in enumerate("xyz")])
    return S.grids(sizes)


_INSIDE = "select q.mesh_id, query_id, sum(val*(1-abs(x-i))*(1-abs(y-j))*(1-abs(z-k))) val from q join sdf s on s.mesh_id = q.mesh_id and i between floor(x) and floor(x)+1 and j between floor(y) and floor(y)+1 and k between floor(z) and floor(z)+1 where x >= 0 and y >= 0 and z >= 0 and x < 12 and y < 12 and z < 12 group by 1, 2"
_OUTSIDE = "select q.mesh_id, query_id, arg_min(r, (d, c)) val from (select q.mesh_id, query_id, sqrt((x-i)**2+(y-j)**2+(z-k)**2) d, (i*12+j)*12+k c, sqrt((x-i)**2+(y-j)**2+(z-k)**2)+val r from q join sdf s on s.mesh_id = q.mesh_id where abs(val) < sqrt(2.0)/2 and (x < 0 or y < 0 or z < 0 or x >= 12 or y >= 12 or z >= 12)) q group by 1, 2"
#: SQL of the signed distance at queries q (mesh_id, query_id, x, y, z).
SIGNED = f"{_INSIDE} union all {_OUTSIDE}"


@query("j11_signed_distance", f"with q as materialized (select cast(cloud_id as int) mesh_id, point_id query_id, x*14+6 x, y*14+6 y, z*14+6 z from points where cast(cloud_id as int) in (select mesh_id from sdf)) {SIGNED}", "val", places=5)
def j11b(s, d):
    """Each point as a place in its label's grid; many are outside."""
    q = V.points(s, d).selectExpr("cast(cloud_id as int) mesh_id", "point_id query_id", "x*14+6 x", "y*14+6 y", "z*14+6 z")
    return S.signed_distance(V.sdf(s, d).withColumn("mesh_id", F.col("mesh_id").cast("int")), q)


_GRAD = ", ".join(f"(coalesce(lead(val) over w{c}, val) - coalesce(lag(val) over w{c}, val)) / (case when lead(val) over w{c} is null or lag(val) over w{c} is null then 1 else 2 end) g{c}" for c in "ijk")
_WINDOWS = "window " + ", ".join(f"w{c} as (partition by mesh_id, {', '.join(x for x in 'ijk' if x != c)} order by {c})" for c in "ijk")


@query("w08_grid_gradient", f"select mesh_id, i, j, k, {_GRAD} from sdf {_WINDOWS}", "gi gj gk")
def w08(s, d):
    return S.grid_gradient(V.sdf(s, d)).select("mesh_id", "i", "j", "k", "gi", "gj", "gk")


@query("w08_grid_curvature", f"with g as materialized (select mesh_id, i, j, k, {_GRAD} from sdf {_WINDOWS}), c as (select mesh_id, i, j, k, " + ", ".join(f"(lead(g{b}) over w{a} - lag(g{b}) over w{a})/4 c{a}{b}" for a in "ijk" for b in "ijk") + f" from g {_WINDOWS}), h as (select mesh_id, i, j, k, 2*cii hxx, 2*cjj hyy, 2*ckk hzz, cij+cji hxy, cik+cki hxz, cjk+ckj hyz from c where cii is not null and cjj is not null and ckk is not null) select *, hxx*(hyy*hzz-hyz*hyz) - hxy*(hxy*hzz-hyz*hxz) + hxz*(hxy*hyz-hyy*hxz) det from h", "hxx hyy hzz hxy hxz hyz det")
def w08b(s, d):
    return S.grid_curvature(V.sdf(s, d))


@query("g08_subdivide_until", "with m as (select mesh_id, count(*) n, max(greatest(sqrt((x2-x1)**2+(y2-y1)**2+(z2-z1)**2), sqrt((x3-x2)**2+(y3-y2)**2+(z3-z2)**2), sqrt((x3-x1)**2+(y3-y1)**2+(z3-z1)**2))) l from corners group by 1) select mesh_id, cast(n*4**greatest(ceil(log2(l/0.8)), 0) as bigint) n, l/2**greatest(ceil(log2(l/0.8)), 0) longest from m", "longest")
def g08b(s, d):
    c = M.subdivide_until(_corners(s, d), 0.8)
    return c.groupBy("mesh_id").agg(F.count("*").alias("n")).join(M.longest_edges(c), "mesh_id")


@query("p30_to_grid", "select mesh_id, cid, gx, gy, gz, gx < 0 or gy < 0 or gz < 0 or gx >= 12 or gy >= 12 or gz >= 12 outside from (select cast(cloud_id as int) mesh_id, point_id cid, (x+0.6)/0.1 gx, (y+0.6)/0.1 gy, (z+0.6)/0.1 gz from points)", "gx gy gz")
def p30(s, d):
    p = V.points(s, d).selectExpr("cast(cloud_id as int) mesh_id", "point_id cid", "x", "y", "z")
    return S.to_grid(p, (-0.6, -0.6, -0.6), 0.1, 12)
