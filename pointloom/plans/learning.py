"""Queries on contacts, evaluation and arms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.beta import beta_quantile_sql
from ..functions.eigen import SWEEPS_6, jacobi_sql
from ..operators import learn as L
from ..operators import quality as Q
from . import query
from . import views as V
from .clouds import U

_FRAME = "select *, case when abs(abs(dx)-1) < 1e-9 then 0 else (1-dx*dx)/sqrt(1-dx*dx) end t1x, case when abs(abs(dx)-1) < 1e-9 then 1 else -dx*dy/sqrt(1-dx*dx) end t1y, case when abs(abs(dx)-1) < 1e-9 then 0 else -dx*dz/sqrt(1-dx*dx) end t1z from contacts"
_FRAME2 = f"select *, dy*t1z-dz*t1y t2x, dz*t1x-dx*t1z t2y, dx*t1y-dy*t1x t2z from ({_FRAME})"
_CONE = f"select grasp_id, side, cast(k as int) edge, " + ", ".join(f"d{c}+0.5*cos(k*2*pi()/8)*t1{c}+0.5*sin(k*2*pi()/8)*t2{c} f{c}" for c in "xyz") + f", sqrt((dx+nx*a)**2+(dy+ny*a)**2+(dz+nz*a)**2) <= 0.5*a valid from (select *, -(dx*nx+dy*ny+dz*nz) a from ({_FRAME2})), range(8) e(k)"
_WRENCH = f"select grasp_id, side, edge, fx, fy, fz, ry*fz-rz*fy tx, rz*fx-rx*fz ty, rx*fy-ry*fx tz from (select k.grasp_id, k.side, edge, fx*w fx, fy*w fy, fz*w fz, px-cx rx, py-cy ry, pz-cz rz from ({_CONE}) k join (select c.*, greatest(-(dx*nx+dy*ny+dz*nz), 0) w, cx, cy, cz from contacts c join grasps using (grasp_id)) c on c.grasp_id = k.grasp_id and c.side = k.side)"


def _com(s, d):
    return V.grasps(s, d).select("grasp_id", *[F.col(f"c{c}").alias(f"com_{c}") for c in "xyz"])


def _wrenches(s, d):
    c = V.contacts(s, d)
    return Q.wrenches(c, Q.friction_cone(c, 0.5, 8), _com(s, d))


@query("p28_contact_frame", f"select grasp_id, side, t1x, t1y, t1z, t2x, t2y, t2z from ({_FRAME2})", "t1x t1y t1z t2x t2y t2z")
def p28(s, d):
    return Q.contact_frame(V.contacts(s, d)).select("grasp_id", "side", *[f"t{n}{c}" for n in (1, 2) for c in "xyz"])


@query("p27_friction_cone", _CONE, "fx fy fz")
def p27(s, d):
    return Q.friction_cone(V.contacts(s, d), 0.5, 8)


@query("p29_wrenches", _WRENCH, "fx fy fz tx ty tz")
def p29(s, d):
    return _wrenches(s, d)


_ANGLE = "acos(greatest(least(abs((p1.n{c}x*lx+p1.n{c}y*ly+p1.n{c}z*lz))/len, 1), -1))"


@query("j16_force_closure", "select grasp_id, acos(least(abs(anx*lx+any_*ly+anz*lz)/len, 1)) <= atan(0.5) and acos(least(abs(bnx*lx+bny*ly+bnz*lz)/len, 1)) <= atan(0.5) closed from (select a.grasp_id, a.nx anx, a.ny any_, a.nz anz, b.nx bnx, b.ny bny, b.nz bnz, b.px-a.px lx, b.py-a.py ly, b.pz-a.pz lz, sqrt((b.px-a.px)**2+(b.py-a.py)**2+(b.pz-a.pz)**2) len from contacts a join contacts b on a.grasp_id = b.grasp_id and a.side = 0 and b.side = 1)")
def j16(s, d):
    return Q.force_closure(V.contacts(s, d), 0.5)


_GRAM = ", ".join(f"sum({a}*{b}) {a}_{b}" for i, a in enumerate(Q.W6) for b in Q.W6[i:])


@query("a25_grasp_gram", f"select grasp_id, {_GRAM} from ({_WRENCH}) group by 1", " ".join(f"{a}_{b}" for i, a in enumerate(Q.W6) for b in Q.W6[i:]))
def a25(s, d):
    return Q.grasp_gram(_wrenches(s, d))


_M36 = "[" + ", ".join(f"{min(a, b, key=Q.W6.index)}_{max(a, b, key=Q.W6.index)}" for a in Q.W6 for b in Q.W6) + "]::double[]"


@query("a26_grasp_spectrum", f"with recursive {jacobi_sql(f'select grasp_id, {_M36} m from (select grasp_id, {_GRAM} from ({_WRENCH}) group by 1)', 'grasp_id', 6, SWEEPS_6)} select grasp_id, s[1] min_singular, sqrt(list_product(s)) volume, coalesce(s[1] / nullif(s[6], 0), 0) isotropy from (select grasp_id, list_transform(l, lambda x: case when x > 1e-12 * l[6] then sqrt(x) else 0 end) s from (select grasp_id, list_sort([m[1], m[8], m[15], m[22], m[29], m[36]]) l from turned))", "min_singular volume isotropy")
def a26(s, d):
    return Q.grasp_spectrum(Q.grasp_gram(_wrenches(s, d)))


def _dirs(s):
    return s.createDataFrame([(k, *[float((k * (i + 3) * 7 % 11) - 5) / 5 for i in range(6)]) for k in range(40)], "dir_id int, u0 double, u1 double, u2 double, u3 double, u4 double, u5 double")


@query("a28_epsilon_directions", f"select grasp_id, greatest(min(h), 0) epsilon from (select grasp_id, k, max(" + "+".join(f"{a}*((k*{i + 3}*7 % 11)-5)/5.0" for i, a in enumerate(Q.W6)) + f") h from ({_WRENCH}), range(40) t(k) group by 1, 2) group by 1", "epsilon")
def a28(s, d):
    return Q.epsilon_directions(_wrenches(s, d), _dirs(s))


_CONE4 = _CONE.replace("/8)", "/4)").replace("range(8)", "range(4)")


@query("a27_epsilon_force", f"""with f as (select grasp_id, side*1000+edge k, fx, fy, fz from ({_CONE4})), t as (select a.grasp_id, a.k k1, b.k k2, c.k k3, a.fx x1, a.fy y1, a.fz z1, (b.fy-a.fy)*(c.fz-a.fz)-(b.fz-a.fz)*(c.fy-a.fy) mx, (b.fz-a.fz)*(c.fx-a.fx)-(b.fx-a.fx)*(c.fz-a.fz) my, (b.fx-a.fx)*(c.fy-a.fy)-(b.fy-a.fy)*(c.fx-a.fx) mz
 from f a join f b on a.grasp_id = b.grasp_id and a.k < b.k join f c on c.grasp_id = b.grasp_id and b.k < c.k), u as (select *, sqrt(mx*mx+my*my+mz*mz) l, (mx*x1+my*y1+mz*z1)/sqrt(mx*mx+my*my+mz*mz) off from t where sqrt(mx*mx+my*my+mz*mz) > 1e-12),
 g as (select u.grasp_id, k1, k2, k3, off, max((mx*fx+my*fy+mz*fz)/l-off) hi, min((mx*fx+my*fy+mz*fz)/l-off) lo from u join f using (grasp_id) group by 1, 2, 3, 4, 5)
 select f.grasp_id, greatest(coalesce(min(case when hi <= 1e-9 then off when lo >= -1e-9 then -off end), 0), 0) epsilon from (select distinct grasp_id from f) f left join g using (grasp_id) group by 1""", "epsilon")  # fmt: skip
def a27(s, d):
    return Q.epsilon_force(Q.friction_cone(V.contacts(s, d), 0.5, 4))


@query("x02_quality_by_name", "select grasp_id, cast(acos(least(abs(anx*lx+any_*ly+anz*lz)/len, 1)) <= atan(0.8) and acos(least(abs(bnx*lx+bny*ly+bnz*lz)/len, 1)) <= atan(0.8) as double) quality from (select a.grasp_id, a.nx anx, a.ny any_, a.nz anz, b.nx bnx, b.ny bny, b.nz bnz, b.px-a.px lx, b.py-a.py ly, b.pz-a.pz lz, sqrt((b.px-a.px)**2+(b.py-a.py)**2+(b.pz-a.pz)**2) len from contacts a join contacts b on a.grasp_id = b.grasp_id and a.side = 0 and b.side = 1)", "quality")
def x02(s, d):
    return Q.quality(V.contacts(s, d), "force_closure", mu=0.8)


@query("a29_expected_quality", "select user_id grasp_id, avg(value) mean, var_pop(value) variance, count(*) n from events group by 1", "mean variance", places=4)
def a29(s, d):
    return Q.expected_quality(V.table(s, d, "events").select(F.col("user_id").alias("grasp_id"), F.col("value").alias("quality")))


_PRED = "list_position(probs, list_max(probs)) - 1"


@query("p32_softmax_argmax", f"select row_id, cast({_PRED} as int) cls, probs[1] p0 from preds10", "p0")
def p32(s, d):
    t = V.table(s, d, "embeddings").selectExpr("vec_id row_id", "transform(slice(embedding, 1, 10), x -> cast(x as double)) e").withColumn("p", L.softmax(F.col("e")))
    return t.select("row_id", L.argmax_class(F.col("p")).alias("cls"), F.get("p", F.lit(0)).alias("p0"))


@query("a30_accuracy", f"select avg(cast({_PRED} = label as double)) accuracy, avg(-ln(probs[label+1])) nll, count(*) n from preds10", "accuracy nll")
def a30(s, d):
    return L.accuracy(V.preds10(s, d))


@query("a30_accuracy_by", f"select label, avg(cast({_PRED} = label as double)) accuracy, count(*) n from preds10 group by 1", "accuracy")
def a30b(s, d):
    return L.accuracy_by(V.preds10(s, d), "label")


@query("a31_confusion", f"select cast(a as int) label, cast(b as int) pred, count(row_id) n from range(10) x(a), range(10) y(b) left join (select label, {_PRED} pred, row_id from preds10) p on p.label = a and p.pred = b group by 1, 2")
def a31(s, d):
    return L.confusion(V.preds10(s, d), 10)


@query("a32_binary_metrics", "select 100*(fp+fn)/n error_rate, fp/(fp+tn) fpr, case when tp+fp = 0 then 1 else tp/(tp+fp) end \"precision\", case when tp+fp = 0 then 1 else tp/(tp+fn) end recall from (select count(*)::double n, count(case when score >= 0.1 and label = 1 then 1 end)::double tp, count(case when score >= 0.1 and label = 0 then 1 end)::double fp, count(case when score < 0.1 and label = 1 then 1 end)::double fn, count(case when score < 0.1 and label = 0 then 1 end)::double tn from preds2)", 'error_rate fpr "precision" recall')
def a32(s, d):
    return L.binary_metrics(V.preds2(s, d), 0.1)


@query("a33_topk_error", "select 100*avg(cast(r >= 3 as double)) error from (select row_id, len(list_filter(range(1, 11), lambda i: probs[i] > probs[label+1] or (probs[i] = probs[label+1] and i < label+1))) r from preds10)", "error")
def a33(s, d):
    return L.topk_error(V.preds10(s, d), 3)


@query("a34_merge_labels", "select row_id, new, sum(p) p from (select row_id, cast((i-1) // 4 as int) new, probs[i] p from preds10, range(1, 11) t(i)) group by 1, 2", "p")
def a34(s, d):
    return L.merge_labels(V.preds10(s, d), s.createDataFrame([(k, k // 4) for k in range(10)], "old int, new int"))


@query("a35_flatten_multiclass", "select row_id, cast(i-1 as int) cls, probs[i] score, cast(i-1 = label as int) label from preds10, range(1, 11) t(i)", "score")
def a35(s, d):
    return L.flatten_multiclass(V.preds10(s, d))


_CURVE = "select score, tp/(tp+fp) \"precision\", tp/ap recall, fp/aq fpr from (select score, sum(p) over o tp, sum(q) over o fp, sum(p) over () ap, sum(q) over () aq from (select score, count(case when label = 1 then 1 end)::double p, count(case when label <> 1 then 1 end)::double q from preds2 group by 1) window o as (order by score desc))"


@query("a36_curve", _CURVE, 'score "precision" recall fpr')
def a36(s, d):
    return L.curve(V.preds2(s, d))


@query("a36_average_precision", f"select sum((recall-r0)*\"precision\") average_precision, sum((fpr-f0)*(recall+r0)/2) roc_auc from (select *, coalesce(lag(recall) over (order by score desc), 0) r0, coalesce(lag(fpr) over (order by score desc), 0) f0 from ({_CURVE}))", "average_precision roc_auc")
def a36b(s, d):
    return L.average_precision(V.preds2(s, d))


@query("a37_regression_error", "select avg((score-label)**2) mse from preds2", "mse")
def a37(s, d):
    return V.preds2(s, d).agg(F.avg((F.col("score") - F.col("label")) ** 2).alias("mse"))


@query("a38_mispredicted", f"select row_id, label from preds10 where {_PRED} <> label")
def a38(s, d):
    return L.mispredicted(V.preds10(s, d)).select("row_id", "label")


@query("a39_vote", f"select label, cls, score from (select label, cast({_PRED} as int) cls, count(*) n, avg(list_max(probs)) score from preds10 group by 1, 2) qualify row_number() over (partition by label order by n desc, cls) = 1", "score")
def a39(s, d):
    return L.vote(V.preds10(s, d), "label")


@query("a40_beta_posterior", "select arm, alpha, beta, n, alpha/(alpha+beta) mean, alpha*beta/((alpha+beta)**2*(alpha+beta+1)) variance from (select arm, 1+sum(v) alpha, 1+count(*)-sum(v) beta, count(*) n from rewards group by 1)", "alpha beta mean variance")
def a40(s, d):
    return L.beta_posterior(V.rewards(s, d))


@query("a41_bernoulli_posterior", "select arm, avg(v) mean, count(*) n, 1.5034945*sqrt(avg(v)*(1-avg(v))/count(*)) width from rewards group by 1", "mean width")
def a41(s, d):
    return L.bernoulli_posterior(V.rewards(s, d))


@query("a42_gaussian_posterior", "select arm, avg(v) mean, avg(v*v)-avg(v)**2 variance, count(*) n, (avg(v*v)-avg(v)**2)/sqrt(count(*)) uncertainty from rewards group by 1", "mean variance uncertainty")
def a42(s, d):
    return L.gaussian_posterior(V.rewards(s, d))


@query("a43_best_arms", "select arm, mean, variance from (select arm, avg(v) mean, avg(v*v)-avg(v)**2 variance from rewards group by 1) qualify rank() over (order by mean desc) = 1", "mean variance")
def a43(s, d):
    return L.best_arms(L.gaussian_posterior(V.rewards(s, d))).select("arm", "mean", "variance")


_BETA = "select arm, alpha/(alpha+beta) mean, alpha*beta/((alpha+beta)**2*(alpha+beta+1)) variance from (select arm, 1+sum(v) alpha, 1+count(*)-sum(v) beta from rewards group by 1)"


@query("a44_best_arm_lcb", f"select arm, mean-1.645*sqrt(variance) lcb from ({_BETA}) order by lcb desc, arm limit 1", "lcb")
def a44(s, d):
    return L.best_arm_lcb(L.beta_posterior(V.rewards(s, d)), 1.645).select("arm", "lcb")


@query("a44_best_arm_quantile", f"with recursive {beta_quantile_sql('select arm, 0.05::double p, 1+sum(v) a, 1+count(*)-sum(v) b from rewards group by arm', 'arm')} select arm, q lcb from quantiles order by q desc, arm limit 1", "lcb")
def a44b(s, d):
    return L.best_arm_quantile(L.beta_posterior(V.rewards(s, d)), 0.05).select("arm", "lcb")


@query("t07_ucb_arm", f"select arm, mean+2*sqrt(variance) ucb from ({_BETA}) order by ucb desc, arm limit 1", "ucb")
def t07(s, d):
    return L.ucb_arm(L.beta_posterior(V.rewards(s, d)), 2.0).select("arm", "ucb")


@query("t09_best_per_bin", f"select bin, arm from (select *, cast(floor({U.format("'2:' || arm")}*5) as bigint) bin from ({_BETA})) qualify row_number() over (partition by bin order by mean desc, arm) = 1")
def t09(s, d):
    return L.best_per_bin(L.beta_posterior(V.rewards(s, d)), 5, 2)


@query("w13_posterior_history", "select arm, k, 1+s alpha, 1+k-s beta from (select arm, row_number() over w k, sum(v) over w s, lead(seq) over w is null last from rewards window w as (partition by arm order by seq)) where k % 10 = 0 or last", "alpha beta")
def w13(s, d):
    return L.posterior_history(V.rewards(s, d), 10)


@query("a45_losses", "select avg(-(label*ln(g)+(1-label)*ln(1-g))) cross_entropy, avg((label-g)**2) squared, sum(w*(label-g)**2)/sum(w) weighted from (select label, 0.01+0.98*score g, 1.0+row_id % 3 w from preds2)", "cross_entropy squared weighted")
def a45(s, d):
    return L.losses(V.preds2(s, d).selectExpr("label", "0.01D + 0.98D * score g", "1.0D + row_id % 3 w"), "label", "g", "w")


@query("a47_least_squares", "select i, j, s from (select 0 i, 0 j, sum(l_quantity*l_quantity) s from lineitem union all select 0, 1, sum(l_quantity*l_tax) from lineitem union all select 1, 0, sum(l_quantity*l_tax) from lineitem union all select 1, 1, sum(l_tax*l_tax) from lineitem union all select 0, -1, sum(l_quantity*l_discount) from lineitem union all select 1, -1, sum(l_tax*l_discount) from lineitem)", "s", places=4)
def a47(s, d):
    return L.least_squares_terms(V.table(s, d, "lineitem"), ["l_quantity", "l_tax"], "l_discount")


@query("x05_objective", "select arm, seq, -v neg, cast(v >= 0.5 as double) thr from rewards", "neg thr")
def x05(s, d):
    r = V.rewards(s, d)
    return L.objective(L.objective(r, "negate", "v").withColumnRenamed("objective", "neg"), "threshold", "v", 0.5).select("arm", "seq", "neg", F.col("objective").alias("thr"))
