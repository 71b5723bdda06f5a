"""Batch twins of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learn
from ..operators.learn import Stop
from ..streaming import frames as S
from . import query
from . import views as V


@query("st01_features", "select cast(cloud_id as bigint) frame_id, cast(floor(x/0.25) as bigint) i, cast(floor(y/0.25) as bigint) j, cast(floor(z/0.25) as bigint) k, count(*) n, avg(z) z from points where z > 0.01 group by 1, 2, 3, 4", "z")
def st01(s, d):
    p = V.points(s, d).groupBy(F.col("cloud_id").cast("long").alias("frame_id")).agg(F.collect_list(F.struct("x", "y", "z")).alias("points"))
    return S.stream_features(p.withColumn("ts", F.lit("2024-01-01").cast("timestamp")), 0.25, "1 minute").drop("window")


@query("st02_gate", "select frame_id, ts, source from (select *, last_value(home ignore nulls) over (partition by source order by ts, kind, frame_id rows between unbounded preceding and current row) now from (select source, ts, home, null frame_id, 0 kind from states union all select source, ts, null, frame_id, 1 from frames)) where kind = 1 and now")
def st02(s, d):
    return S.gate_batch(V.frames(s, d), V.states(s, d))


@query("st03_latest_frame", "select source, arg_max(frame_id, ts) frame_id, max(ts) ts from frames group by 1")
def st03(s, d):
    return S.latest_frame(V.frames(s, d))


@query("st04_robot_state", "select event_id, source, list_bool_and(list_transform(range(1, 7), lambda i: abs(j[i]-1) < 1)) home from joints")
def st04(s, d):
    return S.robot_state(V.joints(s, d), [1.0] * 6).select("event_id", "source", "home")


@query("st02_gate_idle", "select frame_id, ts, source from (select *, last_value(case when home is not null then {t: ts, h: home} end ignore nulls) over w said, last_value(case when silent then ts end ignore nulls) over w since from (select *, ts > lag(ts) over (partition by source order by ts, kind, frame_id) + interval 2 days silent from (select source, ts, home, null frame_id, 0 kind from states union all select source, ts, null, frame_id, 1 from frames)) window w as (partition by source order by ts, kind, frame_id rows between unbounded preceding and current row)) where kind = 1 and said.h and (since is null or said.t >= since)")
def st02b(s, d):
    return S.gate_batch(V.frames(s, d), V.states(s, d), "2 days")


@query("st05_publish_best", "select frame_id, grasp_id, score, cast(row_number() over (partition by frame_id order by score desc, grasp_id) as int) place from (select cast(cloud_id as bigint) frame_id, grasp_id, case when width < 0.35 then 0 else refine end score from grasps) qualify place <= 2", "score")
def st05(s, d):
    g = V.grasps(s, d).selectExpr("cast(cloud_id as long) frame_id", "grasp_id", "width", "refine score", "timestamp '2024-01-01 00:00:00' ts")
    return S.publish_best(g.union(g), 0.35, 2).drop("ts")


def _until(test: str) -> str:
    """SQL of the posterior at the first reward that a test of k, v, before and variance holds for."""
    return f"select arm, 1 + sum(v) alpha, 1 + count(*) - sum(v) beta, count(*) n, coalesce(bool_or(k = stop), false) stopped from (select *, min(case when {test} then k end) over (partition by arm) stop from (select *, a * b / ((a + b) * (a + b) * (a + b + 1)) variance from (select *, 1 + s a, 1 + k - s b from (select arm, v, row_number() over w k, coalesce(lag(v) over w, 0) before, sum(v) over w s from rewards window w as (partition by arm order by seq))))) where stop is null or k <= stop group by arm"


@query("st06_posterior", _until("k >= 20").replace(", coalesce(bool_or(k = stop), false) stopped", ""), "alpha beta")
def st06(s, d):
    return S.posterior_batch(V.rewards(s, d), 20)


@query("st06_progress", _until("abs(v - before) < 0.05"), "alpha beta")
def st06b(s, d):
    return learn.posterior_until(V.rewards(s, d), Stop.progress(0.05))


@query("st06_confidence", _until("variance < 0.01"), "alpha beta")
def st06c(s, d):
    return learn.posterior_until(V.rewards(s, d), Stop.confidence(0.01))


@query("st06_either", _until("k >= 12 or abs(v - before) < 0.02 or variance < 0.004"), "alpha beta")
def st06d(s, d):
    return learn.posterior_until(V.rewards(s, d), Stop.count(12) | Stop.progress(0.02) | Stop.confidence(0.004))


@query("st06_both", _until("k >= 3 and abs(v - before) < 0.2 and variance < 0.05"), "alpha beta")
def st06e(s, d):
    return learn.posterior_until(V.rewards(s, d), Stop.count(3) & Stop.progress(0.2) & Stop.confidence(0.05))


@query("st07_window_counts", "select source, time_bucket(interval '1 day', ts) start, count(*) n, avg(value) as value from frames group by 1, 2", "value")
def st07(s, d):
    return S.window_counts(V.frames(s, d), "1 day")


@query("st07_session_counts", "select source, min(ts) start, count(*) n from (select *, sum(new) over (partition by source order by ts, frame_id) g from (select *, case when ts < lag(ts) over (partition by source order by ts, frame_id) + interval '6 hours' then 0 else 1 end new from frames)) group by source, g")
def st07b(s, d):
    return S.session_counts(V.frames(s, d), "6 hours")
