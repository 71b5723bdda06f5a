"""Streaming forms of the detection loop; each has a batch form as well, which is how they are checked.

Those with state of their own (``gate_stream``, ``publish_best``, ``stream_posterior``) need the RocksDB state store:
``spark.sql.streaming.stateStore.providerClass`` = ``stateful.STORE``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.catalog import rank_grasps
from ..operators.learn import Stop, posterior_until


def stream_features(frames: DataFrame, leaf: float, late: str, width: str = "1 minute") -> DataFrame:
    """Voxel features of frames (frame_id, ts, points array<struct<x,y,z>>): count and mean height of each cell above the
    table, per frame; append mode with a watermark, so state is bounded."""
    p = frames.withWatermark("ts", late) if frames.isStreaming else frames
    p = p.select("frame_id", "ts", F.explode("points").alias("p")).select("frame_id", "ts", "p.*").where("z > 0.01")
    cells = [F.floor(F.col(c) / leaf).alias(i) for c, i in zip("xyz", "ijk", strict=True)]
    return p.select("frame_id", "ts", "z", *cells).groupBy("frame_id", F.window("ts", width), "i", "j", "k").agg(F.count("*").alias("n"), F.avg("z").alias("z"))


def gate_batch(frames: DataFrame, states: DataFrame, idle: str | None = None) -> DataFrame:
    """Frames whose source's latest state before them is home: last value over the time-ordered union.

    With ``idle`` (an interval such as "10 minutes"), a source that has been silent for longer is forgotten: its flag
    counts as not home until its next state.
    """
    both = states.select("source", "ts", "home", F.lit(None).cast("long").alias("frame_id"), F.lit(0).alias("kind")).unionByName(
        frames.select("source", "ts", F.lit(None).cast("boolean").alias("home"), "frame_id", F.lit(1).alias("kind")))
    line = Window.partitionBy("source").orderBy("ts", "kind", "frame_id")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    if idle is None:
        seen = both.withColumn("now", F.last("home", ignorenulls=True).over(upto))
    else:
        silent = F.col("ts") > F.lag("ts").over(line) + F.expr(f"interval {idle}")
        seen = both.withColumn("_from", F.when(silent, F.col("ts"))).withColumn("_from", F.last("_from", ignorenulls=True).over(upto))
        said = F.last(F.when(F.col("home").isNotNull(), F.struct("ts", "home")), ignorenulls=True).over(upto)
        seen = seen.withColumn("_said", said).withColumn("now", F.col("_said.home") & (F.col("_from").isNull() | (F.col("_said.ts") >= F.col("_from"))))
    return seen.where("kind = 1 and now").select("frame_id", "ts", "source")


def gate_stream(events: DataFrame, late: str = "1 minute", idle: str = "1 day") -> DataFrame:
    """``gate_batch`` on a stream of (source, ts, frame_id or null, home or null), whatever order events come in.

    Events wait in their source's state until the watermark has passed them, then are gone through in order of time, so
    a state that comes late still decides about the frames after it. What comes after the watermark is lost. A source
    silent for longer than ``idle`` is forgotten, and its state removed.
    """
    from .stateful import Gate, micros

    rows = events.withWatermark("ts", late).select("source", "ts", F.unix_micros("ts").alias("us"), "frame_id", "home")
    out = rows.groupBy("source").transformWithStateInPandas(Gate(micros(events.sparkSession, idle)), "frame_id long, us long, source long", "append", "EventTime")
    return out.select("frame_id", F.timestamp_micros("us").alias("ts"), "source")


def latest_frame(frames: DataFrame) -> DataFrame:
    """The newest frame of each source in a batch; on a stream, call it inside foreachBatch."""
    return frames.groupBy("source").agg(F.max_by("frame_id", F.struct("ts", "frame_id")).alias("frame_id"), F.max("ts").alias("ts"))


def for_each_newest(frames: DataFrame, handle: Callable[[DataFrame], None]):
    """A stream writer that gives the newest frame of each source in each trigger to ``handle``."""
    return frames.writeStream.foreachBatch(lambda batch, _: handle(latest_frame(batch)))


def robot_state(joints: DataFrame, home: list[float], within: float = 1.0) -> DataFrame:
    """Whether all joints (array j) are within so many degrees of home; works on streams as it keeps no state."""
    target = F.array(*[F.lit(h) for h in home])
    off = F.zip_with("j", target, lambda a, b: F.abs(a - b))
    return joints.withColumn("home", F.forall(off, lambda x: x < within))


def publish_best(scored: DataFrame, least_width: float, n: int = 1, late: str = "1 minute") -> DataFrame:
    """(frame_id, ts, grasp_id, score, place): the n best grasps of each frame, once.

    Too-narrow grasps score 0. Of a grasp that is repeated in a frame, the best score counts; equal scores go by grasp_id;
    a null score is no score. All rows of a frame carry its time ts. On a stream, a frame's best so far (never more than n)
    are its state, and are given out when the watermark passes the frame.
    """
    s = scored.withColumn("score", F.when(F.col("width") < least_width, 0.0).otherwise(F.col("score"))).where("score is not null")
    if s.isStreaming:
        from .stateful import Best

        rows = s.withWatermark("ts", late).select("frame_id", "ts", F.unix_micros("ts").alias("us"), "grasp_id", "score")
        out = rows.groupBy("frame_id").transformWithStateInPandas(Best(n), "frame_id long, us long, grasp_id long, score double, place int", "append", "EventTime")
        return out.select("frame_id", F.timestamp_micros("us").alias("ts"), "grasp_id", "score", "place")
    each = s.groupBy("frame_id", "grasp_id").agg(F.max("ts").alias("ts"), F.max("score").alias("score"))
    best = rank_grasps(each, "frame_id", n).withColumn("place", F.row_number().over(Window.partitionBy("frame_id").orderBy(F.desc("score"), "grasp_id")))
    return best.select("frame_id", "ts", "grasp_id", "score", "place")


def stream_posterior(rewards: DataFrame, stop: Stop, a0: float = 1.0, b0: float = 1.0) -> DataFrame:
    """Running Beta posterior of each arm of a stream (arm, seq, v): (arm, alpha, beta, n, stopped) for each arm and trigger.

    Rewards count in the order in which triggers bring them, within a trigger by seq. An arm that ``stop`` holds for takes
    no more, and gives no more rows.
    """
    from .stateful import Arm

    rows = rewards.select("arm", "seq", "v")
    return rows.groupBy("arm").transformWithStateInPandas(Arm(stop, a0, b0), "arm long, alpha double, beta double, n long, stopped boolean", "update", "None")


def posterior_batch(rewards: DataFrame, most: int, a0: float = 1.0, b0: float = 1.0) -> DataFrame:
    """What stream_posterior holds after all rewards, with ``Stop.count(most)``."""
    return posterior_until(rewards, Stop.count(most), a0, b0).drop("stopped")


def window_counts(scored: DataFrame, width: str, slide: str | None = None, late: str = "1 minute") -> DataFrame:
    """Rows and mean score in tumbling or sliding windows of each source; late rows go once the watermark has passed."""
    s = scored.withWatermark("ts", late) if scored.isStreaming else scored
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return s.groupBy("source", w.alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("value")).select("source", F.col("w.start").alias("start"), "n", "value")


def session_counts(scored: DataFrame, gap: str, late: str = "1 minute") -> DataFrame:
    s = scored.withWatermark("ts", late) if scored.isStreaming else scored
    return s.groupBy("source", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("source", F.col("w.start").alias("start"), "n")
