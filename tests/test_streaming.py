"""Streams give what their batch twins give."""

import random

import pytest
from pyspark.sql import functions as F

from pointloom.operators import learn
from pointloom.operators.learn import Stop
from pointloom.sources import formats
from pointloom.streaming import frames as S
from pointloom.streaming import stateful


@pytest.fixture(autouse=True)
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def in_files(spark, tmp_path, name, batches, schema):
    """A stream that reads one file after the other, one a trigger, and all rows as a frame."""
    import os

    folder = tmp_path / name
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"b{i:02}"))
        for f in (folder / f"b{i:02}").glob("*.parquet"):
            os.utime(f, (1_000_000 + i, 1_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "b*"))
    return stream, spark.createDataFrame([r for b in batches for r in b], schema)


def at(df, *columns):
    return df.select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t")).alias("ts"), *columns)


def gated(spark, tmp_path, batches, name, late, idle):
    stream, rows = in_files(spark, tmp_path, name, batches, "source long, t double, home boolean, n long")
    shape = lambda d: at(d, "source", F.when(F.col("home").isNull(), F.col("n")).alias("frame_id"), "home")
    got = run(spark, S.gate_stream(shape(stream), late, idle), name)
    e = shape(rows)
    want = S.gate_batch(e.where("frame_id is not null").drop("home"), e.where("home is not null").drop("frame_id"), idle)
    key = lambda d: sorted((r.source, r.frame_id, r.ts) for r in d.collect())
    return key(got), key(want)


FLUSH = [(99, 10_000.0, None, 9_999)]  # a later event of another source moves the watermark on


def test_gate_reorders_events_of_several_triggers(spark, tmp_path):
    batches = [
        [(1, 0.0, True, 0), (1, 1.0, None, 1), (2, 0.0, None, 2)],
        [(1, 3.0, None, 3), (1, 2.5, None, 5), (2, 5.0, True, 0)],
        [(1, 2.0, False, 0), (2, 4.0, None, 6), (2, 6.0, None, 7)],  # the state at 2 comes after the frames at 2.5 and 3
        [(1, 7.0, True, 0), (1, 7.0, None, 8), (2, 6.0, None, 9)],  # at the same time the state goes first
        FLUSH,
    ]
    got, want = gated(spark, tmp_path, batches, "gate", "20 seconds", "1 hour")
    assert got == want
    assert [g[:2] for g in got] == [(1, 1), (1, 8), (2, 7), (2, 9)]


def test_gate_forgets_idle_sources(spark, tmp_path):
    batches = [[(1, 0.0, True, 0), (1, 1.0, None, 1)], [(1, 40.0, None, 2), (2, 30.0, True, 0)], [(2, 35.0, None, 3), (1, 41.0, True, 0)], [(1, 45.0, None, 4), (2, 100.0, None, 5)], FLUSH]
    got, want = gated(spark, tmp_path, batches, "idle", "10 seconds", "20 seconds")
    assert got == want
    assert [g[:2] for g in got] == [(1, 1), (1, 4), (2, 3)]


def test_gate_on_random_events(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(rnd.randrange(4), float(i) + rnd.random() * 0.5, rnd.choice((None, None, True, False)), i) for i in range(80)]
    shuffled = sorted(rows, key=lambda r: r[1] + rnd.random() * 12)
    batches = [shuffled[k : k + 16] for k in range(0, 80, 16)] + [FLUSH]
    got, want = gated(spark, tmp_path, batches, "random", "30 seconds", "8 seconds")
    assert got == want and len(got) > 3


def test_best_of_each_frame_once(spark, tmp_path):
    rnd = random.Random(1)
    frames = [(f, f * 10.0, g, rnd.choice((0.1, 0.5, 0.5, 0.9, None)), rnd.choice((0.01, 0.2))) for f in range(6) for g in range(7) for _ in range(2)]
    frames.sort(key=lambda r: r[1] + rnd.random() * 15)
    batches = [frames[k : k + 20] for k in range(0, len(frames), 20)] + [[(99, 5_000.0, 1, 0.5, 0.2)]]
    stream, rows = in_files(spark, tmp_path, "best", batches, "frame_id long, t double, grasp_id long, score double, width double")
    shape = lambda d: at(d, "frame_id", "grasp_id", "score", "width")
    got = run(spark, S.publish_best(shape(stream), 0.1, 3, "40 seconds"), "best")
    want = S.publish_best(shape(rows), 0.1, 3).where("frame_id <> 99")
    key = lambda d: sorted(tuple(r) for r in d.select("frame_id", "place", "grasp_id", "score", "ts").collect())
    assert key(got) == key(want)
    assert got.count() == 18


RULES = {"count": Stop.count(6), "progress": Stop.progress(0.05), "confidence": Stop.confidence(0.02), "either": Stop.count(9) | Stop.progress(0.01), "both": Stop.count(3) & Stop.confidence(0.03)}


@pytest.mark.parametrize("rule", RULES)
def test_posterior(spark, tmp_path, rule):
    rnd = random.Random(2)
    rows = [(a, i, rnd.choice((0.0, 0.25, 0.9, 1.0, rnd.random()))) for i in range(15) for a in (1, 2, 3)] + [(4, 0, 0.5)]
    stream, frame = in_files(spark, tmp_path, rule, [rows[k : k + 10] for k in range(0, len(rows), 10)], "arm long, seq long, v double")
    got = run(spark, S.stream_posterior(stream, RULES[rule]), f"posterior_{rule}", "update").groupBy("arm").agg(F.max_by(F.struct("alpha", "beta", "n", "stopped"), "n").alias("s")).select("arm", "s.*")
    key = lambda d: sorted((x.arm, round(x.alpha, 9), round(x.beta, 9), x.n, x.stopped) for x in d.collect())
    assert key(got) == key(learn.posterior_until(frame, RULES[rule]))


def test_frames_windows_and_newest(spark, tmp_path):
    f = spark.createDataFrame([(i, i % 2, float(i), [(float(i), 0.0, 0.5)]) for i in range(6)], "frame_id long, source long, value double, points array<struct<x:double,y:double,z:double>>")
    f = f.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("frame_id") * 60)).select("frame_id", "ts", "source", "points", "value")
    f.drop("value").coalesce(1).write.parquet(str(tmp_path / "f"))
    stream = formats.read_frames(spark, str(tmp_path / "f"), stream=True)
    feats = run(spark, S.stream_features(stream, 0.5, "1 second"), "feats").count()
    assert 0 < feats <= S.stream_features(f, 0.5, "1 second").count() == 6  # the last window waits for the watermark
    seen = []
    q = S.for_each_newest(stream, lambda b: seen.extend((r.source, r.frame_id) for r in b.collect())).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(seen) == [(0, 4), (1, 5)]
    assert S.window_counts(f, "1 hour").agg(F.sum("n")).first()[0] == 6
    assert formats.read_frames(spark, str(tmp_path / "f")).where("is_dense").count() == 6
