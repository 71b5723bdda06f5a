"""The arm of the largest Beta quantile, worked out for the arms that may have it alone."""

import random

import pytest
from pyspark.sql import functions as F

from pointloom.functions import uniform
from pointloom.operators import compose as C
from pointloom.operators import learn as L


@pytest.fixture(scope="module")
def arms(spark):
    rnd = random.Random(8)
    rows = [(i, 1 + rnd.random() * 9, 1 + rnd.random() * 20) for i in range(400)]
    rows += [(1000 + i, *max(rows, key=lambda r: r[1] / (r[1] + r[2]))[1:]) for i in range(200)]  # equals of a good one
    t = F.col("alpha") + F.col("beta")
    return spark.createDataFrame(rows, "arm long, alpha double, beta double").withColumn("mean", F.col("alpha") / t).withColumn("variance", F.col("alpha") * F.col("beta") / (t * t * (t + 1))).cache()


@pytest.mark.parametrize("p", [0.001, 0.05, 0.5, 0.97, None])
def test_few_arms_may_be_the_best(arms, p):
    at = uniform(4, F.col("arm")) if p is None else F.lit(p)
    want = L.with_quantile(arms, at, "q").orderBy(F.desc("q"), "arm").first()
    some = L.may_be_largest(arms, at)
    got = L.with_quantile(some, at, "q").orderBy(F.desc("q"), "arm").first()
    assert (got.arm, got.q) == (want.arm, want.q) and some.count() < 20
    best = C.choose(arms, "thompson", 4) if p is None else L.best_arm_quantile(arms, p)
    assert best.first().arm == want.arm
