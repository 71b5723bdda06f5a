import numpy as np
from pyspark.sql import functions as F

from pointloom.functions import eigen

SIX = ("xx", "yy", "zz", "xy", "xz", "yz")


def matrices():
    rng = np.random.default_rng(0)
    out = [np.zeros((3, 3)), np.eye(3), np.diag([1.0, 1.0, 1.0 + 1e-9])]
    for k in range(120):
        a = rng.normal(0, 1, (3, 3))
        out.append((a @ a.T, np.outer(a[0], a[0]), a + a.T, a @ a.T * 1e-9, np.outer(a[0], a[0]) + 1e-7 * (a @ a.T))[k % 5])
    return out


def test_three_by_three_against_numpy(spark):
    given = matrices()
    rows = [(k, *[float(m["xyz".index(s[0]), "xyz".index(s[1])]) for s in SIX]) for k, m in enumerate(given)]
    df = spark.createDataFrame([*rows, (-1, None, *[1.0] * 5)], "id long, " + ", ".join(f"s{s} double" for s in SIX))
    found = eigen.eigen3(df, ["id"])
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString() and "Pandas" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r for r in found.collect()}
    for k, m in enumerate(given):
        v = np.array([[got[k][f"e{n}{c}"] for c in "xyz"] for n in range(3)])
        values = np.array([got[k][f"l{n}"] for n in range(3)])
        size = max(np.abs(m).max(), 1e-300)
        assert np.abs(v.T @ np.diag(values) @ v - m).max() <= 1e-13 * size, k
        assert np.abs(v @ v.T - np.eye(3)).max() < 1e-13 and np.abs(values - np.linalg.eigvalsh(m)).max() <= 1e-13 * size
        assert all(next(x for x in row if abs(x) > 1e-9) > 0 for row in v)
    assert got[-1].l0 is None


def test_six_by_six_against_numpy(spark):
    rng = np.random.default_rng(1)
    given = [a @ a.T for a in (rng.normal(0, 1, (6, 3 + k % 5)) for k in range(30))]
    df = spark.createDataFrame([(k, m.ravel().tolist()) for k, m in enumerate(given)], "id long, m array<double>")
    for r in df.select("id", eigen.eigenvalues(F.col("m"), 6).alias("l")).collect():
        assert np.abs(np.array(r.l) - np.linalg.eigvalsh(given[r.id])).max() < 1e-12
