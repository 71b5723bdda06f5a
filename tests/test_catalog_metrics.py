"""Metrics of objects, counted without a copy of each row for every count."""

from pointloom.operators import catalog as C


def test_available_metrics_make_no_copies_of_rows(spark):
    rows = [(1, 10, "b"), (1, 10, "a"), (1, 11, "a"), (2, 10, None), (2, None, "c"), (None, 7, "a"), (3, 1, "x"), (3, 1, "x")]
    df = C.available_metrics(spark.createDataFrame(rows, "object_id long, grasp_id long, metric string"))
    assert {tuple(r) for r in df.collect()} == {(1, 2, 2, "a,b"), (2, 1, 1, "c"), (None, 1, 1, "a"), (3, 1, 1, "x")}
    assert "Expand" not in df._jdf.queryExecution().toString()
