"""A catalog of objects, grasps and metrics: tables of keys, stored as Parquet by dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def insert_absent(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose keys the table lacks are appended."""
    return table.unionByName(new.join(table.select(*keys), keys, "left_anti"))


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of equal keys."""
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new)


def delete(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys, on, "left_anti")


def number_grasps(grasps: DataFrame, have: DataFrame, keys: list[str], order: str) -> DataFrame:
    """grasp_id of rows without one: place in the group plus the number of grasps the group has already."""
    n = have.groupBy(*keys).agg(F.count("*").alias("_have"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return grasps.withColumn("_place", place).join(n, keys, "left").withColumn("grasp_id", F.col("_place") + F.coalesce("_have", F.lit(0))).drop("_place", "_have")


def subset(df: DataFrame, key: str, start: int, end: int) -> DataFrame:
    """Rows whose key has place start .. end - 1 in key order; only the first ``end`` keys are ranked."""
    keys = df.select(key).distinct().orderBy(key).limit(end)
    w = Window.orderBy(key)
    chosen = keys.withColumn("_k", F.row_number().over(w) - 1).where((F.col("_k") >= start) & (F.col("_k") < end)).select(key)
    return df.join(chosen, key, "left_semi")


def chunked(df: DataFrame, key: str, per_file: int) -> DataFrame:
    """Adds index (place in key order, dense when keys are) and chunk, for files of a fixed number of rows.

    Places come from the counts of the ranges before each row's own, so no single task ranks all rows.
    """
    from .rounds import running

    out = running(df, [F.col(key)], {"index": F.lit(1)}).withColumn("index", F.col("index") - 1)
    return out.withColumn("chunk", F.floor(F.col("index") / per_file))


def write_tensors(df: DataFrame, key: str, path: str, per_file: int = 1000) -> None:
    chunked(df, key, per_file).repartition("chunk").write.partitionBy("chunk").parquet(path)


def datapoint(spark: SparkSession, path: str, i: int, per_file: int = 1000) -> DataFrame:
    """One row by its index; only its chunk is read."""
    return spark.read.parquet(path).where((F.col("chunk") == i // per_file) & (F.col("index") == i))


def pending(views: DataFrame, outputs: DataFrame, key: str, kinds: int) -> DataFrame:
    """Views that don't have all kinds of output yet."""
    done = outputs.groupBy(key).agg(F.count_distinct("kind").alias("n")).where(F.col("n") >= kinds).select(key)
    return views.join(done, key, "left_anti")


def passing(metadata: DataFrame, filters: dict[str, tuple[float, float]]) -> DataFrame:
    """Objects that have every named value, all within their bounds."""
    ok = F.lit(False)
    for name, (lo, hi) in filters.items():
        ok = ok | ((F.col("name") == name) & F.col("value").between(lo, hi))
    good = metadata.where(F.col("name").isin(list(filters))).groupBy("object_id").agg(F.count_distinct(F.when(ok, F.col("name"))).alias("n"))
    return good.where(F.col("n") == len(filters)).select("object_id")


def grasp_metrics(grasps: DataFrame, metrics: DataFrame) -> DataFrame:
    """Grasps with their metrics as a map; without any, an empty one."""
    m = metrics.groupBy("object_id", "grasp_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    return grasps.join(m, ["object_id", "grasp_id"], "left").withColumn("metrics", F.coalesce("metrics", F.create_map().cast("map<string,double>")))


def sorted_grasps(grasps: DataFrame, metrics: DataFrame, metric: str) -> DataFrame:
    """Grasps by a metric, highest first; an unknown metric is an error."""
    m = metrics.where(F.col("metric") == metric)
    if not m.head(1):
        raise ValueError(f"no metric {metric}")
    return grasps.join(m.select("object_id", "grasp_id", "value"), ["object_id", "grasp_id"]).orderBy(F.desc("value"), "object_id", "grasp_id")


def best_grasp(metrics: DataFrame, metric: str) -> DataFrame:
    best = metrics.where(F.col("metric") == metric).groupBy("object_id").agg(F.max(F.struct("value", (-F.col("grasp_id")).alias("g"))).alias("x"))
    return best.select("object_id", (-F.col("x.g")).alias("grasp_id"), F.col("x.value").alias("value"))


def rank_grasps(scored: DataFrame, key: str, n: int = 1) -> DataFrame:
    from .points import cap_per_group

    return cap_per_group(scored, [key], [F.desc("score"), "grasp_id"], n)


def scale_metric(df: DataFrame, key: str, value: str, least: float) -> DataFrame:
    """Min-max scaling within a key, 1 when all are equal; values at or below ``least`` go."""
    b = df.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    kept = df.where(F.col(value) > least).join(b, key)
    return kept.withColumn("scaled", F.when(F.col("_hi") == F.col("_lo"), 1.0).otherwise((F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)))).drop("_lo", "_hi")


def available_metrics(metrics: DataFrame) -> DataFrame:
    """Of each object: how many metrics and grasps (object_id, grasp_id, metric) it has, and the metrics' names.

    Metrics and grasps are told apart one after the other, by plain sums: counted side by side, each row would be shuffled
    once for each of them, and sets of names would be sorted and spilled.
    """
    names = metrics.groupBy("object_id", "metric").agg(F.lit(0).cast("long").alias("n"))
    grasps = metrics.groupBy("object_id", "grasp_id").count().groupBy("object_id").agg(F.count("grasp_id").alias("n")).select("object_id", F.lit(None).cast("string").alias("metric"), "n")
    both = names.union(grasps).groupBy("object_id")
    return both.agg(F.count("metric").alias("n_metrics"), F.sum("n").alias("n_grasps"), F.array_join(F.sort_array(F.collect_set("metric")), ",").alias("names"))


def names(table: DataFrame, column: str) -> DataFrame:
    return table.select(column).distinct()


def label_entities(df: DataFrame, key: str) -> DataFrame:
    """Dense numbers for the values of a key; only the distinct values are ranked."""
    from .rounds import running

    k = running(df.select(key).distinct(), [F.col(key)], {"number": F.lit(1)})
    return df.join(k.withColumn("number", F.col("number") - 1), key)


def training_index(grasps: DataFrame, transforms: DataFrame, per_file: int) -> DataFrame:
    """Grasps of objects that have a transform, at most per_file of each."""
    from .points import cap_per_group

    return cap_per_group(grasps.join(transforms, "cloud_id"), ["cloud_id"], ["grasp_id"], per_file)


def metadata_conflicts(requested: DataFrame, stored: DataFrame) -> DataFrame:
    return requested.intersect(stored)


class Metadata:
    """Named functions of an object's rows, each an aggregate column; all are computed in one pass."""

    def __init__(self):
        self.functions: dict[str, Column] = {}

    def register(self, name: str, column: Column) -> None:
        if not isinstance(column, Column):
            raise TypeError("a metadata function is an aggregate column")
        self.functions[name] = column

    def compute(self, rows: DataFrame, key: str, wanted: list[str], stored: DataFrame | None = None, overwrite: bool = False) -> DataFrame:
        """(key, name, value) of the wanted names; those stored already are left out unless ``overwrite``."""
        for name in wanted:
            if name not in self.functions:
                raise KeyError(name)
        wide = rows.groupBy(key).agg(*[self.functions[n].cast("double").alias(n) for n in wanted])
        out = wide.unpivot([key], wanted, "name", "value")
        return out if overwrite or stored is None else out.join(stored.select(key, "name"), [key, "name"], "left_anti")
