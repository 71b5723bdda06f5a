"""The catalog on disk: a Parquet table for each kind of entity, partitioned by dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = {"objects": ["object_id"], "grasps": ["object_id", "gripper", "grasp_id"], "metrics": ["object_id", "gripper", "grasp_id", "metric"], "stable_poses": ["object_id", "pose_id"], "metadata": ["object_id", "name"]}


class Catalog:
    def __init__(self, spark: SparkSession, root: str, dataset: str):
        self.spark, self.root, self.dataset = spark, root, dataset

    def _path(self, entity: str) -> str:
        return f"{self.root}/{entity}/dataset={self.dataset}"

    def exists(self, entity: str) -> bool:
        """Whether the table is there. One that a broken-off replacement left aside is put back first."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(entity))
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            return True
        aside = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_{entity}-{self.dataset}-old")
        return fs.exists(aside) and fs.rename(aside, path)

    def read(self, entity: str) -> DataFrame:
        self.exists(entity)
        return self.spark.read.parquet(self._path(entity))

    def store(self, entity: str, new: DataFrame, force_overwrite: bool = False) -> None:
        """Append rows whose keys are absent. Keys that are there: an error, or with force_overwrite their rows are replaced."""
        from ..operators.catalog import upsert

        keys = KEYS[entity]
        if not self.exists(entity):
            new.write.parquet(self._path(entity))
        elif not force_overwrite:
            if new.join(self.read(entity).select(*keys), keys, "left_semi").head(1):
                raise ValueError(f"{entity} are stored already")
            new.write.mode("append").parquet(self._path(entity))
        else:
            self._replace(entity, upsert(self.read(entity), new, keys))

    def delete(self, entity: str, keys: DataFrame) -> None:
        from ..operators.catalog import delete

        self._replace(entity, delete(self.read(entity), keys, keys.columns))

    def _replace(self, entity: str, rows: DataFrame) -> None:
        """Write beside, put the old table aside, swap: a failure at any point leaves the old table, at its place or aside."""
        side = f"{self.root}/_{entity}-{self.dataset}"
        rows.write.mode("overwrite").parquet(side)
        jvm = self.spark._jvm
        old, new = jvm.org.apache.hadoop.fs.Path(self._path(entity)), jvm.org.apache.hadoop.fs.Path(side)
        fs = old.getFileSystem(self.spark._jsc.hadoopConfiguration())
        aside = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_{entity}-{self.dataset}-old")
        fs.delete(aside, True)
        if not fs.rename(old, aside):
            raise OSError(f"can't put {old} aside")
        if not fs.rename(new, old):
            fs.rename(aside, old)
            raise OSError(f"can't put {new} in its place")
        fs.delete(aside, True)

    def grasps(self, object_id, gripper: str) -> DataFrame:
        return self.read("grasps").where((F.col("object_id") == object_id) & (F.col("gripper") == gripper))

    def stable_poses(self, object_id, min_p: float = 0.0) -> DataFrame:
        return self.read("stable_poses").where((F.col("object_id") == object_id) & (F.col("p") > min_p))
