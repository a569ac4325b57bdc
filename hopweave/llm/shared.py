"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from hopweave.sources.shared import checkpoint_folder as folder
from hopweave.sources.shared import written

__all__ = ["Scratch", "cut", "folder", "written"]


class Scratch:
    """Tables of one call of an operator; drop() removes those that its result does not read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{folder(spark)}/scratch-{uuid.uuid4().hex}"
        self.held: dict[str, list[str]] = {}

    def written(self, df: DataFrame, name: str, last: bool = False) -> DataFrame:
        """df written and read again; last: for good, since the result reads it."""
        path = f"{self.path}{'-result' if last else ''}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        if not last:
            self.held.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, path: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def forget(self, *names: str, newest: int = 0) -> None:
        """Removes tables of these names, but for the newest."""
        for name in names:
            paths = self.held.pop(name, [])
            self.held[name] = paths[len(paths) - newest :] if newest else []
            for path in paths[: len(paths) - newest]:
                self._delete(path)

    def drop(self) -> None:
        self._delete(self.path)


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed, so that a loop's plan and lineage stay short."""
    folder(df.sparkSession)
    return df.checkpoint()
