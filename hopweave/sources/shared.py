"""Tables that are written once and read again, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where none is set, a folder of this application in the warehouse, which goes when the application ends."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/hopweave-{spark.sparkContext.applicationId}"
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(own)
    files.deleteOnExit(own)
    return path


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder, which is also where checkpoints go from now on unless a place was set."""
    found = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read again: it is computed once, and lost executors cost none of it."""
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
    """What written() gives, in buckets by a column: joins and groups by it need no shuffle. df should be dealt likewise."""
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, by).option("path", f"{checkpoint_folder(df.sparkSession)}/{table}").saveAsTable(table)
    found = df.sparkSession.table(table)
    df.sparkSession.sql(f"DROP TABLE {table}")  # its files stay
    return found
