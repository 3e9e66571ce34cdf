"""Cutting lineage in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of a table that is small against the input (frontiers, links, labels)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def own_dir(spark: SparkSession) -> str:
    """The folder of this application's stored tables within the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/graphloom-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, for tables that several branches read.

    It stays until ``clear`` is called, as lost executors may need it again.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> bool:
    """Deletes all that this application has stored, once no table that reads it is needed; whether there was any."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    return bool(path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True))
