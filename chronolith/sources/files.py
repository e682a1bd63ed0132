"""Small steps on folders of tables, by Hadoop's file systems, so that any store Spark reads will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def located(spark: SparkSession, path: str):
    """(file system, path) as the JVM sees them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = located(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = located(spark, path)
    fs.delete(at, True)


def create_new(spark: SparkSession, path: str) -> bool:
    """Makes an empty file; false if there is one already."""
    fs, at = located(spark, path)
    if fs.exists(at):
        return False
    try:
        fs.create(at, False).close()
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it isn't there."""
    fs, at = located(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path``, without rows if nothing has been written there."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
