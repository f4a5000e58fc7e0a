"""Paths on any Hadoop file system."""

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or at least one file of a pattern, is there."""
    hadoop, system = _path(spark, path)
    return bool(system.globStatus(hadoop))


def complete_partitions(spark: SparkSession, path: str, name: str) -> list[int]:
    """Values of ``name=<number>`` folders whose write was committed."""
    hadoop, system = _path(spark, f"{path}/{name}=*/_SUCCESS")
    found = system.globStatus(hadoop) or []
    return sorted(int(status.getPath().getParent().getName().split("=", 1)[1]) for status in found)


def delete(spark: SparkSession, path: str) -> None:
    hadoop, system = _path(spark, path)
    system.delete(hadoop, True)
