"""Parquet tables as inputs."""

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table, in the splits that spark.sql.files.maxPartitionBytes gives."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows over all cores, for costly text work after a scan.

    Files of a few large row groups have fewer splits than there are cores. Only
    then are the rows, cut to the columns that are needed, dealt out by a hash
    of ``key``; a scan with enough splits is left as it is, without a shuffle.
    """
    if rows.isStreaming:
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, key)
