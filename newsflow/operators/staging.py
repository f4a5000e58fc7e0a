"""Intermediate tables in the folder all executors share.

A plan that reads an intermediate result several times writes it once as
Parquet: lineage ends there, a lost executor costs no recomputation, later
reads prune columns and the optimizer sees real sizes.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get(SETTING, None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"{SETTING} must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="newsflow-"))
        folder = context.getCheckpointDir()
    return folder


class Staging:
    """One job's intermediate tables. ``drop`` removes them when the job is done.

    A result that is read later still needs them, so nobody may be there to
    drop them; what is left goes when the application ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/newsflow/{uuid.uuid4().hex}"
        path, files = self._files()
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _files(self):
        """(the folder, its file system) in the JVM."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def table(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def result(self, frame: DataFrame, name: str) -> DataFrame:
        """The table of a job's result; the job's other tables are removed."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        frame.write.parquet(path)
        root, files = self._files()
        for entry in files.listStatus(root):
            if not path.endswith(f"/{entry.getPath().getName()}"):
                files.delete(entry.getPath(), True)
        return self.spark.read.schema(frame.schema).parquet(path)

    def discard(self, name: str) -> None:
        """Remove the job's tables of that name, which nothing reads any more."""
        root, files = self._files()
        for entry in files.listStatus(root):
            if entry.getPath().getName().rpartition("-")[0] == name:
                files.delete(entry.getPath(), True)

    def drop(self) -> None:
        path, files = self._files()
        files.delete(path, True)


def staging_for(frame: DataFrame, staging: Staging | None) -> Staging:
    return staging or Staging(frame.sparkSession)
