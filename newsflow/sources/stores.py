"""Snapshot store and article table: Parquet folders written batch by batch.

A batch lives in its own partition folder, so writing it again replaces it,
and a batch counts only once its write was committed.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from newsflow.schemas import FEED_ITEM, POSTING, SPARSE_VECTOR, news_article
from newsflow.sources.files import complete_partitions, delete


class BatchStore:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _folder(self, batch: int) -> str:
        return f"{self.path}/batch={batch}"

    def batches(self) -> list[int]:
        return complete_partitions(self.spark, self.path, "batch")

    def write(self, rows: DataFrame, batch: int) -> None:
        """Replace one batch."""
        rows.select(*self.schema.names).write.mode("overwrite").parquet(self._folder(batch))

    def read(self, batches: list[int] | None = None) -> DataFrame:
        """Rows of the given batches (default: all complete ones); empty when there is none."""
        batches = self.batches() if batches is None else batches
        if not batches:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[self._folder(b) for b in batches])

    def before(self, batch: int) -> list[int]:
        return [b for b in self.batches() if b < batch]

    def reset(self) -> None:
        delete(self.spark, self.path)


class SnapshotStore(BatchStore):
    """The feed snapshots of past runs; the newest complete one is the history."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, FEED_ITEM)

    def latest(self, before: int | None = None) -> DataFrame:
        known = self.batches() if before is None else self.before(before)
        return self.read(known[-1:])


class ArticleStore(BatchStore):
    """The article table."""

    def __init__(self, spark: SparkSession, path: str, vector: T.DataType = SPARSE_VECTOR):
        super().__init__(spark, path, news_article(vector))

    @staticmethod
    def next_id(articles: DataFrame) -> int:
        """1 for an empty or reset table, else one above the largest id."""
        return (articles.agg(F.max("id")).first()[0] or 0) + 1

    def next_id_after(self, batches: list[int]) -> int:
        """As ``next_id``; ids rise with the batches, so the last one with rows tells, and only it is read."""
        for batch in reversed(batches):
            last = self.read([batch]).agg(F.max("id")).first()[0]
            if last is not None:
                return last + 1
        return 1


class PostingStore(BatchStore):
    """The terms of the article table's sparse vectors, appended per batch and kept by bucket."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, POSTING)

    def write(self, rows: DataFrame, batch: int) -> None:
        by_bucket = rows.select(*self.schema.names).repartition("bucket").sortWithinPartitions("bucket", "term")
        by_bucket.write.mode("overwrite").partitionBy("bucket").parquet(self._folder(batch))

    def read(self, batches: list[int] | None = None) -> DataFrame:
        batches = self.batches() if batches is None else batches
        if not batches:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*[self._folder(b) for b in batches])
        return rows.select(*self.schema.names)
