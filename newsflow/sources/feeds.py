"""Landed feed files, pages and JSON batches."""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from newsflow.functions.text import strip
from newsflow.operators.feed import project_items
from newsflow.schemas import FEED_ITEM, FEED_XML_ITEM, INCOMING_ARTICLE, LANDED_PAGE
from newsflow.sources.files import exists


def _entries(reader, path: str) -> DataFrame:
    """Entries of feed files with the full path of their file as ``snapshot_id``.

    Files of one name in different folders are different snapshots. A file is
    read whole by one task.
    """
    entries = reader.format("xml").option("rowTag", "item").option("multiLine", True).schema(FEED_XML_ITEM).load(path)
    return entries.withColumn("snapshot_id", F.col("_metadata.file_path"))


def feed_items(entries: DataFrame, source: str, fetched_at=None) -> DataFrame:
    """Feed items of entries that lie in the order of their files; positions begin at 0 in each file."""
    at = F.monotonically_increasing_id()
    first = F.min("feed_at").over(Window.partitionBy("snapshot_id"))
    placed = entries.withColumn("feed_at", at).withColumn("feed_pos", F.col("feed_at") - first)
    return project_items(placed, source, fetched_at)


def read_feed(spark: SparkSession, path: str, source: str, fetched_at=None) -> DataFrame:
    """Feed items of landed RSS files; one file is one snapshot, named by its full path."""
    return feed_items(_entries(spark.read, path), source, fetched_at)


def stream_feed(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Landed RSS files as a stream of entries; ``feed_step`` turns a micro-batch into items.

    A file is in one micro-batch as a whole, so positions are given there.
    """
    reader = spark.readStream
    return _entries(reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch), path)


def feed_step(source: str, step, fetched_at=None):
    """``step`` over the feed items of each micro-batch of ``stream_feed``."""
    return lambda batch, batch_id: step(feed_items(batch, source, fetched_at), batch_id)


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType = FEED_ITEM) -> DataFrame:
    """Rows of a JSON list. A missing file is empty; bad JSON and a non-list are errors."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    # Only the first character of each file leaves the scan.
    first = F.substring(strip(F.col("value")), 1, 1)
    roots = spark.read.text(path, wholetext=True).select(first.alias("root")).filter("root <> '['")
    if not roots.isEmpty():
        raise ValueError(f"expected a JSON list in {path}")
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """The batch of scraped articles; a missing file is a batch without work."""
    return read_snapshot(spark, path, INCOMING_ARTICLE)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages (url, html); only these two columns are read."""
    return spark.read.parquet(path).select(*LANDED_PAGE.names)
