"""Feed items: projection, head of the feed, usable items."""

from pyspark.sql import DataFrame, Window, functions as F

from newsflow.functions.text import strip
from newsflow.schemas import FEED_ITEM

# Fixed value: how many entries of a feed are looked at.
FEED_LIMIT = 25


def parsed_date(text):
    """Timestamp of an RSS date with or without the day name; null when malformed."""
    return F.try_to_timestamp(F.regexp_replace(text, "^[A-Za-z]{3}, *", ""), F.lit("d MMM yyyy HH:mm:ss Z"))


def project_items(entries: DataFrame, source: str, fetched_at=None) -> DataFrame:
    """Feed entries (title, link, ...) with snapshot_id and feed_pos as feed items.

    Text is stripped except the raw date and the categories. An empty guid
    falls back to the link.
    """

    def text(name):
        return F.coalesce(F.col(name), F.lit(""))

    url = strip(text("link"))
    guid = strip(F.coalesce(F.nullif(F.col("guid._VALUE"), F.lit("")), url))
    return entries.select(
        "snapshot_id",
        F.col("feed_pos").cast("bigint").alias("feed_pos"),
        F.lit(source).alias("source"),
        guid.alias("guid"),
        strip(text("title")).alias("title"),
        strip(text("description")).alias("rss_summary"),
        url.alias("url"),
        text("pubDate").alias("published_at"),
        parsed_date(F.col("pubDate")).alias("published_ts"),
        F.coalesce(F.col("category"), F.array().cast("array<string>")).alias("categories"),
        (F.current_timestamp() if fetched_at is None else F.lit(fetched_at).cast("timestamp")).alias("rss_fetched_at"),
    ).select(*FEED_ITEM.names)


def feed_head(items: DataFrame, limit: int = FEED_LIMIT) -> DataFrame:
    """First entries of each snapshot. Cut before unusable ones are dropped.

    Spark keeps at most ``limit`` rows per snapshot and task before shuffling.
    """
    order = Window.partitionBy("snapshot_id").orderBy("feed_pos")
    return items.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= limit).drop("_rank")


def usable_items(items: DataFrame) -> DataFrame:
    """Items with a guid or a url."""
    return items.filter((F.col("guid") != "") | (F.col("url") != ""))


def require_items(items: DataFrame) -> DataFrame:
    """The items, or an error when there is none."""
    if items.isEmpty():
        raise ValueError("the feed holds no usable item")
    return items
