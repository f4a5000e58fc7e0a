"""The given tables seen as news data: articles, feed items, pages, mentions.

The tables hold no crypto news, so lexicon and dictionary are parameters that
occur in them; everything else is taken as it is, whole.
"""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from newsflow.functions.lexicon import Lexicon
from newsflow.operators.articles import with_full_text
from newsflow.operators.staging import Staging
from newsflow.schemas import FEED_ITEM
from newsflow.sources.tables import read_table, spread

LEXICON = Lexicon(names=("apache", "license"), tickers=("MIT",))
DICTIONARY = {"APACHE": "asset_apache", "LICENSE": "asset_license", "MIT": "asset_mit"}
EVENT_DICTIONARY = {"CLICK": "asset_click", "VIEW": "asset_view", "ERROR": "asset_error", "PURCHASE": "asset_order"}
PAGE_TAIL = " - 1 - 2 - 3 tail"
# Parts planted into pages.
PLANTED_TABLE = '<table><tr><td>a<TABLE x="1"><td>b</td></TABLE>c<table>d</table></td></tr></table><nav>e<nav>f</nav>g</nav>'
PLANTED_REFERENCES = "<p>&#38;lt;b&#38;gt; &eacute;&trade;&#x41; &amp;amp; &unknown; &#0; &</p>"
# Groups of days that land one after the other.
LANDINGS = 9
FEED_FILE_ITEMS = 50
# Micro-batches into which the sources of documents are dealt in order.
SOURCE_LANDINGS = 3
# Share of the redundant vectors that the approximate variant finds at least.
LSH_RECALL = 0.95
# No pair of the given vectors or texts is within 1e-6 of these distances.
VECTOR_DISTANCE = 0.7
TEXT_DISTANCE = 0.2


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """documents as articles: the first line is the title."""
    rows = read_table(spark, folder, "documents").select("doc_id", "text", "source", "lang")
    return with_full_text(
        spread(rows, "doc_id").select(
            "doc_id",
            F.substring_index("text", "\n", 1).alias("title"),
            F.col("text").alias("full_body"),
            "source",
            "lang",
            F.col("source").alias("snapshot_id"),
            F.col("doc_id").alias("feed_pos"),
        )
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text) for queries that work on every character."""
    return spread(read_table(spark, folder, "documents").select("doc_id", "text"), "doc_id")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("seq"), "embedding", "label")


def _items(frame: DataFrame, **columns) -> DataFrame:
    """Feed items with the given columns; the others are null."""
    return frame.select(
        [columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FEED_ITEM.fields]
    )


def daily_items(spark: SparkSession, folder: str) -> DataFrame:
    """events as feed items: a snapshot per day, one guid per user."""
    return _items(
        read_table(spark, folder, "events"),
        snapshot_id=F.date_format("ts", "yyyy-MM-dd"),
        feed_pos=F.col("event_id"),
        guid=F.col("user_id").cast("string"),
        url=F.lit(""),
    )


def keyed_items(spark: SparkSession, folder: str) -> DataFrame:
    """events as items with a guid and a url of their own; errors have neither."""
    error = F.col("event_type") == "error"
    number = F.get_json_object("props", "$.k")
    guid = F.concat_ws("-", "user_id", "event_type", number)
    url = F.concat(F.lit("https://N.example/"), F.col("user_id"), F.lit("/"), number, F.lit("/?utm_source="), F.col("event_type"))
    return _items(
        spread(read_table(spark, folder, "events"), "event_id"),
        snapshot_id=F.date_format("ts", "yyyy-MM-dd"),
        feed_pos=F.col("event_id"),
        guid=F.when(error, "").otherwise(guid),
        url=F.when(error, "").otherwise(url),
    )


def page_items(spark: SparkSession, folder: str) -> DataFrame:
    """pages as one feed snapshot. Feed urls carry no utm_source, so the pages
    landed under a url with one are not found."""
    return _items(
        read_table(spark, folder, "pages").select("page_id", "url"),
        snapshot_id=F.lit("run"),
        feed_pos=F.col("page_id"),
        guid=F.concat(F.lit("page-"), F.col("page_id")),
        url=F.replace("url", F.lit("?utm_source=feed"), F.lit("")),
    )


def titled_page_items(spark: SparkSession, folder: str, run: int) -> DataFrame:
    """page_items with titles: run 0 has the even ones, run 1 all. Every fifth has no title, every third names an asset."""
    number = F.col("feed_pos")
    named = F.when(number % 3 == 0, F.concat(F.lit("apache "), number)).otherwise(F.concat(F.lit("page "), number))
    items = page_items(spark, folder).withColumn("title", F.when(number % 5 != 0, named))
    items = items.withColumn("snapshot_id", F.lit(f"run {run}"))
    return items if run else items.filter(number % 2 == 0)


def landed_feed(spark: SparkSession, folder: str) -> str:
    """pages as feed files of ``FEED_FILE_ITEMS`` items each; the pattern of their paths."""
    root = f"{Staging(spark).root}/feeds"
    pages = read_table(spark, folder, "pages").select("page_id", "url")
    number = F.floor(F.col("page_id") / FEED_FILE_ITEMS).alias("snapshot")
    item = F.concat(
        F.lit("<item><title>Page "), "page_id", F.lit(" &amp; more</title><link> "), F.replace("url", F.lit("&"), F.lit("&amp;")),
        F.lit("</link><guid>page-"), "page_id", F.lit("</guid><pubDate>Mon, 05 Jan 2026 10:20:30 +0000</pubDate></item>"),
    )
    lines = pages.select(number, F.col("page_id").alias("pos"), item.alias("line"))
    files = pages.select(number).distinct()
    head = files.select("snapshot", F.lit(-1).cast("bigint").alias("pos"), F.lit("<rss><channel><title>c</title>").alias("line"))
    tail = files.select("snapshot", F.lit((1 << 63) - 1).alias("pos"), F.lit("</channel></rss>").alias("line"))
    lines = lines.unionByName(head).unionByName(tail).repartition("snapshot").sortWithinPartitions("snapshot", "pos")
    lines.select("snapshot", "line").write.partitionBy("snapshot").text(root)
    return f"{root}/*/*.txt"


def landed_json(spark: SparkSession, folder: str) -> str:
    """pages as files with a JSON list of items each; the pattern of their paths."""
    root = f"{Staging(spark).root}/snapshots"
    number = F.floor(F.col("page_id") / FEED_FILE_ITEMS)
    record = F.to_json(
        F.struct(
            F.concat(F.lit("day "), number).alias("snapshot_id"), F.col("page_id").alias("feed_pos"), "url",
            F.concat(F.lit("page-"), "page_id").alias("guid"), F.substring("html", 1, 40).alias("title"),
            F.array(F.lit("a"), F.col("page_id").cast("string")).alias("categories"), F.lit(1).alias("unknown"),
        )
    )
    pages = read_table(spark, folder, "pages").select("page_id", number.alias("snapshot"), record.alias("record"))
    # Brackets go to the first and the last row of a list. Rows of their own would come by a union, whose two
    # sides Spark may cut into partitions differently: then a list lies in two files.
    whole = Window.partitionBy("snapshot")
    placed = pages.select("snapshot", "record", F.row_number().over(whole.orderBy("page_id")).alias("pos"), F.count(F.lit(1)).over(whole).alias("rows"))
    opened = F.concat(F.when(F.col("pos") == 1, "[").otherwise(","), "record")
    line = F.concat(opened, F.when(F.col("pos") == F.col("rows"), "]").otherwise(""))
    lines = placed.select("snapshot", "pos", line.alias("line")).repartition("snapshot").sortWithinPartitions("snapshot", "pos")
    lines.select("snapshot", "line").write.partitionBy("snapshot").text(root)
    return f"{root}/*/*.txt"


def page_history(spark: SparkSession, folder: str) -> DataFrame:
    """labels as the previous snapshot of page_items."""
    return _items(
        read_table(spark, folder, "labels"),
        snapshot_id=F.lit("earlier"),
        feed_pos=F.col("doc_id"),
        guid=F.concat(F.lit("page-"), F.col("doc_id")),
        url=F.lit(""),
    )


def event_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """events as mentions: one article per user, the value as score."""
    return read_table(spark, folder, "events").select(
        F.col("user_id").alias("article_id"),
        F.col("event_id").alias("pos"),
        F.concat(F.lit("▁"), F.col("event_type"), F.lit(" ")).alias("word"),
        (F.col("value") / 20).alias("score"),
    )
