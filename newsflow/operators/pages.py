"""Items and their landed pages: join, main text, status."""

from pyspark.sql import DataFrame, functions as F

from newsflow.functions.html import main_text
from newsflow.functions.text import clean_body, let
from newsflow.operators.skew import lookup

# Fixed value: the error of a page without article text.
NO_CONTENT = "no main article content was extracted"
NO_PAGE = "no page was landed for this url"


def item_page_join(items: DataFrame, pages: DataFrame, item_id="feed_pos", landed: str | None = None) -> DataFrame:
    """Items with the html landed under their exact url, null when there is none.

    Pages of other urls are dropped before any html moves. Of several pages of
    one url the latest by the column ``landed`` counts, ties and the default
    by the html itself, so an item stays one row.
    """
    asked = items.select("url").filter("url is not null").distinct()
    latest = F.struct(*[F.col(c) for c in ([landed] if landed else []) + ["html"]])
    wanted = pages.join(asked, "url", "left_semi").groupBy("url").agg(F.max_by("html", latest).alias("html"))
    return lookup(items, wanted, "url", spread_by=item_id)


def with_scrape_status(joined: DataFrame, scraped_at=None) -> DataFrame:
    """Replace html by full_body, scrape_status and scrape_error.

    The body is computed once, in its own projection; status and error only
    look at it.
    """
    body = joined.withColumn("full_body", let(clean_body(main_text(F.col("html"))), lambda b: F.nullif(b, F.lit(""))))
    found = F.col("full_body").isNotNull()
    return (
        body.withColumn("scraped_at", F.current_timestamp() if scraped_at is None else F.lit(scraped_at).cast("timestamp"))
        .withColumn("scrape_status", F.when(found, "success").otherwise("failed"))
        .withColumn("scrape_error", F.when(found, F.lit(None).cast("string")).when(F.col("html").isNull(), NO_PAGE).otherwise(NO_CONTENT))
        .drop("html")
    )


def successful(scraped: DataFrame) -> DataFrame:
    return scraped.filter(F.col("scrape_status") == "success")
