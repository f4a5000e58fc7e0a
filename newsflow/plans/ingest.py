"""From feed items to scraped articles."""

from pyspark.sql import DataFrame

from newsflow.operators.feed import FEED_LIMIT, feed_head, require_items, usable_items
from newsflow.operators.incremental import find_new
from newsflow.operators.pages import item_page_join, with_scrape_status
from newsflow.operators.reports import run_summary


def new_items(items: DataFrame, history: DataFrame, limit: int | None = FEED_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(usable items of the head of the feed, those of them that the history does not hold)."""
    head = items if limit is None else feed_head(items, limit)
    current = require_items(usable_items(head))
    return current, find_new(current, history)


def scrape(fresh: DataFrame, pages: DataFrame, scraped_at=None, landed: str | None = None) -> DataFrame:
    """Articles with body and status from the latest landed page of each item (see ``item_page_join``)."""
    return with_scrape_status(item_page_join(fresh, pages, landed=landed), scraped_at)


def ingest(
    items: DataFrame,
    history: DataFrame,
    pages: DataFrame,
    limit: int | None = FEED_LIMIT,
    scraped_at=None,
    landed: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(current items, new articles with body and status, run summary).

    Head of the feed, usable items, items not in the history, their pages,
    clean bodies. The current items become the next history, so a feed without
    usable items is an error, raised before any state could move.
    """
    current, fresh = new_items(items, history, limit)
    articles = scrape(fresh, pages, scraped_at, landed)
    return current, articles, run_summary(current, articles)
