"""Counts that describe a run."""

from pyspark.sql import DataFrame, functions as F


def run_summary(items: DataFrame, scraped: DataFrame) -> DataFrame:
    """One row: rss_items, new_items, scrape_success, scrape_failed."""
    status = F.coalesce(F.col("scrape_status"), F.lit("none"))
    kinds = items.select(F.lit("item").alias("kind")).unionByName(scraped.select(status.alias("kind")))
    return kinds.agg(
        F.count_if(F.col("kind") == "item").alias("rss_items"),
        F.count_if(F.col("kind") != "item").alias("new_items"),
        F.count_if(F.col("kind") == "success").alias("scrape_success"),
        F.count_if(F.col("kind") == "failed").alias("scrape_failed"),
    )


def batch_size(articles: DataFrame) -> DataFrame:
    return articles.agg(F.count(F.lit(1)).alias("articles"))


def with_disposition(labelled: DataFrame) -> DataFrame:
    """``disposition`` per article: DROPPED, Redundant or Unique."""
    return labelled.withColumn(
        "disposition",
        F.when(F.col("status") == "DROPPED", "DROPPED").when(F.col("is_redundant"), "Redundant").otherwise("Unique"),
    )


def disposition_report(labelled: DataFrame, *by: str) -> DataFrame:
    return with_disposition(labelled).groupBy(*by, "disposition").agg(F.count(F.lit(1)).alias("articles"))
