"""Lexicon filter, defaults and constraints of article rows."""

from pyspark.sql import DataFrame, functions as F

from newsflow.functions.articles import rejection_reason
from newsflow.functions.lexicon import CRYPTO_ASSETS, Lexicon, mentions_asset
from newsflow.functions.text import article_body, full_text


def with_full_text(articles: DataFrame) -> DataFrame:
    """Add ``body`` (first filled of the text columns) and ``text`` (title and body)."""
    return articles.withColumn("body", article_body(articles.columns)).withColumn(
        "text", full_text(F.col("title"), F.col("body"))
    )


def filter_assets(articles: DataFrame, lexicon: Lexicon = CRYPTO_ASSETS, text: str = "text") -> DataFrame:
    """Articles whose text names an asset of the lexicon."""
    return articles.filter(mentions_asset(F.col(text), lexicon))


def label_assets(articles: DataFrame, lexicon: Lexicon = CRYPTO_ASSETS, text: str = "text") -> DataFrame:
    """All articles with status PASSED or DROPPED by the same rule."""
    return articles.withColumn("status", F.when(mentions_asset(F.col(text), lexicon), "PASSED").otherwise("DROPPED"))


def with_defaults(rows: DataFrame) -> DataFrame:
    """Fill is_redundant, novelty_label and created_at where they are missing."""
    defaults = {
        "is_redundant": F.lit(False),
        "novelty_label": F.lit("High"),
        "created_at": F.current_timestamp(),
    }
    filled = {
        name: F.coalesce(F.col(name), value) if name in rows.columns else value for name, value in defaults.items()
    }
    return rows.withColumns(filled)


def valid_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(rejection_reason(rows.columns).isNull())


def rejected_rows(rows: DataFrame) -> DataFrame:
    """Rows that break a rule of the article table, with the first broken rule."""
    return rows.withColumn("reason", rejection_reason(rows.columns)).filter("reason is not null")
