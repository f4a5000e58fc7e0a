"""From scraped articles to rows of the article table."""

from pyspark.sql import Column, DataFrame, functions as F

from newsflow.functions.lexicon import CRYPTO_ASSETS, Lexicon
from newsflow.functions.vectors import term_vector
from newsflow.operators.articles import filter_assets, valid_rows, with_defaults, with_full_text
from newsflow.operators.entities import embed_with, with_entities
from newsflow.operators.ids import dense_ids
from newsflow.operators.novelty import DISTANCE_THRESHOLD, flag_redundant
from newsflow.operators.staging import Staging, staging_for
from newsflow.schemas import news_article
from newsflow.sources.stores import ArticleStore


def three_word_vector(text: Column) -> Column:
    """Default vector of an article: its runs of three words."""
    return term_vector(text, ngram=3)


def detect_novelty(
    articles: DataFrame,
    stored: DataFrame | None = None,
    start_id: int = 1,
    order_by: list[str] = ("snapshot_id", "feed_pos"),
    vector=three_word_vector,
    make_encoder=None,
    threshold: float = DISTANCE_THRESHOLD,
    staging: Staging | None = None,
    postings: DataFrame | None = None,
) -> DataFrame:
    """``articles`` (with ``text``) in arrival order with id, embedding, is_redundant, novelty_label.

    Vectors come from the column function ``vector`` or, when given, from the
    caller's own model (see ``embed_with``). ``stored`` rows (id, embedding),
    or the ``postings`` of sparse ones, all count as earlier.
    """
    staging = staging_for(articles, staging)
    # Written first, because the sort looks at its input twice.
    articles = staging.table(articles, "articles")
    numbered = dense_ids(articles, list(order_by), start_id, "id", staging)
    if make_encoder is None:
        embedded = numbered.withColumn("embedding", vector(F.col("text")))
    else:
        embedded = embed_with(numbered, make_encoder)
    embedded = staging.table(embedded.withColumn("seq", F.col("id")), "embedded")
    corpus = None if stored is None else stored.select(F.col("id").alias("seq"), "embedding")
    return flag_redundant(embedded, corpus, threshold, staging=staging, postings=postings).drop("seq")


def process_articles(
    articles: DataFrame,
    stored: DataFrame | None = None,
    lexicon: Lexicon = CRYPTO_ASSETS,
    dictionary: dict | None = None,
    extra_names=("ripple", "binance coin"),
    created_at=None,
    start_id: int | None = None,
    **options,
) -> DataFrame:
    """Rows for the article table: every article that names an asset, redundant or not.

    The cheap text filter comes first, vectors only for what passes it, and
    entities only for what is not redundant.
    """
    # Rows that the table would refuse get no id and are no corpus for others.
    passed = filter_assets(with_full_text(valid_rows(articles)), lexicon)
    if start_id is None:
        start_id = 1 if stored is None else ArticleStore.next_id(stored)
    flagged = detect_novelty(passed, stored, start_id, **options)
    rows = with_entities(flagged, lexicon, dictionary, extra_names=extra_names)
    # The table's description column holds the body that was used.
    rows = rows.withColumn("description", F.col("body"))
    if created_at is not None:
        rows = rows.withColumn("created_at", F.lit(created_at).cast("timestamp"))
    rows = with_defaults(rows)
    schema = news_article(rows.schema["embedding"].dataType)
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in rows.columns}
    return rows.withColumns(missing).select(*schema.names)
