"""Explicit schemas of every record; nothing is inferred from data."""

from pyspark.sql import types as T


def _struct(**fields):
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


STRINGS = T.ArrayType(T.StringType())

# One <item> of a feed file as the XML reader delivers it.
FEED_XML_ITEM = _struct(
    title=T.StringType(),
    link=T.StringType(),
    description=T.StringType(),
    guid=_struct(_VALUE=T.StringType(), _isPermaLink=T.StringType()),
    category=STRINGS,
    pubDate=T.StringType(),
)

FEED_ITEM = _struct(
    snapshot_id=T.StringType(),
    feed_pos=T.LongType(),
    source=T.StringType(),
    guid=T.StringType(),
    title=T.StringType(),
    rss_summary=T.StringType(),
    url=T.StringType(),
    published_at=T.StringType(),
    published_ts=T.TimestampType(),
    categories=STRINGS,
    rss_fetched_at=T.TimestampType(),
)

SCRAPED_ARTICLE = T.StructType(
    FEED_ITEM.fields
    + _struct(
        scraped_at=T.TimestampType(),
        full_body=T.StringType(),
        scrape_status=T.StringType(),
        scrape_error=T.StringType(),
    ).fields
)

# A scraped article as other systems hand it over; description is the last
# body fallback.
INCOMING_ARTICLE = T.StructType(
    SCRAPED_ARTICLE.fields + [T.StructField("description", T.StringType(), True)]
)

LANDED_PAGE = _struct(url=T.StringType(), html=T.StringType())

MENTION = _struct(pos=T.IntegerType(), word=T.StringType(), score=T.DoubleType())
LINKED_ENTITY = _struct(
    asset_id=T.StringType(), matched_text=T.StringType(), ner_confidence=T.DoubleType()
)

TERM = _struct(term=T.LongType(), weight=T.DoubleType())
SPARSE_VECTOR = T.ArrayType(TERM)
POSTING = _struct(
    bucket=T.IntegerType(), term=T.LongType(), seq=T.LongType(), weight=T.DoubleType(), h1=T.LongType(), h2=T.LongType()
)
DENSE_VECTOR = T.ArrayType(T.FloatType())


def news_article(vector=SPARSE_VECTOR):
    """Schema of the article table for one kind of vector."""
    return _struct(
        id=T.LongType(),
        title=T.StringType(),
        description=T.StringType(),
        url=T.StringType(),
        is_redundant=T.BooleanType(),
        novelty_label=T.StringType(),
        embedding=vector,
        extracted_assets=T.ArrayType(LINKED_ENTITY),
        category=T.StringType(),
        impact=T.StringType(),
        sentiment=T.StringType(),
        target_investor=T.StringType(),
        summary=T.StringType(),
        created_at=T.TimestampType(),
    )
