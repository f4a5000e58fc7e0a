"""Entity linking for mention tables, and the plug-ins for own models."""

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from newsflow.functions.entities import (
    ASSET_DICTIONARY,
    MIN_CONFIDENCE,
    clean_mention,
    confidence,
    dictionary_keys,
    gazetteer_mentions,
    link_mentions,
)
from newsflow.functions.lexicon import CRYPTO_ASSETS, Lexicon
from newsflow.operators.skew import lookup
from newsflow.schemas import MENTION


def dictionary_table(spark, dictionary=None, match_spaced: bool = False) -> DataFrame:
    """The dictionary as (surface, asset_id)."""
    keys = dictionary_keys(dictionary or ASSET_DICTIONARY, match_spaced)
    return spark.createDataFrame(list(keys.items()), "surface string, asset_id string")


def extract_mentions(articles: DataFrame, lexicon: Lexicon = CRYPTO_ASSETS, text: str = "text", **options) -> DataFrame:
    """``articles`` with the array ``mentions``, computed inside the row."""
    return articles.withColumn("mentions", gazetteer_mentions(F.col(text), lexicon, **options))


def with_entities(articles: DataFrame, lexicon: Lexicon = CRYPTO_ASSETS, dictionary=None, text: str = "text", **options) -> DataFrame:
    """Fill extracted_assets of the articles that are not redundant; others keep null."""
    entities = link_mentions(gazetteer_mentions(F.col(text), lexicon, **options), dictionary)
    return articles.withColumn("extracted_assets", F.when(~F.col("is_redundant"), entities))


def link_entities(mentions: DataFrame, dictionary: DataFrame, key: str = "article_id") -> DataFrame:
    """(key, extracted_assets) from a long table (key, pos, word, score).

    For mention and dictionary tables of any size. The first mention per
    article and asset is a minimum, so each map task already reduces its rows
    and a third of all mentions may belong to one asset or one article.
    """
    confident = mentions.select(
        key, "pos", clean_mention(F.col("word")).alias("surface"), confidence(F.col("score")).alias("score")
    ).filter(F.col("score") > MIN_CONFIDENCE)
    # One row per article and spelling before the dictionary is joined.
    first = confident.groupBy(key, "surface").agg(
        F.min("pos").alias("pos"), F.min_by("score", "pos").alias("score")
    )
    known = lookup(first, dictionary, "surface", spread_by=key, how="inner")
    linked = known.groupBy(key, "asset_id").agg(
        F.min(F.struct("pos", "surface", "score")).alias("m")
    )
    # At most one entry per asset of the dictionary.
    return linked.groupBy(key).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("m.pos", "asset_id", "m.surface", "m.score"))),
            lambda e: F.struct(
                e["asset_id"].alias("asset_id"), e["surface"].alias("matched_text"), e["score"].alias("ner_confidence")
            ),
        ).alias("extracted_assets")
    )


def embed_with(articles: DataFrame, make_encoder, text: str = "text") -> DataFrame:
    """Add ``embedding`` from the caller's own model.

    ``make_encoder()`` is called once per task and returns a function from a
    list of texts to a list of float vectors. Filter before this step: Spark
    does not move filters below it.
    """
    schema = T.StructType(articles.schema.fields + [T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def encode(batches):
        encoder = make_encoder()
        for batch in batches:
            vectors = [list(map(float, v)) for v in encoder(batch[text].tolist())]
            yield batch.assign(embedding=pd.Series(vectors, index=batch.index, dtype=object))

    return articles.mapInPandas(encode, schema)


def tag_with(articles: DataFrame, make_tagger, key: str = "article_id", text: str = "text") -> DataFrame:
    """Long mention table (key, pos, word, score) from the caller's own tagger.

    ``make_tagger()`` returns a function from a list of texts to a list of
    [(word, score), ...] per text, in text order.
    """
    schema = T.StructType([articles.schema[key], *MENTION.fields])

    def tag(batches):
        tagger = make_tagger()
        for batch in batches:
            rows = [
                (row_key, pos, word, float(score))
                for row_key, found in zip(batch[key], tagger(batch[text].tolist()))
                for pos, (word, score) in enumerate(found)
            ]
            yield pd.DataFrame(rows, columns=schema.names)

    return articles.select(key, text).mapInPandas(tag, schema)
