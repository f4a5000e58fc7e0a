"""Mentions of assets and their links to asset ids, inside one row."""

from pyspark.sql import Column, functions as F

from newsflow.functions.lexicon import CRYPTO_ASSETS, Lexicon, whole_words
from newsflow.functions.text import let, strip

# Fixed values.
WORD_PIECE_MARK = "\u2581"
MIN_CONFIDENCE = 0.80
ASSET_DICTIONARY = {
    "BITCOIN": "asset_btc",
    "BTC": "asset_btc",
    "ETHEREUM": "asset_eth",
    "ETH": "asset_eth",
    "TETHER": "asset_usdt",
    "USDT": "asset_usdt",
    "BNB": "asset_bnb",
    "BINANCE COIN": "asset_bnb",
    "XRP": "asset_xrp",
    "RIPPLE": "asset_xrp",
    "USD COIN": "asset_usdc",
    "USDC": "asset_usdc",
    "SOLANA": "asset_sol",
    "SOL": "asset_sol",
    "TRON": "asset_trx",
    "TRX": "asset_trx",
    "DOGECOIN": "asset_doge",
    "DOGE": "asset_doge",
    "HYPERLIQUID": "asset_hype",
    "HYPE": "asset_hype",
}


def gazetteer_mentions(text: Column, lexicon: Lexicon = CRYPTO_ASSETS, extra_names=("ripple", "binance coin")) -> Column:
    """Ordered mentions (pos, word, score) of lexicon terms in a text.

    Names may appear in any case, tickers only as written; the score is 1.0.
    ``extra_names`` are names that link to an asset without being in the filter.
    """
    names = whole_words((*lexicon.names, *extra_names), ignore_case=True)
    tickers = whole_words(lexicon.tickers, ignore_case=False)
    # The tickers' own word edges follow the names' flag group, so close it.
    found = F.regexp_extract_all(text, F.lit(f"(?:{names})|(?-i:{tickers})"), 0)
    return F.transform(
        found, lambda word, pos: F.struct(pos.alias("pos"), word.alias("word"), F.lit(1.0).alias("score"))
    )


def clean_mention(word: Column) -> Column:
    """Dictionary form of a mention: no word-piece marks or spaces, upper case."""
    return F.upper(strip(F.translate(word, WORD_PIECE_MARK + " ", "")))


def confidence(score: Column) -> Column:
    return F.round(score, 4)


def dictionary_keys(dictionary, match_spaced: bool):
    """Surface forms to compare with cleaned mentions, which never hold a space.

    Forms with a space therefore never match unless ``match_spaced`` asks for
    their space-free spelling.
    """
    if match_spaced:
        return {surface.replace(" ", ""): asset for surface, asset in dictionary.items()}
    return dict(dictionary)


def link_mentions(mentions: Column, dictionary=None, match_spaced: bool = False) -> Column:
    """Linked entities of one article's mentions: first confident mention per asset.

    ``mentions`` is an array of (pos, word, score) in text order. Everything
    happens inside the row, so no shuffle is needed.
    """
    keys = dictionary_keys(dictionary or ASSET_DICTIONARY, match_spaced)
    lookup = F.create_map(*[F.lit(x) for pair in keys.items() for x in pair])

    linked = F.transform(
        mentions,
        lambda m: let(
            clean_mention(m["word"]),
            lambda word: F.struct(
                F.try_element_at(lookup, word).alias("asset_id"),
                word.alias("matched_text"),
                confidence(m["score"]).alias("ner_confidence"),
            ),
        ),
    )
    usable = F.filter(linked, lambda e: e["asset_id"].isNotNull() & (e["ner_confidence"] > MIN_CONFIDENCE))
    # An article has at most as many linked assets as the dictionary holds.
    return F.aggregate(
        usable,
        F.array().cast("array<struct<asset_id:string,matched_text:string,ner_confidence:double>>"),
        lambda acc, e: F.when(F.exists(acc, lambda seen: seen["asset_id"] == e["asset_id"]), acc).otherwise(
            F.array_append(acc, e)
        ),
    )


def matched_texts(entities: Column) -> Column:
    return F.transform(entities, lambda e: e["matched_text"])
