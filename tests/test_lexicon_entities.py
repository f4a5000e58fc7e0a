from pyspark.sql import functions as F

from newsflow.functions import entities, lexicon

# Own sentences: a name and a ticker, neither, a name in a question, and a ticker's letters in lower case.
NEWS = [
    "Traders move to Hyperliquid. Volume in HYPE doubled within a week",
    "A new token was listed. Nobody has heard of it before.",
    "Will Solana validators vote today?. SOL holders wait for the count",
    "All the hype is about sol, the old word for daylight. A calm day at sea.",
]


def test_filter_sample(one):
    assert one(lexicon.mentions_asset, NEWS) == [True, False, True, False]


def test_word_edges(one):
    names = ["USD  COIN", "usd coin", "solanaé", "ſolana", "bnb", "x_tron", "Ripple"]
    assert one(lexicon.names_match, names) == [False, True, False, True, True, False, False]
    assert one(lexicon.ticker_match, ["BTC.", "HYPE2", "btc", "(SOL)"]) == [True, False, False, True]


def test_mentions_in_text_order(one):
    text = "Solana fees fell. Later BTC rose, as did Ethereum and then HYPE; no hype, no btc"
    got = one(entities.gazetteer_mentions, [text])[0]
    assert [(m["pos"], m["word"], m["score"]) for m in got] == [
        (0, "Solana", 1.0), (1, "BTC", 1.0), (2, "Ethereum", 1.0), (3, "HYPE", 1.0),
    ]
    linked = one(lambda c: entities.link_mentions(entities.gazetteer_mentions(c)), [text, "", None])
    assert [e["asset_id"] for e in linked[0]] == ["asset_sol", "asset_btc", "asset_eth", "asset_hype"]
    assert linked[1] == []


MENTIONS = "array<struct<pos:int,word:string,score:double>>"


def link(one, mentions, **options):
    rows = [(i, w, s) for i, (w, s) in enumerate(mentions)]
    got = one(lambda c: entities.link_mentions(c, **options), [rows], MENTIONS)[0]
    return [(e["asset_id"], e["matched_text"], e["ner_confidence"]) for e in got]


def test_link_rules(one):
    assert link(one, [("▁Bit coin", 0.95), ("BTC", 0.99)]) == [("asset_btc", "BITCOIN", 0.95)]
    assert link(one, [("BTC", 0.80004), ("BTC", 0.80005)]) == [("asset_btc", "BTC", 0.8001)]
    assert link(one, [("USD COIN", 0.99), ("nothing", 0.99)]) == []
    assert link(one, [("USD COIN", 0.99)], match_spaced=True) == [("asset_usdc", "USDCOIN", 0.99)]
    assert link(one, [("xrp", 0.9), ("sol", 0.91), ("ripple", 0.99)]) == [
        ("asset_xrp", "XRP", 0.9), ("asset_sol", "SOL", 0.91),
    ]
