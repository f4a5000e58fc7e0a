"""Whole-word lexicon matching built from term lists."""

import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# A word edge: no letter, digit or underscore of any script on that side.
NO_WORD_BEFORE = r"(?<![\p{L}\p{N}_])"
NO_WORD_AFTER = r"(?![\p{L}\p{N}_])"


def whole_words(terms, ignore_case: bool) -> str:
    """Regular expression for any of ``terms`` as a whole word, in group 1."""
    flags = "(?iu)" if ignore_case else ""
    return f"{flags}{NO_WORD_BEFORE}({'|'.join(re.escape(t) for t in terms)}){NO_WORD_AFTER}"


@dataclass(frozen=True)
class Lexicon:
    """Names match in any case, tickers only as written."""

    names: tuple[str, ...]
    tickers: tuple[str, ...]

    def names_pattern(self) -> str:
        return whole_words(self.names, ignore_case=True)

    def tickers_pattern(self) -> str:
        return whole_words(self.tickers, ignore_case=False)


# The ten assets by market value.
CRYPTO_ASSETS = Lexicon(
    names=(
        "bitcoin", "ethereum", "tether", "bnb", "xrp",
        "usd coin", "solana", "tron", "dogecoin", "hyperliquid",
    ),
    tickers=("BTC", "ETH", "USDT", "USDC", "SOL", "TRX", "DOGE", "HYPE"),
)


def names_match(text: Column, lexicon: Lexicon = CRYPTO_ASSETS) -> Column:
    return text.rlike(lexicon.names_pattern())


def ticker_match(text: Column, lexicon: Lexicon = CRYPTO_ASSETS) -> Column:
    return text.rlike(lexicon.tickers_pattern())


def mentions_asset(text: Column, lexicon: Lexicon = CRYPTO_ASSETS) -> Column:
    """True when the text has a name or a ticker of the lexicon."""
    return names_match(text, lexicon) | ticker_match(text, lexicon)
