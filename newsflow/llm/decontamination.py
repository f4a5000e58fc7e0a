"""Documents that contain benchmark items.

A document's candidate windows have the length of an item and start at a word
shingle that the item shares: any window moves right to its first shared
shingle without losing one, so no better window exists elsewhere. Each window
and item gets a 64-bit SimHash. Fingerprints are cut into more blocks than two of
them may differ in bits, so two within the radius are equal in some block. The
index holds an item under each block together with each of its shingles, and a
window asks with each block and its first shingle: an equi-join finds every
pair within the radius, and compares no window with items it shares nothing
with. Pairs are then verified by the exact weighted Jaccard similarity of
their shingles (weight: occurrences).

Positions of shared shingles are found first; only texts that have any are
read again to cut their windows. Which side of a join travels is left to the
optimizer, by measured sizes.

Words are lower-cased runs without ASCII white space, shingles five words, or
a whole item if it is shorter. Null or empty texts and items match nothing. A
null id is an id of its own. Equal rows give one result; rows with one id and
different texts give one each. Empty tables give an empty result. Extra
columns are ignored, or kept as they are by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsflow.functions.text import let
from newsflow.llm.words import free_name
from newsflow.operators.staging import Staging, staging_for

SHINGLE = 5
SIMILARITY = 0.8
# Two sets of similarity 0.8 differ in some 10 of 64 bits; 20 is more than three deviations above.
RADIUS = 20
# Positions of shared shingles, some 24 bytes each, that are sent to the texts rather than the texts to them.
MOST_SENT = 1_000_000
_SPACE = "[ \\t\\n\\x0B\\f\\r]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SPACE), lambda w: w != "")


def _shingles(words: Column, width: int) -> Column:
    """Fingerprints of all shingles in order; empty if there are fewer words."""
    return F.when(
        F.size(words) >= width,
        F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(width)))),
    ).otherwise(F.array().cast("array<bigint>"))


def _text_shingles(text: Column, width: int) -> Column:
    return let(_words(text), lambda words: _shingles(words, width))


def simhash(shingles: Column) -> Column:
    """64 bits: whether more than half of all occurrences have the bit set."""
    bits = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda b: F.aggregate(shingles, F.lit(0), lambda n, h: n + F.getbit(h, b).cast("int")) * 2 > F.size(shingles),
    )
    return F.aggregate(
        F.zip_with(bits, F.sequence(F.lit(0), F.lit(63)), lambda on, b: F.struct(on.alias("on"), b.alias("b"))),
        F.lit(0).cast("bigint"),
        lambda value, x: F.when(x["on"], value.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), x["b"]))).otherwise(value),
    )


def _blocks(fingerprint: Column, radius: int) -> Column:
    """(block, value) of radius + 1 blocks that cover all 64 bits."""
    at, out = 0, []
    for number in range(radius + 1):
        width = (64 - at) // (radius + 1 - number)
        value = F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << width) - 1))
        out.append(F.struct(F.lit(number).alias("block"), value.alias("value")))
        at += width
    return F.array(*out)


def _overlap(a: Column, b: Column) -> Column:
    """Sum over shingles of the smaller number of occurrences."""
    times = lambda values, x: F.size(F.filter(values, lambda v: v == x))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))


def find(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
    staging: Staging | None = None,
) -> DataFrame:
    """(doc_id, text_key, item_id, start, size, hamming, similarity): the best window per document and item."""
    staging = staging_for(docs, staging)
    items = items.select(F.col(f"`{item_id}`").alias("item_id"), _words(F.col(f"`{item_text}`")).alias("words"))
    items = items.select("item_id", "words", F.size("words").alias("size")).filter("size > 0")
    items = items.withColumn("width", F.least("size", F.lit(SHINGLE)))
    # The item's shingles have the width that its length allows.
    by_width = F.lit(None).cast("array<bigint>")
    for width in range(1, SHINGLE + 1):
        by_width = F.when(F.col("width") == width, _shingles(F.col("words"), width)).otherwise(by_width)
    items = staging.table(
        items.select("item_id", "size", "width", by_width.alias("shingles")).withColumn("print", simhash(F.col("shingles"))),
        "items",
    )
    widths = [row["width"] for row in items.select("width").distinct().collect()]  # at most SHINGLE rows
    keyed = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).filter("text is not null")
    keyed = keyed.withColumn("text_key", F.xxhash64("text"))
    if not widths:
        widths = [SHINGLE]
    windows = None
    for width in widths:
        sharing = staging.table(
            items.filter(F.col("width") == width).select("size", F.explode("shingles").alias("h")).groupBy("h").agg(F.collect_set("size").alias("sizes")),
            f"sharing{width}",
        )
        hashed = keyed.select("doc_id", "text_key", _text_shingles(F.col("text"), width).alias("hashes"))
        spots = (
            hashed.select("doc_id", "text_key", F.posexplode("hashes").alias("start", "h"))
            .join(sharing, "h")
            .select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "start", F.explode("sizes").alias("size"))
            .groupBy("d", "k")
            .agg(F.collect_set(F.struct("start", "size")).alias("spots"))
        )
        spots = staging.table(spots, f"spots{width}")
        # One plan; a side of known size need not wait for the optimizer's estimate.
        if (spots.agg(F.sum(F.size("spots"))).first()[0] or 0) <= MOST_SENT:
            spots = F.broadcast(spots)
        same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k"))
        cut = F.slice(F.col("hashes"), F.col("start") + 1, F.col("size") - (width - 1)).alias("shingles")
        found = (
            keyed.join(spots, same)
            .select("doc_id", "text_key", "spots", _text_shingles(F.col("text"), width).alias("hashes"))
            .select("doc_id", "text_key", "hashes", F.inline("spots"))
            .select("doc_id", "text_key", "start", "size", cut)
        )
        windows = found if windows is None else windows.unionByName(found)
    windows = staging.table(
        windows.dropDuplicates(["doc_id", "text_key", "start", "size"]).withColumn("print", simhash(F.col("shingles"))), "windows"
    )
    index = items.select("item_id", "size", "print", F.explode(F.array_distinct("shingles")).alias("h"))
    index = index.select("item_id", "size", "h", F.col("print").alias("item_print"), F.inline(_blocks(F.col("print"), radius)))
    key = ["doc_id", "text_key", "start", "size"]
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    pairs = (
        windows.select(*key, "print", F.col("shingles")[0].alias("h"), F.inline(_blocks(F.col("print"), radius)))
        .join(staging.table(index, "index"), ["size", "h", "block", "value"])
        .filter(distance <= radius)
        .select(*key, "item_id", distance.alias("hamming"))
        .dropDuplicates()
    )
    w = windows.select(*[F.col(c).alias(f"w_{c}") for c in key], F.col("shingles").alias("w_shingles"))
    same = F.col("doc_id").eqNullSafe(F.col("w_doc_id"))
    for c in key[1:]:
        same = same & (F.col(c) == F.col(f"w_{c}"))
    i = items.select(F.col("item_id").alias("i_item_id"), F.col("size").alias("i_size"), F.col("shingles").alias("i_shingles"))
    item_same = F.col("item_id").eqNullSafe(F.col("i_item_id")) & (F.col("size") == F.col("i_size"))
    common = _overlap(F.col("i_shingles"), F.col("w_shingles"))
    every = F.size("i_shingles") + F.size("w_shingles")
    verified = (
        pairs.join(w, same)
        .join(i, item_same)
        .withColumn("common", common)
        .withColumn("similarity", F.col("common") / (every - F.col("common")))
        .filter(F.col("similarity") >= similarity)
    )
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "size", "hamming")).alias("best")
    return verified.groupBy("doc_id", "text_key", "item_id").agg(best).select(
        "doc_id",
        "text_key",
        "item_id",
        (-F.col("best.back")).alias("start"),
        F.col("best.size").alias("size"),
        F.col("best.hamming").alias("hamming"),
        F.col("best.similarity").alias("similarity"),
    )


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without those that contain an item, with their own columns, whatever their names."""
    hit, key = free_name(docs.columns, "hit"), free_name(docs.columns, "hit_key")
    staging = staging_for(docs, options.pop("staging", None))
    found = find(docs, items, doc_id, text, staging=staging, **options)
    # Written, so that its size is known: few hits are sent to the texts, not the texts to them.
    hits = staging.table(found.select(F.col("doc_id").alias(hit), F.col("text_key").alias(key)).distinct(), "hits")
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(hit)) & (F.xxhash64(F.col(f"`{text}`")) == F.col(key))
    return docs.join(hits, same, "left_anti")
