"""Mixing sources to target weights by hash thresholds.

A document's place is a hash of its id. Sizes are summed by source and hash
bucket; within a source the buckets below the budget are taken whole, and only
the bucket at the boundary is divided further, until it holds one hash value.
The result is one threshold per source, so taking is a filter without a sort.
A larger budget moves a threshold up only, so smaller mixes lie inside larger ones.

Null text: size 0. A null source is a source of its own, last in order. A null
id is replaced by the text. Rows with equal ids share a hash and are taken or
left together. An empty table, or one without words, takes nothing. Extra
columns are ignored, or kept as they are by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsflow.llm.words import free_name
from newsflow.operators.staging import Staging, staging_for

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_COPIES = 2
WORD = r"[^\x20\x09-\x0D]+"
# Bits of a hash, and bits told apart in one histogram.
HASH_BITS, LEVEL_BITS = 60, 12


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def place(doc_id: Column, text: Column) -> Column:
    """A hash in [0, 2^60) that SQL engines agree on."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), text), F.lit(""))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES
) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code point order, null last, get the weights in turn. A target
    stops at ``most`` times its source; what is cut off is shared again by
    weight. The level at which that settles is the largest of the levels
    reached by cutting 0, 1, 2, ... sources in order of size per weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    weighted = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn)).withColumn(
        "most", F.col("source_size") * most
    )
    cut = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = cut.rowsBetween(Window.unboundedPreceding, -1), cut.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    left = F.lit(share) * total - F.coalesce(F.sum("most").over(before), F.lit(0))
    level = F.max("level").over(Window.partitionBy())
    return weighted.withColumn("level", left / F.sum("weight").over(onward)).select(
        "source",
        "source_size",
        F.least(F.col("most").cast("double"), level * F.col("weight")).alias("target"),
    )


def thresholds(rows: DataFrame, budgets: DataFrame, staging: Staging) -> DataFrame:
    """(source, budget, below): documents with place < below come nearest to the budget.

    ``rows`` is (source, place, size), ``budgets`` (source, budget).
    """
    state = budgets.select("source", "budget", F.lit(0).cast("bigint").alias("below"), F.lit(0).cast("bigint").alias("used"))
    for level in range(HASH_BITS // LEVEL_BITS):
        width = 1 << (HASH_BITS - LEVEL_BITS * (level + 1))
        span = width << LEVEL_BITS
        s = state.select(F.col("source").alias("s"), "budget", "below", "used")
        # On the first level all rows are in the one open bucket; later, those of the boundary bucket only.
        inside = (F.col("place") >= F.col("below")) & (F.col("place") < F.col("below") + span)
        histogram = (
            rows.join(s, F.col("source").eqNullSafe(F.col("s")) & inside)
            .groupBy("s", "budget", "below", "used", F.expr(f"(place - below) div {width}").alias("bucket"))
            .agg(F.sum("size").alias("size"))
        )
        running = Window.partitionBy("s").orderBy("bucket")
        total = F.col("used") + F.sum("size").over(running)
        steps = histogram.withColumn("after", total).filter(F.col("after") > F.col("budget"))
        boundary = steps.groupBy("s", "budget", "below").agg(F.min(F.struct("bucket", "after", "size")).alias("b"))
        found = boundary.select(
            F.col("s"),
            (F.col("below") + F.col("b.bucket") * width).alias("lower"),
            (F.col("b.after") - F.col("b.size")).alias("before"),
            F.col("b.after").alias("after"),
        )
        last = level == HASH_BITS // LEVEL_BITS - 1
        nearer = (F.col("after") - F.col("budget")) < (F.col("budget") - F.col("before"))
        lower = F.col("lower") + F.when(nearer, 1).otherwise(0) if last else F.col("lower")
        # A source without boundary is taken whole: its threshold lies above every hash.
        state = staging.table(
            state.join(found, F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source",
                "budget",
                F.coalesce(lower, F.lit(1 << HASH_BITS)).alias("below"),
                F.coalesce("before", F.col("used")).alias("used"),
            ),
            f"threshold{level}",
        )
    return state.select("source", "budget", "below")


def _sized(docs: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    return docs.select(
        F.col(source).alias("source"), place(F.col(doc_id), F.col(text)).alias("place"), words_in(F.col(text)).alias("size")
    )


def plan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_COPIES,
    staging: Staging | None = None,
) -> DataFrame:
    """(source, source_size, target, whole, below): what the mix takes of each source.

    Every document is taken ``whole`` times, and those with place < below once more.
    """
    staging = staging_for(docs, staging)
    rows = staging.table(_sized(docs, doc_id, source, text), "sized")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = staging.table(targets(sizes, weights, share, most), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    goals = goals.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    # A source with no budget left needs no histogram.
    open_goals = goals.filter("budget > 0").select("source", "budget")
    found = thresholds(rows, open_goals, staging).select(F.col("source").alias("s"), "below")
    return goals.join(found, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "source_size", "target", "whole", F.coalesce("below", F.lit(0).cast("bigint")).alias("below")
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> tuple[DataFrame, str, str]:
    """``docs`` with a struct of its source's plan and the number of copies taken; both names come with it."""
    # Written first, so that the optimizer sees how small it is and broadcasts it only then.
    decided = staging_for(docs, options.get("staging")).table(plan(docs, doc_id, source, text, **options), "plan")
    info, copies = free_name(docs.columns, "mix"), free_name(docs.columns, "copies")
    decided = decided.select(F.struct("*").alias(info))
    joined = docs.join(decided, F.col(f"`{source}`").eqNullSafe(F.col(f"`{info}`.source")))
    more = F.when(place(F.col(f"`{doc_id}`"), F.col(f"`{text}`")) < F.col(f"`{info}`.below"), 1).otherwise(0)
    return joined.withColumn(copies, F.col(f"`{info}`.whole") + more), info, copies


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with their own columns, a document taken twice as two rows."""
    rows, info, copies = mix(docs, **options)
    # A source without words has target 0, and its documents cost none of it: they stay.
    number = F.when(F.col(f"`{info}`.source_size") == 0, 1).otherwise(F.col(f"`{copies}`"))
    again = free_name(rows.columns, "copy")
    return rows.withColumn(again, F.explode(F.array_repeat(F.lit(0), number.cast("int")))).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
