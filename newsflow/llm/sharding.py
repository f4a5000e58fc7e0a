"""Shards with equal row counts that keep linked documents together.

Balanced label propagation: documents start in hashed shards. In every round a
group of linked documents looks at its counts per shard and asks to move to the
shard that holds most of it; a shard admits no more than its quota of free
rows, by a hash, and the rest stays for the next round. Links are kept as group
membership and votes as counts per (group, shard), so a group of any size costs
at most one row per shard and never a pair of documents.

At the end shards above their share give up rows, unlinked ones first, to those
below: counts differ by at most one (law "rows").

Null text: linked with nothing. Documents with equal ids are separate rows. An
empty table gives an empty result. A group larger than a shard is split over as
few shards as quotas allow. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newsflow.operators.ids import dense_ids
from newsflow.operators.staging import Staging, staging_for

SHARDS = 24
ROUNDS = 4
_UNIT = float(1 << 32)


def _chance(*columns) -> Column:
    """A number in [0, 1) that a rerun repeats."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 32)) / F.lit(_UNIT)


def propagate(members: DataFrame, shards: int, room: int, rounds: int, staging: Staging) -> DataFrame:
    """(row, group, shard) after label propagation; ``room`` rows fit a shard."""
    for number in range(rounds):
        votes = members.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("n"))
        loads = F.broadcast(votes.groupBy("shard").agg(F.sum("n").alias("load")))  # at most one row per shard
        votes = staging.table(votes.join(loads, "shard"), f"votes{number}")
        # Where most of the group is; a full shard is asked only by rows already there.
        open_votes = F.when(F.col("load") < room, F.struct("n", F.hash("group", "shard").alias("tie"), F.col("shard").alias("to")))
        aims = votes.groupBy("group").agg(F.max(open_votes).alias("best"), F.max("n").alias("most"))
        moves = votes.join(aims, "group").filter(
            (F.col("shard") != F.col("best.to")) & (F.col("n") <= F.col("best.n"))
        ).select("group", "shard", "n", F.col("best.to").alias("to"))
        asked = moves.groupBy("to").agg(F.sum("n").alias("asked"))
        free = votes.groupBy(F.col("shard").alias("to")).agg((F.lit(room) - F.max("load")).alias("free"))
        quota = asked.join(free, "to").select("to", F.least(F.lit(1.0), F.col("free") / F.col("asked")).alias("quota"))
        moves = moves.join(F.broadcast(quota), "to").select("group", "shard", "to", "quota")
        go = _chance("row", F.lit(number)) < F.col("quota")
        members = staging.table(
            members.join(moves, ["group", "shard"], "left").select(
                "row", "group", F.when(go, F.col("to")).otherwise(F.col("shard")).alias("shard")
            ),
            f"members{number}",
        )
    return members


def start_of(shards: int) -> Column:
    """The shard in which a row begins."""
    return F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)).cast("int")


def _at(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("bigint") for v in values]), index.cast("int") + 1)


def _before(values: list[int]) -> list[int]:
    return [sum(values[:i]) for i in range(len(values))]


def into_shards(
    docs: DataFrame,
    shards: int = SHARDS,
    doc_id: str = "doc_id",
    text: str = "text",
    rounds: int = ROUNDS,
    staging: Staging | None = None,
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, linked): every row in a shard, slots without gaps."""
    staging = staging_for(docs, staging)
    body = F.col(f"`{text}`")
    # The group of equal texts is a fingerprint with checksum and length.
    base = staging.table(
        docs.select(
            F.col(f"`{doc_id}`").alias("doc_id"),
            (F.coalesce(F.octet_length(body), F.lit(0)) + 8).cast("bigint").alias("size"),
            F.coalesce(F.crc32(body), F.lit(0)).cast("bigint").alias("text_crc32"),
            F.when(body.isNotNull(), F.struct(F.xxhash64(body).alias("a"), F.xxhash64(F.lit("b"), body).alias("b"))).alias("group"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "base",
    )
    rows = base.count()
    several = base.filter("group is not null").groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("group")
    members = staging.table(base.join(several, "group").select("row", "group", start_of(shards).alias("shard")), "members")
    placed = propagate(members, shards, -(-rows // shards), rounds, staging)
    linked = placed.select("row", F.col("shard").alias("voted"))
    table = staging.table(
        base.join(linked, "row", "left").withColumn("linked", F.col("voted").isNotNull())
        .withColumn("shard", F.coalesce("voted", start_of(shards))).drop("voted"),
        "placed",
    )
    counted = {r["shard"]: r["n"] for r in table.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    has = [counted.get(s, 0) for s in range(shards)]
    fits = [rows // shards + (s < rows % shards) for s in range(shards)]
    over = [max(0, h - f) for h, f in zip(has, fits)]
    lack = [max(0, f - h) for h, f in zip(has, fits)]
    ordered = dense_ids(
        table.withColumn("unlinked", ~F.col("linked")), ["shard", "unlinked", "group", "doc_id", "row"], 0, "at", staging
    )
    spot = F.col("at") - _at(_before(has), F.col("shard"))
    extra = spot - _at(fits, F.col("shard")) + _at(_before(over), F.col("shard"))
    # Rows beyond a shard's share fill the gaps of the others in order.
    gaps = F.array(*[F.lit(g).cast("bigint") for g in _before(lack)])
    numbers = F.array(*[F.lit(s) for s in range(shards) if lack[s]])
    starts = F.array(*[F.lit(_before(lack)[s]).cast("bigint") for s in range(shards) if lack[s]])
    moved = ordered.withColumn("spot", spot).withColumn("extra", F.when(spot >= _at(fits, F.col("shard")), extra))
    if any(lack):
        to = F.element_at(numbers, F.size(F.filter(starts, lambda s: s <= F.col("extra"))))
        moved = moved.withColumn("to", F.when(F.col("extra").isNotNull(), to))
    else:
        moved = moved.withColumn("to", F.lit(None).cast("int"))
    slot = _at(has, F.col("to")) + F.col("extra") - F.element_at(gaps, F.col("to") + 1)
    return moved.select(
        "doc_id",
        "size",
        "text_crc32",
        F.coalesce("to", F.col("shard")).alias("shard"),
        F.coalesce(slot, F.col("spot")).alias("slot"),
        "linked",
    )
