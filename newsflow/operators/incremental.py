"""What is new in a snapshot, compared with the one before."""

from pyspark.sql import DataFrame, functions as F

from newsflow.functions.urls import article_keys, guid_key, url_key
from newsflow.operators.ids import dense_ids
from newsflow.operators.skew import lookup
from newsflow.operators.staging import Staging, staging_for

ITEM_ID = ["snapshot_id", "feed_pos"]


def historical_keys(history: DataFrame) -> DataFrame:
    """Distinct keys of all items."""
    return history.select(F.explode(article_keys(F.col("guid"), F.col("url"))).alias("key")).distinct()


def _keys(items: DataFrame, staging: Staging) -> DataFrame:
    """Only the ids and keys of the items, computed once."""
    return staging.table(
        items.select(*ITEM_ID, guid_key(F.col("guid")).alias("_guid"), url_key(F.col("url")).alias("_url")), "keys"
    )


def _unseen(items: DataFrame, keys: DataFrame, seen_guids: DataFrame, seen_urls: DataFrame, extra: list[str]) -> DataFrame:
    """Items whose guid key and url key are both absent from the seen ones.

    The lookups carry ids and keys only; the items themselves move once, to
    meet the ids of the new ones. An item without keys stays. Items among
    themselves are not deduplicated.
    """
    found = keys
    for key, seen, flag in (("_guid", seen_guids, "_guid_seen"), ("_url", seen_urls, "_url_seen")):
        seen = seen.filter(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True))
        counts = keys.groupBy(key, *extra).agg(F.count(F.lit(1)).alias("rows"))
        found = lookup(found, seen, [key, *extra], spread_by="feed_pos", counts=counts)
    fresh = found.filter("_guid_seen is null and _url_seen is null").select(*ITEM_ID)
    return items.join(fresh, ITEM_ID, "left_semi")


def find_new(current: DataFrame, history: DataFrame, staging: Staging | None = None) -> DataFrame:
    """Items of ``current`` that share neither guid nor url with ``history``.

    (snapshot_id, feed_pos) identifies an item.
    """
    staging = staging_for(current, staging)
    old = _keys(history, staging)
    return _unseen(current, _keys(current, staging), old.select("_guid"), old.select("_url"), [])


def number_snapshots(items: DataFrame, staging: Staging | None = None) -> DataFrame:
    """(snapshot_id, snapshot_no): position of each snapshot in time."""
    return dense_ids(items.select("snapshot_id").distinct(), ["snapshot_id"], name="snapshot_no", staging=staging)


def previous_snapshots(items: DataFrame, staging: Staging | None = None) -> DataFrame:
    """(snapshot_id, previous_id): the snapshot right before, null for the first."""
    numbered = number_snapshots(items, staging)
    before = numbered.select((F.col("snapshot_no") + 1).alias("snapshot_no"), F.col("snapshot_id").alias("previous_id"))
    return numbered.join(before, "snapshot_no", "left").select("snapshot_id", "previous_id")


def numbered_diff(items: DataFrame, staging: Staging | None = None) -> DataFrame:
    """Of items with ``snapshot_no``, those whose keys the snapshot with the number before does not hold.

    An item that left and comes back is new again. All snapshots are compared
    in one pass: a key of snapshot n is looked up among the keys of n - 1.
    """
    staging = staging_for(items, staging)
    keys = items.select(*ITEM_ID, "snapshot_no", guid_key(F.col("guid")).alias("_guid"), url_key(F.col("url")).alias("_url"))
    keys = staging.table(keys, "numbered")
    following = (F.col("snapshot_no") + 1).alias("snapshot_no")
    return _unseen(items, keys, keys.select("_guid", following), keys.select("_url", following), ["snapshot_no"])


def snapshot_diff(items: DataFrame, staging: Staging | None = None) -> DataFrame:
    """Of every snapshot, the items that are not in the snapshot before it.

    An item that left and comes back is new again. All snapshots are compared
    in one pass: a key of snapshot n is looked up among the keys of n - 1.
    """
    staging = staging_for(items, staging)
    keys = _keys(items, staging)
    keys = staging.table(
        lookup(keys, number_snapshots(keys, staging), "snapshot_id", spread_by="feed_pos", how="inner"), "numbered"
    )
    following = (F.col("snapshot_no") + 1).alias("snapshot_no")
    return _unseen(items, keys, keys.select("_guid", following), keys.select("_url", following), ["snapshot_no"])
