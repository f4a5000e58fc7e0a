"""Feed snapshots that arrive in parts, late or again.

A snapshot gets its number when its first items arrive: numbers rise with the
micro-batches and inside one with the snapshot id. Items are compared with the
snapshot whose number is one less, as far as it has arrived. When a part comes
later, the snapshot it belongs to and the one after it are compared anew, and
the new result takes the place of the old one. So the final result does not
depend on how snapshots were cut into micro-batches.

Each micro-batch writes its items, its results and then a register of all
snapshots: which micro-batches hold parts of one, and which has its result.
Readers follow the newest register, so nothing counts before it is written. A
replayed micro-batch reads the register before it and writes the same again.

(snapshot_id, feed_pos) identifies an item. An item without a snapshot id
belongs to a snapshot named ''. An empty micro-batch changes nothing.
"""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from newsflow.operators.incremental import numbered_diff
from newsflow.operators.staging import Staging
from newsflow.schemas import FEED_ITEM
from newsflow.sources.stores import BatchStore

_NUMBERED = T.StructType(FEED_ITEM.fields + [T.StructField("snapshot_no", T.LongType()), T.StructField("in_batch", T.LongType())])
_REGISTER = T.StructType(
    [
        T.StructField("snapshot_id", T.StringType()),
        T.StructField("snapshot_no", T.LongType()),
        T.StructField("parts", T.ArrayType(T.LongType())),
        T.StructField("result", T.LongType()),
    ]
)


class SnapshotLog:
    """The snapshots of a feed and what was new in each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.items = BatchStore(spark, f"{path}/items", _NUMBERED)
        self.results = BatchStore(spark, f"{path}/results", _NUMBERED)
        self.register = BatchStore(spark, f"{path}/register", _REGISTER)

    def _register(self, before: int | None = None) -> DataFrame:
        known = self.register.batches() if before is None else self.register.before(before)
        return self.register.read(known[-1:])

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Take the items of one micro-batch."""
        staging = Staging(self.spark)
        try:
            self._add(batch, batch_id, staging)
        finally:
            staging.drop()

    def _add(self, batch: DataFrame, batch_id: int, staging: Staging) -> None:
        named = F.coalesce("snapshot_id", F.lit(""))
        current = staging.table(batch.select(*FEED_ITEM.names).withColumn("snapshot_id", named), "current")
        if current.isEmpty():
            return
        known = self._register(batch_id)
        last = known.agg(F.max("snapshot_no")).first()[0] or 0
        arrived = current.select("snapshot_id").distinct().withColumn("arrived", F.lit(True))
        # A row per snapshot of this micro-batch is numbered here, and one per snapshot ever lies in the register.
        number = F.row_number().over(Window.orderBy("snapshot_id")) + F.lit(last)
        fresh = arrived.join(known, "snapshot_id", "left_anti").select("snapshot_id", number.cast("bigint").alias("snapshot_no"))
        fresh = fresh.withColumn("parts", F.array().cast("array<bigint>")).withColumn("result", F.lit(None).cast("bigint"))
        rows = known.unionByName(fresh).join(arrived, "snapshot_id", "left")
        after = rows.filter("arrived").select((F.col("snapshot_no") + 1).alias("snapshot_no"), F.lit(True).alias("after"))
        own = F.array(F.lit(batch_id).cast("bigint"))
        rows = staging.table(
            rows.join(after, "snapshot_no", "left").select(
                "snapshot_id",
                "snapshot_no",
                F.when(F.col("arrived"), F.array_union("parts", own)).otherwise(F.col("parts")).alias("parts"),
                "result",
                F.coalesce("arrived", "after", F.lit(False)).alias("changed"),
            ),
            "register",
        )
        numbered = current.join(rows.select("snapshot_id", "snapshot_no"), "snapshot_id")
        self.items.write(numbered.withColumn("in_batch", F.lit(batch_id).cast("bigint")), batch_id)

        changed = rows.filter("changed").select("snapshot_no")
        compared = changed.unionByName(changed.select((F.col("snapshot_no") - 1).alias("snapshot_no"))).distinct()
        parts = rows.join(compared, "snapshot_no", "left_semi").select(F.explode("parts").alias("part")).distinct()
        # The micro-batches that hold parts of the compared snapshots; all others are not opened.
        held = self.items.read(sorted(r["part"] for r in parts.collect())).join(compared, "snapshot_no", "left_semi")
        new = numbered_diff(staging.table(held, "held"), staging).join(changed, "snapshot_no", "left_semi")
        self.results.write(new.withColumn("in_batch", F.lit(batch_id).cast("bigint")), batch_id)
        result = F.when(F.col("changed"), F.lit(batch_id).cast("bigint")).otherwise(F.col("result"))
        self.register.write(rows.withColumn("result", result), batch_id)

    def new_items(self) -> DataFrame:
        """Of every snapshot, the items that are not in the one before."""
        valid = self._register().select("snapshot_no", F.col("result").alias("in_batch"))
        return self.results.read().join(valid, ["snapshot_no", "in_batch"], "left_semi").select(*FEED_ITEM.names)

    def latest(self) -> DataFrame:
        """The items of the newest snapshot, all parts."""
        newest = self._register().select(F.max_by(F.struct("snapshot_no", "parts"), "snapshot_no").alias("n")).select("n.*").first()
        if newest["snapshot_no"] is None:
            return self.items.read([])
        return self.items.read(sorted(newest["parts"])).filter(F.col("snapshot_no") == newest["snapshot_no"]).select(*FEED_ITEM.names)
