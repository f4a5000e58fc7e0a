"""Dense ids in arrival order, given without gathering the rows in one task."""

from pyspark.sql import DataFrame, Window, functions as F

from newsflow.operators.staging import Staging, staging_for

# Layout of monotonically_increasing_id: partition number above, row below.
ROW_BITS = 33


def dense_ids(
    frame: DataFrame, order_by: list[str], start: int = 1, name: str = "id", staging: Staging | None = None
) -> DataFrame:
    """``frame`` with ids start, start + 1, ... in the order of ``order_by``.

    The rows are range-partitioned and sorted once and written; an id is the
    number of rows in earlier partitions plus the position in its own. Only
    the partition sizes, one row per partition, meet in one task.
    """
    staging = staging_for(frame, staging)
    numbered = frame.orderBy(*order_by).withColumn("_row", F.monotonically_increasing_id())
    numbered = staging.table(numbered, "sorted").withColumn("_part", F.shiftright("_row", ROW_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        numbered.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    )
    position = F.col("_row").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (
        numbered.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.lit(start).cast("bigint") + F.col("_offset") + position)
        .drop("_row", "_part", "_offset")
    )
