"""Lookups that stay balanced when one key holds a large share of the rows."""

from pyspark.sql import DataFrame, functions as F

# At most this many heavy keys get salts. Every other key then holds less than
# one part in MAX_HEAVY_KEYS of the rows, and the broadcast table of heavy keys
# has at most MAX_HEAVY_KEYS rows whatever the data size.
MAX_HEAVY_KEYS = 1000
ROWS_PER_SALT = 250_000
MAX_SALTS = 4096


def heavy_keys(counts: DataFrame, keys: list[str], rows_per_salt: int) -> DataFrame:
    """(keys, salts) of the heaviest keys in ``counts`` (keys, rows)."""
    return (
        counts.filter(F.col("rows") > rows_per_salt)
        .orderBy(F.desc("rows"))
        .limit(MAX_HEAVY_KEYS)
        .select(*keys, F.least(F.ceil(F.col("rows") / rows_per_salt), F.lit(MAX_SALTS)).cast("int").alias("_salts"))
    )


def lookup(
    big: DataFrame,
    unique: DataFrame,
    keys: str | list[str],
    spread_by: str | list[str],
    how: str = "left",
    counts: DataFrame | None = None,
    rows_per_salt: int | None = None,
) -> DataFrame:
    """Join ``big`` with ``unique`` (at most one row per key), splitting heavy keys.

    The heavy keys, at most MAX_HEAVY_KEYS, are found first by a count with
    map-side combining; ``counts`` (keys, rows) saves counting ``big`` again.
    Without any, this is a plain equi-join. Rows of a heavy key are spread over
    salts by a hash of ``spread_by``, so a retried task puts them in the same
    place; the one matching row is repeated per salt. Null keys match nothing
    and are spread as well.
    """
    keys = [keys] if isinstance(keys, str) else keys
    spread = F.xxhash64(*([spread_by] if isinstance(spread_by, str) else spread_by))
    if counts is None:
        counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    present = F.lit(True)
    for key in keys:
        present = present & F.col(key).isNotNull()
    found = heavy_keys(counts.filter(present), keys, rows_per_salt or ROWS_PER_SALT)
    rows = found.collect()
    if not rows and how == "inner":
        return big.join(unique, keys, how)

    no_salt = F.lit(0).cast("bigint")
    if rows:
        heavy = F.broadcast(big.sparkSession.createDataFrame(rows, found.schema))
        salt = F.when(F.col("_salts") > 1, F.pmod(spread, F.col("_salts"))).otherwise(no_salt)
        salted = big.join(heavy, keys, "left").withColumn("_salt", F.when(present, salt).otherwise(spread)).drop("_salts")
        last = (F.coalesce("_salts", F.lit(1)) - 1).cast("bigint")
        repeated = unique.join(heavy, keys, "left").withColumn("_salt", F.explode(F.sequence(no_salt, last))).drop("_salts")
    else:
        salted = big.withColumn("_salt", F.when(present, no_salt).otherwise(spread))
        repeated = unique.withColumn("_salt", no_salt)
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
