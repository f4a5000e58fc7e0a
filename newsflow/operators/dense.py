"""Exact and hashed neighbour search for dense vectors.

Spark routes rows to cells and splits cells into tiles of bounded size; inside
a task one tile is compared with another by a matrix product. No row pair ever
leaves a task, only each row's earliest match.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from newsflow.operators.staging import Staging

TILE_ROWS = 2048
# Parts that a cell is divided into at a time, and how often: cell numbers fit 64 bits.
FAN = 256
DEPTH = 7
# Rows of a cell that one task compares with the centres of its parts.
DEALT_TILES = 4
ROUNDING = 1e-6
_UNIT = 1 << 30
# Tiles of the earliest rows that every asking row meets first; rows left after that meet the
# others directly while they fill no more than so many tiles.
EARLY_TILES = 2
# Rows that a worker signs or compares at a time.
SLICE = 512


def _unit(vectors) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows as doubles and a mask of the usable ones (finite, not zero)."""
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    usable = np.isfinite(norms) & (norms > 0)
    return matrix / np.where(usable, norms, 1.0)[:, None], usable


def _angles(dots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(dots, -1.0, 1.0))


def _usable(vec):
    return F.exists(vec, lambda x: x != 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _centres(placed: DataFrame, wide: DataFrame, level: int, tile_rows: int, fan: int) -> DataFrame:
    """(cell, seqs, vecs): of each wide cell some rows, chosen by a hash, about one per tile and at most ``fan``."""
    wanted = F.least(F.ceil(F.col("rows") / tile_rows), F.lit(fan)) + 8
    chance = F.pmod(F.xxhash64(F.lit(level), "seq"), F.lit(_UNIT)) / _UNIT
    chosen = placed.select("cell", "seq", "vec").join(wide, "cell").filter(chance < wanted / F.col("rows"))
    chosen = chosen.groupBy("cell").agg(F.slice(F.array_sort(F.collect_list(F.struct("seq", "vec"))), 1, fan).alias("centre"))
    return chosen.select("cell", F.col("centre.seq").alias("seqs"), F.col("centre.vec").alias("vecs"))


def _dealt(rows: DataFrame, centres: DataFrame, counts: DataFrame, size: int):
    """The rows of a cell in parts of about ``size``, each with the cell's centres."""
    parts = counts.select("cell", F.ceil(F.col("rows") / size).alias("parts"))
    left = rows.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("seq"), F.col("parts"))).drop("parts")
    right = centres.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")
    return left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part"))


def _assign(threshold: float, fan: int):
    """Per row: its part of the cell, the angle to the part's centre, and the earliest matching centre so far."""

    def assign(rows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        rows, own = rows.drop(columns="part"), rows["seq"].to_numpy()
        if rows.empty or centres.empty:
            return rows.assign(parent=pd.array([pd.NA] * len(rows), "Int64"))
        seqs = np.asarray(centres["seqs"].iloc[0], np.int64)
        dots = _unit(rows["vec"])[0] @ _unit(centres["vecs"].iloc[0])[0].T
        near = (1.0 - dots < threshold) & (seqs[None, :] < own[:, None])
        bound = rows["bound"].to_numpy()
        match = np.minimum(np.where(near, seqs[None, :], bound[:, None]).min(axis=1), bound)
        angles = _angles(dots)
        part = angles.argmin(axis=1)
        return rows.assign(
            parent=rows["cell"].astype("Int64"),
            cell=rows["cell"] * fan + 1 + part,
            angle=angles[np.arange(len(rows)), part],
            bound=match,
        )

    return assign


def _route(reach: float, fan: int):
    """Per asking row: the parts of the cell that can hold a row within ``reach`` of it.

    A part holds angles low to high around its centre, and all its rows are
    nearer to that centre than to any other: both bound where a match may be.
    """

    def route(rows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or centres.empty:
            return rows[["cell", "seq"]]
        centre = centres.iloc[0]
        part = np.asarray(centre["cells"], np.int64) - rows["cell"].iloc[0] * fan - 1
        low, high = (np.asarray(centre[name], np.float64) for name in ("lows", "highs"))
        every = _angles(_unit(rows["vec"])[0] @ _unit(centre["vecs"])[0].T)
        angles = every[:, part]
        possible = (angles <= reach + high + ROUNDING) & (angles >= low - reach - ROUNDING)
        possible &= angles <= every.min(axis=1)[:, None] + 2 * reach + ROUNDING
        row, at = np.nonzero(possible)
        return pd.DataFrame({"cell": np.asarray(centre["cells"], np.int64)[at], "seq": rows["seq"].to_numpy()[row]})

    return route


def _compare(threshold: float):
    """The earliest stored row within the threshold of each query; with signatures, of those that share a cell with it."""

    def compare(queries: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or stored.empty:
            return pd.DataFrame({"seq": np.array([], np.int64), "match_seq": np.array([], np.int64)})
        stored = stored.sort_values("seq", kind="stable")
        c, _ = _unit(stored["vec"])
        c_seq, c_own = stored["seq"].to_numpy(), np.stack(stored["own"]) if "own" in stored else None
        seqs, matches = [], []
        for at in range(0, len(queries), SLICE):
            part = queries.iloc[at : at + SLICE]
            near = (1.0 - _unit(part["vec"])[0] @ c.T < threshold) & (c_seq[None, :] < part["bound"].to_numpy()[:, None])
            if c_own is not None:
                visited = np.stack(part["visited"])
                visited = visited.reshape(len(part), c_own.shape[1], -1)
                for row in np.flatnonzero(near.any(axis=1)):
                    met = np.flatnonzero(near[row])
                    near[row, met] = (visited[row][None] == c_own[met][:, :, None]).any(axis=(1, 2))
            hit = near.any(axis=1)
            seqs.append(part["seq"].to_numpy()[hit])
            matches.append(c_seq[near.argmax(axis=1)[hit]])
        return pd.DataFrame({"seq": np.concatenate(seqs), "match_seq": np.concatenate(matches)})

    return compare


def _compare_in_tiles(
    queries: DataFrame, stored: DataFrame, threshold: float, tile_rows: int, staging: Staging, vectors: DataFrame | None = None
) -> DataFrame:
    """Earliest match of each query (cell, seq, bound, vec) among the stored rows of its cells.

    A cell with more than ``tile_rows`` rows on either side is cut into tiles;
    each pair of tiles is one group. The table of tiles is written, so that its
    size decides how it meets the rows. With ``vectors`` (seq, vec) the queries
    have none of their own and get them last.
    """

    def sizes(frame, name):
        return frame.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile_rows).alias(name))

    tiles = staging.table(sizes(queries, "q_tiles").join(sizes(stored, "c_tiles"), "cell"), "tiles")

    def spread(frame, own, other):
        # New aliases, because both sides may come from one table.
        return (
            frame.select([F.col(name).alias(name) for name in frame.columns])
            .join(tiles, "cell")
            .withColumn(f"{own}_tile", F.pmod(F.xxhash64("seq"), F.col(f"{own}_tiles")))
            .withColumn(f"{other}_tile", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{other}_tiles") - 1)))
            .drop("q_tiles", "c_tiles")
        )

    keys = ["cell", "q_tile", "c_tile"]
    asked = spread(queries, "q", "c")
    # As files, ids are many times smaller than in a broadcast: such joins are sorted, whatever the size of the files.
    left = (asked if vectors is None else asked.hint("merge").join(vectors, "seq")).groupBy(*keys)
    right = spread(stored.drop("query", "bound"), "c", "q").groupBy(*keys)
    found = left.cogroup(right).applyInPandas(_compare(threshold), "seq bigint, match_seq bigint")
    return found.groupBy("seq").agg(F.min("match_seq").alias("match_seq"))


def _after_earliest(rows: DataFrame, threshold: float, tile_rows: int, staging: Staging) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(settled, open, later, number of open rows): asking rows against the earliest ones, and what that leaves.

    No row outside is earlier than the earliest ones, so a match among them is
    the earliest there is, and an asking row among them without a match has
    none. ``open`` are the other asking rows without a match, ``later`` all rows
    that they have not met. Where rows within the threshold are not rare, few
    rows stay open, and the rest costs little more than reading it.
    """
    total = rows.count()
    share = min(1.0, EARLY_TILES * tile_rows / max(1, total))
    last = rows.agg(F.percentile_approx("seq", share, 100_000)).first()[0]
    one = rows.withColumn("cell", F.lit(0).cast("bigint"))
    asking = one.filter("query").withColumn("bound", F.col("seq"))
    first = one if last is None else one.filter(F.col("seq") <= last)
    settled = staging.table(_compare_in_tiles(asking, first, threshold, tile_rows, staging), "early")
    later = one if last is None else one.filter(F.col("seq") > last)
    left = later.filter("query").withColumn("bound", F.col("seq")).hint("merge").join(settled.select("seq"), "seq", "left_anti")
    left = staging.table(left, "open")
    return settled, left, later, left.count()


def tree(
    vectors: DataFrame, threshold: float, first_match: bool, staging: Staging, tile_rows: int = TILE_ROWS, fan: int = FAN
) -> tuple[DataFrame, DataFrame]:
    """(placed, asked): each row (cell, seq, vec, query, bound) in a leaf, and the leaves (cell, seq) each row must ask.

    A cell of more than a tile is divided around centres of its own, again and
    again, so the number of leaves grows with the rows and none holds much more
    than a tile, unless its rows all match each other. Only ids are
    routed; ``bound`` is the earliest centre that matches, or the row itself. Centres meet the rows
    of their own cell only, so no task and no broadcast sees all of them.
    """
    columns = "cell bigint, seq bigint, vec array<float>, query boolean, bound bigint, parent bigint, angle double"
    usable = vectors.filter(_usable(F.col("vec"))).select(
        F.lit(0).cast("bigint").alias("cell"), "seq", F.col("vec").cast("array<float>").alias("vec"), "query", F.col("seq").cast("bigint").alias("bound"), F.lit(None).cast("double").alias("angle")
    )
    placed = staging.table(usable, "placed")
    asked = placed.filter("query").select("cell", "seq")
    reach = math.acos(max(-1.0, 1.0 - threshold))
    for level in range(DEPTH):
        counts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("angle").alias("radius"))
        # Rows that all match each other need not be told apart.
        counts = counts.filter((F.col("rows") > tile_rows) & (F.coalesce("radius", F.lit(math.pi)) > reach / 2))
        wide = staging.table(counts.select("cell", "rows"), "wide")
        if wide.isEmpty():
            break
        centres = staging.table(_centres(placed, wide, level, tile_rows, fan), "centres")
        names = wide.select("cell")
        moved = _dealt(placed, centres, wide, DEALT_TILES * tile_rows).applyInPandas(_assign(threshold, fan), columns)
        rest = placed.join(names, "cell", "left_anti").withColumn("parent", F.lit(None).cast("bigint"))
        placed = staging.table(moved.unionByName(rest), "placed")
        part = placed.filter("parent is not null").groupBy("parent", "cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"))
        part = part.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct("cell", "low", "high"))).alias("p"))
        part = part.select(F.col("parent").alias("cell"), F.col("p.cell").alias("cells"), F.col("p.low").alias("lows"), F.col("p.high").alias("highs"))
        shapes = staging.table(centres.join(part, "cell"), "shapes")
        # Flags need no second match.
        open_rows = placed.filter("query") if first_match else placed.filter("query and bound = seq")
        asked = asked.hint("merge").join(open_rows.select("seq"), "seq", "left_semi")
        going = staging.table(asked.join(names, "cell", "left_semi"), "going")
        asks = going.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"))
        going = going.hint("merge").join(open_rows.select("seq", "vec"), "seq")
        routed = _dealt(going, shapes, asks, DEALT_TILES * tile_rows).applyInPandas(_route(reach, fan), "cell bigint, seq bigint")
        asked = staging.table(routed.unionByName(asked.join(names, "cell", "left_anti").select("cell", "seq")), "asked")
        placed = placed.drop("parent")
    return placed, asked


def dense_matches(
    vectors: DataFrame, threshold: float, first_match: bool, staging: Staging, tile_rows: int = TILE_ROWS, fan: int = FAN
) -> DataFrame:
    """(seq, match_seq) for distinct dense vectors (seq, query, vec); exact.

    Rows meet the earliest ones first. Those left meet the others in tiles if
    they are few, else in a tree: a row can only match rows of a cell whose
    centre is within (threshold angle + cell radius) of it; all other cells are
    skipped.
    """
    usable = vectors.filter(_usable(F.col("vec"))).select("seq", F.col("vec").cast("array<float>").alias("vec"), "query")
    rows = staging.table(usable, "usable")
    settled, left, later, count = _after_earliest(rows, threshold, tile_rows, staging)
    if not count:
        return settled
    if count <= EARLY_TILES * tile_rows:
        return settled.unionByName(_compare_in_tiles(left, later, threshold, tile_rows, staging))
    asks = left.select("seq", F.lit(True).alias("open"))
    later = later.select("seq", "vec").hint("merge").join(asks, "seq", "left").select("seq", "vec", F.col("open").isNotNull().alias("query"))
    placed, asked = tree(later, threshold, first_match, staging, tile_rows, fan)
    centred = placed.filter("query and bound < seq").select("seq", F.col("bound").alias("match_seq"))
    open_rows = placed.filter("query") if first_match else placed.filter("query and bound = seq")
    queries = asked.hint("merge").join(open_rows.select("seq", "bound"), "seq").select("cell", "seq", "bound")
    stored = placed.select("cell", "seq", "vec")
    found = _compare_in_tiles(queries, stored, threshold, tile_rows, staging, placed.select("seq", "vec"))
    return settled.unionByName(centred.unionByName(found).groupBy("seq").agg(F.min("match_seq").alias("match_seq")))


def _signatures(planes: np.ndarray, tables: int, bits: int, probes: int):
    """Per row and table: the side of ``bits`` random planes, as a cell number (``own``, one per table).

    An asking row also visits the cells beyond the ``probes`` planes it lies
    nearest to, one at a time: a near row on another side is most likely there
    (``visited``, per table its own cell and these).
    """
    powers = 1 << np.arange(bits)

    def sign(batches):
        for whole in batches:
            for at in range(0, len(whole), SLICE):
                batch = whole.iloc[at : at + SLICE]
                unit, usable = _unit(batch["vec"])
                batch, unit = batch[usable], unit[usable]
                margins = (unit @ planes.T).reshape(len(batch), tables, bits)
                own = ((margins > 0) * powers).sum(axis=2)
                nearest = np.abs(margins).argsort(axis=2)[:, :, :probes]
                cells = np.concatenate([own[:, :, None], own[:, :, None] ^ powers[nearest]], axis=2)
                cells += (np.arange(tables) << bits)[None, :, None]
                yield batch.assign(own=list(cells[:, :, 0]), visited=list(cells.reshape(len(batch), -1)))

    return sign


def approximate_matches(
    vectors: DataFrame,
    threshold: float,
    tables: int,
    bits: int,
    seed: int,
    staging: Staging,
    probes: int = 2,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(seq, match_seq) among rows that share a cell in at least one table, or lie in a cell that the other visits.

    Rows meet the earliest ones first. What is left meets the others whole if it
    is little, else cell by cell.
    """
    if not 0 < bits <= 14 or not 0 < tables <= 64 or not 0 <= probes <= bits:
        raise ValueError("bits must be 1 to 14, tables 1 to 64, probes 0 to bits")
    dim = vectors.select(F.max(F.size("vec"))).first()[0]
    if dim is None:
        return vectors.sparkSession.createDataFrame([], "seq bigint, match_seq bigint")
    planes = np.random.default_rng(seed).normal(size=(tables * bits, dim))
    signed = staging.table(
        vectors.select("seq", "query", "vec").mapInPandas(
            _signatures(planes, tables, bits, probes), "seq bigint, query boolean, vec array<float>, own array<int>, visited array<int>"
        ),
        "signed",
    )
    settled, left, later, count = _after_earliest(signed, threshold, tile_rows, staging)
    if not count:
        return settled
    if count <= EARLY_TILES * tile_rows:
        return settled.unionByName(_compare_in_tiles(left, later, threshold, tile_rows, staging))
    queries = left.select(F.explode(F.col("visited").cast("array<bigint>")).alias("cell"), "seq", "bound", "vec")
    stored = later.select(F.explode(F.col("own").cast("array<bigint>")).alias("cell"), "seq", "vec")
    return settled.unionByName(_compare_in_tiles(queries, stored, threshold, tile_rows, staging))
