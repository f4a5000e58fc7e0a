"""Hard negatives: rows of another label that score just below an anchor's positives.

Vectors are integers; a score is an inner product. An anchor's positives are
its best rows of the same label, its negatives for a positive the best rows of
other labels whose score lies in a window under the positive's score.

Angular triangle filtering decides what is scored. Every row stores its angles
to a few reference directions. For two rows with angles a and b to one of them
the angle between the rows lies in [|a - b|, min(a + b, 2 pi - a - b)]. The
cosines of these bounds, times the norms and widened by more than all rounding
errors, bound the score. Rows lie in chunks of similar direction; an anchor
meets a chunk only if the chunk's score interval overlaps a window that the
anchor still asks for, and the integers decide.

Anchors grow with the rows, so neither side is broadcast. Both are packed into
blocks of bounded size; pairs of blocks whose labels or angles cannot meet are
dropped on the blocks' bounds alone. Rows are taken in rounds of growing size:
what a round found narrows the windows of the next, so a pair of blocks returns
few rows. A block that holds a hot label is one of many, as blocks have a size
and labels do not decide where a row goes.

References are chosen from at most ``SAMPLE`` rows, those with the smallest
hash; they decide what is skipped, never the result.

Rows with a null label, a null vector or a null or non-finite component take no
part. A null id is no anchor and comes last among ties. A missing component of
a shorter vector counts as 0. Repeated rows count as rows of their own; each
repeated anchor gives its results. Scores beyond 64 bits are clamped. An empty
table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from newsflow.llm.blocks import LAST, column, pack, unpack
from newsflow.operators.shipping import ship_package
from newsflow.operators.staging import Staging, staging_for

SAMPLE = 2048
REFERENCES = 16
CHUNK = 256
# Rows and anchors of a block at most; at least this many blocks of rows are aimed at.
BLOCK = 65536
LEAST_BLOCK = 2048
BLOCKS = 48
# Anchors scored against a chunk at a time, and found rows kept before they are reduced.
ANCHORS = 2048
KEPT = 1 << 20
# Each round takes this many times the blocks of rows of all rounds before.
GROWTH = 12
# More than the error of an angle stored with 32 bits, and of the products.
_ANGLE_ERROR = 1e-5
_SCORE_ERROR = 1e-6
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_ROW_BITS = 33


def _directions(sample: list[list[int]]) -> np.ndarray:
    """At most ``REFERENCES`` unit vectors of a sample, each far from those before."""
    width = max([1, *map(len, sample)])
    vectors = np.array([v + [0] * (width - len(v)) for v in sample], np.float64).reshape(-1, width)
    norms = np.linalg.norm(vectors, axis=1)
    vectors = vectors[norms > 0] / norms[norms > 0, None]
    chosen = list(range(len(vectors)))[:1]
    nearest = vectors @ vectors[0] if chosen else norms
    while 0 < len(chosen) < min(REFERENCES, len(vectors)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    return vectors[chosen]


def _matrix(lists: pa.ListArray, fill: int = 0, width: int = 0) -> np.ndarray:
    """A list column of numbers as the rows of a matrix."""
    bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    sizes = np.diff(bounds)
    width = max(width, int(sizes.max(initial=0)))
    out = np.full((len(sizes), width), fill, flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat[bounds[0] : bounds[-1]]
    return out


def _fixed(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list column."""
    size, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * width), pa.array(matrix.ravel()))


def _narrowed(vectors: np.ndarray) -> np.ndarray:
    """The same integers with as few bits as hold them all."""
    most = max(-int(vectors.min(initial=0)), int(vectors.max(initial=0)))
    return vectors.astype(next(kind for kind in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(kind).max))


def angles_to(references: np.ndarray, vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Angle of each vector to each reference; a right angle for the zero vector, whose scores are 0 anyway."""
    width = min(vectors.shape[1], references.shape[1])
    cosines = vectors[:, :width].astype(np.float64) @ references[:, :width].T
    cosines /= np.where(norms > 0, norms, 1)[:, None]
    return np.arccos(np.clip(cosines, -1, 1))


def angle_bounds(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray):
    """(least, greatest) angle between rows whose angles to the references lie in two ranges."""
    least = np.maximum(np.maximum(low - other_high, other_low - high), 0).max(-1, initial=0)
    most = np.minimum(high + other_high, 2 * np.pi - low - other_low).min(-1, initial=np.pi)
    return least, most


def score_bounds(angle: tuple, norm_low, norm_high, other_low, other_high) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) inner product of vectors by the bounds of their angle and their norms."""
    cos_least = np.cos(np.minimum(angle[1] + _ANGLE_ERROR, np.pi))
    cos_most = np.cos(np.maximum(angle[0] - _ANGLE_ERROR, 0))
    short, long = norm_low * other_low, norm_high * other_high
    slack = 1 + _SCORE_ERROR * long
    return np.where(cos_least < 0, long, short) * cos_least - slack, np.where(cos_most < 0, short, long) * cos_most + slack


def scores_of(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of integer vectors; ``most`` bounds the product of two norms, so every partial sum."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if most < 2**23:
        return a.astype(np.float32) @ b.astype(np.float32).T
    if most < 2**52:
        return a.astype(np.float64) @ b.astype(np.float64).T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, _LEAST, _MOST).astype(np.int64)


class Block:
    """Rows of a payload in their order: by label, nearest reference, angle to it."""

    def __init__(self, payload: bytes):
        batch = unpack(payload)
        self.ids = batch.column("id")
        self.row, self.label, self.norm = (column(batch, n) for n in ("row", "label", "norm"))
        self.vectors = _matrix(batch.column("vector"))
        self.angles = _matrix(batch.column("angles")).astype(np.float64)


_BOUNDS = "label_low bigint, label_high bigint, norm_low double, norm_high double, low array<double>, high array<double>"
_BLOCK = f"block bigint, {_BOUNDS}, rows array<bigint>, payload binary"


def _block(number: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    label, norm = column(batch, "label"), column(batch, "norm")
    own = _matrix(batch.column("angles")).astype(np.float64)
    payload = batch.select(["row", "id", "label", "norm", "angles"]).append_column("vector", _fixed(_narrowed(_matrix(batch.column("vector")))))
    values = {
        "block": number, "label_low": label.min(), "label_high": label.max(), "norm_low": norm.min(), "norm_high": norm.max(),
        "low": own.min(0), "high": own.max(0), "rows": column(batch, "row"), "payload": pack(payload),
    }
    kinds = {"low": pa.list_(pa.float64()), "high": pa.list_(pa.float64()), "rows": pa.list_(pa.int64()), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(n)) for n, v in values.items()], list(values))


def _blocks(index: DataFrame, count: int, size: int) -> DataFrame:
    """Rows of the index in about count / size blocks of at most ``size`` neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, waiting, rows = TaskContext.get().partitionId() << _ROW_BITS, [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - rows)
                batch = batch.slice(part.num_rows)
                waiting.append(part)
                rows += part.num_rows
                if rows == size:
                    yield _block(number, pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])
                    number, waiting, rows = number + 1, [], 0
        if rows:
            yield _block(number, pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])

    order = ["label", "cell", "near", "row"]
    return index.repartitionByRange(-(-count // size), *order).sortWithinPartitions(*order).mapInArrow(run, _BLOCK)


def _may_meet(same: bool):
    """Pairs of blocks, by their bounds and the range of scores that the anchors of one still ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda name: column(batch, name)
            if same:
                keep = (get("label_low") <= get("to_label_high")) & (get("label_high") >= get("to_label_low"))
            else:
                one = (get("label_low") == get("label_high")) & (get("to_label_low") == get("to_label_high"))
                keep = ~(one & (get("label_low") == get("to_label_low")))
            between = angle_bounds(*(_matrix(batch.column(n)) for n in ("low", "high", "to_low", "to_high")))
            least, most = score_bounds(between, get("norm_low"), get("norm_high"), get("to_norm_low"), get("to_norm_high"))
            keep &= (most >= get("least")) & (least <= get("most"))
            yield batch.select(["block", "to_block"]).filter(pa.array(keep))

    return run


class _Found:
    """What a block of anchors has found so far: the best ``count`` rows per anchor and window."""

    def __init__(self, low: np.ndarray, count: int, order: np.ndarray, row: np.ndarray):
        self.low, self.count, self.order, self.row = low, count, order, row
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, anchor: np.ndarray, window: np.ndarray, score: np.ndarray, at: np.ndarray) -> None:
        self.parts.append((anchor, window, score.astype(np.int64), at))
        self.size += len(at)
        if self.size > KEPT:
            self.reduce()

    def reduce(self) -> tuple:
        """Keep the best; a full window asks for nothing below its last row from then on."""
        anchor, window, score, at = (np.concatenate(c) for c in zip(*self.parts))
        order = np.lexsort((self.row[at], self.order[at], ~score, window, anchor))
        anchor, window, score, at = (c[order] for c in (anchor, window, score, at))
        group = anchor * self.low.shape[1] + window
        first = np.flatnonzero(np.diff(group, prepend=-1))
        rank = np.arange(len(group)) - np.repeat(first, np.diff(first, append=len(group)))
        last = rank == self.count - 1
        self.low[anchor[last], window[last]] = np.maximum(self.low[anchor[last], window[last]], score[last])
        keep = rank < self.count
        self.parts = [tuple(c[keep] for c in (anchor, window, score, at))]
        self.size = int(keep.sum())
        return self.parts[0]


def scan(anchors: Block, low: np.ndarray, high: np.ndarray, rows: Block, same: bool, count: int) -> tuple:
    """(anchor, window, score, row) of the best rows per anchor and window [low, high]; positions in the blocks."""
    chunks = []
    for at in range(0, len(rows.row), CHUNK):
        part = slice(at, at + CHUNK)
        own, norm, label = rows.angles[part], rows.norm[part], rows.label[part]
        chunks.append((part, (own.min(0), own.max(0)), (norm.min(), norm.max()), label, label.min(), label.max()))
    order = rows.ids.fill_null(LAST).to_numpy(zero_copy_only=False)
    results = []
    for at in range(0, len(anchors.row), ANCHORS):
        some = slice(at, at + ANCHORS)
        own, norm, label, number = anchors.angles[some], anchors.norm[some], anchors.label[some], anchors.row[some]
        vectors, lows, highs = anchors.vectors[some], low[some].copy(), high[some]
        found = _Found(lows, count, order, rows.row)
        for part, bounds, norms, labels, label_low, label_high in chunks:
            least, most = score_bounds(angle_bounds(own, own, *bounds), norm, norm, *norms)
            asked = ((lows <= most[:, None]) & (highs >= least[:, None]) & (lows <= highs)).any(1)
            asked &= (label >= label_low) & (label <= label_high) if same else (label != label_low) | (label != label_high)
            who = np.flatnonzero(asked)
            if not len(who):
                continue
            scores = scores_of(vectors[who], rows.vectors[part], float(norm[who].max() * norms[1]))
            hit = (label[who][:, None] == labels) == same
            hit &= (scores >= lows[who].min(1)[:, None]) & (scores <= highs[who].max(1)[:, None])
            hit &= number[who][:, None] != rows.row[part]
            x, y = np.nonzero(hit)
            score = scores[x, y]
            for window in range(lows.shape[1]):
                wanted = np.flatnonzero((score >= lows[who[x], window]) & (score <= highs[who[x], window]))
                if len(wanted):
                    found.add(who[x[wanted]], np.full(len(wanted), window), score[wanted], part.start + y[wanted])
        if found.size:
            anchor, *rest = found.reduce()
            results.append((anchor + at, *rest))
    return tuple(np.concatenate(c) for c in zip(*results)) if results else (np.zeros(0, np.int64),) * 4


def _scan_pairs(same: bool, count: int):
    names = ["anchor", "window", "score", "id", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                anchors, rows = (Block(batch.column(n)[i].as_py()) for n in ("to_payload", "payload"))
                asked = batch.column("asked")[i].values
                order = np.argsort(column_of(asked, "row"))
                place = order[np.searchsorted(column_of(asked, "row"), anchors.row, sorter=order)]
                low, high = (_matrix(asked.field(n).take(pa.array(place)), fill) for n, fill in (("lows", _MOST), ("highs", _LEAST)))
                anchor, window, score, at = scan(anchors, low, high, rows, same, count)
                out = [pa.array(anchors.row[anchor]), pa.array(window.astype(np.int32)), pa.array(score), rows.ids.take(pa.array(at)), pa.array(rows.row[at])]
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def column_of(structs: pa.StructArray, name: str) -> np.ndarray:
    return structs.field(name).to_numpy(zero_copy_only=False)


def _best(rows: DataFrame, anchors: DataFrame, asked: DataFrame, count: int, same: bool, staging: Staging) -> DataFrame:
    """(anchor, window, score, id, row): the best ``count`` rows in each window of ``asked`` (row, block, lows, highs)."""
    bounds = [c for c in rows.columns if c not in ("block", "rows", "payload")]
    to = anchors.select("block", *bounds).select(*(F.col(c).alias(f"to_{c}") for c in ["block", *bounds]))
    to = staging.table(to.withColumn("place", F.row_number().over(Window.orderBy("to_block"))), "bounds")
    places, blocks = to.count(), rows.count()
    turn = F.pmod(F.xxhash64("block"), F.lit(1 << 30)) / float(1 << 30)
    shares = [min(1.0, 8 / max(1, blocks))]
    while shares[-1] < 1:
        shares.append(min(1.0, shares[-1] * (1 + GROWTH)))
    best, before = None, 0.0
    for share in shares:
        per_block = asked.groupBy("block").agg(
            F.min(F.array_min("lows")).alias("least"),
            F.max(F.array_max("highs")).alias("most"),
            F.collect_list(F.struct("row", "lows", "highs")).alias("asked"),
        )
        per_block = per_block.withColumnRenamed("block", "to_block")
        some = rows.filter((turn >= before) & (turn < share) if share < 1 else turn >= before)
        # Bounds only, some numbers a block; which pairs of blocks must be opened at all.
        met = some.select("block", *bounds, F.explode(F.sequence(F.lit(1), F.lit(places))).alias("place")).join(to, "place")
        met = met.join(per_block.drop("asked"), "to_block").mapInArrow(_may_meet(same), "block bigint, to_block bigint")
        opened = (
            met.join(some.select("block", "payload"), "block")
            .join(anchors.select(F.col("block").alias("to_block"), F.col("payload").alias("to_payload")), "to_block")
            .join(per_block.select("to_block", "asked"), "to_block")
        )
        found = opened.select("payload", "to_payload", "asked").mapInArrow(
            _scan_pairs(same, count), "anchor bigint, window int, score bigint, id bigint, row bigint"
        )
        found = found if best is None else found.unionByName(best)
        order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
        best = staging.table(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count).drop("rank"), "best")
        if share < 1:
            full = best.groupBy("anchor", "window").agg(F.count("*").alias("n"), F.min("score").alias("last")).filter(F.col("n") == count)
            full = full.groupBy(F.col("anchor").alias("row")).agg(F.map_from_entries(F.collect_list(F.struct("window", "last"))).alias("full"))
            raised = F.transform("lows", lambda low, i: F.coalesce(F.greatest(low, F.try_element_at("full", i)), low))
            asked = staging.table(asked.join(full, "row", "left").withColumn("lows", raised).drop("full"), "asked")
        before = share
    return best


def _index(rows: DataFrame, references: np.ndarray) -> DataFrame:
    """Rows with their angles to the references, the nearest of these, and a number of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << _ROW_BITS
        for batch in batches:
            vectors = _matrix(batch.column("vector"))
            norms = np.sqrt(np.square(vectors.astype(np.float64)).sum(1))
            found = angles_to(references, vectors, norms)
            cell = found.argmin(1) if found.shape[1] else np.zeros(len(norms), np.int64)
            near = found.min(1, initial=np.pi)
            size = batch.num_rows
            more = {"row": pa.array(np.arange(number, number + size)), "norm": pa.array(norms), "angles": _fixed(found.astype(np.float32)),
                    "cell": pa.array(cell.astype(np.int32)), "near": pa.array(near)}
            number += size
            yield pa.RecordBatch.from_arrays([*batch.columns, *more.values()], [*batch.schema.names, *more])

    kinds = "id bigint, label bigint, anchor boolean, vector array<bigint>, row bigint, norm double, angles array<float>, cell int, near double"
    return rows.mapInArrow(run, kinds)


def usable(label: Column, vector: Column) -> Column:
    """Whether a row takes part: a label, and a vector whose components are all there and finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return label.isNotNull() & F.coalesce(whole, F.lit(False))


def mine(
    rows: DataFrame,
    anchor: Column,
    vec_id: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    percent: int = 80,
    staging: Staging | None = None,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each row where ``anchor`` holds.

    A component x becomes floor(scale * x). A negative scores at least
    ``percent`` of its positive and at most as much. Labels are integers.
    """
    spark = rows.sparkSession
    ship_package(spark)
    staging = staging_for(rows, staging)
    own_label, own_vector = F.col(f"`{label}`"), F.col(f"`{vector}`")
    quantised = F.transform(own_vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    valid = rows.filter(usable(own_label, own_vector)).select(
        F.col(f"`{vec_id}`").cast("bigint").alias("id"),
        own_label.cast("bigint").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
        quantised.alias("vector"),
    )
    sample = valid.select("vector").orderBy(F.xxhash64("vector")).limit(SAMPLE).collect()
    index = staging.table(_index(valid, _directions([list(r.vector) for r in sample])), "index")
    count, n_anchors = index.agg(F.count("*"), F.coalesce(F.sum(F.col("anchor").cast("long")), F.lit(0))).first()
    size = min(BLOCK, max(LEAST_BLOCK, -(-count // BLOCKS)))
    blocks = staging.table(_blocks(index, max(1, count), size), "rows")
    anchors = staging.table(_blocks(index.filter("anchor"), max(1, n_anchors), BLOCK), "anchors")

    every = anchors.select("block", F.explode("rows").alias("row"))
    open_ended = every.select("row", "block", F.array(F.lit(_LEAST)).alias("lows"), F.array(F.lit(_MOST)).alias("highs"))
    of_label = _best(blocks, anchors, open_ended, positives, True, staging)
    ranked = of_label.filter(F.col("score") >= 0).withColumn(
        "window", F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")) - 1
    )
    # The least integer that is at least ``percent`` of a score, without leaving 64 bits.
    score, rest = F.col("score"), 100 - percent
    least = score - (F.expr("score div 100") * rest + F.expr(f"((score % 100) * {rest}) div 100"))
    ranked = staging.table(ranked.select("anchor", "window", F.col("id").alias("positive_id"), score.alias("positive_score"), least.alias("low")), "positives")
    in_order = F.sort_array(F.collect_list(F.struct("window", "low", "positive_score")))
    asked = ranked.groupBy(F.col("anchor").alias("row")).agg(in_order.alias("w"))
    asked = asked.select("row", F.col("w.low").alias("lows"), F.col("w.positive_score").alias("highs")).join(every, "row")
    asked = staging.table(asked.select("row", "block", "lows", "highs"), "asked")
    others = _best(blocks, anchors, asked, negatives, False, staging)
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    others = others.withColumn("rank", F.row_number().over(order))
    found = (
        others.select("anchor", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(ranked.drop("low"), ["anchor", "window"])
        .join(index.filter("anchor").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
    return staging.result(found, "hard-negatives")
