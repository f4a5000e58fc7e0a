"""Documents packed into blocks that keep their identity over several passes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from newsflow.llm.words import fold, pieces, words_of

_ROW_BITS = 33
HOMES = 8
_COMPRESSED = 512
# Spark's defaults for Arrow batches, and what whole texts need instead.
_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m"), "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000")}
LAST = np.iinfo(np.int64).max


def small_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, as each is held by the JVM and the worker at once; own settings stay."""
    for key, (default, wanted) in _BATCHES.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, wanted)


def release() -> None:
    """Give freed memory back to the system: a worker process outlives its task, and what it keeps adds up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as stream:
        return stream.read_next_batch()


def arrays(**columns: np.ndarray) -> bytes:
    """Numpy columns of equal length as compressed bytes."""
    return pack(pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns)))


def raw_columns(*columns: np.ndarray) -> bytes:
    """Columns of equal length as bytes without a schema: what a short message to a bucket can afford."""
    data = np.uint32(len(columns[0])).tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)
    packed = pa.compress(data, codec="zstd", asbytes=True) if len(data) >= _COMPRESSED else data
    return np.uint32(len(data)).tobytes() + packed


def from_raw(data: bytes, *kinds: type) -> list[np.ndarray]:
    """The columns of ``raw_columns``, given their types."""
    size, body = int(np.frombuffer(data, np.uint32, 1)[0]), data[4:]
    if size >= _COMPRESSED:
        body = pa.decompress(body, size, codec="zstd", asbytes=True)
    count, at, out = int(np.frombuffer(body, np.uint32, 1)[0]), 4, []
    for kind in kinds:
        out.append(np.frombuffer(body, kind, count, at))
        at += count * np.dtype(kind).itemsize
    return out


def entries(*columns: tuple[np.ndarray, int]) -> np.ndarray:
    """One row of bytes per entry, from (unsigned values, bytes that hold them)."""
    parts = [np.ascontiguousarray(v.astype("<u8")).view(np.uint8).reshape(len(v), 8)[:, :width] for v, width in columns]
    return np.concatenate(parts, 1)


def fields(rows: np.ndarray, *widths: int) -> list[np.ndarray]:
    """The columns of ``entries``."""
    out, at = [], 0
    for width in widths:
        wide = np.zeros((len(rows), 8), np.uint8)
        wide[:, :width] = rows[:, at : at + width]
        out.append(wide.view("<u8").ravel())
        at += width
    return out


def by_bucket(rows: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(bucket, message) from byte rows that are in order of their buckets: a message is its rows' bytes, nothing more."""
    found, starts = np.unique(buckets, return_index=True)
    offsets = (np.append(starts, len(rows)) * rows.shape[1]).astype(np.int32)
    data = pa.py_buffer(np.ascontiguousarray(rows).tobytes())
    return found.astype(np.int64), pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(offsets.tobytes()), data])


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def order_keys(ids: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(id, fingerprint of the text): the order of documents; a null id comes last."""
    words = words_of(texts)
    hashes, texts_of = words.hashes(), words.texts()
    tie = np.zeros(len(ids), np.uint64)
    np.add.at(tie, texts_of, fold(hashes, np.arange(len(hashes)) - words.first[texts_of]))
    return pc.fill_null(ids.cast(pa.int64()), LAST).to_numpy(zero_copy_only=False), tie


def into_blocks(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(home, block, payload): about a megabyte of whole documents a row, sorted by id.

    A block's number comes from its task and place, so callers write the
    result once and read that table in every later pass. Each task deals its
    blocks to ``HOMES`` homes, few enough for files of some size and enough for
    an even spread over buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        number = task << _ROW_BITS
        for batch in batches:
            for piece in pieces(batch, text):
                ids, texts = piece.column(doc_id), piece.column(text)
                keys, tie = order_keys(ids, texts)
                order = pa.array(np.lexsort((tie, keys)))
                block = pa.RecordBatch.from_arrays([ids.take(order), texts.take(order)], ["id", "text"])
                home = task * HOMES + number % HOMES
                yield pa.RecordBatch.from_arrays(
                    [pa.array([home]), pa.array([number]), pa.array([pack(block)], pa.binary())],
                    ["home", "block", "payload"],
                )
                number += 1

    return docs.select(doc_id, text).mapInArrow(run, "home bigint, block bigint, payload binary")
