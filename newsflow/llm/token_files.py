"""Token ids of documents in ORC files.

Files hold (doc_id, place, ids) in ascending order of doc_id, null first.
ORC stores the ids with integer run-length encoding, keeps a row index per
stripe and a Bloom filter on doc_id, so a reader works stripe by stripe and
skips what cannot hold a wanted document.

Texts are range-partitioned and sorted before they are encoded. A tokenizer is
applied once per distinct word that a worker meets: white space ends a token
in every tokenizer that drops it, so a text's ids are those of its words in
order. That holds for the word-level vocabularies this module is meant for;
``whole_texts=True`` encodes each text as one string for all others.

Null text: only the end id. Empty and blank texts likewise. Rows with equal
ids all stay, ordered by a hash of their text. An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from newsflow.llm.words import Words, pieces, words_of
from newsflow.operators.ids import ROW_BITS
from newsflow.operators.shipping import ship_package

END_ID = 1
# Distinct words a worker remembers; beyond that it starts anew. One takes about 45 bytes.
CACHED_WORDS = 4_000_000
ORC = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "compression": "zstd",
}


class Encoder:
    """A tokenizer with the ids of words seen before; one per worker process."""

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._clear()

    @classmethod
    def load(cls, path: str) -> Encoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _clear(self) -> None:
        # Word fingerprints in order, and where each word's ids lie.
        self.known = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        lengths = np.array([len(f) for f in found], np.int64)
        starts = len(self.ids) + np.cumsum(lengths) - lengths
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum()))])
        at = np.searchsorted(self.known, hashes)
        self.known, self.starts = np.insert(self.known, at, hashes), np.insert(self.starts, at, starts)
        self.lengths = np.insert(self.lengths, at, lengths)

    def encode_words(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, number of ids of each word)."""
        hashes, place, name_of = np.unique(words.hashes(), return_index=True, return_inverse=True)
        if len(self.known) > CACHED_WORDS:
            self._clear()
        new = np.flatnonzero(~np.isin(hashes, self.known, assume_unique=True))
        if len(new):
            raw, starts, ends = words.raw.tobytes(), words.starts[place[new]], words.ends[place[new]]
            self._learn(hashes[new], [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())])
        entry = np.searchsorted(self.known, hashes)[name_of]
        lengths = self.lengths[entry]
        total = int(lengths.sum())
        shift = np.repeat(self.starts[entry] - (np.cumsum(lengths) - lengths), lengths)
        return self.ids[shift + np.arange(total)], lengths

    def encode(self, texts: pa.Array, end_id: int, whole: bool) -> pa.ListArray:
        """Ids of each text with the end id behind."""
        if whole:
            found = self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
            return pa.array([[*f.ids, end_id] for f in found], pa.list_(pa.int32()))
        words = words_of(texts)
        ids, lengths = self.encode_words(words)
        sizes = words.per_text(lengths, words.first)
        bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
        out = np.full(bounds[-1], end_id, np.int32)
        inside = np.ones(len(out), bool)
        inside[bounds[1:] - 1] = False
        out[inside] = ids
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(out))


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = END_ID,
    doc_id: str = "doc_id",
    text: str = "text",
    whole_texts: bool = False,
) -> None:
    """Encode every whole text and write the ids to ORC files under ``path``.

    ``tokenizer`` is the path of a tokenizer file that every executor can open.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.load(tokenizer)
        place = TaskContext.get().partitionId() << ROW_BITS
        for batch in batches:
            for piece in pieces(batch, "text"):
                ids = encoder.encode(piece.column("text"), end_id, whole_texts)
                rows = pa.array(np.arange(place, place + piece.num_rows))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), rows, ids], ["doc_id", "place", "ids"])
                place += piece.num_rows

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    encoded = sorted_rows.mapInArrow(run, f"doc_id {kind}, place bigint, ids array<int>")
    encoded.write.options(**ORC).orc(path)


def read_tokens(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """(doc_id, place, ids); with ``ids``, other stripes and row groups are skipped by their metadata."""
    rows = spark.read.orc(path)
    return rows if ids is None else rows.filter(F.col("doc_id").isin(ids))


def summary(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from what ``read_tokens`` gives.

    Starts are running sums inside each written partition, plus the totals of
    the partitions before it; only those totals, one row each, meet in a task.
    """
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            bounds = lists.offsets.to_numpy()
            flat = lists.values.to_numpy().astype("<u4")
            data = memoryview(flat).cast("B")
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("place"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(sums, pa.int64())],
                ["doc_id", "place", "n_tokens", "ids_crc32"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    digests = rows.mapInArrow(run, f"doc_id {kind}, place bigint, n_tokens bigint, ids_crc32 bigint")
    digests = digests.withColumn("part", F.shiftright("place", ROW_BITS))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        digests.groupBy("part")
        .agg(F.sum("n_tokens").alias("total"))
        .select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    )
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    local = digests.withColumn("local", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return local.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )
