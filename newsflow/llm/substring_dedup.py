"""Removal of long passages that occur earlier, found by recompression.

Each text is rewritten in rounds. The first round replaces every run of equal
words by one symbol; every round then replaces pairs, where the first symbol
falls on the left side and the second on the right side of a split of all
symbols. Names and sides are fingerprints of content, so all tasks agree on
them: equal passages get equal symbols inside, only near their ends the
surroundings decide. After r rounds at most 2^r words at either end of a
passage differ. Symbols of the first few rounds, some words long, tell which
windows may occur twice at all; those of the last round, some hundred words
long, are shared by long repeats only.

1. Texts are packed into blocks and written once, bucketed, so that no later
   step moves a text.
2. Each block sends its distinct symbols to buckets. Of a short one the answer
   is whether it occurs anywhere else. A long one comes with its first
   document in the block; the answer is whether an earlier document has it.
   If so, all windows inside are settled: they start earlier elsewhere.
3. Other windows whose middle has only repeated short symbols are verified:
   each block sends the exact fingerprints of those whose first place in the
   block is not settled, with the document; the answer is whether an earlier
   document has the window. So of a long repeat the first copy sends its
   windows, the others only those across the ends of their long symbols.
4. Words under a window that starts earlier elsewhere are cut.

A message is one row of bytes per entry and nothing else, so its size follows
its entries however many buckets there are; a block sends at most one message
per entry. Answers, one bit per entry, go back to the block's home bucket.
Nothing is gathered beyond one bucket, and buckets follow the text volume.

Null text: no words. A null id counts as the largest id. Rows with the same id
are ordered by a hash of their text; of equal rows one counts as the earlier.
Ids are integers. Texts shorter than a window lose nothing. An empty table
gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cached_property
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from newsflow.llm.blocks import by_bucket, entries, fields, into_blocks, order_keys, unpack
from newsflow.llm.words import Words, fold, mix, span_hashes, window_hashes, words_of
from newsflow.operators.shipping import ship_package
from newsflow.operators.staging import Staging, staging_for

# Text bytes for which one bucket of symbols or windows is planned, and one of whole blocks.
BUCKET_BYTES = 16 << 20
HOME_BYTES = 32 << 20
MOST_HOMES = 1 << 16  # of a table; Spark's own limit is 100,000
# Rounds of the long symbols, which have about 4/3 as many words with each round.
LONG_ROUNDS = 16
_LOW_BITS = np.uint64(40)
_SYMBOL, _LONG, _WINDOW = 0, 1, 2
# Bytes of an entry's fields: a symbol with its flag; fingerprint, check, id and tie of a long symbol or a window.
_WIDTHS = {_SYMBOL: (5,), _LONG: (5, 4, 8, 4), _WINDOW: (5, 4, 8, 4)}


def rounds_for(size: int) -> int:
    """Rounds after which the middle of a window is still certain."""
    return max(0, ((size - 1) // 2).bit_length() - 1)


def recompress(words: np.ndarray, texts: np.ndarray, rounds: int, done: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, word at which each starts) of texts given as fingerprints of words, or of symbols after ``done`` rounds."""
    if not len(words):
        return words, np.zeros(0, np.int64)
    fresh = np.ones(len(words), bool)
    fresh[1:] = (words[1:] != words[:-1]) | (texts[1:] != texts[:-1])
    starts = np.flatnonzero(fresh)
    lengths = np.diff(starts, append=len(words))
    symbols = np.where(lengths > 1, fold(words[starts], lengths), words[starts])
    for number in range(done + 1, done + rounds + 1):
        left = (mix(symbols + np.uint64(number)) & np.uint64(1)).astype(bool)
        owner = texts[starts]
        joined = left[:-1] & ~left[1:] & (owner[1:] == owner[:-1])
        first = np.flatnonzero(joined)
        symbols = symbols.copy()
        symbols[first] = fold(symbols[first], symbols[first + 1], np.full(len(first), number))
        keep = np.ones(len(symbols), bool)
        keep[first + 1] = False
        symbols, starts = symbols[keep], starts[keep]
    return symbols, starts


class _Block:
    """The words, symbols and windows of one block; the same in every pass."""

    def __init__(self, payload: bytes, size: int, buckets: int):
        batch = unpack(payload)
        self.ids, self.texts, self.size, self.buckets = batch.column("id"), batch.column("text"), size, buckets
        self.words: Words = words_of(self.texts)
        self.hashes = self.words.hashes()
        self.seconds = self.words.hashes(1)
        self.owner = self.words.texts()
        rounds = rounds_for(size)
        self.margin = (1 << rounds) if rounds else 0
        symbols, self.starts = recompress(self.hashes, self.owner, rounds)
        # One bit of the forty tells that a name occurs again in this block.
        self.names, self.name_of, counts = np.unique(symbols, return_inverse=True, return_counts=True)
        self.name_more = counts > 1
        longs, starts = recompress(symbols, self.owner[self.starts], LONG_ROUNDS - rounds, rounds)
        first = self.starts[starts] if len(starts) else starts
        ends = np.append(first[1:], len(self.hashes)) if len(first) else first
        wide = ends - first > size
        self.long_first, self.long_end = first[wide], ends[wide]
        self.long_second = span_hashes(self.seconds, self.long_first, self.long_end, 1) if len(first) else longs
        both = fold(longs[wide], self.long_second) if len(first) else longs
        self.long_names, self.long_place, self.long_of = np.unique(both, return_index=True, return_inverse=True)

    def sent(self, kind: int, key: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, bucket, byte row) of the entries of one kind, by bucket; equal in every pass."""
        bucket = (key >> _LOW_BITS) % np.uint64(self.buckets)
        order = np.lexsort((key, bucket))
        return order, bucket[order], entries(*zip([c[order] for c in (key, *more)], _WIDTHS[kind]))

    def symbols(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flagged = (self.names & ~np.uint64(1)) | self.name_more.astype(np.uint64)
        return self.sent(_SYMBOL, flagged)

    def longs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        documents = self._document(self.long_first[self.long_place])
        return self.sent(_LONG, self.long_names, self.long_second[self.long_place], *documents)

    @cached_property
    def _order(self) -> tuple[np.ndarray, np.ndarray]:
        return order_keys(self.ids, self.texts)

    def _document(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, upper part of the tie) of the documents of some words."""
        (number, tie), owner = self._order, self.owner[place]
        return number[owner].astype(np.uint64), tie[owner] >> np.uint64(32)

    def windows(self, repeated: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple]:
        """Windows that may occur twice: (starts, name of each, places and settled flags of the names, entries).

        ``repeated`` has a flag per short symbol, ``earlier`` one per long
        symbol. A name's place is where it starts first in this block.
        """
        starts, count = self.words.window_starts(self.size), len(self.hashes)
        single = np.repeat(~repeated[self.name_of], np.diff(self.starts, append=count)) if count else np.zeros(0, bool)
        singles = np.concatenate([[0], np.cumsum(single)])
        equal = np.zeros(count, bool)
        equal[:-1] = (self.hashes[1:] == self.hashes[:-1]) & (self.owner[1:] == self.owner[:-1])
        equals = np.concatenate([[0], np.cumsum(equal)])
        middle = singles[starts + self.size - self.margin] - singles[starts + self.margin]
        runs = equals[starts + self.size - 1] - equals[starts]
        starts = starts[(middle == 0) | (runs > 0)]
        # A long symbol settles the windows inside if it is not the first of its name.
        later = earlier[self.long_of] | (np.arange(len(self.long_of)) != self.long_place[self.long_of])
        until = np.zeros(count + 1, np.int64)
        until[self.long_first[later]] = self.long_end[later]
        until = np.maximum.accumulate(until)
        first = window_hashes(self.hashes, self.size)[starts] if len(starts) else np.zeros(0, np.uint64)
        second = window_hashes(self.seconds, self.size, 1)[starts] if len(starts) else first
        _, place, name_of = np.unique(fold(first, second), return_index=True, return_inverse=True)
        settled = starts[place] + self.size <= until[starts[place]]
        asked = place[~settled]
        entry = self.sent(_WINDOW, mix(first[asked]), second[asked], *self._document(starts[asked]))
        return starts, name_of, place, settled, entry


_SENT = "home bigint, block bigint, kind int, bucket bigint, data binary"


def _messages(home: int, block: int, kind: int, buckets: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    found, data = by_bucket(rows, buckets)
    same = [pa.array(np.full(len(found), v), t) for v, t in ((home, pa.int64()), (block, pa.int64()), (kind, pa.int32()))]
    return pa.RecordBatch.from_arrays([*same, pa.array(found), data], ["home", "block", "kind", "bucket", "data"])


def _answer(table: pa.Table) -> pa.Table:
    """A bit for each entry of a bucket: a symbol occurs again, a long symbol or a window has an earlier document."""
    kind = table.column("kind")[0].as_py()
    widths = _WIDTHS[kind]
    messages = table.column("data").to_pylist()
    rows = np.frombuffer(b"".join(messages), np.uint8).reshape(-1, sum(widths))
    sizes = np.array([len(m) for m in messages]) // sum(widths)
    if kind == _SYMBOL:
        (key,) = fields(rows, *widths)
        _, name_of, counts = np.unique(key >> np.uint64(1), return_inverse=True, return_counts=True)
        several = counts > 1
        several[name_of[(key & np.uint64(1)) > 0]] = True
        flags = several[name_of]
    else:
        key, check, number, tie = fields(rows, *widths)
        key = fold(key, check)
        order = np.lexsort((np.repeat(table.column("block").to_numpy(), sizes), tie, number.view(np.int64), key))
        flags = np.zeros(len(key), bool)
        flags[order[1:]] = key[order[1:]] == key[order[:-1]]
    parts = np.split(flags, np.cumsum(sizes)[:-1])
    return table.set_column(4, "data", pa.array([np.packbits(p).tobytes() for p in parts], pa.binary()))


def _read(answers: list[dict], block: int, kind: int, order: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """The answers of one kind to a block, put back in its own order."""
    got = sorted((a["bucket"], a["data"]) for a in answers if a["block"] == block and a["kind"] == kind)
    sizes = np.unique(buckets, return_counts=True)[1].tolist()
    bits = [np.unpackbits(np.frombuffer(data, np.uint8), count=n) for (_, data), n in zip(got, sizes, strict=True)]
    out = np.zeros(len(order), bool)
    if bits:
        out[order] = np.concatenate(bits)
    return out


def _blocks_of(batches: Iterator[pa.RecordBatch], size: int, buckets: int) -> Iterator[tuple[int, int, _Block, list]]:
    for batch in batches:
        answers = batch.column("answers") if "answers" in batch.schema.names else None
        for i, (home, number) in enumerate(zip(batch.column("home").to_pylist(), batch.column("block").to_pylist())):
            block = _Block(batch.column("payload")[i].as_py(), size, buckets)
            yield home, number, block, (answers[i].as_py() or []) if answers is not None else []


def _gathered(homes: int, *answers: DataFrame) -> DataFrame:
    """(home, answers): what all buckets answered to a home's blocks, some bits per word of them.

    Dealt out like the blocks, so that the join moves no block.
    """
    rows = answers[0]
    for part in answers[1:]:
        rows = rows.unionByName(part)
    return rows.repartition(homes, "home").groupBy("home").agg(F.collect_list(F.struct("block", "kind", "bucket", "data")).alias("answers")).hint("shuffle_hash")


def remove_repeats(
    docs: DataFrame,
    size: int = 20,
    doc_id: str = "doc_id",
    text: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    staging: Staging | None = None,
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): texts without windows of ``size`` words seen earlier."""
    spark = docs.sparkSession
    ship_package(spark)
    staging = staging_for(docs, staging)
    id_type = docs.schema[doc_id].dataType.simpleString()
    docs = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(8, -(-total // bucket_bytes))
    # Written in buckets of homes: what joins them later moves to them.
    name = f"newsflow_blocks_{uuid.uuid4().hex}"
    homes = min(MOST_HOMES, max(8, -(-total // HOME_BYTES)))
    into_blocks(docs, "id", "text").write.bucketBy(homes, "home").option("path", f"{staging.root}/{name}").saveAsTable(name)
    blocks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # only the name; the files belong to the staging folder

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for home, number, block, _ in _blocks_of(batches, size, buckets):
            yield _messages(home, number, _SYMBOL, *block.symbols()[1:])
            yield _messages(home, number, _LONG, *block.longs()[1:])

    def flags(block: _Block, number: int, answers: list) -> tuple[np.ndarray, np.ndarray]:
        return _read(answers, number, _SYMBOL, *block.symbols()[:2]), _read(answers, number, _LONG, *block.longs()[:2])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for home, number, block, answers in _blocks_of(batches, size, buckets):
            *_, entry = block.windows(*flags(block, number, answers))
            yield _messages(home, number, _WINDOW, *entry[1:])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, number, block, answers in _blocks_of(batches, size, buckets):
            starts, name_of, place, settled, (order, bucket, _) = block.windows(*flags(block, number, answers))
            # Of a name only the first place may stay, if nothing earlier has it.
            settled[~settled] = _read(answers, number, _WINDOW, order, bucket)
            repeat = np.ones(len(starts), bool)
            repeat[place] = settled
            change = np.zeros(len(block.hashes) + 1, np.int64)
            np.add.at(change, starts[repeat], 1)
            np.add.at(change, starts[repeat] + size, -1)
            keep = np.cumsum(change[:-1]) == 0
            removed = block.words.per_text(~keep, block.words.first)
            kept = []
            for i, value in enumerate(block.texts.to_pylist()):
                found = (value or "").encode().split()
                if removed[i]:
                    found = compress(found, keep[block.words.first[i] : block.words.first[i + 1]])
                kept.append(b" ".join(found).decode())
            yield pa.RecordBatch.from_arrays(
                [block.ids, pa.array(block.words.counts), pa.array(removed), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text"],
            )

    shared = staging.table(blocks.mapInArrow(symbols, _SENT).groupBy("kind", "bucket").applyInArrow(_answer, _SENT), "symbols")
    asked = blocks.join(_gathered(homes, shared), "home", "left").mapInArrow(windows, _SENT)
    later = staging.table(asked.groupBy("kind", "bucket").applyInArrow(_answer, _SENT), "windows")
    return blocks.join(_gathered(homes, shared, later), "home", "left").mapInArrow(
        cut, f"doc_id {id_type}, n_words bigint, n_removed bigint, kept_text string"
    )
