"""Language identification by prediction by partial matching.

Every language gets a tree of byte contexts of up to three bytes with counts of
what follows. A byte costs -log2 of its probability in the longest context that
the language knows; a byte unseen there pays the escape probability and is
looked up one byte shorter, down to a uniform order. The statistics are frozen
before scoring: contexts kept by the trees are laid out as one table of exact
code lengths, so a text costs one lookup per byte for all languages together.
The language with the shortest code wins, the first by name of equals; the
score is its posterior share.

Trees are fitted on a bounded sample: per language about ``sample`` documents
chosen by a hash of the id. All their byte sequences are counted and every
language is kept. Contexts seen fewer than ``least`` times in all samples
together are left to shorter ones; ``least`` is the smallest power of two for
which the table of code lengths has at most ``TABLE_BYTES``, which
is what travels to the executors. Everything else covers all documents.

Null text, or one without a letter: 'und', score 0. Null labels are not
learned. Without any labelled text, or in an empty table, nothing is learned
and every prediction is 'und'. Very long texts are scored whole, in pieces of
rows. Repeated rows get the same prediction. Kept columns may have any name but
``lang_pred`` and ``score``; others are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from newsflow.llm.words import free_name, pieces, text_bytes
from newsflow.operators.shipping import ship_package
from newsflow.operators.staging import Staging, staging_for

ORDER = 3
SAMPLE_DOCS = 1000
TABLE_BYTES = 32 << 20


def _grams(raw: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> list[np.ndarray]:
    """The byte at each place and the three before it, newest first; 0 before a text's start."""
    columns = [values[raw]]
    position = np.arange(len(raw)) - np.repeat(offsets[:-1], np.diff(offsets))
    for back in range(1, ORDER + 1):
        column = np.zeros(len(raw), columns[0].dtype)
        column[back:] = columns[0][:-back]
        column[position < back] = values[0]
        columns.append(column)
    return columns


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) of (lang, text): four-byte sequences by language, the newest byte lowest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                names = np.array(piece.column("lang").to_pylist(), object)
                for name in np.unique(names):
                    raw, offsets = text_bytes(piece.column("text").filter(pa.array(names == name)))
                    columns = _grams(raw, offsets, np.arange(256, dtype=np.int64))
                    codes, counts = np.unique(sum(c << (8 * i) for i, c in enumerate(columns)), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], ["lang", "gram", "n"])

    rows = docs.select("lang", F.lower("text").alias("text"))
    return rows.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Trees:
    """The context trees of all languages as one table of code lengths."""

    def __init__(self, counts: pa.Table, table_bytes: int = TABLE_BYTES):
        names = counts.column("lang").to_numpy() if counts.num_rows else np.zeros(0, object)
        self.languages = sorted(set(names.tolist()))
        lang = np.searchsorted(np.array(self.languages, object), names) if len(names) else np.zeros(0, np.int64)
        gram, n = counts.column("gram").to_numpy().astype(np.int64), counts.column("n").to_numpy().astype(np.float64)
        parts = [(gram >> (8 * i)) & 255 for i in range(ORDER + 1)]
        # How often each row's context of an order occurs; rare ones are left to shorter contexts.
        often = [np.ones(len(gram))]
        rows = []
        for order in range(1, ORDER + 1):
            _, of = np.unique((gram >> 8) & ((1 << (8 * order)) - 1), return_inverse=True)
            totals = np.bincount(of, n)
            often.append(totals[of])
            rows.append(totals)
        row_bytes = 4 * (len(np.unique(gram & 255)) + 2) * max(1, len(self.languages))
        self.least = 1
        while sum((r >= self.least).sum() for r in rows) * row_bytes > table_bytes:
            self.least *= 2
        seen = np.unique(np.concatenate([np.zeros(1, np.int64), *parts]))
        # Class 0 stands for all bytes that no language has.
        self.values = np.zeros(256, np.int32)
        self.values[seen] = np.arange(1, len(seen) + 1)
        size, languages = len(seen) + 1, len(self.languages)
        parts = [self.values[p].astype(np.int64) for p in parts]
        self.size = size
        # Probabilities of every byte class after a context; order -1 is uniform over bytes.
        probability = np.full((1, size, languages), 1 / 256)
        row_of = np.zeros(1, np.int64)  # context code -> row, for the order before
        for order in range(ORDER + 1):
            code = np.zeros(len(gram), np.int64)
            for back in range(order, 0, -1):
                code = code * size + parts[back]
            contexts = np.unique(code[often[order] >= self.least] if order else code)
            if not len(contexts):
                # Nothing known at this order: its codes point to the rows of the order before.
                row_of = row_of[np.arange(size**order) % (size ** (order - 1))] if order else row_of
                continue
            at = np.minimum(np.searchsorted(contexts, code), len(contexts) - 1)
            known = contexts[at] == code
            count = np.zeros((len(contexts), size, languages))
            np.add.at(count, (at[known], parts[0][known], lang[known]), n[known])
            total, kinds = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
            shorter = row_of[contexts % (size ** max(order - 1, 0))] if order else np.zeros(len(contexts), np.int64)
            lower = probability[shorter]
            escape = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
            mine = np.where(count > 0, count / np.maximum(total + kinds, 1), escape * lower)
            # Every code of this order points to its own row, or to that of its shorter context.
            rows = np.arange(size**order) % (size ** max(order - 1, 0)) if order else np.zeros(1, np.int64)
            row_of = row_of[rows] if order else row_of
            if order == 0:
                probability, row_of = mine, np.zeros(1, np.int64)
            else:
                row_of[contexts] = len(probability) + np.arange(len(contexts))
                probability = np.concatenate([probability, mine])
        self.row_of = row_of.astype(np.int32)
        self.bits = (-np.log2(probability)).astype(np.float32)

    def code_lengths(self, column: pa.Array) -> np.ndarray:
        """Bits of each text under each language."""
        raw, offsets = text_bytes(column)
        columns = _grams(raw, offsets, self.values.astype(np.int64))
        code = np.zeros(len(raw), np.int64)
        for back in range(ORDER, 0, -1):
            code = code * self.size + columns[back]
        bits = self.bits[self.row_of[code], columns[0]]
        total = np.zeros((len(bits) + 1, len(self.languages)))
        np.cumsum(bits, axis=0, dtype=np.float64, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]


def fit(docs: DataFrame, lang: str = "lang", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE_DOCS, staging: Staging | None = None) -> Trees:
    """Trees from a bounded sample of the given labelled documents."""
    staging = staging_for(docs, staging)
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = rows.filter("lang is not null and text is not null")
    counts = staging.table(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("of")), "languages")
    chance = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 32)) / F.lit(float(1 << 32))
    chosen = rows.join(counts, "lang").filter(chance < sample / F.col("of"))
    # As large as the sample's own byte sequences, whatever the corpus.
    return Trees(staging.table(gram_counts(chosen), "grams").orderBy("lang", "gram").toArrow())


def predict(docs: DataFrame, trees: Trees, keep: list[str], text: str = "text") -> DataFrame:
    """(kept columns, lang_pred, score) from the text alone."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    body_name, letters_name = free_name(keep, "body"), free_name(keep, "letters")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for piece in pieces(batch, body_name):
                letters = np.array(piece.column(letters_name).to_pylist(), bool)
                names = np.full(len(letters), "und", object)
                score = np.zeros(len(letters))
                if known.languages and len(letters):
                    bits = known.code_lengths(piece.column(body_name))
                    best = bits.argmin(1)
                    share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                    names = np.where(letters, np.array(known.languages, object)[best], "und")
                    score = np.where(letters, share, 0.0)
                rest = [piece.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(names.tolist(), pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    whole, kept = F.col(f"`{text}`"), [F.col(f"`{c}`") for c in keep]
    rows = docs.select(*kept, F.lower(whole).alias(body_name), F.coalesce(whole.rlike(r"\p{L}"), F.lit(False)).alias(letters_name))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Whether a document is in the quarter that is not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
