"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger holds the measurements
and one bit per failed rule; a policy is a versioned set of rules, that is a bit
mask, so trying another policy or leaving a rule out never reads a text again.

Null text: no words, so the rule on length fails. Empty tables give empty
ledgers. Repeated rows are judged one by one. Extra columns stay, whatever
their names; the ledger sits in one struct column whose name avoids them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from newsflow.llm.words import Words, fold, free_name, pieces, span_hashes, window_hashes, words_of
from newsflow.operators.shipping import ship_package

MEASURES = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_upper n_letters n_alpha_words"
).split()

# Rule name -> condition, in SQL over the measures, under which a document fails.
# A rule's bit is its place here; new rules go to the end.
RULES = {
    "too_short": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 14 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "upper_case": "100 * n_upper > 40 * n_letters",
    "few_letters": "100 * n_alpha_words < 70 * n_words",
}


@dataclass(frozen=True)
class Policy:
    """A named version: the rules that reject."""

    version: str
    rules: tuple[str, ...]

    def mask(self, catalogue: dict[str, str] = RULES) -> int:
        return sum(1 << list(catalogue).index(rule) for rule in self.rules)


BASE = Policy("base", ("too_short", "repeated_words"))
STRICT = Policy("strict-1", tuple(RULES))

_SYMBOL, _UPPER, _ALPHA = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[ord("A") : ord("Z") + 1] = True
_ALPHA[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


def _in_spans(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[ends] - total[starts]


def _lines(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(non-blank lines, those equal to an earlier one) per text."""
    texts = len(words.offsets) - 1
    breaks = np.flatnonzero(words.raw == 10)
    owner = np.searchsorted(words.offsets, breaks, "right") - 1
    owners = np.concatenate([np.arange(texts), owner])
    starts = np.concatenate([words.offsets[:-1], breaks + 1])
    ends = np.concatenate([words.offsets[1:], breaks])
    # A line start and a line end of the same rank belong together; adding the
    # text's number keeps texts apart that meet at one byte.
    order = np.argsort(starts + owners, kind="stable")
    starts, owners = starts[order], owners[order]
    ends = ends[np.argsort(ends + np.concatenate([np.arange(texts), owner]), kind="stable")]
    filled = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, owners = starts[filled], ends[filled], owners[filled]
    lines = np.bincount(owners, minlength=texts)
    values = words.raw.astype(np.uint64) + np.uint64(1)
    keys = fold(span_hashes(values, starts, ends), span_hashes(values, starts, ends, 1), owners)
    _, where = np.unique(keys, return_index=True)
    return lines, lines - np.bincount(owners[where], minlength=texts)


def _repeated(words: Words, size: int = 3) -> np.ndarray:
    """Words inside a window of ``size`` words that occurs at least twice in its text."""
    starts = words.window_starts(size)
    hashes = window_hashes(words.hashes(), size)[starts] if len(starts) else np.zeros(0, np.uint64)
    keys = fold(hashes, words.texts()[starts])
    order = np.argsort(keys)
    keys = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[1:] == keys[:-1]
    twice = starts[order[same[:-1] | same[1:]]] if len(keys) else starts
    covered = np.zeros(len(words.starts), bool)
    for step in range(size):
        covered[twice + step] = True
    return words.per_text(covered, words.first)


def measure_texts(column: pa.Array) -> dict[str, np.ndarray]:
    """All measures of a string column."""
    words = words_of(column)
    raw = words.raw
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[words.starts] = 1
    inside[words.ends] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    lines, repeated_lines = _lines(words)
    alpha = _ALPHA[raw]
    return {
        "n_words": words.counts,
        "word_chars": words.per_text(inside & ((raw & 0xC0) != 0x80)),
        "n_symbols": words.per_text(_SYMBOL[raw]),
        "n_dup_lines": repeated_lines,
        "n_repeat_words": _repeated(words),
        "n_lines": lines,
        "n_upper": words.per_text(_UPPER[raw]),
        "n_letters": words.per_text(alpha),
        "n_alpha_words": words.per_text(_in_spans(alpha, words.starts, words.ends) > 0, words.first),
    }


def measured(docs: DataFrame, text: str = "text", into: str = "ledger") -> tuple[DataFrame, str]:
    """``docs`` with a struct of all measures, and the name of that column."""
    ship_package(docs.sparkSession)
    name = free_name(docs.columns, into)
    kind = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text):
                found = measure_texts(piece.column(text))
                struct = pa.StructArray.from_arrays([pa.array(found[m].astype(np.int64)) for m in MEASURES], MEASURES)
                yield pa.RecordBatch.from_arrays([*piece.columns, struct], [*piece.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, kind)])), name


def failure_bits(rules: dict[str, str] = RULES, struct: str | None = None) -> Column:
    """The bit of every rule that a document fails; the measures are columns, or fields of ``struct``."""
    bits = F.lit(0).cast("bigint")
    for place, condition in enumerate(rules.values()):
        if struct:
            condition = re.sub(rf"\b({'|'.join(MEASURES)})\b", rf"`{struct}`.\1", condition)
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << place)).otherwise(F.lit(0)).cast("bigint"))
    return bits


def ledger(docs: DataFrame, text: str = "text", keep: list[str] | None = None, rules: dict[str, str] = RULES) -> DataFrame:
    """(kept columns, measures, failure_bits): each rule evaluated once per document."""
    keep = ["doc_id"] if keep is None else keep
    rows, name = measured(docs.select(*dict.fromkeys([*keep, text])), text)
    return rows.select(*keep, F.col(f"`{name}`.*"), failure_bits(rules, name).alias("failure_bits"))


def rejects(bits: Column, policy: Policy, catalogue: dict[str, str] = RULES) -> Column:
    return bits.bitwiseAND(F.lit(policy.mask(catalogue))) != 0


def ablations(entries: DataFrame, policies: list[Policy], catalogue: dict[str, str] = RULES) -> DataFrame:
    """Per policy and rule: documents, failures, rejections, and what only this rule rejects.

    The ledger is first counted by bit pattern, of which there are at most
    2^rules; everything else is bit arithmetic over those counts.
    """
    cases = [
        F.struct(
            F.lit(policy.version).alias("version"),
            F.lit(rule).alias("rule"),
            F.lit(policy.mask(catalogue)).cast("bigint").alias("mask"),
            F.lit(1 << list(catalogue).index(rule)).cast("bigint").alias("bit"),
        )
        for policy in policies
        for rule in policy.rules
    ]
    bits = F.col("failure_bits")
    counted = lambda wanted: F.sum(F.when(wanted, F.col("n")).otherwise(0))
    return (
        entries.groupBy("failure_bits")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("failure_bits", "n", F.explode(F.array(*cases)).alias("case"))
        .select("failure_bits", "n", "case.*")
        .groupBy("version", "rule")
        .agg(
            F.sum("n").alias("documents"),
            counted(bits.bitwiseAND(F.col("bit")) != 0).alias("failed"),
            counted(bits.bitwiseAND(F.col("mask")) != 0).alias("rejected"),
            counted(bits.bitwiseAND(F.col("mask")) == F.col("bit")).alias("rejected_by_it_alone"),
        )
    )


def accepted(docs: DataFrame, policy: Policy = STRICT, text: str = "text") -> DataFrame:
    """The documents that ``policy`` keeps, with their own columns."""
    rows, name = measured(docs, text)
    return rows.filter(~rejects(failure_bits(RULES, name), policy)).drop(name)
