"""Fill-in-the-middle rows, cut at line boundaries drawn by a hash of the id.

The boundaries of a text are one ordered set of code-point offsets: 0 and the
end of each line. It is kept as a compressed set: offsets with the same upper
16 bits share a container, which is a sorted array, a bitmap or a list of runs,
whichever takes the fewest bytes. Containers carry cumulative cardinalities,
so the k-th boundary is found by a search over containers and a select inside
one. Sets can be stored and cut again with other seeds without reading texts.

Texts are assembled in the JVM; Python sees them once, to find their lines.

Null text counts as empty. Empty texts, and texts that hold a sentinel, stay
plain. A null id draws like the empty id. Repeated rows give repeated results.
An empty table gives no rows. Other columns stay; new columns take free names.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from newsflow.llm.words import free_name, text_bytes
from newsflow.operators.shipping import ship_package

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_ARRAY, _BITMAP, _RUNS = 0, 1, 2
_WORDS = 1024  # 64-bit words of a bitmap of 2^16 bits


def _runs(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first value, number of values) of each run of consecutive values."""
    first = np.flatnonzero(np.diff(low, prepend=low[0] - 2) != 1)
    return low[first], np.diff(first, append=len(low))


@dataclass
class Container:
    kind: int
    data: np.ndarray

    @classmethod
    def of(cls, low: np.ndarray) -> Container:
        """The smallest container for sorted 16-bit values, given as wider integers."""
        if len(low) < 3:
            return cls(_ARRAY, low.astype("<u2"))
        starts, lengths = _runs(low)
        sizes = {_ARRAY: 2 * len(low), _BITMAP: 8 * _WORDS, _RUNS: 4 * len(starts)}
        kind = min(sizes, key=sizes.get)
        if kind == _ARRAY:
            return cls(kind, low.astype("<u2"))
        if kind == _RUNS:
            return cls(kind, np.stack([starts, lengths - 1], 1).astype("<u2").ravel())
        bits = np.zeros(64 * _WORDS, np.uint8)
        bits[low] = 1
        return cls(kind, np.packbits(bits, bitorder="little").view("<u8"))

    @classmethod
    def read(cls, kind: int, data: bytes) -> Container:
        return cls(kind, np.frombuffer(data, "<u8" if kind == _BITMAP else "<u2"))

    def select(self, rank: int) -> int:
        """The value with ``rank`` smaller ones."""
        if self.kind == _ARRAY:
            return int(self.data[rank])
        if self.kind == _RUNS:
            starts, lengths = self.data[::2].astype(np.int64), self.data[1::2].astype(np.int64) + 1
            upto = np.cumsum(lengths)
            run = int(np.searchsorted(upto, rank, "right"))
            return int(starts[run] + rank - (upto[run] - lengths[run]))
        upto = np.cumsum(np.bitwise_count(self.data).astype(np.int64))
        word = int(np.searchsorted(upto, rank, "right"))
        bits = np.unpackbits(self.data[word : word + 1].view(np.uint8), bitorder="little")
        before = int(upto[word - 1]) if word else 0
        return 64 * word + int(np.flatnonzero(bits)[rank - before])


class BoundarySet:
    """A set of non-negative integers below 2^48 with select."""

    def __init__(self, keys: np.ndarray, upto: np.ndarray, containers: list[Container]):
        # upto[i] is the number of members in containers 0 .. i.
        self.keys, self.upto, self.containers = keys, upto, containers

    @classmethod
    def of(cls, values: np.ndarray) -> BoundarySet:
        """From sorted distinct values."""
        high, low = values >> 16, values & 0xFFFF
        keys, first = np.unique(high, return_index=True)
        bounds = [*first.tolist(), len(values)]
        containers = [Container.of(low[a:b]) for a, b in zip(bounds, bounds[1:])]
        return cls(keys, np.array(bounds[1:], np.int64), containers)

    def __len__(self) -> int:
        return int(self.upto[-1]) if len(self.upto) else 0

    def select(self, rank: int) -> int:
        """The member with ``rank`` smaller ones."""
        at = int(np.searchsorted(self.upto, rank, "right"))
        before = int(self.upto[at - 1]) if at else 0
        return (int(self.keys[at]) << 16) + self.containers[at].select(rank - before)

    def to_bytes(self) -> bytes:
        parts = [struct.pack("<I", len(self.keys))]
        for key, upto, c in zip(self.keys.tolist(), self.upto.tolist(), self.containers):
            data = c.data.tobytes()
            parts += [struct.pack("<IQBI", key, upto, c.kind, len(data)), data]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> BoundarySet:
        (count,) = struct.unpack_from("<I", data)
        at, keys, upto, containers = 4, [], [], []
        for _ in range(count):
            key, total, kind, size = struct.unpack_from("<IQBI", data, at)
            at += struct.calcsize("<IQBI")
            keys.append(key)
            upto.append(total)
            containers.append(Container.read(kind, data[at : at + size]))
            at += size
        return cls(np.array(keys, np.int64), np.array(upto, np.int64), containers)


def _line_ends(raw: np.ndarray) -> np.ndarray:
    """0 and the end of each line of a text in UTF-8, in code points."""
    ends = np.flatnonzero(raw == ord("\n")) + 1
    if len(raw) and (not len(ends) or ends[-1] != len(raw)):
        ends = np.append(ends, len(raw))
    inner = np.flatnonzero((raw & 0xC0) == 0x80)  # bytes that start no code point
    return np.concatenate([[0], ends - np.searchsorted(inner, ends)])


def boundaries(text: Column) -> Column:
    """The stored boundary set of a text: 0 and the ends of its lines."""

    @F.arrow_udf("binary")
    def find(texts: pa.Array) -> pa.Array:
        raw, bounds = text_bytes(texts)
        pairs = zip(bounds[:-1].tolist(), bounds[1:].tolist())
        return pa.array([BoundarySet.of(_line_ends(raw[a:b])).to_bytes() for a, b in pairs], pa.binary())

    return find(text)


def cuts(stored: Column, one: Column, other: Column) -> Column:
    """(n, first, second) of a stored set of n + 1 boundaries: those of the two draws, modulo n + 1, in order."""

    @F.arrow_udf("struct<n: bigint, first: bigint, second: bigint>")
    def find(sets: pa.Array, ones: pa.Array, others: pa.Array) -> pa.Array:
        out = []
        for data, x, y in zip(sets.to_pylist(), ones.to_pylist(), others.to_pylist()):
            found = BoundarySet.from_bytes(data)
            first, second = sorted((x % len(found), y % len(found)))
            out.append({"n": len(found) - 1, "first": found.select(first), "second": found.select(second)})
        kind = pa.struct([("n", pa.int64()), ("first", pa.int64()), ("second", pa.int64())])
        return pa.array(out, kind)

    return find(stored, one, other)


def draws(doc_id: Column, seed: int, count: int = 4) -> list[Column]:
    """``count`` (at most 8) unsigned 32-bit numbers from a hash of seed and id."""
    digest = F.sha2(F.concat_ws("", F.lit(f"{seed}:"), doc_id.cast("string")), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(count)]


def transform(
    docs: DataFrame,
    seed: int = 7,
    percent: int = 100,
    spm_percent: int = 50,
    doc_id: str = "doc_id",
    text: str = "text",
) -> tuple[DataFrame, dict[str, str]]:
    """The rows of ``docs`` with the transformed text; (rows, names of the new columns).

    New columns, by their usual names: ``n`` lines, ``form`` (plain, psm or
    spm), ``prefix_chars`` and ``middle_chars`` (null if plain), ``output``.
    ``percent`` of the documents are transformed, ``spm_percent`` of these put
    the suffix first.
    """
    ship_package(docs.sparkSession)
    names: dict[str, str] = {}
    for wanted in ("n", "form", "prefix_chars", "middle_chars", "output", "cut"):
        names[wanted] = free_name([*docs.columns, *names.values()], wanted)
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    h1, h2, h3, h4 = draws(F.col(f"`{doc_id}`"), seed)
    rows = docs.withColumn(names["cut"], cuts(boundaries(F.col(f"`{text}`")), h1, h2))
    cut = F.col(names["cut"])
    held = whole.contains(PREFIX) | whole.contains(SUFFIX) | whole.contains(MIDDLE)
    plain = (whole == "") | held | (h3 % 100 >= percent)
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    prefix = F.substring(whole, F.lit(1), cut.first)
    middle = F.substring(whole, cut.first + 1, cut.second - cut.first)
    suffix = F.substring(whole, cut.second + 1, F.length(whole))
    output = (
        F.when(F.col(names["form"]) == "plain", whole)
        .when(F.col(names["form"]) == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    rows = rows.withColumn(names["form"], form)
    changed = F.col(names["form"]) != "plain"
    rows = rows.withColumns(
        {
            names["n"]: cut.n,
            names["prefix_chars"]: F.when(changed, cut.first),
            names["middle_chars"]: F.when(changed, cut.second - cut.first),
            names["output"]: output,
        }
    ).drop(names["cut"])
    del names["cut"]
    return rows, names


def restore(output: Column, form: Column) -> Column:
    """The text that ``transform`` was given, from its output and form alone."""
    head = F.substring_index(output, MIDDLE, 1)
    prefix = F.substring_index(F.when(form == "psm", F.substring_index(head, SUFFIX, 1)).otherwise(head), PREFIX, -1)
    suffix = F.substring_index(F.when(form == "spm", F.substring_index(head, PREFIX, 1)).otherwise(head), SUFFIX, -1)
    return F.when(form == "plain", output).otherwise(F.concat(prefix, F.substring_index(output, MIDDLE, -1), suffix))
