"""SentencePiece ids by backtracking over longest matches, and texts from ids.

A model of merge type joins, again and again, the neighbouring pieces whose
union has the best score, the leftmost of equals. The result is also the only
row of pieces in which every two neighbours are compatible: merged alone, their
common text gives these two pieces again. So a text is read from the left:

1. An Aho-Corasick automaton over the reversed pieces, run once from the end,
   gives the longest piece at each position; shorter ones are its prefixes.
2. The longest piece that is compatible with the one before it is taken.
3. Where none fits, the position is marked as failed in a bitfield, the piece
   before it is taken back and its next shorter prefix tried. A failed position
   is never entered again, so the work is linear in the text.

Compatibility is decided by re-merging: the merges of both pieces are undone
from the latest to the earliest, and in each state so met the two pieces at the
border must not have had a better merge than the one undone. That needs merges
whose score is below those of their parts; a piece without such a history (runs
of spaces have equal scores) is merged anew together with its neighbour.

White space begins a piece in models that say so, checked when a model is
loaded; then texts fall into stretches that repeat, and a worker encodes a
stretch once. Other models see each text as one stretch. A model that is not of
merge type, or has user-defined pieces, fails the check of ``verified``.

Null text counts as empty: only the begin and end id. Very long texts are
encoded whole. Repeated rows, null ids and other columns stay as they are; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from newsflow.llm.token_files import Encoder
from newsflow.llm.words import Words, pieces, text_bytes
from newsflow.operators.shipping import ship_package

SPACE = "▁"
_SPACE_BYTES = SPACE.encode()
# Pairs of pieces whose compatibility a worker remembers.
KNOWN_PAIRS = 1_000_000


class Merges:
    """The pieces of a model with their merge histories."""

    def __init__(self, ranks: dict[str, float]):
        import ahocorasick

        # A lower rank merges earlier. Single characters are where merging begins.
        self.ranks = ranks
        self.split: dict[str, tuple[str, str]] = {}
        self.regular: dict[str, bool] = {}
        self.shorter: dict[str, str] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in sorted(ranks, key=len):
            if len(piece) > 1:
                merged, last = self.merge(piece)
                if len(merged) > 1:
                    continue  # no text ever ends in this piece
                self.split[piece] = last
                self.regular[piece] = all(len(x) == 1 or self.regular[x] and ranks[x] < ranks[piece] for x in last)
            self.automaton.add_word(piece[::-1], len(piece))
        self.automaton.make_automaton()
        for piece in self.split:
            size = len(piece) - 1
            while size > 1 and piece[:size] not in self.split:
                size -= 1
            self.shorter[piece] = piece[:size]

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """(pieces, last pair merged) by the definition; for short texts, as it is quadratic."""
        parts, last = list(text), None
        while True:
            best, at = None, 0
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                return parts, last
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: str, right: str) -> bool:
        """Whether the text of both, merged alone, gives both again."""
        known = self.fits.get((left, right))
        if known is None:
            if self.regular.get(left, True) and self.regular.get(right, True):
                known = self._undone(left, right)
            else:
                known = self.merge(left + right)[0] == [left, right]
            if len(self.fits) >= KNOWN_PAIRS:
                self.fits.clear()
            self.fits[left, right] = known
        return known

    def _undone(self, left: str, right: str) -> bool:
        """Undo the merges of both from the latest; at the border nothing better may have been open."""
        ranks, split = self.ranks, self.split
        undone, on_left = np.inf, False
        while True:
            joint = ranks.get(left + right)
            # Of equal ranks the leftmost merges first: the border lies right of a merge on the left side.
            if joint is not None and (joint < undone or (joint == undone and not on_left)):
                return False
            a, b = split.get(left), split.get(right)
            if a is None and b is None:
                return True
            on_left = b is None or (a is not None and ranks[left] > ranks[right])
            if on_left:
                undone, left = ranks[left], a[1]
            else:
                undone, right = ranks[right], b[0]

    def longest(self, text: str) -> list[int]:
        """Length of the longest piece that starts at each position, 1 where there is none."""
        size = len(text)
        out = [1] * size
        for end, length in self.automaton.iter(text[::-1]):
            if length > out[~end]:
                out[~end] = length
        return out

    def pieces(self, text: str) -> list[str]:
        size, known, shorter = len(text), self.fits.get, self.shorter
        longest = self.longest(text)
        at, last, taken = 0, "", []
        failed = None  # a flag per position, once one has failed
        piece = text[: longest[0]] if size else ""
        while at < size:
            end = at + len(piece)
            if failed is None or not failed[end]:
                fits = known((last, piece)) if last else True
                if fits or (fits is None and self.compatible(last, piece)):
                    taken.append(piece)
                    at, last = end, piece
                    piece = text[at : at + longest[at]] if at < size else ""
                    continue
            piece = shorter.get(piece)
            if piece is None:
                if failed is None:
                    failed = bytearray(size + 1)
                failed[at] = 1
                piece = taken.pop()
                at -= len(piece)
                last = taken[-1] if taken else ""
        return taken


class PieceEncoder(Encoder):
    """A model with the ids of stretches seen before; one per worker process."""

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        plain = [i for i in range(count) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        names = [model.id_to_piece(i) for i in plain]
        self.merges = Merges({name: -model.get_score(i) for name, i in zip(names, plain)})
        self.ids_of = {name: (i,) for name, i in zip(names, plain)}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.splits = not any(a != SPACE and b == SPACE for name in names for a, b in zip(name, name[1:]))
        self._clear()

    def _ids(self, stretch: str) -> list[int]:
        out: list[int] = []
        for piece in self.merges.pieces(stretch):
            ids = self.ids_of.get(piece)
            out += ids if ids is not None else [self.byte_ids[b] for b in piece.encode()]
        return out

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        found = [self._ids(w) for w in words]
        lengths = np.array([len(f) for f in found], np.int64)
        starts = len(self.ids) + np.cumsum(lengths) - lengths
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum()))])
        at = np.searchsorted(self.known, hashes)
        self.known, self.starts = np.insert(self.known, at, hashes), np.insert(self.starts, at, starts)
        self.lengths = np.insert(self.lengths, at, lengths)

    def stretches(self, texts: list[str]) -> Words:
        """Normalised texts cut before each run of spaces."""
        raw, offsets = text_bytes(pa.array([self.model.normalize(t) for t in texts], pa.large_string()))
        begins = np.zeros(len(raw), bool)
        begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        if self.splits and len(raw) > 3:
            space = np.zeros(len(raw), bool)
            space[:-2] = (raw[:-2] == _SPACE_BYTES[0]) & (raw[1:-1] == _SPACE_BYTES[1]) & (raw[2:] == _SPACE_BYTES[2])
            begins[3:] |= space[3:] & ~space[:-3]
        starts = np.flatnonzero(begins)
        return Words(raw, offsets, starts, np.append(starts[1:], len(raw)) if len(starts) else starts, np.searchsorted(starts, offsets))

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text between the begin and the end id."""
        if len(self.ids) > 8 * len(self.known) + (1 << 24):
            self._clear()  # very long stretches must not fill the memory
        words = self.stretches(pc.fill_null(texts.cast(pa.large_string()), "").to_pylist())
        ids, lengths = self.encode_words(words)
        bounds = np.concatenate([[0], np.cumsum(words.per_text(lengths, words.first) + 2)])
        out = np.full(bounds[-1], self.model.eos_id(), np.int32)
        out[bounds[:-1]] = self.model.bos_id()
        inside = np.ones(len(out), bool)
        inside[bounds[:-1]] = inside[bounds[1:] - 1] = False
        out[inside] = ids
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(out))


def verified(path: str) -> str:
    """``path``, if this module encodes its pieces, and characters outside of them, as the library does."""
    encoder = PieceEncoder.load(path)
    model = encoder.model
    names = [model.id_to_piece(i).replace(SPACE, " ") for i in range(model.get_piece_size())]
    texts = [" ".join(names[i : i + 256]) for i in range(0, len(names), 256)] + ["\U0010ffff\U0010ffff a\u0001\x00", "  ", ""]
    expected = model.encode(texts, add_bos=True, add_eos=True)
    if encoder.encode(pa.array(texts)).to_pylist() != expected:
        raise ValueError(f"{path} is not a model that merges pairs by score with byte fallback")
    return path


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): ids of every whole text. ``model`` is the path of a model that every executor can open."""
    ship_package(docs.sparkSession)
    verified(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.load(model)
        for batch in batches:
            for piece in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), encoder.encode(piece.column("text"))], ["doc_id", "ids"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(rows: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, text) of (doc_id, ids): the text by the library, the digest of ids as 32-bit words."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = PieceEncoder.load(model).model
        for batch in batches:
            lists = batch.column("ids")
            bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
            data = memoryview(flat).cast("B")
            spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
            digests = [hashlib.sha256(data[4 * a : 4 * b]).hexdigest() for a, b in spans]
            texts = [decoder.decode(flat[a:b].tolist()) for a, b in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(digests), pa.array(texts, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "text"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, text string")
