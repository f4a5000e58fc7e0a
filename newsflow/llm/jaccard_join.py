"""Documents whose word shingle sets overlap, joined by signature trees.

Equal sets are one class. Classes that cannot reach the similarity never meet:
sets are cut into hashed parts, one more than twice what two linked sets may
differ in is not needed, and classes that share a part get into one tree. A
tree's leaves hold up to a hundred classes of similar size; every node has
the OR of its token bitmaps, the range of set sizes and the largest number of
tokens lost to shared bits. Two trees, or one with itself, are traversed from
branches over leaves and twigs to classes. A pair of nodes is dropped when the
largest overlap it may hold, that is common bits plus lost tokens, is less than
its smallest sizes need. What is left is verified on the sets themselves.

Links inside a leaf and to the next leaf are found first, where the leaves are
built. Pairs of leaves that these links already put in one component are not
traversed, so a large group of near copies costs about as much as its size.
Other pairs of leaves meet on wider bitmaps of their classes first, four bits a
token; whole sets travel only for the pairs of leaves this leaves over. Pairs
are dealt in blocks, and a leaf travels once for each block that names it.

Null and empty texts have no set and link with nothing. Fewer words than a
shingle form one shingle. Repeated rows are linked (if they have a set). With
a null id a document gets the smallest id of its component, which may be null.
Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from newsflow.llm.blocks import column, from_raw, pack, raw_columns, release, small_batches, unpack
from newsflow.llm.graph import components
from newsflow.llm.words import fold, free_name, mix, pieces, span_hashes, window_hashes, words_of
from newsflow.operators.shipping import ship_package
from newsflow.operators.staging import Staging, staging_for
from newsflow.sources.files import delete

BITS = 1024
LONGS = BITS // 64
LEAF, TWIG, BRANCH = 128, 8, 32
# Tokens of a leaf: one more class closes it.
LEAF_TOKENS = 1 << 17
BUCKET_BYTES = 16 << 20
# Leaves on each side of a block of pairs: of their bitmaps, and of whole sets.
SIGN_SIDE, FULL_SIDE = 64, 4
_ROW_BITS = 33


class Sets:
    """Distinct shingles of many texts: text i has tokens[first[i]:first[i + 1]], in order."""

    def __init__(self, texts: pa.Array, width: int):
        words = words_of(texts, lower=True)
        hashes, starts = words.hashes(), words.window_starts(width)
        tokens = window_hashes(hashes, width)[starts] if len(starts) else np.zeros(0, np.uint64)
        short = np.flatnonzero((words.counts > 0) & (words.counts < width))
        owner = np.concatenate([words.texts()[starts], short])
        tokens = np.concatenate([tokens, span_hashes(hashes, words.first[short], words.first[short + 1])])
        order = np.lexsort((tokens, owner))
        tokens, owner = tokens[order], owner[order]
        fresh = np.ones(len(tokens), bool)
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
        self.tokens, self.owner = tokens[fresh], owner[fresh]
        self.first = np.searchsorted(self.owner, np.arange(len(texts) + 1))
        self.sizes = np.diff(self.first)

    def total(self, values: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        return sums[self.first[1:]] - sums[self.first[:-1]]

    def classes(self) -> np.ndarray:
        """One number per set, the same for equal sets."""
        a, b = self.total(mix(self.tokens)), self.total(mix(self.tokens ^ np.uint64(0x5851F42D4C957F2D)))
        return fold(self.sizes, a, b).view(np.int64)


def size_classes(largest: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first size, parts, equal parts) of each size class; linked sets lie in one class or in neighbours.

    Sets of class c and c + 1 that link differ in at most ``differ`` tokens, so
    at least ``parts - differ`` parts are equal. That number is chosen above the
    parts that are empty by chance, so that a filled one is among the equal
    ones. No parts where nothing may differ.
    """
    low, lows, parts, equal = 1, [], [], []
    while low <= largest:
        high = low * 100 // percent
        differ = (high + high * 100 // percent) * (100 - percent) // (100 + percent)
        empty = (differ + 2) * math.exp(-low / (differ + 2))
        spare = 2 + math.ceil(empty + 6 * math.sqrt(empty))
        lows.append(low)
        parts.append(differ + spare if differ else 0)
        equal.append(spare)
        low = high + 1
    return np.array(lows, np.int64), np.array(parts, np.int64), np.array(equal, np.int64)


def part_keys(sets: Sets, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, text) for the parts under which a set meets those it may link with."""
    lows, parts, equal = size_classes(int(sets.sizes.max(initial=1)), percent)
    own = np.searchsorted(lows, sets.sizes, "right") - 1
    keys, owners = [], []
    for back in (0, 1):
        scheme = own - back
        count = np.where((scheme >= 0) & (sets.sizes > 0), parts[np.maximum(scheme, 0)], 0)
        at = np.cumsum(count) - count
        used = count[sets.owner] > 0
        owner, tokens = sets.owner[used], sets.tokens[used]
        part = (mix(tokens ^ np.uint64(0xA5A5)) % np.maximum(count[owner], 1).astype(np.uint64)).astype(np.int64)
        sums, filled = np.zeros(int(count.sum()), np.uint64), np.zeros(int(count.sum()), bool)
        np.add.at(sums, at[owner] + part, mix(tokens ^ np.uint64(0x3C3C)))
        filled[at[owner] + part] = True
        text = np.repeat(np.arange(len(count)), count)
        number = np.arange(len(text)) - at[text]
        # All equal parts may be empty only where a set has that many empty ones.
        empty = np.bincount(text[~filled], minlength=len(count))
        keep = filled | (empty >= equal[np.maximum(scheme, 0)])[text]
        keys.append(fold(scheme[text], number, sums)[keep])
        owners.append(text[keep])
    return np.concatenate(keys), np.concatenate(owners)


def linked(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common >= percent * (a + b - common)


class Leaf:
    """Classes of a leaf with their sets and bitmaps."""

    def __init__(self, payload: bytes):
        batch = unpack(payload)
        self.names = column(batch, "name")
        self.sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in batch.column("tokens")]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.bits = np.stack([bitmap(s) for s in self.sets])
        self.lost = self.sizes - np.bitwise_count(self.bits).sum(1, dtype=np.int64)
        cuts = np.arange(0, len(self.sets), TWIG)
        self.twig_bits = np.bitwise_or.reduceat(self.bits, cuts)
        self.twig_low = np.minimum.reduceat(self.sizes, cuts)
        self.twig_high = np.maximum.reduceat(self.sizes, cuts)
        self.twig_lost = np.maximum.reduceat(self.lost, cuts)


def bitmap(tokens: np.ndarray, width: int = BITS) -> np.ndarray:
    bits = np.zeros(width, bool)
    bits[(tokens % np.uint64(width)).astype(np.int64)] = True
    return np.packbits(bits).view(np.uint64)


def signatures(leaf: Leaf) -> bytes:
    """Bitmaps of a leaf's classes, each of a power of two of bits, at least four a token."""
    wide = [bitmap(s, max(64, 1 << (4 * len(s) - 1).bit_length())).tobytes() for s in leaf.sets]
    return pack(pa.RecordBatch.from_arrays([pa.array(leaf.sizes), pa.array(wide, pa.large_binary())], ["size", "bits"]))


def _by_width(signs: bytes, roots: list[int]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bitmaps, sizes, roots) of the classes of each bitmap width."""
    batch = unpack(signs)
    sizes, roots = column(batch, "size"), np.array(roots, np.int64)
    bits = [np.frombuffer(b.as_buffer(), np.uint64) for b in batch.column("bits")]
    widths = np.array([len(b) for b in bits])
    return [(np.stack([bits[i] for i in np.flatnonzero(widths == w)]), sizes[widths == w], roots[widths == w]) for w in np.unique(widths)]


def may_meet(a: list, b: list, percent: int) -> bool:
    """Can a class of one leaf link with one of the other that is not in its component?"""
    for bits_a, sizes_a, roots_a in a:
        for bits_b, sizes_b, roots_b in b:
            if 100 * sizes_a.max() < percent * sizes_b.min() or 100 * sizes_b.max() < percent * sizes_a.min():
                continue
            # The wider bitmap, folded, is the bitmap of the narrower width.
            width = min(bits_a.shape[1], bits_b.shape[1])
            x, y = (np.bitwise_or.reduce(m.reshape(len(m), -1, width), axis=1) for m in (bits_a, bits_b))
            lost_x, lost_y = (n - np.bitwise_count(m).sum(1, dtype=np.int64) for m, n in ((x, sizes_a), (y, sizes_b)))
            pairs = may_link(x, sizes_a, sizes_a, lost_x, y, sizes_b, sizes_b, lost_y, percent)
            if (pairs & (roots_a[:, None] != roots_b[None])).any():
                return True
    return False


def may_link(bits_a, low_a, high_a, lost_a, bits_b, low_b, high_b, lost_b, percent: int) -> np.ndarray:
    """Matrix: can a class of node a and one of node b link?"""
    common = np.bitwise_count(bits_a[:, None] & bits_b[None]).sum(-1, dtype=np.int64)
    most = common + np.minimum(lost_a[:, None], lost_b[None])
    enough = (100 + percent) * most >= percent * (low_a[:, None] + low_b[None])
    sizes = (100 * high_a[:, None] >= percent * low_b[None]) & (100 * high_b[None] >= percent * low_a[:, None])
    return enough & sizes


def traverse(a: Leaf, b: Leaf, percent: int) -> list[tuple[int, int]]:
    """Links between two leaves (or inside one) that connect what they can connect."""
    same = a is b
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    found = []
    twigs = may_link(a.twig_bits, a.twig_low, a.twig_high, a.twig_lost, b.twig_bits, b.twig_low, b.twig_high, b.twig_lost, percent)
    for x, y in zip(*np.nonzero(twigs)):
        if same and x > y:
            continue
        s, t = slice(x * TWIG, (x + 1) * TWIG), slice(y * TWIG, (y + 1) * TWIG)
        pairs = may_link(a.bits[s], a.sizes[s], a.sizes[s], a.lost[s], b.bits[t], b.sizes[t], b.sizes[t], b.lost[t], percent)
        for i, j in zip(*np.nonzero(pairs)):
            i, j = int(i) + x * TWIG, int(j) + y * TWIG
            if same and i >= j:
                continue
            left, right = find(int(a.names[i])), find(int(b.names[j]))
            if left == right:
                continue
            common = len(np.intersect1d(a.sets[i], b.sets[j], assume_unique=True))
            if linked(common, a.sizes[i], b.sizes[j], percent):
                root[left] = right
                found.append((int(a.names[i]), int(b.names[j])))
    return found


def _may_link(a: str, b: str, percent: int) -> Column:
    """The same bound on two rows of the node table."""
    common = F.lit(0)
    for i in range(LONGS):
        common = common + F.bit_count(F.col(f"{a}.bits")[i].bitwiseAND(F.col(f"{b}.bits")[i]))
    most = common + F.least(f"{a}.lost", f"{b}.lost")
    return (
        (F.col(f"{a}.high") * 100 >= F.col(f"{b}.low") * percent)
        & (F.col(f"{b}.high") * 100 >= F.col(f"{a}.low") * percent)
        & (most * (100 + percent) >= (F.col(f"{a}.low") + F.col(f"{b}.low")) * percent)
    )


def _leaves(rows: DataFrame, percent: int) -> DataFrame:
    """Leaves of at most LEAF classes from rows (tree, name, size, low_token, tokens).

    ``a`` and ``b`` are the ends of the links inside a leaf and to the one before it.
    """
    kind = "leaf bigint, tree bigint, low bigint, high bigint, lost bigint, bits array<bigint>, names array<bigint>, a array<bigint>, b array<bigint>, signs binary, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << _ROW_BITS
        held: list = []
        tree, last, tokens = None, None, 0
        before: Leaf | None = None

        def close() -> pa.RecordBatch:
            nonlocal before
            # Near copies lie side by side here, so this compresses well.
            payload = pack(pa.RecordBatch.from_arrays([pa.array([n for n, _ in held], pa.int64()), pa.array([t for _, t in held], pa.large_binary())], ["name", "tokens"]))
            leaf = Leaf(payload)
            links = traverse(leaf, leaf, percent) + (traverse(before, leaf, percent) if before else [])
            before = leaf
            joined = np.bitwise_or.reduce(leaf.bits).view(np.int64)
            ends = [[link[at] for link in links] for at in (0, 1)]
            row = [number, tree, int(leaf.sizes.min()), int(leaf.sizes.max()), int(leaf.lost.max()), joined, leaf.names, *ends, signatures(leaf), payload]
            types = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 4 + [pa.binary()] * 2
            names = ["leaf", "tree", "low", "high", "lost", "bits", "names", "a", "b", "signs", "payload"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        for batch in batches:
            for at in range(batch.num_rows):
                here, name = batch.column("tree")[at].as_py(), batch.column("name")[at].as_py()
                if name == last:
                    continue  # repeated rows bring a class more than once
                last = name
                data = batch.column("tokens")[at].as_py()
                if held and (here != tree or len(held) >= LEAF or tokens > LEAF_TOKENS):
                    yield close()
                    held, tokens, number = [], 0, number + 1
                if here != tree:
                    before = None
                tree = here
                held.append((name, data))
                tokens += len(data) // 8
        if held:
            yield close()
        release()

    ordered = rows.repartitionByRange("tree", "size", "low_token", "name").sortWithinPartitions("tree", "size", "low_token", "name")
    return ordered.select("tree", "name", "tokens").mapInArrow(run, kind)


def _in_blocks(pairs: DataFrame, leaves: DataFrame, side: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, leaves) by block, (p, q) and (at_p, at_q): pairs of ``side`` by ``side`` leaves, and each leaf they name once.

    So a leaf travels once per block instead of once per pair, a block's size is
    bounded, and leaves without a pair do not travel at all.
    """
    p, q = F.floor(F.col("x") / side), F.floor(F.col("y") / side)
    placed = pairs.select(p.alias("p"), q.alias("q"), "x", "y")
    named = pairs.select(p.alias("at_p"), q.alias("at_q"), F.explode(F.array("x", "y")).alias("leaf")).distinct()
    return placed, leaves.join(named, "leaf")


def _traversed(pairs: DataFrame, leaves: DataFrame, percent: int, staging: Staging) -> DataFrame:
    """(a, b): links found by traversing pairs (x, y) of leaves."""
    named = pairs.select(F.explode(F.array("x", "y")).alias("leaf")).distinct()
    needed = staging.table(leaves.select("leaf", "payload").join(named, "leaf", "left_semi"), "needed")
    placed, held = _in_blocks(pairs, needed, FULL_SIDE)

    def run(asked: pa.Table, table: pa.Table) -> pa.Table:
        payload = dict(zip(table.column("leaf").to_pylist(), table.column("payload")))
        ends = sorted(zip(asked.column("x").to_pylist(), asked.column("y").to_pylist()))
        found: list[tuple[int, int]] = []
        at, left = None, None
        for x, y in ends:
            if x != at:
                at, left = x, Leaf(payload[x].as_buffer())
            found += traverse(left, Leaf(payload[y].as_buffer()), percent)
        release()
        links = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": links[:, 0], "b": links[:, 1]})

    return placed.groupBy("p", "q").cogroup(held.groupBy("at_p", "at_q")).applyInArrow(run, "a bigint, b bigint")


def _refined(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) of leaves that may hold links between components, by the bitmaps of their classes."""
    placed, held = _in_blocks(pairs, signs, SIGN_SIDE)

    def run(asked: pa.Table, table: pa.Table) -> pa.Table:
        ids = table.column("leaf").to_pylist()
        known = {n: _by_width(s.as_buffer(), r.as_py()) for n, s, r in zip(ids, table.column("signs"), table.column("roots"))}
        kept = [may_meet(known[x], known[y], percent) for x, y in zip(asked.column("x").to_pylist(), asked.column("y").to_pylist())]
        release()
        return asked.select(["x", "y"]).filter(pa.array(kept, pa.bool_()))

    return placed.groupBy("p", "q").cogroup(held.groupBy("at_p", "at_q")).applyInArrow(run, "x bigint, y bigint")


def _written(staging: Staging, frame: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A written table and its path, for one that goes as soon as the next is written."""
    path = f"{staging.root}/{name}-{uuid.uuid4().hex[:8]}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path), path


def join(
    docs: DataFrame,
    width: int = 3,
    percent: int = 90,
    doc_id: str = "doc_id",
    text: str = "text",
    staging: Staging | None = None,
) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents link when 100 * intersection >= percent * union."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(f"`{text}`").alias("mark"))
    members, named = _classes(rows, width, percent, staging_for(docs, staging))
    none = members.filter("name is null").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    found = members.join(named, "name").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    return found.unionByName(none)


def _classes(docs: DataFrame, width: int, percent: int, staging: Staging) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, mark, name, size) and classes (name, root, component_id) of rows (doc_id, text, mark).

    ``name`` is the class of a row's set, null if it has none. A mark is a hash
    that tells rows with one id, or without an id, from each other.
    """
    ship_package(docs.sparkSession)
    small_batches(docs.sparkSession)
    id_kind = docs.schema["doc_id"].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                sets = Sets(piece.column("text"), width)
                name = pa.array(sets.classes(), mask=sets.sizes == 0)
                size = pa.array(np.diff(sets.first).astype(np.int64))
                bytes_ = pa.array(np.full(len(size), piece.column("text").nbytes // max(1, len(size))))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("mark"), name, size, bytes_], ["doc_id", "mark", "name", "size", "n_bytes"])
        release()

    members = staging.table(docs.mapInArrow(measure, f"doc_id {id_kind}, mark bigint, name bigint, size bigint, n_bytes bigint"), "members")
    total = members.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_BYTES))
    members = members.drop("n_bytes")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                sets = Sets(piece.column("text"), width)
                names = sets.classes()
                keys, owner = part_keys(sets, percent)
                name = names[owner]
                # A key meets its piece's smallest class here; only that one travels.
                order = np.lexsort((name, keys))
                keys, name = keys[order], name[order]
                fresh = np.ones(len(keys), bool)
                fresh[1:] = keys[1:] != keys[:-1]
                smallest = name[fresh][np.cumsum(fresh) - 1] if len(keys) else name
                other = name != smallest
                links = np.unique(np.stack([smallest[other], name[other]], 1), axis=0)
                bucket = (keys[fresh] >> np.uint64(40)) % np.uint64(buckets)
                # In the order of classes, these compress to next to nothing; 40 bits and the bucket tell keys apart.
                kept_keys, kept_names = keys[fresh], name[fresh]
                where = np.lexsort((kept_names, bucket))
                found, starts = np.unique(bucket[where], return_index=True)
                parts = np.split(where, starts[1:]) if len(found) else []
                low, high = kept_keys.astype(np.uint32), (kept_keys >> np.uint64(32)).astype(np.uint8)
                data = [raw_columns(low[p], high[p], np.diff(kept_names[p], prepend=0)) for p in parts]
                out = [found.astype(np.int64), np.full(len(links), -1) - (links[:, 0] % buckets)] if len(links) else [found.astype(np.int64)]
                bucket_col = np.concatenate(out)
                blobs = pa.array(data + [None] * len(links), pa.binary())
                none = np.zeros(len(found), np.int64)
                ends = [pa.array(np.concatenate([none, links[:, c]]) if len(links) else none) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket_col), blobs, *ends], ["bucket", "data", "a", "b"])
        release()

    def met(table: pa.Table) -> pa.Table:
        sent = [from_raw(d, np.uint32, np.uint8, np.int64) for d in table.column("data").to_pylist()]
        low, high = (np.concatenate([m[c] for m in sent]).astype(np.uint64) for c in (0, 1))
        keys = low | (high << np.uint64(32))
        name = np.concatenate([np.cumsum(m[2]) for m in sent])
        order = np.lexsort((name, keys))
        keys, name = keys[order], name[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        smallest = name[fresh][np.cumsum(fresh) - 1]
        other = name != smallest
        links = np.unique(np.stack([smallest[other], name[other]], 1), axis=0)
        release()
        return pa.table({"a": links[:, 0], "b": links[:, 1]})

    spark = docs.sparkSession
    sent, sent_path = _written(staging, docs.mapInArrow(keyed, "bucket bigint, data binary, a bigint, b bigint"), "keys")
    local = sent.filter("data is null").select("a", "b")
    across = sent.filter("data is not null").select("bucket", "data").groupBy("bucket").applyInArrow(met, "a bigint, b bigint")
    trees = staging.table(components(local.unionByName(across), staging), "trees")
    delete(spark, sent_path)

    wanted = (
        members.filter("name is not null")
        .groupBy("name")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("first"))
        .join(trees.withColumnRenamed("node", "name"), "name")
        .select("name", F.col("first.doc_id").alias("first_id"), F.col("first.mark").alias("first_mark"), F.col("root").alias("tree"))
    )
    # One text per class; the mark keeps rows without an id, or with the same one, apart.
    same = (F.col("mark") == F.col("first_mark")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    texts = docs.join(wanted, same).select("text", "name", "tree")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                sets = Sets(piece.column("text"), width)
                _, once = np.unique(column(piece, "name"), return_index=True)
                hit = np.sort(once[sets.classes()[once] == column(piece, "name")[once]])
                bounds = list(zip(sets.first[hit].tolist(), sets.first[hit + 1].tolist()))
                data = [sets.tokens[a:b].tobytes() for a, b in bounds]
                low = [int(sets.tokens[a].view(np.int64)) for a, _ in bounds]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("tree").take(pa.array(hit)), piece.column("name").take(pa.array(hit)), pa.array(sets.sizes[hit]), pa.array(low, pa.int64()), pa.array(data, pa.binary())],
                    ["tree", "name", "size", "low_token", "tokens"],
                )
        release()

    rows = texts.mapInArrow(tokens, "tree bigint, name bigint, size bigint, low_token bigint, tokens binary")
    sets, sets_path = _written(staging, rows, "sets")
    leaves = staging.table(_leaves(sets, percent), "leaves")
    delete(spark, sets_path)
    first = leaves.select(F.inline(F.arrays_zip("a", "b")))
    joined = components(first, staging)
    # The component of a leaf's classes, if these all have one.
    names = leaves.select("leaf", F.posexplode("names").alias("at", "name"))
    state = names.join(joined.withColumnRenamed("node", "name"), "name", "left")
    state = state.withColumn("root", F.coalesce("root", "name")).groupBy("leaf").agg(
        F.min("root").alias("least"), F.max("root").alias("most"), F.array_sort(F.collect_list(F.struct("at", "root"))).getField("root").alias("roots")
    )
    nodes = leaves.select("leaf", "tree", "low", "high", "lost", "bits").join(state, "leaf").withColumn("branch", F.floor(F.col("leaf") / BRANCH))
    nodes = staging.table(nodes, "nodes")
    rest = staging.table(_open_pairs(nodes, percent), "pairs")
    signs = nodes.select("leaf", "roots").join(leaves.select("leaf", "signs"), "leaf")
    rest = staging.table(_refined(rest, signs, percent), "refined")
    second = _traversed(rest, leaves, percent, staging)
    links = staging.table(first.unionByName(second), "links")
    roots = components(links, staging).withColumnRenamed("node", "name")
    classes = members.filter("name is not null").groupBy("name").agg(F.min("doc_id").alias("id"))
    rooted = classes.join(roots, "name", "left").withColumn("root", F.coalesce("root", "name"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return members, staging.table(rooted.join(least, "root").select("name", "root", "component_id"), "named")


def _open_pairs(nodes: DataFrame, percent: int) -> DataFrame:
    """(x, y): leaves beyond neighbours that may hold links and are not in one component yet."""
    joined_bits = F.array(*[F.bit_or(F.col("bits")[i]) for i in range(LONGS)])
    branches = nodes.groupBy("tree", "branch").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.max("lost").alias("lost"), joined_bits.alias("bits"),
        F.min("least").alias("least"), F.max("most").alias("most"), F.count(F.lit(1)).alias("n"),
    )
    open_ = lambda a, b: (F.least(f"{a}.least", f"{b}.least") != F.greatest(f"{a}.most", f"{b}.most"))
    p, q = branches.alias("p"), branches.alias("q")
    above = p.join(q, (F.col("p.tree") == F.col("q.tree")) & (F.col("p.branch") <= F.col("q.branch")))
    above = above.filter(((F.col("p.branch") != F.col("q.branch")) | (F.col("p.n") > 1)) & open_("p", "q") & _may_link("p", "q", percent))
    above = above.select(F.col("p.tree").alias("tree"), F.col("p.branch").alias("pb"), F.col("q.branch").alias("qb"))
    a, b = nodes.alias("a"), nodes.alias("b")
    below = above.join(a, (F.col("a.tree") == above["tree"]) & (F.col("a.branch") == F.col("pb"))).join(
        b, (F.col("b.tree") == above["tree"]) & (F.col("b.branch") == F.col("qb")) & (F.col("a.leaf") + 1 < F.col("b.leaf"))
    )
    return below.filter(open_("a", "b") & _may_link("a", "b", percent)).select(F.col("a.leaf").alias("x"), F.col("b.leaf").alias("y"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", staging: Staging | None = None) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id, null last; and every row without words.

    Columns stay as they are. Rows that share an id, or have none, are
    documents of their own: only the overlap of their texts decides. Of rows
    with the smallest id that with the smallest hash of all columns stays; rows
    equal in all columns are one.
    """
    staging = staging_for(docs, staging)
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    mark = F.xxhash64(*hashed)
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), mark.alias("mark"))
    members, named = _classes(rows, width, percent, staging)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("first")
    stays = members.join(named, "name").groupBy("root").agg(first)
    own_id, own_mark = free_name(docs.columns, "kept_id"), free_name(docs.columns, "kept_mark")
    stays = staging.table(stays.select(F.col("first.doc_id").alias(own_id), F.col("first.mark").alias(own_mark)).distinct(), "stays")
    has_words = F.coalesce(F.col(f"`{text}`").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    written, blank = docs.filter(has_words), docs.filter(~has_words)
    kept = written.join(stays, (mark == F.col(own_mark)) & F.col(f"`{doc_id}`").eqNullSafe(F.col(own_id)))
    # What shares a mark is one row repeated.
    return kept.dropDuplicates([own_mark]).drop(own_id, own_mark).unionByName(blank)
