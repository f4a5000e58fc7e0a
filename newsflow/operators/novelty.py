"""Novelty: is there an earlier row within a cosine distance?

Every row of ``new`` is compared with all earlier rows, stored ones and earlier
rows of the same batch, whether those are redundant themselves or not. That
makes it one join instead of a loop.

Rows carry ``seq``, their arrival order, unique over ``new`` and ``corpus``.
Sparse vectors (see ``term_vector``) go through a prefix join, dense ones
through a cell join; both are exact. The steps they share:

1. Equal vectors collapse to their earliest row. A group of copies costs one
   row from there on, however large it is.
2. Each row is compared with *one* earliest row of its lists or with a bounded
   set of pivots. In a large group of near copies that settles nearly all
   rows at linear cost.
3. Only what is left is compared in full, in pieces of bounded size. Sparse
   rows meet candidates in growing rounds: for flags, samples of all rows; for
   the earliest match, ranges of rising ``seq``, so that what a round finds is
   final and lists that begin later are not looked at again.
4. A pair of sparse rows shows its weights at their common rare terms before
   any vector moves; the norms of what these leave over bound the rest.

Sparse vectors are several times as large as their texts. Without stored rows
they are never written or shuffled whole: a worker cuts each to the part that a
match must touch (``_prefixes``), and vectors are asked for again only for the
rows of possible pairs. With stored rows, vectors are cut to shared terms and
written, and their rare terms are ordered by exact counts (``_rare_first_lists``).
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from newsflow.functions.articles import novelty_label
from newsflow.functions.vectors import sparse_dot
from newsflow.operators.dense import approximate_matches, dense_matches
from newsflow.operators.skew import lookup
from newsflow.operators.staging import Staging, staging_for

# Fixed value: closer than this means redundant.
DISTANCE_THRESHOLD = 0.2

# Bounds are compared with this slack so that rounding never loses a pair; the
# pair itself is then decided by its real distance.
SLACK = 1e-9
# Rows of a list that meet in one group, on either side.
ROWS_PER_PIECE = 4096
# Rows of the longest list that the first round takes.
FIRST_ROUND = 16
ROUND_GROWTH = 16
POSTING_BUCKETS = 256
# Ids of the rows of pairs, up to this many, are broadcast to the vectors; beyond it the vectors are shuffled whole.
BROADCAST_IDS = 1 << 21
# Frequent terms come last in the order of terms. They are found among one row in ``SAMPLE``, as those that at least
# ``SEEN`` of these rows hold, up to ``FREQUENT_TERMS``. The order decides how much is compared, not what is found.
SAMPLE = 32
SEEN = 3
FREQUENT_TERMS = 1 << 20
# Terms that a worker orders at a time.
TERMS_PER_SLICE = 1 << 18
# All rows have entries for the terms at one end of the order. What lies below makes about this part of the square of
# the similarity, so that rows that share little of their entries are known without their vectors.
BELOW = 0.86
# Rounds end when the rows still open meet no more candidates than so many per entry.
LAST_ROUND = 4


def _rows(new, corpus, vector, staging):
    """Two frames (seq, is_new, vec, h1, h2): the new rows and the stored ones, with a vector.

    The new rows are written before the filter: a filter on a computed vector
    would be pushed below its projection and compute it twice. The stored rows
    are a table already and are read from there.
    """
    sparse = _is_sparse(new, vector)

    def side(frame, is_new):
        return frame.select(
            F.col("seq").cast("bigint").alias("seq"),
            F.lit(is_new).alias("is_new"),
            F.col(vector).alias("vec"),
            F.xxhash64(vector).alias("h1"),
            F.xxhash64(F.lit(1), F.col(vector)).alias("h2"),
        )

    def usable(rows):
        if sparse:
            return rows.filter(F.size("vec") > 0)
        unusable = F.exists("vec", lambda x: x.isNull() | F.isnan(x))
        return rows.filter(~unusable & F.exists("vec", lambda x: x != 0))

    new_rows = usable(staging.table(side(new, True), "new"))
    return new_rows, None if corpus is None else usable(side(corpus, False))


def _sharing_terms(stored: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Stored sparse vectors cut down to the terms of the new rows.

    All other terms add nothing to a dot product with a new row. A small batch
    makes the term table small enough for Spark to broadcast it, so of a large
    stored table only the shared terms are ever shuffled.
    """
    asked = new_rows.select(F.explode("vec").alias("t")).select("t.term").distinct()
    terms = stored.select("seq", "is_new", F.explode("vec").alias("t")).withColumn("term", F.col("t.term"))
    shared = terms.join(asked, "term", "left_semi")
    return shared.groupBy("seq", "is_new").agg(F.sort_array(F.collect_list("t")).alias("vec")).select("seq", "vec")


def posting_bucket(term: Column) -> Column:
    """The partition of the posting table that holds a term."""
    return F.pmod(F.xxhash64(F.lit(3), term), F.lit(POSTING_BUCKETS)).cast("int")


def postings_of(rows: DataFrame, seq: str = "id", vector: str = "embedding") -> DataFrame:
    """(bucket, term, seq, weight, h1, h2): one row per term of each sparse vector, to be kept by bucket."""
    own = F.col(vector)
    each = rows.select(
        F.col(seq).cast("bigint").alias("seq"), F.xxhash64(own).alias("h1"), F.xxhash64(F.lit(1), own).alias("h2"), F.explode(own).alias("t")
    )
    return each.select(posting_bucket(F.col("t.term")).alias("bucket"), F.col("t.term").alias("term"), "seq", F.col("t.weight").alias("weight"), "h1", "h2")


def _posted(postings: DataFrame, new_rows: DataFrame, staging: Staging) -> DataFrame:
    """(seq, h1, h2, vec): stored rows that share a term with the new ones, cut down to such terms.

    Only the buckets of the new rows' terms are opened; their numbers, at most
    ``POSTING_BUCKETS``, are all that reaches the driver.
    """
    terms = new_rows.select(F.explode("vec").alias("t")).select("t.term").distinct()
    asked = staging.table(terms.withColumn("bucket", posting_bucket(F.col("term"))), "asked")
    opened = [r["bucket"] for r in asked.select("bucket").distinct().collect()]
    hit = postings.filter(F.col("bucket").isin(opened)).join(asked, ["bucket", "term"], "left_semi")
    vec = F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("vec")
    return staging.table(hit.groupBy("seq", "h1", "h2").agg(vec), "posted")


def _collapse(new_rows, stored, sparse: bool, first_match: bool, staging: Staging, postings=None):
    """Groups of equal vectors, and the earliest row of each group.

    A vector is recognised by two 64-bit hashes with different seeds. ``query``
    marks the vectors whose match is asked for.
    """
    narrow = ["seq", "is_new", "h1", "h2"]
    hashes = new_rows.select(*narrow)
    rows = new_rows.select("seq", "vec")
    if stored is not None:
        hashes = hashes.unionByName(stored.select(*narrow))
        rows = rows.unionByName(_sharing_terms(stored, new_rows) if sparse else stored.select("seq", "vec"))
    if postings is not None:
        posted = _posted(postings, new_rows, staging).withColumn("is_new", F.lit(False))
        hashes = hashes.unionByName(posted.select(*narrow))
        rows = rows.unionByName(posted.select("seq", "vec"))
    groups = staging.table(
        hashes.groupBy("h1", "h2").agg(
            F.min("seq").alias("rep"),
            F.min(F.when(F.col("is_new"), F.col("seq"))).alias("first_new"),
            F.count(F.lit(1)).alias("rows"),
        ),
        "groups",
    )
    query = F.col("first_new").isNotNull() if first_match else F.col("first_new").eqNullSafe(F.col("rep"))
    wanted = groups.select(F.col("rep").alias("seq"), query.alias("query"))
    # seq is unique on both sides, so this join has no heavy key.
    return groups, staging.table(rows.join(wanted, "seq"), "vectors")


def _alone(new: DataFrame, vectors_of, similarity: float, staging: Staging):
    """(rows, groups, prefixes) of sparse rows without stored ones.

    As ``_collapse``, but no vector is written: one pass computes them and
    leaves their hashes and prefixes.
    """
    prefixes = _prefixes(vectors_of(new).select("seq", F.lit(True).alias("query"), "vec"), similarity, staging)
    hashes = staging.table(prefixes.select("seq", "h1", "h2"), "hashes")
    groups = staging.table(hashes.groupBy("h1", "h2").agg(F.min("seq").alias("rep"), F.count(F.lit(1)).alias("rows")), "groups")
    copied = groups.filter("rows > 1")
    copies = lookup(hashes, copied.select("h1", "h2", "rep"), ["h1", "h2"], spread_by="seq", how="inner", counts=copied)
    copies = staging.table(copies.filter("seq != rep").select("seq", "h1", "h2"), "copies")
    alone = prefixes.filter("seq is not null").join(_small(copies), ["seq", "h1", "h2"], "left_anti")
    return hashes, groups, alone


def _mixed(terms: np.ndarray) -> np.ndarray:
    """Terms in an order that has nothing to do with their values; one to one on 64 bits."""
    x = terms.astype(np.int64).view(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(mixed: np.ndarray) -> np.ndarray:
    """The 40 bits by which terms meet. Terms that share them by accident only add to the bounds of a pair."""
    return (mixed >> np.uint64(24)).astype(np.int64)


def _slices(batches):
    """(batch, first term of each row and the end, terms, weights) of Arrow batches with ``vec``, cut into some terms each."""
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("vec"))
        starts = lists.offsets.to_numpy()
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + TERMS_PER_SLICE, "right")) - 1)
            values = lists.values.slice(starts[first], starts[last] - starts[first])
            terms, weights = values.flatten()
            yield batch.slice(first, last - first), starts[first : last + 1] - starts[first], terms.to_numpy(), weights.to_numpy().astype(np.float64)
            first = last


def _hashes(terms: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each row's vector: sums of what its entries give."""
    bits, sums = weights.view(np.int64), []
    for seed in (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D):
        each = _mixed((_mixed(terms ^ np.int64(seed)) + _mixed(bits)).view(np.int64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
        sums.append((total[starts[1:]] - total[starts[:-1]]).view(np.int64))
    return sums


def _seen_keys(batches):
    for _, _, terms, _ in _slices(batches):
        yield pa.RecordBatch.from_arrays([pa.array(_keys(_mixed(terms)))], ["key"])


def _frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(keys, rows of the sample) of frequent terms, rising by key."""
    sample = rows.filter(F.pmod(F.xxhash64(F.lit(4), "seq"), F.lit(SAMPLE)) == 0).select("vec")
    counts = sample.mapInArrow(_seen_keys, "key bigint").groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    found = counts.filter(F.col("rows") >= SEEN).orderBy(F.desc("rows"), "key").limit(FREQUENT_TERMS).toArrow()
    keys, seen = (found.column(c).to_numpy() for c in ("key", "rows"))
    order = np.argsort(keys)
    return keys[order], seen[order]


_ENTRY = "struct<high:int,low:tinyint,info:bigint>"
_ENTRY_ARROW = pa.struct([("high", pa.int32()), ("low", pa.int8()), ("info", pa.int64())])
# What an entry brings besides its term and row is one number, so that a shuffled entry is short however few of a row go
# the same way: its weight and the row's ``cut`` and ``below``, all rounded up to such parts, and whether the row asks.
WEIGHT_PARTS = 1 << 14
NORM_PARTS = 1 << 10


def _cut_to_prefix(similarity: float, keys: np.ndarray, seen: np.ndarray):
    """For mapInArrow: ``vec`` gives way to ``h1``, ``h2`` and ``entries``, see ``_prefixes``."""
    needed = similarity * similarity
    border = np.uint64(int(BELOW * needed * 2.0**64))

    def run(batches):
        for batch, starts, terms, weights in _slices(batches):
            mixed = _mixed(terms)
            key = _keys(mixed)
            often = np.zeros(len(key), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                often = np.where(keys[at] == key, seen[at], 0)
            row = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            order = np.lexsort((mixed, -often, row))
            key, weight, square = key[order], weights[order], weights[order] ** 2
            total = np.concatenate([[0.0], np.cumsum(square)])
            rest = total[1:] - total[starts[:-1]][row]
            over = (often[order] == 0) & (mixed[order] >= border)
            kept = over | (rest >= needed - SLACK)
            cut, below = (np.bincount(row, np.where(x, 0.0, square), batch.num_rows) + SLACK for x in (kept, over))
            norms = [np.ceil(n * NORM_PARTS).astype(np.int64) for n in (cut, below)]
            asks = batch.column(batch.schema.get_field_index("query")).to_numpy(zero_copy_only=False).astype(np.int64)
            of_row = (norms[0] << 12) + (norms[1] << 1) + asks
            info = (np.ceil(np.abs(weight[kept]) * WEIGHT_PARTS).astype(np.int64) << 23) + of_row[row[kept]]
            columns = [(key[kept] >> 8).astype(np.int32), (key[kept] & 255).astype(np.uint8).view(np.int8), info]
            entries = pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(_ENTRY_ARROW))
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=batch.num_rows))]).astype(np.int32)
            carried = batch.drop_columns(["vec"])
            hashes = [pa.array(h) for h in _hashes(terms.astype(np.int64), weights, starts)]
            out = [*carried.columns, *hashes, pa.ListArray.from_arrays(pa.array(ends), entries)]
            whole = pa.RecordBatch.from_arrays(out, [*carried.schema.names, "h1", "h2", "entries"])
            yield whole.filter(pa.array(np.diff(starts) > 0))

    return run


def _prefixes(rows: DataFrame, similarity: float, staging: Staging) -> DataFrame:
    """Sparse rows (seq, query, vec) with a vector, cut to entries: the terms of which a match must share one, and some more.

    Terms have one order for all rows: frequent ones first, the others by a
    hash. If two rows reach the similarity s, then up to their last common term
    in that order either has a squared norm of s * s at least, because all of
    their dot product lies there. So only terms from there on need an entry.
    All terms from a border on, the same for all rows, have one. ``cut`` is the
    squared norm of a row's terms without an entry, ``below`` that of its terms
    before the border, both rounded up.
    """
    term = rows.schema["vec"].dataType.elementType["term"].dataType
    if not isinstance(term, T.IntegralType):
        rows = rows.withColumn("vec", F.transform("vec", lambda t: F.struct(F.xxhash64(t["term"]).alias("term"), t["weight"].alias("weight"))))
    keys, seen = _frequent(rows)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "vec")
    kinds += f", h1 bigint, h2 bigint, entries array<{_ENTRY}>"
    return staging.table(rows.mapInArrow(_cut_to_prefix(similarity, keys, seen), kinds), "prefixes")


def _upward(bound: str) -> Column:
    """A bound as a float, rounded up."""
    return F.expr(f"cast(({bound}) * 1.000001d as float)")


def _lists(prefixes: DataFrame, similarity: float, staging: Staging) -> DataFrame:
    """Entries of terms that several rows have, without those of rows that cannot have a match.

    (term, seq, query, weight, cut, below, rows, largest, left, first_seq,
    first_weight): ``largest`` is the largest weight of the list, ``left`` the
    square of what a row and one of its list may share without an entry.
    Entries are shuffled once; a list is counted where it meets.
    """
    term = F.expr("shiftleft(cast(e.high as bigint), 8) + pmod(cast(e.low as bigint), 256L)").alias("term")
    dealt = prefixes.select("seq", F.explode("entries").alias("e")).select(term, "seq", F.col("e.info").alias("info")).repartition("term")
    entries = dealt.selectExpr(
        "term",
        "seq",
        "(info & 1) = 1 as query",
        f"shiftright(info, 23) / {WEIGHT_PARTS}d as weight",
        f"(shiftright(info, 12) & 2047) / {NORM_PARTS}d as cut",
        f"(shiftright(info, 1) & 2047) / {NORM_PARTS}d as below",
    )
    over = "over (partition by term)"
    met = entries.selectExpr(
        "*",
        f"count(1) {over} as rows",
        f"max(query) {over} as asked",
        f"min(struct(seq, weight)) {over} as first",
        f"max(abs(weight)) {over} as largest",
        f"max(cut) {over} as most_cut",
        f"max(below) {over} as most_below",
    ).filter("rows > 1 and asked")
    left = _upward("greatest(cut * most_below, below * most_cut)").alias("left")
    first = [F.col("first.seq").alias("first_seq"), F.col("first.weight").alias("first_weight")]
    met = staging.table(met.select("term", "seq", "query", "weight", "cut", "below", "rows", "largest", left, *first), "met")
    staging.discard("prefixes")
    live = staging.table(_able(met, similarity, staging), "live")
    staging.discard("met")
    return live


def _able(entries: DataFrame, similarity: float, staging: Staging) -> DataFrame:
    """Entries of the rows that may have a match in the lists of these entries.

    Their weights times the largest ones of their lists must reach what is
    missing to the similarity when all else that a pair may share is shared.
    """
    most = entries.groupBy("seq").agg(F.sum(F.expr("abs(weight) * largest")).alias("most"), F.max("left").alias("left"))
    able = most.filter(F.col("most") + F.sqrt("left") >= similarity - SLACK)
    return entries.join(_small(staging.table(able.select("seq"), "able")), "seq", "left_semi")


def _rare_first_lists(vectors: DataFrame, needed: float, staging: Staging) -> DataFrame:
    """Inverted lists of the terms a match must share.

    (term, seq, query, weight, rest, cut, rows, first_seq, first_weight): terms
    are ordered by how many rows hold them, rarest first. ``rest`` is the
    squared norm of a row's vector from that term on. If two rows reach the
    similarity s, then at their first common term rest * rest >= s * s (``needed``),
    because all of their dot product comes from there on. So a term whose
    ``rest`` is below s * s needs no entry. ``cut`` is the squared norm of the
    terms of a row without an entry.
    """
    terms = vectors.select("seq", "query", F.explode("vec").alias("t")).select(
        "seq", "query", F.col("t.term").alias("term"), F.col("t.weight").alias("weight")
    )
    # Terms no asking row holds cannot matter, nor can terms of a single row. They are counted where they meet: the
    # terms are shuffled once. A row holds a term once, so even one that all rows hold is a small part of them.
    counted = terms.selectExpr("*", "count(1) over (partition by term) as rows", "max(query) over (partition by term) as asked")
    shared = counted.filter("rows > 1 and asked").drop("asked")
    # One row's terms at a time: the window is as large as one text.
    ranked = shared.selectExpr(
        "term",
        "seq",
        "query",
        "weight",
        "sum(weight * weight) over (partition by seq order by rows desc, term desc "
        "rows between unbounded preceding and current row) as rest",
    )
    left_over = F.max(F.when(F.col("rest") < needed, F.col("rest")).otherwise(0.0)).over(Window.partitionBy("seq"))
    prefix = staging.table(ranked.withColumn("cut", left_over).filter(F.col("rest") >= needed), "prefix")
    lists = prefix.groupBy("term").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("seq").alias("first_seq"),
        F.min_by("weight", "seq").alias("first_weight"),
        F.max("query").alias("asked"),
    ).filter((F.col("rows") > 1) & F.col("asked"))
    lists = staging.table(lists.drop("asked"), "lists")
    return staging.table(lookup(prefix, lists, "term", spread_by="seq", how="inner", counts=lists), "live")


def _small(rows: DataFrame) -> DataFrame:
    """Rows of ids, to be broadcast if there are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def _confirm(pairs: DataFrame, vectors, threshold: float) -> DataFrame:
    """Earliest candidate of each row that really is within the threshold.

    ``vectors`` are rows (seq, vec), or a function that gives those of ids.
    Only vectors of a pair are shuffled, their terms and weights apart: that
    takes half the bytes.
    """
    few = 2 * pairs.count() <= BROADCAST_IDS

    def of(side: str, name: str) -> DataFrame:
        ids = pairs.select(F.col(side).alias("seq")).distinct()
        ids = F.broadcast(ids) if few else ids
        asked = vectors(ids) if callable(vectors) else vectors.select("seq", "vec").join(ids, "seq", "left_semi")
        return asked.select(F.col("seq").alias(side), F.col("vec.term").alias(f"{name}_term"), F.col("vec.weight").alias(f"{name}_weight"))

    def whole(name: str) -> Column:
        return F.transform(
            F.arrays_zip(f"{name}_term", f"{name}_weight"),
            lambda t: F.struct(t[f"{name}_term"].alias("term"), t[f"{name}_weight"].alias("weight")),
        )

    left = lookup(pairs, of("seq", "a"), "seq", spread_by="cand", how="inner")
    both = lookup(
        left,
        of("cand", "b"),
        "cand",
        spread_by="seq",
        how="inner",
        counts=pairs.groupBy("cand").agg(F.count(F.lit(1)).alias("rows")),
    )
    near = both.filter(F.lit(1.0) - sparse_dot(whole("a"), whole("b")) < threshold)
    return near.groupBy("seq").agg(F.min("cand").alias("match_seq"))


def _shares(largest: int, first_round: int) -> list[float]:
    """Shares of all rows that the rounds end with: so that the longest list gives few entries, then ever more, then all."""
    shares = [first_round / max(1, largest)]
    while shares[-1] < 1:
        shares.append(shares[-1] * ROUND_GROWTH)
    return [*shares[:-1], 1.0]


def _possible_pairs(asking: DataFrame, candidates: DataFrame, share: float, similarity: float, rows_per_piece: int) -> DataFrame:
    """(seq, cand): pairs whose entries leave the similarity possible.

    Both sides of a list are cut into pieces, and every pair of pieces is one
    group, so no group has more than ``rows_per_piece`` rows a side. Common
    entries are summed up. All other common terms lie before the later of the
    two rows' first entries, and so before the border: they add at most the norm
    of that row's terms without an entry times the norm of the other row's
    terms before the border. The greater of both products is a bound, whichever
    row it is. Lists without a border have a tighter one in the other row's
    norm after the last common entry.
    """
    bordered = "below" in asking.columns
    carried = ["weight", "cut", "below"] if bordered else ["weight", "cut", "rest"]
    asked_pieces = F.ceil(F.col("rows") / rows_per_piece)
    given_pieces = F.ceil(F.col("rows") * share / rows_per_piece)

    def side(rows: DataFrame, prefix: str, own: str, own_pieces: Column, other: str, other_pieces: Column, *more: str) -> DataFrame:
        return rows.select(
            "term",
            F.pmod(F.xxhash64("seq"), own_pieces).alias(own),
            F.explode(F.sequence(F.lit(0).cast("bigint"), other_pieces - 1)).alias(other),
            F.col("seq").alias(f"{prefix}_seq"),
            *[F.col(c).alias(f"{prefix}_{c}") for c in (*carried, *more)],
        )

    q = side(asking, "q", "q_piece", asked_pieces, "c_piece", given_pieces, "before")
    c = side(candidates, "c", "c_piece", given_pieces, "q_piece", asked_pieces)
    met = q.join(c, ["term", "q_piece", "c_piece"]).filter("c_seq < q_before")
    common = F.sum(F.expr("abs(q_weight * c_weight)")).alias("common")
    if bordered:
        pairs = met.groupBy("q_seq", "c_seq").agg(common, F.max(_upward("greatest(q_cut * c_below, c_cut * q_below)")).alias("left"))
        possible = F.col("common") + F.sqrt("left") >= similarity - SLACK
    else:
        pairs = met.groupBy("q_seq", "c_seq").agg(
            common,
            F.max(F.expr("q_rest * c_rest")).alias("first"),
            F.max("q_cut").alias("q_cut"),
            F.max("c_cut").alias("c_cut"),
            F.min(F.expr("c_rest - c_weight * c_weight")).alias("c_after"),
            F.min(F.expr("q_rest - q_weight * q_weight")).alias("q_after"),
        )
        left = F.sqrt(F.greatest(F.expr("q_cut * c_after"), F.expr("c_cut * q_after"), F.lit(0.0)))
        possible = (F.col("first") >= similarity * similarity - SLACK) & (F.col("common") + left >= similarity - SLACK)
    return pairs.filter(possible).select(F.col("q_seq").alias("seq"), F.col("c_seq").alias("cand"))


def sparse_matches(
    vectors,
    prefixes: DataFrame | None,
    threshold: float,
    first_match: bool,
    staging: Staging,
    rows_per_piece: int = ROWS_PER_PIECE,
    first_round: int = FIRST_ROUND,
) -> DataFrame:
    """(seq, match_seq) for distinct sparse unit vectors: ``vectors`` as for ``_confirm``, with query if there are no ``prefixes``."""
    similarity = 1.0 - threshold
    if prefixes is None:
        live = _rare_first_lists(vectors, similarity * similarity - SLACK, staging)
    else:
        live = _lists(prefixes, similarity, staging)
    asking = live.filter("query")

    # The row that begins most of a row's lists, by weight: one candidate each.
    led = asking.filter("first_seq < seq").groupBy("seq", "first_seq").agg(F.sum(F.expr("weight * first_weight")).alias("common"))
    # Entries hold 1 - similarity ** 2 of a row's squared norm at least, and near copies share most of them. Who shares
    # less with its leader shares it by accident; the rounds decide that by bounds, before any vector moves.
    led = led.filter(F.col("common") >= (1.0 - similarity * similarity) / 4)
    best = F.max_by("first_seq", F.struct("common", -F.col("first_seq"))).alias("cand")
    leaders = staging.table(led.groupBy("seq").agg(best), "leaders")
    settled = staging.table(_confirm(leaders, vectors, threshold), "settled")

    # Rounds. For flags the candidates are samples by a hash, and a row that has
    # a match is done. For the earliest match they are ranges of rising seq: a
    # row is done once its match lies before the range, and so is a list that
    # begins after the match.
    largest, entries = live.agg(F.coalesce(F.max("rows"), F.lit(0)), F.count(F.lit(1))).first()
    shares = _shares(largest, first_round)
    if first_match:
        ends = live.agg(F.percentile_approx("seq", F.array(*[F.lit(x) for x in shares]), F.lit(100_000))).first()[0] or shares
        bounds, place = [*ends[:-1], None], F.col("seq")
    else:
        bounds, place = [*shares[:-1], None], F.pmod(F.xxhash64(F.lit(2), F.col("seq")), F.lit(1 << 30)) / (1 << 30)
    low = None
    for share, high in zip(shares, bounds):
        if first_match:
            open_rows = asking.join(_small(settled), "seq", "left").withColumn("before", F.coalesce("match_seq", "seq")).drop("match_seq")
            if low is not None:
                open_rows = open_rows.filter(F.col("before") > low)
        else:
            open_rows = asking.join(_small(settled), "seq", "left_anti").withColumn("before", F.col("seq"))
        open_rows = open_rows.filter("first_seq < before")
        if prefixes is not None:
            open_rows = _able(open_rows, similarity, staging)
            if (open_rows.agg(F.sum("rows")).first()[0] or 0) <= LAST_ROUND * entries:
                share, high = 1.0, None
        given = live if low is None else live.filter(place >= low)
        given = given if high is None else given.filter(place < high)
        pairs = staging.table(_possible_pairs(open_rows, given, share, similarity, rows_per_piece), "pairs")
        low = high
        if not pairs.isEmpty():
            both = settled.unionByName(_confirm(pairs, vectors, threshold))
            settled = staging.table(both.groupBy("seq").agg(F.min("match_seq").alias("match_seq")), "settled")
        if high is None:
            break
    return settled


def _flag(new: DataFrame, new_rows: DataFrame, groups: DataFrame, matches: DataFrame, first_match: bool) -> DataFrame:
    """Carry the matches of distinct vectors back to every row of ``new``."""
    found = groups.join(matches.withColumnRenamed("seq", "rep"), "rep", "left")
    earliest = lookup(
        new_rows.select("seq", "h1", "h2"),
        found.select("h1", "h2", "rep", "match_seq"),
        ["h1", "h2"],
        spread_by="seq",
        how="inner",
        counts=groups,
    ).select(
        F.col("seq").alias("_seq"),
        F.coalesce("match_seq", F.when(F.col("seq") > F.col("rep"), F.col("rep"))).alias("match_seq"),
    )
    flagged = new.join(earliest, F.col("seq").cast("bigint") == F.col("_seq"), "left").drop("_seq")
    flagged = flagged.withColumn("is_redundant", F.col("match_seq").isNotNull())
    flagged = flagged.withColumn("novelty_label", novelty_label(F.col("is_redundant")))
    return flagged if first_match else flagged.drop("match_seq")


def _is_sparse(frame: DataFrame, vector: str | Column) -> bool:
    return isinstance(frame.select(vector).schema[0].dataType.elementType, T.StructType)


def flag_redundant(
    new: DataFrame,
    corpus: DataFrame | None = None,
    threshold: float = DISTANCE_THRESHOLD,
    vector: str | Column = "embedding",
    first_match: bool = False,
    staging: Staging | None = None,
    postings: DataFrame | None = None,
) -> DataFrame:
    """``new`` with is_redundant and novelty_label; exact.

    With ``first_match`` it also gets ``match_seq``, the earliest stored row
    within the threshold. A null or zero vector matches nothing. Stored sparse
    vectors come as rows in ``corpus`` or as a table of ``postings_of`` them.
    ``vector`` names the column, or is an expression: then vectors are computed
    once for all rows and again for those of possible pairs, and are no column
    of the result.
    """
    if not 0 < threshold < 1 and _is_sparse(new, vector) or not 0 < threshold <= 2:
        raise ValueError("threshold must be above 0, and below 1 for sparse vectors")
    staging = staging_for(new, staging)
    sparse = _is_sparse(new, vector)
    if postings is not None and not sparse:
        raise ValueError("postings hold sparse vectors")
    if sparse and corpus is None and postings is None:
        own = F.col(vector) if isinstance(vector, str) else vector

        def vectors_of(rows: DataFrame) -> DataFrame:
            return rows.select(F.col("seq").cast("bigint").alias("seq"), own.alias("vec"))

        new_rows, groups, prefixes = _alone(new, vectors_of, 1.0 - threshold, staging)
        # The rows are chosen before their vectors are computed; a join behind that would be too late.
        chosen = lambda ids: vectors_of(new.join(ids.withColumnRenamed("seq", "_seq"), F.col("seq").cast("bigint") == F.col("_seq"), "left_semi"))
        matches = sparse_matches(chosen, prefixes, threshold, first_match, staging)
        return _flag(new, new_rows, groups, matches, first_match)
    if not isinstance(vector, str):
        new, vector = new.withColumn("_vector", vector), "_vector"
    new_rows, stored = _rows(new, corpus, vector, staging)
    groups, vectors = _collapse(new_rows, stored, sparse, first_match, staging, postings)
    if sparse:
        matches = sparse_matches(vectors, None, threshold, first_match, staging)
    else:
        matches = dense_matches(vectors, threshold, first_match, staging)
    return _flag(new, new_rows, groups, matches, first_match)


def flag_redundant_approx(
    new: DataFrame,
    corpus: DataFrame | None = None,
    threshold: float = DISTANCE_THRESHOLD,
    vector: str = "embedding",
    tables: int = 16,
    bits: int = 6,
    seed: int = 42,
    probes: int = 2,
    staging: Staging | None = None,
) -> DataFrame:
    """As ``flag_redundant`` for dense vectors, comparing only rows that share a hash.

    Pairs are decided by their real distance, so nothing is flagged wrongly;
    a near pair that shares no hash is missed. More ``tables`` and ``probes``
    (neighbouring hashes that a row visits per table) find more, more ``bits``
    compare less.
    """
    staging = staging_for(new, staging)
    new_rows, stored = _rows(new, corpus, vector, staging)
    groups, vectors = _collapse(new_rows, stored, False, False, staging)
    matches = approximate_matches(vectors, threshold, tables, bits, seed, staging, probes)
    return _flag(new, new_rows, groups, matches, False)


def measured_recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """One row of (exact, found, wrong) counts of flags: what approximate flags hold of the exact ones, and what beyond."""
    flags = lambda frame, name: frame.select("seq", F.col("is_redundant").alias(name))
    both = flags(exact, "near").join(flags(approximate, "flagged"), "seq")
    return both.agg(
        F.count_if("near").alias("exact"),
        F.count_if(F.col("near") & F.col("flagged")).alias("found"),
        F.count_if(~F.col("near") & F.col("flagged")).alias("wrong"),
    )


def match_report(flagged: DataFrame, stored: DataFrame) -> DataFrame:
    """(seq, match_id, match_title): the matched article and the start of its title."""
    titles = stored.select(F.col("seq").alias("match_seq"), F.col("id").alias("match_id"), F.substring("title", 1, 40).alias("match_title"))
    matched = flagged.filter(F.col("match_seq").isNotNull()).select("seq", "match_seq")
    return lookup(matched, titles, "match_seq", spread_by="seq", how="inner").select("seq", "match_id", "match_title")

