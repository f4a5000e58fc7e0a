"""Vectors: hashed term vectors of texts, and cosine measures."""

from pyspark.sql import Column, functions as F

from newsflow.functions.text import let

WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def shingle_hashes(tokens: Column, length: int) -> Column:
    """64-bit hash of every run of ``length`` words; a shorter text is one run."""
    hashed = F.transform(tokens, lambda w: F.xxhash64(w))
    if length == 1:
        return hashed

    def runs(h):
        # Positions behind the end give null, which a hash skips.
        starts = F.sequence(F.lit(0), F.greatest(F.size(h) - length, F.lit(0)))
        joined = F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(length)]))
        # Null and empty stay as they are.
        return F.when(F.size(h) > 0, joined).otherwise(h)

    return let(hashed, runs)


def bucket(term: Column, dim: int) -> Column:
    """Bucket of a term in a vector of fixed dimension; md5 is the same on every engine."""
    return F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint") % dim


def _run_lengths(values: Column) -> Column:
    """(term, count) of an array by sorting it; stays inside the row."""

    def starts_of(s):
        return F.filter(
            F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))
        )

    def counted(s, starts):
        return F.transform(
            starts,
            lambda start, k: F.struct(
                F.get(s, start).alias("term"),
                (F.coalesce(F.get(starts, k + 1), F.size(s)) - start).alias("count"),
            ),
        )

    return let(F.sort_array(values), lambda s: F.when(F.size(s) > 0, let(starts_of(s), lambda st: counted(s, st))))


def term_vector(text: Column, ngram: int = 1, dim: int | None = None) -> Column:
    """Unit vector of log-damped term counts, sparse, sorted by term.

    Without ``dim`` a term is the 64-bit hash of ``ngram`` consecutive words,
    which in practice keeps every term apart; with ``ngram=3`` unrelated texts
    then share few terms. ``dim`` hashes single words to that many buckets. A
    text without any word has no vector (null).
    """
    if dim is None:
        terms = shingle_hashes(words(text), ngram)
    elif ngram == 1:
        terms = F.transform(words(text), lambda w: bucket(w, dim))
    else:
        raise ValueError("a fixed dimension goes with single words")

    def damped(counts):
        return F.transform(
            counts, lambda c: F.struct(c["term"].alias("term"), F.log1p(c["count"].cast("double")).alias("weight"))
        )

    def unit(terms):
        norm = F.sqrt(F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t["weight"] * t["weight"]))
        return let(
            norm,
            lambda n: F.transform(
                terms, lambda t: F.struct(t["term"].alias("term"), (t["weight"] / n).alias("weight"))
            ),
        )

    return let(damped(_run_lengths(terms)), lambda t: F.when(t.isNotNull(), unit(t)))


def sparse_dot(a: Column, b: Column) -> Column:
    """Dot product of two sparse vectors that are sorted by term.

    Two sorted runs are merged by the sort; equal terms end up side by side.
    """

    def neighbours(s):
        return F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))),
            F.lit(0.0),
            lambda acc, i: acc
            + F.when(
                F.get(s, i)["term"] == F.get(s, i - 1)["term"],
                F.get(s, i)["weight"] * F.get(s, i - 1)["weight"],
            ).otherwise(0.0),
        )

    return let(F.sort_array(F.concat(a, b)), neighbours)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos(a, b); null when a vector is null or zero."""
    return F.lit(1.0) - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
