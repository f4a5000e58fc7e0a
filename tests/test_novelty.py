import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsflow.functions.vectors import term_vector
from newsflow.operators import dense, novelty, skew
from newsflow.operators.novelty import flag_redundant, flag_redundant_approx, match_report
from newsflow.operators.staging import Staging

WORDS = [f"w{i}" for i in range(60)]


def brute_force(vectors, is_new, threshold):
    """Earliest earlier row within the threshold, by comparing everything."""
    matches = {}
    for i, v in sorted(vectors.items()):
        if not is_new[i] or v is None:
            continue
        near = [j for j, u in vectors.items() if j < i and u is not None and 1 - float(v @ u) < threshold]
        if near:
            matches[i] = min(near)
    return matches


def sparse_as_numpy(rows):
    terms = {}
    out = {}
    for seq, vector in rows:
        if vector is None:
            out[seq] = None
            continue
        dense_vector = np.zeros(3000)
        for e in vector:
            dense_vector[terms.setdefault(e["term"], len(terms))] = e["weight"]
        out[seq] = dense_vector
    return out


def make_texts(seed):
    """A third of the rows are near copies of one text, some exact copies, some empty."""
    rng = random.Random(seed)
    base = [rng.choice(WORDS) for _ in range(40)]
    texts = []
    for i in range(150):
        kind = rng.random()
        if kind < 0.33:
            text = list(base)
            for _ in range(rng.randint(0, 9)):
                text[rng.randrange(40)] = rng.choice(WORDS)
        elif kind < 0.45 and texts:
            text = rng.choice(texts).split()
        elif kind < 0.5:
            text = []
        else:
            text = [rng.choice(WORDS) for _ in range(rng.randint(1, 40))]
        texts.append(" ".join(text))
    return texts


@pytest.mark.parametrize("ngram,threshold,stored", [(1, 0.2, 0), (1, 0.5, 60), (3, 0.2, 60), (2, 0.6, 0)])
def test_sparse_join_equals_brute_force(spark, monkeypatch, ngram, threshold, stored):
    # Small pieces, rounds and salts so that the paths for heavy keys are taken.
    monkeypatch.setattr(novelty.sparse_matches, "__defaults__", (7, 4))
    monkeypatch.setattr(skew, "ROWS_PER_SALT", 10)
    rows = spark.createDataFrame(list(enumerate(make_texts(ngram))), "seq long, text string").withColumn(
        "embedding", term_vector(F.col("text"), ngram=ngram)
    )
    new, corpus = rows.filter(F.col("seq") >= stored), rows.filter(F.col("seq") < stored)
    vectors = sparse_as_numpy([(r["seq"], r["embedding"]) for r in rows.collect()])
    expected = brute_force(vectors, {i: i >= stored for i in vectors}, threshold)
    exact = flag_redundant(new, corpus if stored else None, threshold, first_match=True).collect()
    assert {r["seq"]: r["match_seq"] for r in exact if r["is_redundant"]} == expected
    assert len(exact) == 150 - stored and len(expected) > 20
    flags = flag_redundant(new, corpus if stored else None, threshold).collect()
    assert {r["seq"] for r in flags if r["novelty_label"] == "Low"} == set(expected)


def near_copies(n, seed=5):
    """Copies of one text with a few changed words each, behind some texts that share its words."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(60)]
    texts = [" ".join(rng.sample(base, 12) + [f"o{i}{k}" for k in range(30)]) for i in range(20)]
    for i in range(n):
        text = list(base)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(60)] = f"c{rng.randrange(n)}"
        texts.append(" ".join(text))
    return list(enumerate(texts))


@pytest.mark.parametrize("first_match", [True, False])
def test_near_copies_cost_about_their_number(spark, monkeypatch, first_match):
    """The pairs that meet, and the pairs whose vectors travel, grow with a group of near copies, not with its square."""
    counted = {"met": 0, "confirmed": 0}
    possible, confirm = novelty._possible_pairs, novelty._confirm

    def count_met(asking, given, *rest):
        pairs = asking.select("term", "seq", "before").join(given.select("term", F.col("seq").alias("cand")), "term")
        counted["met"] += pairs.filter("cand < before").count()
        return possible(asking, given, *rest)

    def count_confirmed(pairs, *rest):
        counted["confirmed"] += pairs.count()
        return confirm(pairs, *rest)

    monkeypatch.setattr(novelty, "_possible_pairs", count_met)
    monkeypatch.setattr(novelty, "_confirm", count_confirmed)
    each = []
    for n in (250, 2000):
        counted.update(met=0, confirmed=0)
        rows = spark.createDataFrame(near_copies(n), "seq long, text string").withColumn("embedding", term_vector(F.col("text"), ngram=1))
        found = flag_redundant(rows, threshold=0.2, first_match=first_match)
        assert found.filter("is_redundant").count() >= n - 10
        each.append((counted["met"] / n, counted["confirmed"] / n))
    assert each[1][0] <= 1.5 * each[0][0] + 1 and each[1][1] <= 1.5 * each[0][1] + 1


def test_accidental_pairs_move_no_vectors(spark, monkeypatch):
    """Texts that share a few words but are far apart are dropped by their common entries alone."""
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(400)]
    rows = spark.createDataFrame([(i, " ".join(rng.sample(vocabulary, 50))) for i in range(300)], "seq long, text string")
    met, confirmed = [], []
    possible, confirm = novelty._possible_pairs, novelty._confirm

    def count_met(asking, given, *rest):
        pairs = asking.select("term", "seq", "before").join(given.select("term", F.col("seq").alias("cand")), "term")
        met.append(pairs.filter("cand < before").select("seq", "cand").distinct().count())
        return possible(asking, given, *rest)

    monkeypatch.setattr(novelty, "_possible_pairs", count_met)
    monkeypatch.setattr(novelty, "_confirm", lambda pairs, *rest: confirmed.append(pairs.count()) or confirm(pairs, *rest))
    flagged = flag_redundant(rows.withColumn("embedding", term_vector(F.col("text"), ngram=1)), threshold=0.2)
    assert flagged.filter("is_redundant").isEmpty()
    assert sum(met) > 2000 and sum(confirmed[1:]) < 0.02 * sum(met)


def make_vectors(n=300, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, dim)).astype(np.float32)
    hot = rng.random(n) < 0.33
    rows[hot] = rows[0] + 0.05 * rng.normal(size=(hot.sum(), dim))
    rows[50], rows[120] = rows[10], rows[10]
    rows[7], rows[8] = 0, 0
    return [(i, v.tolist() if i != 9 else None) for i, v in enumerate(rows)]


@pytest.mark.parametrize("threshold,stored", [(0.05, 0), (0.2, 100), (0.7, 0)])
def test_dense_join_equals_brute_force(spark, monkeypatch, threshold, stored):
    monkeypatch.setattr(dense.dense_matches, "__defaults__", (80, 4))
    rows = make_vectors()
    unit = {}
    for i, v in rows:
        norm = np.linalg.norm(v) if v else 0
        unit[i] = np.array(v) / norm if norm else None
    expected = brute_force(unit, {i: i >= stored for i in unit}, threshold)
    frame = spark.createDataFrame(rows, "seq long, embedding array<float>")
    new = frame.filter(F.col("seq") >= stored)
    corpus = frame.filter(F.col("seq") < stored) if stored else None
    got = flag_redundant(new, corpus, threshold, first_match=True).collect()
    assert {r["seq"]: r["match_seq"] for r in got if r["is_redundant"]} == expected
    flags = {r["seq"] for r in flag_redundant(new, corpus, threshold).collect() if r["is_redundant"]}
    assert flags == set(expected)
    approx = {r["seq"] for r in flag_redundant_approx(new, corpus, threshold).collect() if r["is_redundant"]}
    assert approx <= flags and len(approx) >= 0.9 * len(flags)


def test_dense_tree_routes_few_ids(spark):
    """Leaves grow with the rows, and a row asks few of them at a distance of 0.2."""
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(60, 24))
    vectors = centres[draw.integers(0, 60, 2400)] + 0.05 * draw.normal(size=(2400, 24))
    rows = [(i, True, [float(x) for x in v]) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "seq long, query boolean, vec array<float>")
    placed, asked = dense.tree(frame, 0.2, True, Staging(spark), 100, 16)
    cells = placed.select("cell").distinct().count()
    assert cells >= 24 and placed.count() == 2400
    assert asked.select("seq").distinct().count() == 2400
    assert asked.count() < 0.25 * 2400 * cells


def test_chain_and_strict_threshold(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.8, 0.59]), (3, [0.3, 0.95]), (4, [0.0, 0.0]), (5, [0.0, 0.0]), (6, None)]
    frame = spark.createDataFrame(rows, "seq long, embedding array<float>")
    got = {r["seq"]: r["is_redundant"] for r in flag_redundant(frame, threshold=0.25).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False, 5: False, 6: False}
    at_right_angles = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "seq long, embedding array<float>")
    assert [r["is_redundant"] for r in flag_redundant(at_right_angles, threshold=1.0).collect()] == [False, False]


def test_more_distance_flags_more(spark):
    frame = spark.createDataFrame(make_vectors(), "seq long, embedding array<float>")
    sets = [
        {r["seq"] for r in flag_redundant(frame, threshold=t).collect() if r["is_redundant"]} for t in (0.05, 0.3, 0.8)
    ]
    assert sets[0] <= sets[1] <= sets[2]


def test_match_report(spark):
    stored = spark.createDataFrame([(1, 11, "t" * 50)], "seq long, id long, title string")
    flagged = spark.createDataFrame([(2, 1), (3, None)], "seq long, match_seq long")
    assert [tuple(r) for r in match_report(flagged, stored).collect()] == [(2, 11, "t" * 40)]


@pytest.mark.parametrize("first_match", [True, False])
def test_common_neighbours_settle_at_the_earliest_rows(spark, monkeypatch, first_match):
    """Where matches are common, rows that meet in tiles grow with the rows, not with their square; no tree is built."""
    asked = []
    in_tiles, tree = dense._compare_in_tiles, dense.tree

    def count(queries, stored, *rest):
        asked.append(queries.select("cell").join(stored.groupBy("cell").count(), "cell").agg(F.sum("count")).first()[0] or 0)
        return in_tiles(queries, stored, *rest)

    def planted(*args):
        asked.append(10**9)
        return tree(*args)

    monkeypatch.setattr(dense, "_compare_in_tiles", count)
    monkeypatch.setattr(dense, "tree", planted)
    monkeypatch.setattr(dense.dense_matches, "__defaults__", (50, 4))
    each = []
    for n in (1000, 3000):
        asked.clear()
        vectors = np.random.default_rng(n).normal(size=(n, 4))
        frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "seq long, embedding array<float>")
        got = flag_redundant(frame, threshold=0.7, first_match=first_match)
        rows = got.select("seq", "is_redundant", *["match_seq"] * first_match).collect()
        unit = {i: np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) for i, v in enumerate(vectors)}
        expected = brute_force(unit, {i: True for i in unit}, 0.7)
        assert {r["seq"] for r in rows if r["is_redundant"]} == set(expected)
        assert not first_match or {r["seq"]: r["match_seq"] for r in rows if r["is_redundant"]} == expected
        each.append(sum(asked) / n)
    assert each[1] <= 1.5 * each[0]


def test_signing_copies_no_vector():
    """A worker gives each row once, with its cells, in parts of bounded size; before, once per table and probe."""
    planes = np.random.default_rng(0).normal(size=(16 * 6, 8))
    rows = pd.DataFrame({"seq": range(3000), "query": True, "vec": list(np.random.default_rng(1).normal(size=(3000, 8)))})
    parts = list(dense._signatures(planes, 16, 6, 2)([rows]))
    assert max(map(len, parts)) <= dense.SLICE and sum(map(len, parts)) == 3000
    assert all(len(o) == 16 and set(o) <= set(v) and len(v) == 48 for o, v in zip(parts[0]["own"], parts[0]["visited"]))


def test_approximate_ways_agree(spark, monkeypatch):
    """Rows left after the earliest ones meet the others whole or cell by cell: the same rows are flagged."""
    frame = spark.createDataFrame(make_vectors(seed=3), "seq long, embedding array<float>")
    ways = []
    for tiles, tile in ((2, 2048), (2, 40), (0, 30)):
        monkeypatch.setattr(dense, "EARLY_TILES", tiles)
        monkeypatch.setattr(dense.approximate_matches, "__defaults__", (2, tile))
        found = flag_redundant_approx(frame, None, 0.3, tables=3, bits=5).filter("is_redundant").collect()
        ways.append({r["seq"] for r in found})
    assert ways[0] == ways[1] == ways[2] and len(ways[0]) > 50


def test_only_vectors_of_pairs_are_shuffled(spark):
    """A pair is confirmed with the vectors of its rows; the others are dropped where they lie."""
    rows = [(i, f"a{i} b c d") for i in range(50)]
    vectors = spark.createDataFrame(rows, "seq long, text string").select("seq", term_vector(F.col("text"), ngram=1).alias("vec"))
    pairs = spark.createDataFrame([(3, 1), (3, 2), (9, 4)], "seq long, cand long")
    found = novelty._confirm(pairs, vectors, 0.5)
    assert {tuple(r) for r in found.collect()} == {(3, 1), (9, 4)}
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("first_match", [True, False])
def test_vectors_are_not_written(spark, monkeypatch, first_match):
    """Texts that share little leave a part of their terms on disk, once; before, all terms were written twice."""
    rng = random.Random(8)
    texts = [[f"u{rng.randrange(50_000)}" for _ in range(60)] for _ in range(300)]
    texts += [[*t[:58], "other", "words"] for t in texts[:9]]
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "seq long, text string")
    staged, table = [], Staging.table

    def count(self, frame, name):
        out = table(self, frame, name)
        lists = [F.sum(F.size(f.name)) for f in out.schema.fields if f.dataType.typeName() == "array"]
        staged.append(out.agg(*lists).first()[0] or 0 if lists else out.count() if "term" in out.columns else 0)
        return out

    monkeypatch.setattr(Staging, "table", count)
    found = flag_redundant(rows, threshold=0.2, vector=term_vector(F.col("text")), first_match=first_match).filter("is_redundant")
    got = found.collect()
    assert {r["seq"] for r in got} == set(range(300, 309))
    assert not first_match or all(r["match_seq"] == r["seq"] - 300 for r in got)
    assert 0 < sum(staged) < 0.7 * sum(map(len, texts))


def test_cut_vectors_keep_every_match(spark, monkeypatch):
    """Texts of any length, with terms that nearly all hold: the entries of two near rows meet."""
    monkeypatch.setattr(novelty, "SAMPLE", 4)
    rng = random.Random(2)
    texts = []
    for i in range(160):
        text = [f"often{k}" for k in range(rng.choice([0, 3, 12, 40]))] + [f"r{rng.randrange(90)}" for _ in range(rng.choice([1, 2, 5, 20]))]
        texts.append(" ".join(text))
    rows = spark.createDataFrame(list(enumerate(texts)), "seq long, text string").withColumn("embedding", term_vector(F.col("text")))
    vectors = sparse_as_numpy([(r["seq"], r["embedding"]) for r in rows.collect()])
    expected = brute_force(vectors, {i: True for i in vectors}, 0.2)
    got = flag_redundant(rows, threshold=0.2, first_match=True).filter("is_redundant").collect()
    assert {r["seq"]: r["match_seq"] for r in got} == expected and len(expected) > 40
