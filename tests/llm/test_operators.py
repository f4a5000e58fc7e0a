"""Each operator on small tables with nulls, empty and repeated rows, against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from newsflow.llm import (
    decontamination, importance, jaccard_join, language_id, license_scan, mixing, quality_rules, sharding,
    substring_dedup, token_files,
)
from newsflow.llm.blocks import pack

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, size string, ledger string"
CHOICE = random.Random(5)
VOCABULARY = ["".join(CHOICE.choices("abcdeéß", k=CHOICE.randint(1, 6))) for _ in range(300)]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(VOCABULARY, k=n))


def rows():
    base, passage = prose(120, 1), prose(60, 2)
    near = base.split()
    near[60] = "changed"
    texts = [
        base, base.upper(), " ".join(near), base, None, "", " \t\n", "one", "ONE", "two words", passage,
        prose(40, 3) + "\n" + passage + "\x0b" + prose(30, 4), prose(30, 5) + " " + passage, "a " * 60,
        "a " * 45 + prose(10, 6), "line one\nline one\n\nline two\n" * 20, "### $$$ %% | <>", prose(3000, 7), "x\xa0y 　z",
    ]
    kinds = ["b", "a", None, "ä"]
    out = [(i, t, ["en", None, "de"][i % 3], kinds[i % 4], 1, 9, "s", "l") for i, t in enumerate(texts)]
    return out + [out[0], (None, base, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def test_quality_rules(docs, empty):
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_repeat_words, r.n_dup_lines) for r in quality_rules.ledger(docs).collect())
    expected = []
    for doc_id, text, *_ in rows():
        w = words(text)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(w) < 1000 else set()
        lines = [x for x in (text or "").split("\n") if words(x)]
        expected.append((-1 if doc_id is None else doc_id, len(w), len(covered), len(lines) - len(set(lines))))
    assert [g for g in got if g[1] < 1000] == sorted(e for e in expected if e[1] < 1000)
    kept = quality_rules.accepted(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows())
    report = {r.rule: r for r in quality_rules.ablations(quality_rules.ledger(docs), [quality_rules.STRICT]).collect()}
    assert report["too_short"].documents == len(rows()) and report["too_short"].failed >= report["too_short"].rejected_by_it_alone
    assert quality_rules.ledger(empty).count() == 0


def brute_components(data, width, percent):
    sets = []
    for _, text, *_ in data:
        w = [x.lower() for x in words(text)]  # bytes: only A-Z change
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    least = {i: i for i in range(len(data))}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                least[find(i)] = find(j)
    groups = {}
    for i in range(len(data)):
        groups.setdefault(find(i), []).append(data[i][0])
    smallest = {root: min((x for x in ids if x is not None), default=None) for root, ids in groups.items()}
    return sorted(((data[i][0], len(s), smallest[find(i)]) for i, s in enumerate(sets)), key=repr)


def near_copies():
    out = []
    for group in range(6):
        base = prose(60 + 40 * group, 100 + group).split()
        for copy in range(40):
            changed, r = list(base), random.Random(copy * 7 + group)
            for _ in range(r.randint(0, 4)):
                changed[r.randrange(len(changed))] = r.choice(VOCABULARY)
            out.append((len(out), " ".join(changed), None, None, None, None, None, None))
    return out


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_jaccard_join(spark, empty, width, percent):
    data = rows() + [(r[0] + 100, *r[1:]) for r in near_copies()]
    got = jaccard_join.join(spark.createDataFrame(data, SCHEMA), width, percent).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_components(data, width, percent)
    assert jaccard_join.join(empty).count() == 0


def test_jaccard_join_over_many_leaves(spark, monkeypatch):
    """Leaves of three classes, so that links between distant leaves are found in blocks of pairs."""
    for name, value in {"LEAF": 3, "BRANCH": 4, "SIGN_SIDE": 2, "FULL_SIDE": 2}.items():
        monkeypatch.setattr(jaccard_join, name, value)
    data = near_copies()
    got = jaccard_join.join(spark.createDataFrame(data, SCHEMA), 5, 80).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_components(data, 5, 80)


def test_signatures_lose_no_link():
    """Leaves of sets of very different sizes: a pair is dropped only if it holds no link between components."""
    draw = np.random.default_rng(5)
    bases = [draw.integers(1, 2**63, n, np.uint64) for n in (1, 9, 60, 500, 4000)]

    def leaf(first, changed):
        sets = [np.unique(np.concatenate([b[int(len(b) * changed) :], draw.integers(1, 2**63, int(len(b) * changed), np.uint64)])) for b in bases]
        names = pa.array(range(first, first + len(sets)), pa.int64())
        return jaccard_join.Leaf(pack(pa.RecordBatch.from_arrays([names, pa.array([t.tobytes() for t in sets], pa.large_binary())], ["name", "tokens"])))

    roots = [list(range(5)), list(range(10, 15))]
    outcomes = set()
    for changed in (0, 0.05, 0.1, 0.3, 0.9, 1):
        a, b = leaf(0, 0), leaf(10, changed)
        found = jaccard_join.traverse(a, b, 80)
        x, y = (jaccard_join._by_width(jaccard_join.signatures(l), r) for l, r in zip((a, b), roots))
        met = jaccard_join.may_meet(x, y, 80)
        assert met or not found
        outcomes.add(met)
        assert not jaccard_join.may_meet(x, jaccard_join._by_width(jaccard_join.signatures(a), roots[0]), 80)
    assert outcomes == {True, False}


def brute_kept(data):
    """Of each component of near copies the row with the smallest id, and all rows without words."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := [x.lower() for x in words(r[1])]) else set() for r in data]
    group = list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for g, s, r in zip(group, sets, data):
        if s:
            key = (r[0] is None, r[0] or 0)
            least[g] = min(least.get(g, key), key)
    kept = [least[g][1] if not least[g][0] else None for g in least]
    return sorted(map(repr, kept + [r[0] for s, r in zip(sets, data) if not s]))


def test_one_of_each(spark, docs, empty):
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == brute_kept(rows())
    assert jaccard_join.one_of_each(empty).count() == 0


def test_one_of_each_without_ids(spark):
    """Unrelated texts that share an id, or have none, all stay; own columns may have any name."""
    texts = [prose(40, 1000 + i) for i in range(6)]
    data = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (3, texts[5]), (7, texts[5]), (7, prose(40, 1010))]
    frame = spark.createDataFrame([(i, t, 1, "x", {"a": 1}) for i, t in data], "doc_id bigint, text string, _first int, kept_mark string, mark map<string, int>")
    kept = jaccard_join.one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(data[:6] + data[7:], key=repr)


def test_jaccard_join_without_ids(spark):
    """Rows without an id are not paired with each other: each class meets its own text."""
    data = [(None, prose(30, 2000 + i % 40) + (" tail" if i % 3 == 0 else ""), *[None] * 6) for i in range(120)]
    got = jaccard_join.join(spark.createDataFrame(data, SCHEMA), 5, 80).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_components(data, 5, 80)


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_decontamination(spark, docs, empty, monkeypatch, sent):
    """The same, whichever side of the join travels."""
    monkeypatch.setattr(decontamination, "MOST_SENT", sent)
    item = rows()[10][1]
    items = spark.createDataFrame([(1, item), (2, prose(30, 99)), (3, None), (4, ""), (5, "two words")], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.find(docs, items).collect()}
    assert found == {(10, 1), (11, 1), (12, 1), (9, 5)}
    kept = decontamination.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(rows()) - 4
    assert decontamination.find(empty, items).count() == 0
    assert decontamination.clean(docs, items.limit(0)).count() == len(rows())


def test_decontamination_with_clashing_names(spark, docs):
    item = rows()[10][1]
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    named = docs.selectExpr("*", "1 AS hit", "2 AS hit_key", "3 AS _hit", "4 AS similarity", "5 AS start")
    kept = decontamination.clean(named, items)
    assert kept.columns == named.columns and kept.count() == len(rows()) - 3


def brute_windows(text, item, width=5):
    """(similarity, -start) of the best window of the item's length that starts at a shared shingle."""
    w, i = ((x or "").lower().split() for x in (text, item))
    width = min(width, len(i))
    grams = lambda x: [tuple(x[k : k + width]) for k in range(len(x) - width + 1)]
    own, best = grams(i), (0, 0)
    for start in range(len(w)):
        window = grams(w[start : start + len(i)])
        if not window or window[0] not in own:
            continue
        common = sum(min(own.count(g), window.count(g)) for g in set(own))
        best = max(best, (common / (len(own) + len(window) - common), -start))
    return best


def test_decontamination_recall(spark):
    """Changed copies of items inside of other text: at least 0.99 of those at 0.8 or more are found, and no others."""
    items = [(i, prose(40 + i % 30, 5000 + i)) for i in range(60)]
    data = []
    for i, text in items:
        for copy in range(6):
            changed, r = text.split(), random.Random(i * 10 + copy)
            for _ in range(copy % 3):
                changed[r.randrange(len(changed))] = "other"
            data.append((len(data), prose(15, i + copy) + " " + " ".join(changed) + " " + prose(10, copy)))
    expected = {}
    for doc_id, text in data:
        for item_id, item in items[doc_id // 6 : doc_id // 6 + 1]:
            similarity, back = brute_windows(text, item)
            if similarity >= 0.8:
                expected[doc_id, item_id] = (pytest.approx(similarity), -back)
    found = decontamination.find(spark.createDataFrame(data, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in found.collect()}
    assert set(got) <= set(expected) and all(got[k] == expected[k] for k in got)
    assert len(expected) > 120 and len(got) >= 0.99 * len(expected)


def test_sharding(docs, empty):
    out = sharding.into_shards(docs, 4).collect()
    sizes = [sum(r.shard == s for r in out) for s in range(4)]
    assert sum(sizes) == len(rows()) and max(sizes) - min(sizes) <= 1
    for s in range(4):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    assert sorted(r.size for r in out) == sorted(len((t or "").encode()) + 8 for _, t, *_ in rows())
    assert len({r.shard for r in out if r.linked and r.text_crc32 == zlib.crc32(rows()[0][1].encode())}) == 1
    assert sharding.into_shards(empty).count() == 0


def test_token_files(spark, docs, empty, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    token_files.write_tokens(docs, str(tmp_path / "t"), path)
    stored = sorted((repr(r.doc_id), list(r.ids)) for r in token_files.read_tokens(spark, str(tmp_path / "t")).collect())
    assert stored == sorted((repr(i), [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, *_ in rows())
    digest = token_files.summary(token_files.read_tokens(spark, str(tmp_path / "t"))).orderBy("start").collect()
    assert [r.start for r in digest] == [sum(x.n_tokens for x in digest[:i]) for i in range(len(digest))]
    ids = [r.doc_id for r in digest if r.doc_id is not None]
    assert ids == sorted(ids) and token_files.read_tokens(spark, str(tmp_path / "t"), [3]).count() == 1
    token_files.write_tokens(empty, str(tmp_path / "e"), path)
    assert token_files.summary(token_files.read_tokens(spark, str(tmp_path / "t")).limit(0)).count() == 0


def test_language_id(spark, empty):
    texts = [(i, prose(30, i) if i % 2 else " ".join(random.Random(i).choices(["uno", "los", "ñoñez", "que"], k=20)), ["es", "xx"][i % 2]) for i in range(60)]
    frame = spark.createDataFrame([*texts, (90, None, "es"), (91, "123 !", "es"), (92, "los que", None)], "doc_id bigint, text string, lang string")
    trees = language_id.fit(frame)
    got = {r.doc_id: r for r in language_id.predict(frame, trees, ["doc_id"]).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in texts) and got[92].lang_pred == "es"
    assert got[90].lang_pred == got[91].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in got.values())
    bits = trees.bits.astype(float)
    assert (np.exp2(-bits).sum(1) < 1.01).all()
    clashing = language_id.predict(frame.selectExpr("doc_id AS body", "text", "lang AS letters"), trees, ["body", "letters"])
    assert {r.body: r.lang_pred for r in clashing.collect()} == {i: r.lang_pred for i, r in got.items()}
    none = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.predict(frame, none, ["doc_id"]).collect()} == {"und"}
    assert language_id.predict(empty, trees, ["doc_id"]).count() == 0


def brute_bits(samples, least, text):
    """Bits of a text under one language's samples, by prediction by partial matching with counts in dictionaries."""
    every = {}
    own = {}
    for lang, texts in samples.items():
        for t in texts:
            padded = b"\0" * 3 + t.encode()
            for at in range(3, len(padded)):
                for order in range(4):
                    context = padded[at - order : at]
                    every[context] = every.get(context, 0) + 1
                    follows = own.setdefault(lang, {}).setdefault(context, {})
                    follows[padded[at]] = follows.get(padded[at], 0) + 1
    totals = {}
    for lang in samples:
        total, padded = 0.0, b"\0" * 3 + text.encode()
        for at in range(3, len(padded)):
            p = 1.0
            for order in (3, 2, 1, 0):
                context = padded[at - order : at]
                follows = own[lang].get(context)
                if not follows or (order and every[context] < least):
                    continue
                n, kinds = sum(follows.values()), len(follows)
                if padded[at] in follows:
                    p *= follows[padded[at]] / (n + kinds)
                    break
                p *= kinds / (n + kinds)
            else:
                p /= 256
            total -= math.log2(p)
        totals[lang] = total
    return totals


@pytest.mark.parametrize("table_bytes", [1 << 25, 60_000])
def test_language_model_against_brute_force(spark, table_bytes):
    """Code lengths with all contexts, and with rare ones left to shorter ones; any number of languages."""
    draw = random.Random(12)
    samples = {f"l{i:02}": [" ".join(draw.choices(["ab", "ba", f"c{i}", "ñé", "dd" * (i % 4)], k=12)) for _ in range(4)] for i in range(23)}
    frame = spark.createDataFrame([(n, t, lang) for n, (lang, t) in enumerate((k, t) for k, ts in samples.items() for t in ts)], "doc_id bigint, text string, lang string")
    counts = language_id.gram_counts(frame.select("lang", "text")).toArrow()
    trees = language_id.Trees(counts, table_bytes)
    assert trees.languages == sorted(samples) and (trees.least > 1) == (table_bytes < 1 << 20)
    texts = ["ab ba c3", "", "ñé dd \u65e5 x", "c11 c11", "zz"]
    lengths = trees.code_lengths(pa.array(texts))
    for row, text in zip(lengths, texts):
        expected = brute_bits(samples, trees.least, text)
        assert row.tolist() == pytest.approx([expected[lang] for lang in trees.languages], rel=1e-4, abs=1e-3)


def test_license_scan(spark, docs, empty):
    more = spark.createDataFrame([(500, prose(20, 1) + "\nReleased under the MIT License.\n" + prose(5, 3)), (501, "the work")], "doc_id bigint, text string")
    found = license_scan.scan(docs.select("doc_id", "text").unionByName(more)).collect()
    assert [(r.doc_id, r.paragraph, r.family) for r in found] == [(500, 1, "mit")]
    assert license_scan.scan(empty).count() == 0


def test_license_fit_takes_every_line(spark):
    """All plain lines train or calibrate, each in one of the two, and the threshold holds for all that calibrate."""
    near = "licensed under the apache license version 2.0"
    body = [f"{near} " + " ".join(f"w{i}x{k}" for k in range(9)) if i % 50 == 0 else f"the w{i} w{i % 97} sits w{i % 89}" for i in range(10000)]
    docs = spark.createDataFrame([(n, "\n".join(body[n::20]) + "\n\nReleased under the MIT License.") for n in range(20)], "doc_id bigint, text string")
    vocabulary = license_scan.grams_of_notices(spark)
    lines = license_scan._lines(docs, "doc_id", "text", vocabulary).cache()
    scanner = license_scan.fit(lines, vocabulary)
    counts = {r.held: r["count"] for r in lines.filter("plain").groupBy("held").count().collect()}
    assert lines.count() == 10020 and sum(counts.values()) == 10000
    assert (scanner.trained, scanner.held) == (counts[False], counts[True]) and min(counts.values()) > 4500
    scores = [r.probability for r in license_scan._best(scanner.model.transform(lines.filter("plain and held"))).collect()]
    allowed = int(license_scan.FALSE_FINDS * len(scores))
    expected = int(sorted(scores)[-allowed - 1] * license_scan.STEPS + 1) / license_scan.STEPS
    assert scanner.threshold == max(0.5, min(0.9, expected))
    # A line that does not train would leave the model as it is; all of one kind being gone must change it.
    fewer = license_scan.fit(lines.filter("held or doc_id != 0"), vocabulary)
    assert fewer.trained < scanner.trained and fewer.model.interceptVector != scanner.model.interceptVector
    assert {(r.doc_id, r.family) for r in license_scan.scan(docs, scanner=scanner).filter("family = 'mit'").collect()} == {(n, "mit") for n in range(20)}


def test_license_threshold_counts_all(spark):
    rows = spark.range(100000).select((0.4 + 0.5 * F.col("id") / 100000).alias("probability"))
    passed = rows.filter(F.col("probability") >= license_scan._threshold(rows, 100000)).count()
    assert 100 - 2 * 100000 / license_scan.STEPS < passed <= 100
    assert license_scan._threshold(rows.limit(0), 0) == 0.5 and license_scan._threshold(rows.select((F.col("probability") / 2).alias("probability")), 100000) == 0.5


def test_license_features(spark):
    """Grams of neighbouring words only, as those of all words that the templates have."""
    vocabulary = license_scan.grams_of_notices(spark)
    texts = ["Released under the MIT License", "x the mit y license under THE mit", "nothing here", "MIT mit"]
    frame = spark.createDataFrame([(t,) for t in texts], "body string").withColumn("w", license_scan.words(F.col("body")))
    for row in license_scan.described(frame, vocabulary).collect():
        w = row.body.lower().split()
        every = {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}
        own = [x for x in w if x in vocabulary]
        found = {vocabulary[i] for i in row.features.indices if i < len(vocabulary)}
        assert found == every & set(vocabulary) and sorted(row.known) == sorted(set(own))
        assert row.features[len(vocabulary)] == pytest.approx(math.log1p(len(w) - len(own)))
        assert row.plain == (2 * len(set(own)) < len(set(w)))


def test_mixing(docs, empty):
    out, info, copies = mixing.mix(docs)
    taken = {}
    for r in out.collect():
        size = len(words(r.text))
        assert r[info].source_size == sum(len(words(t)) for _, t, _, s, *_ in rows() if s == r.source)
        assert 0 <= r[copies] <= 2
        taken.setdefault(r.source, [r[info].target, 0])[1] += size * r[copies]
    total = sum(len(words(t)) for _, t, *_ in rows())
    assert sum(t for t, _ in taken.values()) == pytest.approx(1.5 * total)
    assert mixing.mixed(docs).columns == docs.columns and mixing.mix(empty)[0].count() == 0


def test_importance(spark, docs, empty):
    good = spark.createDataFrame([(17,), (None,)], "doc_id bigint")
    out = importance.resample(docs, good, share=0.5).collect()
    kept = [r.gumbel_key for r in out if r.kept]
    assert abs(len(kept) - len(out) // 2) <= 2 and min(kept) > max(r.gumbel_key for r in out if not r.kept)
    assert next(r.log_weight for r in out if r.doc_id == 4) == 0
    assert importance.resample(empty, good).count() == 0


def test_importance_against_brute_force(spark):
    """Weights from own models, and noise of its own for every id, also those that end in the same word."""
    data = [(f"{a} x", prose(20, i)) for i, a in enumerate("abcdefgh")] + [("a x", prose(20, 0)), (None, prose(9, 3))]
    good = spark.createDataFrame([("b x",), ("c x",)], "doc_id string")
    out = importance.resample(spark.createDataFrame(data, "doc_id string, text string"), good, share=0.5).collect()
    noise = {(r.doc_id): round(r.gumbel_key - r.log_weight, 9) for r in out}
    assert len(set(noise.values())) == len(noise) == 9

    def model(texts):
        n = np.full(importance.BUCKETS, importance.SMOOTHING)
        for t in texts:
            np.add.at(n, importance.features(importance.words_of(pa.array([t]), lower=True))[0], 1)
        return np.log(n / n.sum())

    ratio = model([t for i, t in data if i in ("b x", "c x")]) - model([t for _, t in data])
    expected = sorted((repr(i), round(float(ratio[importance.features(importance.words_of(pa.array([t]), lower=True))[0]].sum()), 6)) for i, t in data)
    assert sorted((repr(r.doc_id), round(r.log_weight, 6)) for r in out) == expected


def long_repeats():
    """Near copies of long texts, in any order of ids, with ids that repeat or are missing."""
    draw = random.Random(77)
    bases = [[f"w{draw.randrange(4000)}" for _ in range(n)] for n in (900, 700, 25, 20, 19)]
    out = []
    for i in range(90):
        text = list(draw.choice(bases))
        for _ in range(draw.choice([0, 0, 1, 3])):
            text[draw.randrange(len(text))] = draw.choice(["changed", "w1", "w2 w3"])
        if i % 5 == 0:
            text = text[draw.randrange(10) :] + text[: draw.randrange(400)]
        out.append((draw.choice([None, 5, 700 - i, i, 2 * i]), " ".join(text)))
    return out + [(1000, "r " * 500), (1001, "q " + "r " * 300), (1002, "r " * 19), (-4, " ".join(bases[0]))]


def test_substring_dedup_of_long_repeats(spark):
    data = long_repeats()
    # Rows with one id are ordered by a hash of their text, so only ids of their own are compared word by word.
    ids = [i for i, _ in data]
    data = [(i, t) for i, t in data if i is not None and ids.count(i) == 1]
    seen, expected = set(), []
    for doc_id, text in sorted(data):
        w, gone = text.split(), set()
        for i in range(len(w) - 19):
            if tuple(w[i : i + 20]) in seen:
                gone |= set(range(i, i + 20))
            seen.add(tuple(w[i : i + 20]))
        expected.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    for parts, bucket_bytes in ((1, 1 << 24), (7, 1 << 12)):
        out = substring_dedup.remove_repeats(spark.createDataFrame(data, "doc_id bigint, text string").repartition(parts), bucket_bytes=bucket_bytes)
        assert sorted(tuple(r) for r in out.collect()) == expected


def test_substring_dedup_without_ids(spark):
    """Equal ids and none: some order holds, and of each window exactly one occurrence stays."""
    data = long_repeats()
    out = substring_dedup.remove_repeats(spark.createDataFrame(data, "doc_id bigint, text string").repartition(5)).collect()
    assert sorted((repr(r.doc_id), r.n_words) for r in out) == sorted((repr(i), len(t.split())) for i, t in data)
    windows = lambda t: {tuple(w[i : i + 20]) for w in [t.split()] for i in range(len(w) - 19)}
    every = set().union(*(windows(t) for _, t in data))
    kept = [w for r in out for w in windows(r.kept_text) & every]
    assert len(kept) == len(set(kept))
    untouched = sorted(r.kept_text for r in out if r.n_removed == 0 and r.n_words >= 20)
    assert len(untouched) == len(set(untouched)) > 0


def test_substring_dedup(spark, docs, empty):
    size, seen = 20, set()
    data = sorted(rows(), key=lambda r: (r[0] is None, r[0] or 0))
    expected = []
    for doc_id, text, *_ in data:
        w, gone = words(text), set()
        for i in range(len(w) - size + 1):
            window = tuple(w[i : i + size])
            if window in seen:
                gone |= set(range(i, i + size))
            seen.add(window)
        expected.append((repr(doc_id), len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    for bucket_bytes in (64, 1 << 24):
        out = substring_dedup.remove_repeats(docs.repartition(5), bucket_bytes=bucket_bytes)
        got = sorted((repr(r.doc_id), r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in out.collect())
        assert got == sorted(expected)
    assert substring_dedup.remove_repeats(empty).count() == 0
