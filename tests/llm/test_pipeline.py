"""The corpus pipeline against a brute-force version of its stages."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest

import corpus_pipeline
from newsflow.llm import quality_rules
from test_operators import brute_windows, prose, words

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, hit int, kept_id string, copies map<string, int>"
ITEMS = [(i, prose(35 + i, 9000 + i)) for i in range(6)]


def documents():
    draw = random.Random(21)
    rows = []

    def add(text, doc_id=0):
        number = len(rows)
        rows.append((number if doc_id == 0 else doc_id, text, "en", ["b", "a", None, "ä"][number % 4], 1, number, "k", {"m": 1}))

    for i in range(40):
        add(prose(60 + 3 * i, 8000 + i))
    for i in range(12):
        near = prose(60 + 3 * i, 8000 + i).split()
        near[draw.randrange(len(near))] = "other"
        add(" ".join(near).upper() if i % 5 == 0 else "\n".join(near))
    for i, item in ITEMS:
        add(prose(40, i) + " " + item + " " + prose(30, 50 + i))
    for text in (None, "", " \n", "short text", "a " * 80, prose(60, 1) + " ###" * 30, prose(60, 2).upper(), ("same line here\n" * 30), "1 2 3 4 " * 20):
        add(text)
    for i in range(4):
        add(prose(70, 8500 + i), None)
    rows.append(rows[3])
    return rows


def kept_by_quality(rows):
    out = []
    for row in rows:
        text = row[1] or ""
        w = [x.decode() for x in words(text)]
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if words(x)]
        letters = [c for c in text if c.isascii() and c.isalpha()]
        values = {
            "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
            "n_upper": sum(c.isupper() for c in letters), "n_letters": len(letters),
            "n_alpha_words": sum(any(c.isascii() and c.isalpha() for c in x) for x in w),
        }
        if not any(eval(rule.replace("OR", "or"), {}, values) for rule in quality_rules.RULES.values()):
            out.append(row)
    return out


def one_of_each(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for row in rows:
        w = words(row[1].translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    return [min((r for r, g in zip(rows, group) if g == one), key=lambda r: (r[0] is None, r[0] or 0)) for one in dict.fromkeys(group)]


def mixed(rows):
    sizes, total = Counter(), 0
    for row in rows:
        sizes[row[3]] += len(words(row[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_) if open_ else 0
        full = [s for s in open_ if 2 * sizes[s] <= level * weight[s]]
        if not full:
            break
        for s in full:
            target[s] = 2 * sizes[s]
            open_.discard(s)
    target |= {s: level * weight[s] for s in open_}
    out = []
    for source in order:
        own = [r for r in rows if r[3] == source]
        whole = math.floor(target[source] / sizes[source] + 1e-12) if sizes[source] else 1
        budget, upto, more = target[source] - whole * sizes[source], 0, set()
        place = lambda r: int(hashlib.md5((f"text {r[1]}" if r[0] is None else str(r[0])).encode()).hexdigest()[:15], 16)
        for key in sorted({place(r) for r in own}):
            size = sum(len(words(r[1])) for r in own if place(r) == key)
            if upto + size > budget and not upto + size - budget < budget - upto:
                break
            upto += size
            more.add(key)
            if upto > budget:
                break
        for r in own:
            out += [r] * (whole + (budget > 0 and place(r) in more))
    return out


def key(row):
    return repr((row[0], row[1], row[3]))


def test_stages_against_brute_force(spark, tmp_path):
    rows = documents()
    folder = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    brute = {
        "quality_rules": kept_by_quality,
        "near_duplicates": one_of_each,
        "decontamination": lambda given: [r for r in given if all(brute_windows(r[1], item)[0] < 0.8 for _, item in ITEMS)],
        "mixing": mixed,
    }
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = brute[name](rows)
        docs.createOrReplaceTempView("given")
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert sorted(map(key, (tuple(r) for r in docs.collect()))) == sorted(map(key, rows)), name
        left.append(len(rows))
    # Each stage had something to do.
    assert left[0] > left[1] > left[2] < left[3]
    expected = sorted(repr((r[0], len(r[1].encode()) + 8, zlib.crc32(r[1].encode()))) for r in rows)
    for result in (corpus_pipeline.STAGES[-1][1](spark, docs, folder), corpus_pipeline.run(spark, folder)):
        got = result.collect()
        assert sorted(repr((r.doc_id, r.size, r.text_crc32)) for r in got) == expected
        counts = Counter(r.shard for r in got)
        assert set(counts) <= set(range(24)) and max(counts.values()) - min(counts[s] for s in range(24)) <= 1
        assert all(sorted(r.slot for r in got if r.shard == s) == list(range(counts[s])) for s in range(24))


@pytest.mark.parametrize("items", [[], ITEMS[:1]])
def test_empty_tables(spark, tmp_path, items):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
