"""Hard negatives, piece encoding and fill-in-the-middle against brute force, the library and SQL-free counterparts."""

import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from newsflow.llm import fill_in_middle, hard_negatives, piece_encoding

MODEL = public_tokenizers.path("piece_bpe_32k.model")
VECTORS = "vec_id bigint, label int, embedding array<float>, row string, score int, anchor int"
TEXTS = "doc_id bigint, text string, n string, form int, output int, cut int, boundaries int"


def brute_negatives(rows):
    kept = []
    for vec_id, label, vector, *_ in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((vec_id, label, [math.floor(256 * x) for x in vector]))
    out = []
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for i, (anchor, label, vector) in enumerate(kept):
        if anchor is None or anchor % 10:
            continue
        scored = [(sum(a * b for a, b in zip(vector, v)), vid, lab) for j, (vid, lab, v) in enumerate(kept) if j != i]
        for score, positive, _ in sorted((s for s in scored if s[2] == label), key=key)[:5]:
            near = sorted((s for s in scored if s[2] != label and 80 * score <= 100 * s[0] <= 100 * score), key=key)[:5]
            out += [(anchor, positive, rank, n[1], score, n[0]) for rank, n in enumerate(near, 1)]
    return sorted(out, key=repr)


def vectors():
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(6, 8))
    rows = []
    for i in range(400):
        v = centres[i % 6] + draw.normal(size=8) * (0.05 if i % 3 else 0.8)
        # Label 0 holds half of all rows.
        rows.append((i, 0 if i % 2 else i % 5, [float(np.float32(x)) for x in v], None, None, None))
    rows += [
        rows[10], rows[10], rows[20], (None, 0, rows[30][2], None, None, None), (None, 3, rows[31][2], None, None, None),
        (410, None, rows[5][2], None, None, None), (420, 1, None, None, None, None), (430, 1, [1.0, None, 2.0], None, None, None),
        (440, 1, [float("nan")] * 8, None, None, None), (450, 1, [float("inf")] * 8, None, None, None), (460, 2, [], None, None, None),
        (470, 2, [0.0] * 8, None, None, None), (480, 2, [1.0, 2.0], None, None, None), (490, 1, [1e6, -3e5] * 4, None, None, None),
    ]
    return rows


@pytest.mark.parametrize("block,chunk", [(2048, 256), (16, 4)])
def test_hard_negatives(spark, monkeypatch, block, chunk):
    """Small blocks take several rounds; both give the rows of brute force."""
    for name, value in {"LEAST_BLOCK": block, "BLOCK": block, "CHUNK": chunk, "ANCHORS": 8, "KEPT": 64, "GROWTH": 2}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors()
    found = hard_negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute_negatives(rows)


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(empty, F.lit(True)).count() == 0
    assert hard_negatives.mine(spark.createDataFrame(vectors()[:5], VECTORS), F.lit(False)).count() == 0


def test_score_bounds_hold():
    """No pair scores outside of what its angles and norms allow, at any magnitude."""
    draw = np.random.default_rng(9)
    for scale in (1, 300, 1e6):
        a, b = (np.round(draw.normal(size=(60, 12)) * scale).astype(np.int64) for _ in range(2))
        b[:20] = a[:20] * 2
        a[0] = 0
        norms = [np.linalg.norm(x.astype(float), axis=1) for x in (a, b)]
        references = hard_negatives._directions(a[:30].tolist())
        angles = [hard_negatives.angles_to(references, x, n).astype(np.float32).astype(float) for x, n in zip((a, b), norms)]
        scores = a @ b.T
        for j in range(len(b)):
            between = hard_negatives.angle_bounds(angles[0], angles[0], angles[1][j], angles[1][j])
            least, most = hard_negatives.score_bounds(between, norms[0], norms[0], norms[1][j], norms[1][j])
            assert (least <= scores[:, j]).all() and (scores[:, j] <= most).all()
        assert (hard_negatives.scores_of(a, b, float(norms[0].max() * norms[1].max())) == scores).all()


def test_angles_skip_blocks():
    """Rows in clusters: windows near the top leave most chunks unscored."""
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(8, 16))
    points = np.round(256 * (np.repeat(centres, 256, 0) + draw.normal(size=(2048, 16)) * 0.01)).astype(np.int64)
    norms = np.linalg.norm(points.astype(float), axis=1)
    references = hard_negatives._directions(points[::256].tolist())
    angles = hard_negatives.angles_to(references, points, norms)
    met = 0
    for at in range(0, 2048, 256):
        part = slice(at, at + 256)
        between = hard_negatives.angle_bounds(angles, angles, angles[part].min(0), angles[part].max(0))
        met += (hard_negatives.score_bounds(between, norms, norms, norms[part].min(), norms[part].max())[1] >= 0.98 * norms**2).sum()
    assert met < 0.5 * 2048 * 8


def odd_texts():
    choice = random.Random(4)
    marks = ["▁", " ", "  ", "\n", "\t", "a", "the", "ing", "th", "e", "ß", "日", "本", "\U0001f600", "́", "<s>", "</s>", "<unk>",
             "<0x0A>", "\x00", "1", " " * 15, " " * 17, " " * 31, "\xa0", "tion", "<P>", "\r\n"]
    texts = [None, "", " ", "\n", "\n\n", "x", "one\ntwo\nthree", "a<S>b", "ends\n", "ab\n" * 40000, "\n" * 70000, "é\n日本\n" * 500]
    texts += ["".join(choice.choices(marks, k=choice.randint(1, 40))) for _ in range(400)]
    texts += ["".join(choice.choices("abcdeghinorst", k=choice.randint(1, 60))) for _ in range(400)]
    texts += ["word " * 30000, "a" * 100000, *(" " * k for k in range(60)), "x", "x"]
    return texts


def test_piece_encoding(spark):
    texts = odd_texts()
    rows = [(i, t, None, None, None, None, None) for i, t in enumerate(texts)] + [(None, "null id", None, None, None, None, None)]
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = piece_encoding.encode(spark.createDataFrame(rows, TEXTS), MODEL)
    got = {r.doc_id: list(r.ids) for r in ids.collect()}
    assert all(got[i] == library.encode(t or "", add_bos=True, add_eos=True) for i, t, *_ in rows)
    for r in piece_encoding.decode(ids, MODEL).collect():
        assert r.text == library.decode(got[r.doc_id]) and r.n_tokens == len(got[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(np.array(got[r.doc_id], "<u4").tobytes()).hexdigest()
    assert piece_encoding.decode(piece_encoding.encode(spark.createDataFrame([], TEXTS), MODEL), MODEL).count() == 0


def test_backtracking_is_merging():
    """Own small vocabularies with equal scores and dead ends; the definition by merging is the judge."""
    choice = random.Random(8)
    for _ in range(60):
        # Pieces grow by pairs, so that scores fall from parts to wholes, and now and then tie.
        known, ranks = list("abcd"), {c: 100.0 for c in "abc"}
        for step in range(choice.randint(3, 40)):
            piece = choice.choice(known) + choice.choice(known)
            if piece not in ranks and len(piece) < 9:
                ranks[piece] = float(step // 2 if choice.random() < 0.2 else step)
                known.append(piece)
        merges = piece_encoding.Merges(ranks)
        if not all(merges.regular.get(p, False) for p in ranks if len(p) > 1):
            continue
        for _ in range(60):
            text = "".join(choice.choices("abcd", k=choice.randint(0, 30)))
            assert merges.pieces(text) == merges.merge(text)[0]


def test_stretches_with_spaces_inside_of_pieces():
    """A model whose pieces span white space is encoded as whole texts."""
    encoder = piece_encoding.PieceEncoder(MODEL)
    expected = encoder.encode(pa.array(["two words here", ""])).to_pylist()
    encoder.splits = False
    encoder._clear()
    assert encoder.encode(pa.array(["two words here", ""])).to_pylist() == expected


def units(text):
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def test_fill_in_middle(spark):
    rows = [(i, t, "n", 1, 2, 3, 4) for i, t in enumerate(odd_texts())] + [(None, "a\nb\n", "n", 1, 2, 3, 4)]
    frame = spark.createDataFrame(rows, TEXTS)
    out, names = fill_in_middle.transform(frame, percent=90)
    restored = fill_in_middle.restore(F.col(names["output"]), F.col(names["form"]))
    assert out.columns[: len(frame.columns)] == frame.columns and len(set(out.columns)) == len(out.columns)
    got = {r.doc_id: r for r in out.withColumn("restored", restored).collect()}
    forms = set()
    for doc_id, text, *_ in rows:
        text = text or ""
        digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
        lines = units(text)
        a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
        prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
        form = "plain" if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 50 else "psm"
        output = {"plain": text, "psm": f"<P>{prefix}<S>{suffix}<M>{middle}", "spm": f"<S>{suffix}<P>{prefix}<M>{middle}"}[form]
        r = got[doc_id]
        assert (r[names["n"]], r[names["form"]], r[names["output"]], r.restored) == (len(lines), form, output, text)
        assert (r[names["prefix_chars"]], r[names["middle_chars"]]) == ((None, None) if form == "plain" else (len(prefix), len(middle)))
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}
    assert fill_in_middle.transform(spark.createDataFrame([], TEXTS))[0].count() == 0


@pytest.mark.parametrize("density", ["sparse", "dense", "runs", "mixed"])
def test_boundary_set(density):
    draw = np.random.default_rng(2)
    make = {
        "sparse": lambda: draw.choice(1 << 22, 3000, replace=False),
        "dense": lambda: draw.choice(1 << 17, 60000, replace=False),
        "runs": lambda: np.concatenate([np.arange(a, a + 5000) for a in (3, 70000, 1 << 20, (1 << 33) + 7)]),
        "mixed": lambda: np.concatenate([np.arange(9, 50000), (1 << 18) + draw.choice(1 << 16, 30000, replace=False), [1 << 40]]),
    }
    values = np.sort(make[density]())
    found = fill_in_middle.BoundarySet.from_bytes(fill_in_middle.BoundarySet.of(values).to_bytes())
    kinds = {c.kind for c in found.containers}
    assert len(found) == len(values) and {"sparse": {0}, "dense": {1}, "runs": {2}}.get(density, {0, 1, 2}) == kinds
    ranks = [0, 1, len(values) // 3, len(values) - 2, len(values) - 1, *draw.integers(0, len(values), 200).tolist()]
    assert [found.select(r) for r in ranks] == [int(values[r]) for r in ranks]
