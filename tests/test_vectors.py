import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from newsflow.functions import html, vectors

TEXTS = ["The cat the CAT, sat!", "", None, "Über-uns 7 über", "a b c a b c d", "one", "..."]


def plain_words(text):
    cleaned = "".join(c if c.isalnum() else " " for c in text.lower())
    return cleaned.split()


def test_counts_and_weights(one):
    for ngram in (1, 3):
        got = one(lambda c: vectors.term_vector(c, ngram=ngram), TEXTS)
        for value, vector in zip(TEXTS, got):
            tokens = plain_words(value or "")
            if not tokens:
                assert vector is None
                continue
            last = max(len(tokens) - ngram + 1, 1)
            counts = Counter(" ".join(tokens[i : i + ngram]) for i in range(last))
            norm = math.sqrt(sum(math.log1p(n) ** 2 for n in counts.values()))
            expected = sorted(math.log1p(n) / norm for n in counts.values())
            assert np.allclose(sorted(e["weight"] for e in vector), expected)
            assert [e["term"] for e in vector] == sorted(e["term"] for e in vector)


def test_buckets_are_bounded(one):
    got = one(lambda c: vectors.term_vector(c, dim=16), ["a b c d e f g h i j k l m n o p q r s t"])[0]
    assert all(0 <= e["term"] < 16 for e in got)
    assert math.isclose(sum(e["weight"] ** 2 for e in got), 1.0)


def test_sparse_dot_is_cosine(spark):
    frame = spark.createDataFrame([("a b c d", "c d e"), ("a", "b"), ("x y", "y x"), ("q", "q")], "l string, r string")
    got = [
        r[0]
        for r in frame.select(
            vectors.sparse_dot(vectors.term_vector(F.col("l")), vectors.term_vector(F.col("r")))
        ).collect()
    ]
    assert np.allclose(got, [2 / math.sqrt(12), 0.0, 1.0, 1.0])


def test_cosine_distance(spark):
    frame = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), (None, [1.0, 1.0]), ([1.0, 2.0], [2.0, 4.0])],
        "l array<float>, r array<float>",
    )
    got = [r[0] for r in frame.select(vectors.cosine_distance(F.col("l"), F.col("r"))).collect()]
    assert math.isclose(got[0], 1 - 1 / math.sqrt(2)) and got[1] is None and got[2] is None and abs(got[3]) < 1e-12


def test_main_text(one):
    page = (
        "<html><head><title>t</title></head><body><!-- <article>no</article> --><nav>n</nav>"
        "<div>ad</div><article class='x'><h1>H &amp;lt; 1</h1><script>var a='<p>';</script>"
        "<p>one<br/>two&nbsp;<b>three</b></p><table><tr><td>cell</td></tr></table></article><footer>f</footer></body></html>"
    )
    assert one(html.main_text, [page, "<body><p>a</p>b</body>", "", None]) == [
        "H &lt; 1\none\ntwo\xa0three\n", "a\nb", "", None,
    ]
