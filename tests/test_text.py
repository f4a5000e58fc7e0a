from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from newsflow.functions import html, text

QUIET = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
PIECES = st.sampled_from(
    list("ab1 -*\t\n\r\x0b\x1c\x85 \xa0•") + ["\r\n", " - 1", " * 22", "x7 ", "\U0001f600", "A\n", " A\n"]
)
TEXTS = st.lists(st.lists(PIECES, max_size=25).map("".join), min_size=60, max_size=60)


@QUIET
@given(TEXTS)
def test_line_rules_equal_python(one, values):
    assert one(text.split_lines, values) == [v.splitlines() for v in values]
    assert one(text.strip, values) == [v.strip() for v in values]
    cleaned = one(text.clean_body, values)
    for before, after in zip(values, cleaned):
        lines = [x.strip() for x in after.splitlines() if x.strip()]
        assert len(lines) == len(set(lines)) and after == after.strip()
        assert set(lines[:-1]) <= {x.strip() for x in before.splitlines()}
    # Removing repeats again changes nothing unless the join made a new page run.
    assert one(lambda c: text.strip(F.array_join(text.drop_repeated_lines(text.split_lines(c)), "\n")), cleaned) == cleaned


def test_clean_body_fixtures(one):
    assert one(text.clean_body, ["A\nB\nA\n\n\n B \nC - 1 - 2 - 3 tail", "", None]) == ["A\nB\n\n\nC", "", None]
    table = {
        "one\ntwo\none\nthree": "one\ntwo\nthree",
        "  lead\nlead  \nlast": "lead\nlast",
        "end * 1 * 2": "end",
        "end \u2022 1 \u2022 2 more": "end",
        "one - 1 page": "one - 1 page",
        "a\r\nb\r\na": "a\nb",
        "\n\n": "",
    }
    assert one(text.clean_body, list(table)) == list(table.values())
    assert one(text.cut_page_numbers, ["on 2024-01-15 prices", "a - 1", "x - 1 - 2b"]) == ["on 2024", "a - 1", "x - 1 - 2b"]


def test_body_fallback(spark):
    frame = spark.createDataFrame(
        [("", " ", "d"), (None, "", "d"), ("b", "s", "d"), (None, None, None)],
        "full_body string, rss_summary string, description string",
    )
    got = [r[0] for r in frame.select(text.article_body(frame.columns)).collect()]
    assert got == [" ", "d", "b", ""]
    title = spark.createDataFrame([(None, "b"), ("t", "")], "t string, b string")
    assert [r[0] for r in title.select(text.full_text(F.col("t"), F.col("b"))).collect()] == [". b", "t. "]


def test_character_references(one):
    table = {
        "It&#8217;s &mdash; ok &#x27;x&#x27;": "It’s — ok 'x'",
        "&amp;#39; &#0; &#xD800; &#; &#12": "&#39; &#0; &#xD800; &#; &#12",
        "&#128512;&#X41;": "\U0001f600A",
        "plain": "plain",
    }
    assert one(html.main_text, list(table)) == list(table.values())


def test_items_stay_single_when_pages_repeat(spark):
    from newsflow.operators.pages import item_page_join

    items = spark.createDataFrame([(1, "u"), (2, "v"), (3, None)], "feed_pos int, url string")
    pages = spark.createDataFrame([("u", "old", 1), ("u", "new", 2), ("w", "x", 1)], "url string, html string, at int")
    got = {r["feed_pos"]: r["html"] for r in item_page_join(items, pages, landed="at").collect()}
    assert got == {1: "new", 2: None, 3: None}
    assert item_page_join(items, pages).count() == 3


def test_nested_parts_are_dropped_whole(one):
    table = {
        "a<table>b<table>c</table>d</table>e": "ae",
        "a<TABLE x='1'>b<nav>c</nav></table >e": "ae",
        "a<table>b": "ab",
        "a</table>b": "ab",
        "a<table>b<table>c</table>d": "abd",
        "<nav>x<table>y</nav>z</table>w": "zw",
        "<header>h</header><tablet>t</tablet>": "ht",
        "<footer>" * 60 + "x" + "</footer>" * 60 + "y": "y",
        "": "",
    }
    assert one(html.main_text, list(table)) == list(table.values())


def test_references_are_resolved_once(one):
    table = {
        "&#38;lt;b&#38;gt;": "&lt;b&gt;",
        "&amp;amp; &#38;amp;": "&amp; &amp;",
        "&eacute;&trade;&apos;&nbsp;x": "\u00e9\u2122'\xa0x",
        "&#x1F600;&#128512;": "\U0001f600\U0001f600",
        "&#55296; &#0; &#9999999; &nosuch; & &; &amp": "&#55296; &#0; &#9999999; &nosuch; & &; &amp",
        "&&lt;&": "&<&",
    }
    assert one(html.decode_references, list(table)) == list(table.values())
