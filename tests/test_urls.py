from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from newsflow.functions import urls

QUIET = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
SCHEMES = st.sampled_from(["http", "HTTPS", "ftp", "mailto", "x"])
WORDS = st.text(alphabet="aZ9._~*-+%20 é", max_size=6)
NAMES = st.one_of(WORDS, st.sampled_from(["utm_x", "UTM_y", "fbclid", "GCLID", "mc_cid", "mc_eid", "ref"]))
PAIRS = st.lists(st.tuples(NAMES, st.one_of(st.none(), WORDS)), max_size=4).map(
    lambda ps: "&".join(n if v is None else f"{n}={v}" for n, v in ps)
)


@st.composite
def addresses(draw):
    scheme = draw(SCHEMES)
    host = draw(st.sampled_from(["//Ex.COM", "//a.b:80", "", "//u@H"]))
    path = draw(st.sampled_from(["", "/", "/A/b///", "/x%20y", "/a;b"]))
    query = draw(PAIRS)
    tail = draw(st.sampled_from(["", "#f", "#f?a=1"]))
    blank = draw(st.sampled_from(["", " ", "　"]))
    return f"{blank}{scheme}:{host}{path}{'?' + query if query else ''}{tail}{blank}"


TRACKED = ["utm_source=n", "UTM_Medium=2", "fbclid=1", "GCLID=x", "mc_cid=7", "mc_eid=8"]


@QUIET
@given(st.lists(addresses(), min_size=80, max_size=80))
def test_normalize_url_properties(one, values):
    got = one(urls.normalize_url, values)
    assert one(urls.normalize_url, got) == got
    for value in got:
        assert "#" not in value and value == value.strip()
        assert not any(name in value.lower() for name in ("utm_", "fbclid=", "gclid=", "mc_cid=", "mc_eid="))


def test_tracking_parameters_change_nothing(one):
    plain = ["http://a.b/c?x=1&y=2", "https://h/p?q=s", "http://k/?a=1&a=2"]
    for extra in TRACKED:
        assert one(urls.normalize_url, [f"{u}&{extra}" for u in plain]) == plain
        assert one(urls.normalize_url, [u.replace("?", f"?{extra}&") for u in plain]) == plain


def test_normalize_url_fixtures(one):
    cases = {
        "HTTP://Ex.COM/A/b///?utm_source=x&b=1+2&c=&d&fbclid=9&UTM_X=1&z=%zz&t=~*#f": "http://ex.com/A/b?b=1+2&c=&d=&z=%25zz&t=~%2A",
        "https://a.org": "https://a.org/",
        "": "",
        None: "",
        "a/b": "a/b",
        " https://News.Example/Story/ ": "https://news.example/Story",
        "http://h.x:8080/p//?b=2&a=1#top": "http://h.x:8080/p?b=2&a=1",
        "http://h.x?only=": "http://h.x/?only=",
        "FTP://User@Host/File": "ftp://user@host/File",
        "https://h.x/p?q=two%20words&r=%C3%A9": "https://h.x/p?q=two+words&r=%C3%A9",
    }
    assert one(urls.normalize_url, list(cases)) == list(cases.values())


def test_article_keys(spark):
    frame = spark.createDataFrame([(" g ", "http://A.b"), (None, ""), ("", "http://x/?utm_a=1")], "g string, u string")
    got = [r[0] for r in frame.select(urls.article_keys(F.col("g"), F.col("u"))).collect()]
    assert got == [["guid:g", "url:http://a.b/"], [], ["url:http://x/"]]
