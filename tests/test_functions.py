"""Column expressions against fixed cases and against Python's own string and URL functions."""

import math
from urllib.parse import urlparse

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkscore.functions import similarity as sim
from linkscore.functions import text as tx
from linkscore.functions import urls as ux

ODD_SPACES = " \t\n\x0b\x0c\r\x1c\x1f\x85\xa0   　"


def evaluate(spark, values, *columns, ddl="x string"):
    rows = [v if isinstance(v, tuple) else (v,) for v in values]
    result = spark.createDataFrame(rows, ddl).coalesce(1).select(*columns).collect()
    return [r[0] if len(columns) == 1 else tuple(r) for r in result]


@pytest.mark.parametrize(
    ("text", "cleaned"),
    [
        (None, None),
        ("", None),
        ("  ", ""),
        ("　\x1c", ""),
        (" Click Here ", None),
        ("READ MORE", None),
        ("More information...", None),
        ("More information", "More information"),
        ("Please turn JavaScript on now", None),
        ("JavaScript is not essential here", None),
        ("Interaction with the content will be limited.", None),
        ("\xa0a  b ", "a  b"),
    ],
)
def test_clean_text(spark, text, cleaned):
    assert evaluate(spark, [text], tx.clean_text(F.col("x"))) == [cleaned]


WORDS = st.lists(
    st.tuples(st.text("aBcÄ,.", max_size=4), st.text(ODD_SPACES, max_size=2)), max_size=8
).map(lambda parts: "".join(a + b for a, b in parts))


@settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(WORDS, min_size=20, max_size=40))
def test_tokens_are_those_of_python(spark, texts):
    assert evaluate(spark, texts, tx.tokens(F.col("x"))) == [t.lower().split() for t in texts]


def test_context_window_takes_the_last_hit_and_clips(spark):
    tokens = tx.tokens(F.col("x"))
    window = tx.context_window(tokens, F.lit("kw"))
    cases = {
        "a b c d kw e f g h": "b c d kw e f g",
        "kw": "kw",
        "kw a": "kw a",
        "a b c d e KW": "c d e kw",
        "kw 1 2 3 4 5 6 7 kw 8": "5 6 7 kw 8",
        "kw, rocks": None,
        "": None,
        None: None,
    }
    assert evaluate(spark, list(cases), window) == list(cases.values())
    hits = tx.keyword_positions(tokens, F.lit("kw"))
    assert evaluate(spark, ["kw a KW b"], hits) == [[0, 2]]


URLS = [
    "https://www.x.org:80/Home/page-one",
    "http://a.com/p",
    "http://a.commerce.org/index/Default/x-y//z",
    "mailto:a@b.com",
    "javascript:void(0)",
    "#top",
    "",
    "/x;p=1/y;q=2?z#f",
    "http://u:p@WWW.Host.COM/a;b/c",
    "  \x01http://a\tb.com/\np q",
    "//cdn.x.com/lib",
    "http://[::1]:8080/v6",
    "ftp://h/a;type=i",
    "about:a;b",
    "1http://x/y",
    "a/b:c",
    "http://h?q=/a-b",
    "?only=query",
]
BROKEN_URLS = ["http://[::1/x", "http://a]b/", "http://[nothost]/", "http://a／b/x"]


def python_domain(url):
    domain = urlparse(url).netloc.lower()
    for affix in ("www.", ".com", ".org"):
        domain = domain.replace(affix, "")
    return domain or None


def python_words(url):
    words = urlparse(url).path.replace("-", "/").split("/")
    return [w for w in words if w and w.lower() not in ("index", "home", "page", "default")]


def test_url_parts_are_those_of_python(spark):
    x = F.col("x")
    got = evaluate(
        spark, URLS, ux.url_netloc(x), ux.url_path(x), ux.domain_component(x), ux.path_words(x),
        ux.is_splittable(x),
    )
    wanted = [
        (urlparse(u).netloc, urlparse(u).path, python_domain(u), python_words(u), True)
        for u in URLS
    ]
    assert got == wanted


def test_malformed_urls(spark):
    for url in BROKEN_URLS:
        with pytest.raises(ValueError):
            urlparse(url)
    assert evaluate(spark, BROKEN_URLS, ux.is_splittable(F.col("x"))) == [False] * 4
    assert evaluate(spark, BROKEN_URLS, ux.url_tokens(F.col("x"))) == [[u] for u in BROKEN_URLS]


def test_url_tokens(spark):
    cases = {"http://a.b.com/x//y": ["a", "b", "com", "x", "y"], "/x/Index": ["x", "Index"], "": []}
    assert evaluate(spark, list(cases), ux.url_tokens(F.col("x"))) == list(cases.values())


def test_resolve_href_is_plain_concatenation(spark):
    cases = [
        ("http://s/", "/x", "http://s//x"),
        ("http://s/", "/http-guide", "/http-guide"),
        (None, "/x", None),
        (None, "http://y", "http://y"),
        ("http://s/", None, None),
    ]
    got = evaluate(
        spark, [c[:2] for c in cases], ux.resolve_href(F.col("s"), F.col("h")),
        ddl="s string, h string",
    )
    assert got == [c[2] for c in cases]


def test_exact_match_is_substring_ignoring_case(spark):
    cases = [("Python, rocks", "python", 1.0), ("abc", "", 1.0), ("abc", "d", 0.0), (None, "a", None)]
    got = evaluate(
        spark, [c[:2] for c in cases], sim.exact_match(F.col("t"), F.col("k")),
        ddl="t string, k string",
    )
    assert got == [c[2] for c in cases]


def test_cosine(spark):
    cases = [
        ([1.0, 0.0], [1.0, 0.0], 1.0),
        ([1.0, 0.0], [-2.0, 0.0], -1.0),
        ([1.0, 1.0], [1.0, 0.0], 1 / math.sqrt(2)),
        ([0.0, 0.0], [1.0, 0.0], 0.0),
        (None, [1.0, 0.0], None),
    ]
    got = evaluate(
        spark, [c[:2] for c in cases], sim.cosine(F.col("a"), F.col("b")),
        ddl="a array<float>, b array<float>",
    )
    assert got == [None if c[2] is None else pytest.approx(c[2]) for c in cases]


def brute_term_cosine(text, keyword):
    a, b = text.lower().split(), keyword.lower().split()
    dot = sum(a.count(t) * b.count(t) for t in set(a))
    norms = math.sqrt(sum(a.count(t) ** 2 for t in set(a))) * math.sqrt(
        sum(b.count(t) ** 2 for t in set(b))
    )
    return dot / norms if norms else 0.0


def test_term_cosine_against_counting(spark):
    texts = ["a b a c", "A a A", "x", "", "b b c c c d", "the of the"]
    keywords = ["a", "a b a", "", "c d", "The of"]
    pairs = [(t, k) for t in texts for k in keywords]
    got = evaluate(
        spark, pairs, sim.term_cosine(tx.tokens(F.col("t")), tx.tokens(F.col("k"))),
        ddl="t string, k string",
    )
    assert got == [pytest.approx(brute_term_cosine(*p)) for p in pairs]


@pytest.mark.parametrize(
    ("exact", "text_sim", "window_sim", "score"),
    [
        (0, -1, None, 0.002475),
        (0, 0, None, 0.010987),
        (0, 1, None, 0.047380),
        (1, -1, None, 0.269139),
        (1, 0, None, 0.622459),
        (1, 0, 0, 0.817574),
        (1, 1, None, 0.880691),
        (1, 0.5, 0.5, 0.980355),
        (1, 1, 1, 0.981984),
    ],
)
def test_golden_scores(spark, exact, text_sim, window_sim, score):
    context = F.lit(0.0) if window_sim is None else sim.squash(F.lit(float(window_sim)))
    value = sim.final_squash(
        sim.weighted_score(F.lit(float(exact)), sim.squash(F.lit(float(text_sim))), context)
    )
    assert spark.range(1).select(value).first()[0] == pytest.approx(score, abs=1e-6)
