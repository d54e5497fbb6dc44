"""Scoring: formula, providers, the embedding table, items that cannot be scored."""

import hashlib
import math
from decimal import Decimal

import pytest

from linkscore.operators import providers
from linkscore.operators.links import extract_links, link_items, with_keywords
from linkscore.operators.score import score_links, score_text, unscored


def brute_similarity(a, b):
    a, b = a.lower().split(), b.lower().split()
    dot = sum(a.count(t) * b.count(t) for t in set(a))
    norms = math.sqrt(sum(a.count(t) ** 2 for t in set(a)) * sum(b.count(t) ** 2 for t in set(b)))
    return dot / norms if norms else 0.0


def brute_score(text, keyword, similarity=brute_similarity):
    squash = lambda s: 1 / (1 + math.exp(-8 * s))
    lowered, keyword = text.lower(), keyword.lower()
    exact = 1.0 if keyword in lowered else 0.0
    words, context = lowered.split(), 0.0
    for i, word in enumerate(words):
        if word == keyword:
            context = squash(similarity(" ".join(words[max(0, i - 3) : i + 4]), keyword))
    total = 0.5 * exact + 0.3 * squash(similarity(text, keyword)) + 0.2 * context
    return 1 / (1 + math.exp(-10 * (total - 0.6)))


TEXTS = [
    "Python, rocks", "python rocks and Python is python", "a b c d kw e f g h", "", "   ",
    "kw kw kw", "machine learning with machine", "Kw at the start and kw at the end kw",
]
KEYWORDS = ["python", "KW", "", "machine learning", "z"]


def test_scores_against_brute_force(spark):
    pairs = [(t, k) for t in TEXTS for k in KEYWORDS]
    table = spark.createDataFrame(pairs, "processed_text string, keyword string")
    scored = score_text(table).collect()
    assert len(scored) == len(pairs)
    for r in scored:
        assert r.score == pytest.approx(brute_score(r.processed_text, r.keyword)), r
        assert 0 < r.score < 1
        assert (r.exact == 1) == (r.score >= 0.269138)


def test_a_later_filter_does_not_repeat_the_computation(spark):
    table = spark.createDataFrame([("a b", "a")], "processed_text string, keyword string")
    plan = score_text(table).filter("score > 0.5 and exact = 1")._jdf.queryExecution()
    assert plan.optimizedPlan().toString().count("sort_array") == 4


def items(spark, *rows):
    columns = (
        "page_id bigint, link_pos int, seq decimal(38,0), href string, keyword string, "
        "source_url string, processed_text string"
    )
    return spark.createDataFrame([(i, 1, Decimal(i), *r) for i, r in enumerate(rows)], columns)


def test_unscorable_items_pass_through(spark):
    table = items(
        spark,
        ("/a", "K", "http://s", "k"),
        ("/a", None, "http://s", "k"),
        ("/a", "k", None, "k"),
        ("http://t", "k", None, "k"),
        (None, "k", "http://s", "k"),
        ("/a", "k", "http://s", None),
    )
    scored = score_links(table)
    assert scored.count() == 6
    assert sorted(r.page_id for r in unscored(scored).collect()) == [1, 2, 4, 5]
    done = {r.page_id: r.relevance_analysis for r in scored.collect() if r.relevance_analysis}
    assert (done[0].keyword, done[0].href_url) == ("k", "http://s/a")
    assert (done[3].source_url, done[3].href_url) == (None, "http://t")


def letter_encoder():
    """Loader of a stand-in for a sentence model (counts of four letters)."""
    return lambda: lambda texts: [[float(t.count(c)) + 0.5 for c in "aeko"] for t in texts]


def letter_cosine(a, b):
    a, b = letter_encoder()()([a, b])
    dot = sum(x * y for x, y in zip(a, b))
    return dot / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))


@pytest.mark.parametrize("hot_rows", [1_000_000, 2])
def test_vector_scores_use_the_same_formula(spark, hot_rows):
    """Also with keys treated as hot: the same pair many times over."""
    texts = ["one kw two", "koala", "kw kw", "nothing"] + ["koala"] * 20
    table = spark.createDataFrame([(t, "kw") for t in texts], "processed_text string, keyword string")
    windows = score_text(table).select("context_text")
    needed = providers.distinct_texts(
        table.select("processed_text").union(table.select("keyword")).union(windows),
        "processed_text",
    )
    empty = spark.createDataFrame([], "text_key string, vec array<float>")
    vectors = providers.refresh_embeddings(needed, empty, letter_encoder()).cache()
    assert vectors.count() == vectors.select("text_key").distinct().count()
    provider = providers.VectorSimilarity(vectors, hot_rows=hot_rows)
    scored = score_text(table, similarity=provider).collect()
    assert sorted(r.processed_text for r in scored) == sorted(texts)
    for r in scored:
        wanted = brute_score(r.processed_text, "kw", letter_cosine)
        assert r.score == pytest.approx(wanted, abs=1e-6)


def test_a_text_without_vector_is_not_scored(spark):
    table = spark.createDataFrame([("a", "k")], "processed_text string, keyword string")
    empty = spark.createDataFrame([], "text_key string, vec array<float>")
    scored = score_text(table, similarity=providers.VectorSimilarity(empty))
    assert [r.score for r in scored.collect()] == [None]


def test_only_missing_texts_are_encoded(spark):
    texts = spark.createDataFrame([("a",), ("b",), ("b",), (None,), ("ü",)], "t string")
    wanted = providers.distinct_texts(texts, "t")
    keys = {t: hashlib.md5(t.encode()).hexdigest() for t in ("a", "b", "ü")}
    assert {r.text: r.text_key for r in wanted.collect()} == keys
    cached = spark.createDataFrame([(keys["a"], [1.0])], "text_key string, vec array<float>")
    assert {r.text for r in providers.missing_texts(wanted, cached).collect()} == {"b", "ü"}
    table = providers.refresh_embeddings(wanted, cached, letter_encoder())
    found = {r.text_key: list(r.vec) for r in table.collect()}
    assert found[keys["a"]] == [1.0] and set(found) == set(keys.values())


def test_sentence_model_is_optional():
    try:
        import sentence_transformers  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="sentence_transformers"):
            providers.sentence_model_encoder()


def test_links_are_scored_per_keyword(make_pages):
    page = make_pages("<p>about python</p><a href='/py'>python docs</a><a href='/z'>z</a>")
    links = link_items(with_keywords(extract_links(page, ("",)), ["Python", "zebra"]))
    scored = score_links(links).collect()
    for r in scored:
        assert r.relevance_analysis.score == pytest.approx(brute_score(r.processed_text, r.keyword))
    assert {r.relevance_analysis.keyword for r in scored} == {"python", "zebra"}
