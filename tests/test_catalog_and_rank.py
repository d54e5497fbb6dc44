"""Catalog, ranking, and the joins and numbering that must hold for hot keys."""

from decimal import ROUND_HALF_UP, Decimal

import json
import random

import pytest
from pyspark.sql import functions as F

from linkscore.operators import catalog, rank, skew
from linkscore.operators.links import extract_links, link_items, with_keywords
from linkscore.operators.score import score_links

ROW = "keyword string, source_url string, href_url string, relevance_score double"


def scored_items(spark, *rows):
    """Items from (keyword, source_url, href_url, score), in arrival order."""
    table = spark.createDataFrame(
        [(Decimal(i), *r) for i, r in enumerate(rows)],
        "seq decimal(38,0), k string, s string, h string, score double",
    )
    record = F.struct(
        F.col("k").alias("keyword"), F.col("s").alias("source_url"),
        F.col("h").alias("href_url"), "score",
    )
    return table.select("seq", record.alias("relevance_analysis"))


def test_rows_carry_the_whole_item(make_pages):
    page = make_pages("<title>T</title><a href='/x' title='&quot;q&quot;'>x</a>")
    items = score_links(link_items(with_keywords(extract_links(page, ("",)), ["X"])))
    row = catalog.catalog_rows(items).first()
    assert (row.keyword, row.source_url, row.href_url) == ("x", "http://s/", "http://s//x")
    assert row.processed_date is not None
    raw = json.loads(row.raw_data)
    assert raw["title"] == '"q"' and raw["metadata"] == {"title": "T"}
    assert raw["relevance_analysis"]["score"] == pytest.approx(row.relevance_score)


def test_id_tells_null_from_empty_and_depends_on_the_key_only(spark):
    keys = [("k", None, "h"), ("k", "", "h"), ("k", "s", "h"), ("ks", "", "h"), ("k", "s", "h")]
    table = spark.createDataFrame([(*k, 1.0) for k in keys], ROW)
    ids = [r[0] for r in table.select(catalog.row_id()).collect()]
    assert len(set(ids)) == 4 and ids[2] == ids[4]


def brute_upsert(existing, batch):
    state = {r[:3]: r[3] for r in existing}
    for r in batch:
        state[r[:3]] = r[3]
    return state


def test_upsert(spark):
    existing = [("k", "s", "a", 1.0), ("k", "s", "b", 2.0), ("k", None, "a", 3.0)]
    batch = [("k", "s", "a", 4.0), ("k", "s", "c", 5.0), ("k", "s", "a", 6.0), ("k", None, "a", 7.0)]
    table = spark.createDataFrame(existing, ROW)
    incoming = spark.createDataFrame(
        [(*r, Decimal(i)) for i, r in enumerate(batch)], ROW + ", seq decimal(38,0)"
    )
    once = catalog.upsert(table, incoming)
    twice = catalog.upsert(once, incoming)
    for result in (once, twice):
        assert {tuple(r)[:3]: r[3] for r in result.collect()} == brute_upsert(existing, batch)
        assert result.count() == 4


def test_stored_batches_resolve_to_the_newest_row(spark, tmp_path):
    path = str(tmp_path / "catalog")
    first = catalog.catalog_rows(
        scored_items(spark, ("k", "s", "a", 0.1), ("k", "s", "b", 0.2), ("k", "s", "a", 0.3))
    )
    second = catalog.catalog_rows(scored_items(spark, ("k", "s", "b", 0.4), ("l", "s", "b", 0.5)))
    catalog.append_batch(first, path, 0)
    catalog.append_batch(second, path, 1)
    catalog.append_batch(second, path, 1)  # a retried batch replaces itself

    def state(table):
        return {(r.keyword, r.href_url): r.relevance_score for r in table.collect()}

    newest = {("k", "a"): 0.3, ("k", "b"): 0.4, ("l", "b"): 0.5}
    stored = catalog.stored(spark, path)
    assert stored.count() == 4
    assert state(catalog.current(stored)) == newest
    assert state(catalog.current(stored, keyword="l")) == {("l", "b"): 0.5}
    narrow = catalog.current(stored, columns=("keyword", "href_url", "relevance_score"))
    assert state(narrow) == newest
    assert "raw_data" not in narrow._jdf.queryExecution().executedPlan().toString()
    plan = catalog.current(stored, keyword="l")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(keyword,l)" in plan

    target = str(tmp_path / "compacted")
    catalog.compact(spark, path, target)
    assert catalog.stored(spark, target).count() == 3
    assert state(catalog.current(catalog.stored(spark, target))) == newest


@pytest.fixture
def small_catalog(spark):
    rows = [
        ("1", "python", "s1", "h1", 1.0, "{}"), ("2", "python", "s1", "h2", None, "{}"),
        ("3", "python", "s2", "h1", 2.0, "{}"), ("4", "java", "s1", "h1", 3.0, "{}"),
    ]
    return spark.createDataFrame(
        rows, "id string, keyword string, source_url string, href_url string, "
        "relevance_score double, raw_data string",
    )


@pytest.mark.parametrize(
    ("filters", "ids"),
    [
        ({"keyword": "python"}, ["2", "3", "1"]),  # null scores first
        ({"keyword": "Python"}, []),
        ({"source_url": "s1"}, ["2", "4", "1"]),
        ({"keyword": "python", "source_url": "s1"}, ["2", "1"]),
        ({}, ["2", "4", "3", "1"]),
        ({"keyword": "", "source_url": None}, ["2", "4", "3", "1"]),
    ],
)
def test_queries(small_catalog, filters, ids):
    found = catalog.query(small_catalog, **filters)
    assert [r.id for r in found.collect()] == ids
    assert found.columns == list(catalog.RESULT_COLUMNS)
    assert catalog.result_count(small_catalog, **filters).first()[0] == len(ids)


def test_href_lookup(small_catalog):
    assert [tuple(r) for r in catalog.by_href(small_catalog, "h1").collect()] == [
        ("h1", "s1", "java", 3.0)
    ]
    assert catalog.by_href(small_catalog, "nowhere").count() == 0
    for missing in (None, ""):
        with pytest.raises(ValueError):
            catalog.by_href(small_catalog, missing)


def test_best_and_ranked(spark):
    items = scored_items(
        spark, ("k", "s", "u1", 0.2), ("k", "s", "u2", 0.9), ("k", "s", "u1", 0.9),
        ("k", "s", None, None), ("k", "t", "u1", 0.5),
    )
    none = items.limit(1).withColumn("relevance_analysis", F.lit(None))
    ranked = rank.rank_links(rank.best_links(items.union(none))).orderBy("source_url", "rank")
    assert [(r.source_url, r.rank, r.href_url, r.score) for r in ranked.collect()] == [
        ("s", 1, "u1", 0.9), ("s", 2, "u2", 0.9), ("s", 3, "", 0.0), ("t", 1, "u1", 0.5)
    ]


def skewed_best(spark, n=900):
    """One target has a third of the rows or more, with many equal scores."""
    draw = random.Random(3)
    rows = []
    for i in range(n):
        source = draw.choice(["hot", None]) if draw.random() < 0.5 else f"s{draw.randrange(40)}"
        rows.append((source, "k", f"h{i}", draw.choice([0.1, 0.1, 0.5, draw.random()]), Decimal(i)))
    table = spark.createDataFrame(
        rows, "source_url string, keyword string, href_url string, score double, "
        "first_seq decimal(38,0)",
    )
    wanted = {}
    for source in {r[0] for r in rows}:  # null is a source like any other
        own = sorted((r for r in rows if r[0] == source), key=lambda r: (-r[3], r[4]))
        wanted.update({(source, r[2]): i + 1 for i, r in enumerate(own)})
    return table.repartition(4), wanted


def ranks(table):
    return {(r.source_url, r.href_url): r["rank"] for r in table.collect()}


@pytest.mark.parametrize("hot_rows", [1_000_000, 100, 0])
def test_ranking_of_a_hot_target(spark, monkeypatch, hot_rows):
    table, wanted = skewed_best(spark)
    assert ranks(rank.rank_links(table, hot_rows)) == wanted
    monkeypatch.setattr(skew, "MAX_LARGE_GROUPS", 0)
    assert ranks(rank.rank_links(table, hot_rows)) == wanted


def test_top_links_are_the_first_ranks(spark):
    table, wanted = skewed_best(spark)
    assert ranks(rank.top_links(table, 5, salts=3)) == {k: n for k, n in wanted.items() if n <= 5}


def test_results_are_whole_whatever_the_chunk(spark):
    table, wanted = skewed_best(spark)
    ranked = rank.rank_links(table)
    for per_chunk in (7, 1000):
        rows = rank.scrape_results(ranked, per_chunk).orderBy("source_url", "chunk").collect()
        assert all(len(r.results) <= per_chunk for r in rows)
        for source in {k[0] for k in wanted}:
            own = [r for r in rows if r.source_url == source]
            urls = [e.url for r in own for e in r.results]
            assert urls == [h for s, h in sorted(wanted, key=wanted.get) if s == source]
            assert {r["count"] for r in own} == {len(urls)}
            assert [r.chunk for r in own] == list(range(len(own)))


def test_percentage(spark):
    fixed = {0.981984: "98.2%", 0.5: "50.0%", 0.0: "0.0%", 0.8885: "88.8%", 0.0015: "0.1%", 0.0025: "0.3%", 1.0: "100.0%", 0.99996: "100.0%"}
    scores = [*fixed, *(k / 20000 for k in range(0, 20000, 7))]
    table = spark.createDataFrame([(s,) for s in scores], "s double")
    shown = {r[0]: r[1] for r in table.select("s", rank.percentage(F.col("s"))).collect()}
    for s in scores:
        exact = Decimal(s * 100).quantize(Decimal("0.1"), ROUND_HALF_UP)
        assert shown[s] == f"{exact}%" and fixed.get(s, shown[s]) == shown[s]


def test_writers_do_not_replace_each_other(spark, tmp_path):
    path = str(tmp_path / "catalog")

    def rows(score, *hrefs):
        table = spark.createDataFrame([(h, score, i) for i, h in enumerate(hrefs)], "href_url string, relevance_score double, seq int")
        return table.select(
            F.lit("i").alias("id"), F.lit("k").alias("keyword"),
            F.lit("s").alias("source_url"), "href_url", "relevance_score", F.lit("{}").alias("raw_data"),
            F.current_timestamp().alias("processed_date"), F.col("seq").cast("decimal(38,0)").alias("seq"),
        )

    catalog.append_batch(rows(0.1, "a", "b"), path, 7, "one")
    catalog.append_batch(rows(0.2, "b", "c"), path, 0, "two")
    catalog.append_batch(rows(0.1, "a", "b"), path, 7, "one")  # again: keeps its place in time
    catalog.append_batch(rows(0.3, "d"), path, 7, "two")

    def scores(folder):
        return {r["href_url"]: r["relevance_score"] for r in catalog.current(catalog.stored(spark, folder)).collect()}

    assert scores(path) == {"a": 0.1, "b": 0.2, "c": 0.2, "d": 0.3}
    catalog.compact(spark, path, str(tmp_path / "new"))
    assert scores(str(tmp_path / "new")) == scores(path)


def hot_left(spark):
    keys = ["hot"] * 200 + [f"k{i % 50}" for i in range(300)] + [None, "nowhere"]
    return spark.createDataFrame(list(enumerate(keys)), "i int, key string").repartition(4)


@pytest.mark.parametrize("least", [1_000_000, 100, 1])
def test_lookup_join(spark, least):
    right = spark.createDataFrame(
        [("hot", -1)] + [(f"k{i}", i) for i in range(50)], "key string, value int"
    )
    left = hot_left(spark)
    joined = skew.lookup_join(left, right, "key", least)
    assert sorted(map(tuple, joined.select("i", "value").collect()), key=str) == sorted(
        map(tuple, left.join(right, "key", "left").select("i", "value").collect()), key=str
    )


def test_hot_keys_are_dealt_out_evenly(spark, tmp_path):
    """5,000 frequent keys and one with a third of all rows: no task has twice the median."""
    rows = spark.range(300_000)
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5_000))
    rows.select("id", key.alias("key")).write.parquet(str(tmp_path / "left"))
    left = spark.read.parquet(str(tmp_path / "left"))
    right = left.select("key").distinct().withColumn("value", F.length("key"))
    kept = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in kept}
    try:
        for k, v in kept.items():
            spark.conf.set(k, v)
        dealt = skew.pieces(left.select("key"), ["key"], least=10)
        assert dealt.count() <= skew.PIECES_PER_TASK * 16
        joined = skew.lookup_join(left, right, "key", least=10)
        tasks = joined.groupBy(F.spark_partition_id().alias("task")).agg(F.count("value").alias("n"))
        sizes = sorted(r["n"] for r in tasks.collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 300_000 and len(sizes) == 16
    assert sizes[-1] <= 2 * sizes[8]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join(spark, how):
    right = spark.createDataFrame(
        [("hot", -1), ("hot", -2)] + [(f"k{i}", i) for i in range(40)], "key string, value int"
    )
    left = hot_left(spark)
    salted = skew.salted_join(left, right, ["key"], F.col("i"), how, salts=5)
    assert sorted(map(tuple, salted.select("i", "value").collect()), key=str) == sorted(
        map(tuple, left.join(right, "key", how).select("i", "value").collect()), key=str
    )
