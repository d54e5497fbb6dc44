"""Page errors, robots rules, targets, queues and whole runs."""

import random
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from linkscore.operators import catalog, rank
from linkscore.operators.links import extract_links, link_items, with_keywords
from linkscore.operators.score import score_links
from linkscore.plans import queries, runs
from linkscore.schemas import SCORED_ITEM
from linkscore.sources import robots, targets
from linkscore.sources.pages import page_errors, read_page_stream, read_pages, valid_pages
from linkscore.streaming import queue


def test_page_errors(spark):
    rows = [(1, "http://a", "x"), (2, "", "x"), (3, None, None), (4, "http://b", ""), (5, "c", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert [r.page_id for r in valid_pages(pages).collect()] == [1]
    empty = "Nothing was received from "
    assert sorted(map(tuple, page_errors(pages).collect()), key=str) == sorted(
        [
            ("missing_url", "A page has no URL", None),
            ("missing_url", "A page has no URL", None),
            ("empty_response", empty + "http://b", "http://b"),
            ("empty_response", empty + "c", "c"),
        ],
        key=str,
    )


ROBOTS_FILES = [
    "User-agent: *\nAllow: /a/b\nDisallow: /a\n",
    "User-agent: *\nDisallow: /a\nAllow: /a/b\n",
    "User-agent: *\nDisallow:\n",
    "User-agent: *\nDisallow: /\n\nUser-agent: Mozilla\nDisallow: /a\n",
    "User-agent: moz\nDisallow: /a/b\n\nUser-agent: *\nDisallow: /",
    "User-agent: other\nUser-agent: MOZILLA # both\nDisallow: /a # comment\n",
    "User-agent: other\nDisallow: /\nUser-agent: *\nDisallow: /c\n",
    "Disallow: /\n\nUser-agent: *\n\nDisallow: /a\n",
    "User-agent: mozilla\nCrawl-delay: 5\nUser-agent: *\nDisallow: /\n",
    "User-agent: mozilla\n\nUser-agent: *\nDisallow: /a\n\nUser-agent: *\nDisallow: /c\n",
    "User-agent: mozilla\nSitemap: http://x\nUser-agent: b\nDisallow: /c\n",
    "USER-AGENT : *\r\n disallow : /%61/b\r\n",
    "User-agent: *\n# no blank line here\nDisallow: /a/b?q=1\nDisallow: /c d\n",
    "User-agent: *\nUser-agent: mozilla\nDisallow: /\n\nUser-agent: mozilla\nDisallow: /c\n",
    "nonsense\n: x\nUser-agent\n",
    "",
]
ROBOTS_PATHS = ["", "/", "/a", "/a/b", "/a/b/c", "/ab", "/c", "/c%20d", "/a/b?q=12", "/a/b#f", "/A"]


@pytest.mark.parametrize("small", [True, False])
def test_robots_decisions_are_those_of_the_standard_library(spark, small):
    files = [(f"h{i}", text) for i, text in enumerate(ROBOTS_FILES)]
    urls = [f"http://H{i}{path}" for i in range(len(files) + 1) for path in ROBOTS_PATHS]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    rules = robots.agent_rules(spark.createDataFrame(files, "host string, robots_txt string"))
    decided = {r.url: r.allowed for r in robots.with_decision(pages, rules, small).collect()}
    assert len(decided) == len(urls)
    for i, text in enumerate([*ROBOTS_FILES, ""]):
        parser = RobotFileParser()
        parser.parse(text.splitlines())
        for path in ROBOTS_PATHS:
            url = f"http://H{i}{path}"
            assert decided[url] == parser.can_fetch(robots.USER_AGENT, url), (text, url)


def test_robots_errors_and_size_check(spark, monkeypatch):
    files = spark.createDataFrame([("h", "User-agent: *\nDisallow: /x")], "host string, robots_txt string")
    rules = robots.agent_rules(files)
    pages = spark.createDataFrame([(1, "http://h/x"), (2, "http://h/y")], "page_id bigint, url string")
    errors = robots.robots_errors(robots.with_decision(pages, rules)).collect()
    assert [(r.error, r.url) for r in errors] == [("robots_txt_error", "http://h/x")]
    assert robots.rules_are_small(rules)
    monkeypatch.setattr(robots, "MAX_BROADCAST_CHARS", 3)
    assert not robots.rules_are_small(rules)


PAGE = "<body><p>about {0}</p><a href='/{0}'>{0} docs</a><div><a href='/x'>x</a></div></body>"


def sample_pages(spark):
    words = ["python", "java", "rust", "python", "go"]
    rows = [(i, f"http://h{i % 2}/{w}{i}", PAGE.format(w)) for i, w in enumerate(words)]
    rows += [(8, "http://h0/empty", ""), (9, "http://h0/none", "<p>no link</p>")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def analyses(items):
    return sorted(
        (tuple(r.relevance_analysis) for r in items.collect() if r.relevance_analysis), key=str
    )


@pytest.mark.parametrize("limits", [{}, {"chars": -1, "urls": 0}])
def test_run_gives_the_same_with_small_and_large_side_tables(spark, monkeypatch, limits):
    """Targets, robots rules and containers; once broadcast, once with everything shuffled."""
    if limits:
        monkeypatch.setattr(robots, "MAX_BROADCAST_CHARS", limits["chars"])
        monkeypatch.setattr(targets, "MAX_BROADCAST_URLS", limits["urls"])
    wanted = [
        ("http://h0/python0", "Python", None), ("http://h0/python0", "zebra", "div"),
        ("http://h1/java1", "java", "body"), ("http://h0/rust2", "rust", "body"),
        ("http://h0/empty", "k", None), ("http://h0/none", "k", None), ("http://nowhere", "k", None),
        (None, "k", None), ("http://h1/python3", "k", "div > a"),
    ]
    table = spark.createDataFrame(wanted, "url string, keyword string, container string")
    files = spark.createDataFrame(
        [("h0", "User-agent: *\nDisallow: /rust")], "host string, robots_txt string"
    )
    outcome = runs.run(sample_pages(spark), table, files, containers=("body", "div"))
    found = {(r[0], r[1], r[2]) for r in analyses(outcome.items)}
    assert found == {
        ("python", "http://h0/python0", "http://h0/python0/python"),
        ("python", "http://h0/python0", "http://h0/python0/x"),
        ("zebra", "http://h0/python0", "http://h0/python0/x"),
        ("java", "http://h1/java1", "http://h1/java1/java"),
        ("java", "http://h1/java1", "http://h1/java1/x"),
    }
    errors = {(r.error, r.url) for r in outcome.errors.collect()}
    assert {
        ("missing_url", None), ("unsupported_selector", "http://h1/python3"),
        ("empty_response", "http://h0/empty"), ("robots_txt_error", "http://h0/rust2"),
        ("fetch_failed", "http://nowhere"),
    } == errors


def test_stored_run_can_be_queried(spark, tmp_path):
    pages = sample_pages(spark)
    table = pages.select("url").withColumn("keyword", F.lit("Python"))
    path = str(tmp_path / "catalog")
    runs.store(runs.run(pages, table), path, 0)
    runs.store(runs.run(pages, table), path, 1)
    current = catalog.current(catalog.stored(spark, path))
    assert catalog.result_count(current, keyword="python").first()[0] == 10
    assert catalog.result_count(current, keyword="Python").first()[0] == 0
    best = catalog.query(current, keyword="python").first()
    assert best.href_url.endswith("/python") and best.relevance_score > 0.8


def items_of(spark):
    return link_items(with_keywords(extract_links(sample_pages(spark)), ["Python", "java"]))


def test_messages_round_trip(spark):
    items = items_of(spark)
    back = queue.from_messages(queue.to_messages(items))
    assert back.schema.simpleString() == items.schema.simpleString()
    assert sorted(map(str, back.collect())) == sorted(map(str, items.collect()))


def test_peek_does_not_consume(spark, tmp_path):
    items = items_of(spark)
    assert queue.peek(items).first().href == "/python"
    assert queue.peek(items).first().href == "/python"


def test_stages_give_what_the_batch_run_gives(spark, tmp_path):
    source, scored, store = (str(tmp_path / n) for n in ("items", "scored", "catalog"))
    items = items_of(spark)
    queue.publish(items.filter("keyword = 'Python'").repartition(3), source)

    def run_stages():
        stream = queue.read_queue(spark, source, max_files=1)
        queue.run_stage(stream, score_links, "relevance_analysis", scored, str(tmp_path / "c1"))
        done = queue.read_queue(spark, scored, SCORED_ITEM, from_stage=True)
        queue.run_store_stage(done, store, str(tmp_path / "c2"))

    run_stages()
    half = catalog.current(catalog.stored(spark, store))
    assert half.count() == 10
    # what arrives later is processed by the next run, what was processed is not done again
    queue.publish(items.filter("keyword = 'java'"), source)
    run_stages()
    stored = catalog.stored(spark, store)
    assert stored.count() == 20
    forwarded = queue.stage_items(spark, scored, SCORED_ITEM)
    assert analyses(forwarded) == analyses(score_links(items))
    rows = catalog.last_per_key(catalog.catalog_rows(score_links(items)), "seq")
    key = ("keyword", "source_url", "href_url", "relevance_score")
    assert {tuple(r) for r in catalog.current(stored).select(*key).collect()} == {
        tuple(r) for r in rows.select(*key).collect()
    }


def test_page_stream_gives_the_items_of_the_batch_run(spark, tmp_path):
    landing, output = str(tmp_path / "pages"), str(tmp_path / "items")
    sample_pages(spark).repartition(3).write.parquet(landing)
    stream = read_page_stream(spark, landing, max_files=1)
    queue.run_extract_stage(stream, ["Python", "java"], output, str(tmp_path / "c"))
    items = spark.read.schema(items_of(spark).schema).json(output).drop("writer", "batch_id")
    assert sorted(map(str, items.collect())) == sorted(map(str, items_of(spark).collect()))
    errors = spark.read.json(output + "_errors")
    assert [r.error for r in errors.collect()] == ["empty_response"]

    scored = str(tmp_path / "scored")
    queue.run_stage(
        queue.read_queue(spark, output), score_links, "relevance_analysis", scored,
        str(tmp_path / "c2"),
    )
    assert analyses(queue.stage_items(spark, scored, SCORED_ITEM)) == analyses(score_links(items))


def test_failed_items_become_dead_letters(spark, tmp_path):
    source, scored = str(tmp_path / "items"), str(tmp_path / "scored")
    items = items_of(spark)
    broken = items.limit(1).withColumn("keyword", F.lit(None).cast("string"))
    queue.publish(items.unionByName(broken), source)
    (tmp_path / "items" / "bad.json").write_text('{"page_id": 1, "href": \nnot json\n')
    stream = queue.read_queue(spark, source)
    queue.run_stage(stream, score_links, "relevance_analysis", scored, str(tmp_path / "c"))
    assert queue.stage_items(spark, scored, SCORED_ITEM).count() == items.count()
    dead = queue.stage_items(spark, scored, SCORED_ITEM, "failed")
    assert dead.count() == 3
    assert sorted(r[0] for r in dead.select(queue.CORRUPT).collect() if r[0]) == [
        "not json", '{"page_id": 1, "href": '
    ]


def test_archived_queue_is_cleared(spark, tmp_path):
    source, archive = str(tmp_path / "q" / "items"), str(tmp_path / "archive")
    for _ in range(3):  # files of a batch are moved when a later batch has started
        queue.publish(items_of(spark).coalesce(1), source)
        stream = queue.read_queue(spark, source, archive=archive)
        queue.run_stage(
            stream, score_links, "relevance_analysis", str(tmp_path / "scored"), str(tmp_path / "c")
        )
    left = list((tmp_path / "q" / "items").glob("*.json"))
    moved = [p for p in (tmp_path / "archive").rglob("*.json")]
    assert len(left) < 3 and len(left) + len(moved) == 3
    assert queue.stage_items(spark, str(tmp_path / "scored"), SCORED_ITEM).count() == 3 * 20


def test_small_inputs_are_spread_and_large_ones_left_alone(spark, tmp_path):
    path = str(tmp_path / "pages")
    sample_pages(spark).coalesce(1).write.parquet(path)
    assert read_pages(spark, path).rdd.getNumPartitions() == 4
    many = str(tmp_path / "many")
    sample_pages(spark).repartition(7).write.option("maxRecordsPerFile", 1).parquet(many)
    spark.conf.set("spark.sql.files.openCostInBytes", "128MB")
    try:
        plan = read_pages(spark, many)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert "Exchange" not in plan


def test_a_source_with_most_of_the_links(spark):
    """One page holds most links; results do not depend on how the data is spread."""
    draw = random.Random(1)
    hot = "".join(f"<a href='/{i}'>{draw.choice(['kw', 'kw x', 'y'])} {i}</a>" for i in range(400))
    rows = [(1, "http://hot/", f"<body>{hot}</body>")] + [
        (i, f"http://s{i}/", "<body><a href='/1'>kw</a></body>") for i in range(2, 100)
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    best = rank.best_links(runs.scored_items(pages, ["kw"]))
    plain = {tuple(r) for r in rank.rank_links(best).collect()}
    assert plain == {tuple(r) for r in rank.rank_links(best, hot_rows=50).collect()}
    assert len(plain) == 498


@pytest.mark.parametrize("few", [True, False])
def test_run_reports_the_same_errors_for_few_and_many_targets(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(targets, "MAX_BROADCAST_URLS", 0)
        monkeypatch.setattr(robots, "MAX_BROADCAST_CHARS", 0)
    bad_link = "<body><a href='http://[x/'>kw</a><a href='/fine'>kw</a></body>"
    rows = [
        (1, "http://a/1", bad_link), (2, "http://a/2", ""), (3, "http://b/1", bad_link),
        (4, "http://b/2", ""), (5, None, bad_link), (6, "http://c/1", bad_link), (7, "http://d/1", bad_link),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    wanted = [(u, "kw") for u in ("http://a/1", "http://a/2", "http://c/1", "http://gone/", None)]
    table = spark.createDataFrame(wanted, "url string, keyword string")
    files = spark.createDataFrame(
        [(h, "User-agent: *\nDisallow: /") for h in ("C", "d")], "host string, robots_txt string"
    )
    outcome = runs.run(pages, table, files)
    assert sorted((r["error"], r["url"] or "") for r in outcome.errors.collect()) == [
        ("empty_response", "http://a/2"), ("fetch_failed", "http://gone/"), ("invalid_link", "http://a/1"),
        ("missing_url", ""), ("robots_txt_error", "http://c/1"),
    ]
    assert [(r["source_url"], r["href"]) for r in outcome.items.collect()] == [("http://a/1", "/fine")]


def test_run_without_targets(spark):
    table = spark.createDataFrame([], "url string, keyword string")
    outcome = runs.run(sample_pages(spark), table)
    assert outcome.items.collect() == []
    assert [r["error"] for r in outcome.errors.collect()] == ["missing_targets"]


def test_robots_hosts_in_any_case_and_repeated(spark):
    files = spark.createDataFrame(
        [("H0", "User-agent: *\nDisallow: /secret"), ("h0", "User-agent: *\nDisallow: /z"), ("h1", "User-agent: *\nDisallow:")],
        "host string, robots_txt string",
    )
    pages = spark.createDataFrame(
        [(1, "http://h0/secret"), (2, "http://H0/z"), (3, "http://h1/secret")], "page_id bigint, url string"
    )
    decided = robots.with_decision(pages, robots.agent_rules(files)).collect()
    assert {r["page_id"]: r["allowed"] for r in decided} == {1: False, 2: True, 3: True}


def test_turns_of_a_cleared_queue_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    folder = tmp_path / "cleared"
    monkeypatch.setattr(queries, "new_folder", lambda _spark, _name: str(folder))
    html = "<body>" + "".join(f'<a href="/{k}">t{k}</a>' for k in range(7)) + "</body>"
    pages = spark.createDataFrame([(i, f"http://s/{i}", html) for i in range(40)], "page_id bigint, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    try:
        found = {(r["place"], r["keyword"]): r["n_items"] for r in queries.q_clear_queue(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset(setting)
    # Links 3, 6 are in the first turn, 1, 4, 7 in the second, 2, 5 in the last.
    counts = {"archived": 40 * 5, "left": 40 * 2, "processed": 40 * 7}
    assert found == {(place, k): n for place, n in counts.items() for k in queries.KEYWORDS}
    assert len(list((folder / "archive").rglob("*.json"))) > 2
