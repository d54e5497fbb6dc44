"""Hand-over between stages, the stored catalog's layouts and folds, and sessions with few settings."""

import os
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from linkscore import commits
from linkscore.operators import catalog
from linkscore.operators.links import extract_links, link_items, with_keywords
from linkscore.operators.score import score_links
from linkscore.schemas import SCORED_ITEM
from linkscore.streaming import queue

ROOT = Path(__file__).resolve().parent.parent


# -- stages ----------------------------------------------------------------------------------


def items_of(make_pages):
    pages = make_pages(*(f"<body><a href='/{i}'>a{i}</a><a href='/{i}/x'>b</a></body>" for i in range(12)))
    return link_items(with_keywords(extract_links(pages), ["a"]))


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_batch_that_fails_is_handed_on_once(spark, make_pages, tmp_path, monkeypatch, when):
    """The stage dies after writing a batch, before or after it is recorded; the next stages run in between."""
    folder = str(tmp_path)
    items = items_of(make_pages)
    for k in range(4):
        queue.publish(items.filter(F.pmod("page_id", F.lit(4)) == k).coalesce(1), f"{folder}/items")
    real, died = commits.record, []

    def record(session, log, name, **fields):
        dies = "first_commits" in log and len(died) < 2 and name.endswith(("-1", "-2"))
        if when == "after" or not dies:
            real(session, log, name, **fields)
        if dies:
            died.append(name)
            raise RuntimeError("the job died")

    def first():
        stream = queue.read_queue(spark, f"{folder}/items", max_files=1)
        queue.run_stage(stream, score_links, "relevance_analysis", f"{folder}/first", f"{folder}/c1")

    def then():
        stream = queue.read_queue(spark, f"{folder}/first", SCORED_ITEM, from_stage=True)
        same = lambda rows: rows.withColumn("seen", F.lit(True))
        queue.run_stage(stream, same, "seen", f"{folder}/second", f"{folder}/c2")
        stream = queue.read_queue(spark, f"{folder}/second", SCORED_ITEM, from_stage=True, max_files=2)
        queue.run_stage(stream, same, "seen", f"{folder}/third", f"{folder}/c3")

    monkeypatch.setattr(commits, "record", record)
    for _ in range(2):
        with pytest.raises(StreamingQueryException):
            first()
        then()
    first()
    then()
    assert len(died) == 2
    for stage in ("first", "second", "third"):
        found = queue.stage_items(spark, f"{folder}/{stage}", SCORED_ITEM)
        assert sorted(r["seq"] for r in found.collect()) == sorted(r["seq"] for r in items.collect())


def test_items_of_a_stage_that_has_not_run(spark, tmp_path):
    assert queue.stage_items(spark, str(tmp_path / "none"), SCORED_ITEM).collect() == []


# -- catalog ---------------------------------------------------------------------------------


@pytest.fixture
def few_buckets(monkeypatch):
    """Fewer files to write."""
    monkeypatch.setattr(catalog, "BUCKETS", 4)


def batch(spark, score, *keys):
    rows = [("i", *k, float(score), "{}", Decimal(i)) for i, k in enumerate(keys)]
    table = spark.createDataFrame(
        rows, "id string, keyword string, source_url string, href_url string, relevance_score double, "
        "raw_data string, seq decimal(38,0)",
    )
    return table.withColumn("processed_date", F.current_timestamp())


KEYS = [(f"k{i % 3}", f"s{i % 10}", f"h{i}") for i in range(60)]


def state(rows):
    return {(r["keyword"], r["source_url"], r["href_url"]): r["relevance_score"] for r in rows.collect()}


def in_layout(spark, path, layout):
    return state(catalog.current(catalog.stored(spark, path, layout), columns=(*catalog.KEY, "relevance_score")))


def test_lookups_read_one_bucket(spark, tmp_path, few_buckets):
    path = str(tmp_path / "catalog")
    catalog.append_batch(batch(spark, 1, *KEYS), path, 0)
    catalog.append_batch(batch(spark, 2, *KEYS[:30]), path, 1)
    newest = {k: 2.0 if i < 30 else 1.0 for i, k in enumerate(KEYS)}
    assert all(in_layout(spark, path, layout) == newest for layout in catalog.LAYOUTS)

    def bucket(layout, value):
        kind = catalog.LAYOUTS[layout]
        return spark.range(1).select(kind.bucket(F.lit(value))).first()[0]

    kept = {"catalog": bucket("keyword", "k1"), "catalog_by_source": bucket("source", "s7"), "catalog_by_href": bucket("href", "h7")}
    for name, number in kept.items():
        for file in (tmp_path / name).rglob("*.parquet"):
            if file.parent.name != f"bucket={number}":
                file.unlink()
    wanted = {k: v for k, v in newest.items() if k[0] == "k1"}
    found = catalog.find(spark, path, keyword="k1")
    assert state(found) == wanted and found.columns == list(catalog.RESULT_COLUMNS)
    assert [r["relevance_score"] for r in found.collect()] == sorted(wanted.values(), reverse=True)
    assert catalog.find_count(spark, path, keyword="k1").first()[0] == len(wanted)
    assert state(catalog.find(spark, path, source_url="s7")) == {k: v for k, v in newest.items() if k[1] == "s7"}
    assert state(catalog.find(spark, path, keyword="k1", source_url="s7")) == {
        k: v for k, v in newest.items() if k[:2] == ("k1", "s7")
    }
    assert catalog.find_count(spark, path, keyword="K1", source_url="s7").first()[0] == 0
    assert [tuple(r) for r in catalog.find_href(spark, path, "h7").collect()] == [("h7", "s7", "k1", 2.0)]
    with pytest.raises(ValueError):
        catalog.find_href(spark, path, "")


def test_an_empty_catalog(spark, tmp_path):
    path = str(tmp_path / "none")
    assert catalog.find(spark, path).collect() == [] and catalog.find_count(spark, path).first()[0] == 0


def files_of(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names}


def test_folding_touches_one_bucket_only(spark, tmp_path, few_buckets):
    path = str(tmp_path / "catalog")
    for n in range(4):
        catalog.append_batch(batch(spark, n, *KEYS[n:]), path, n)
    newest = {k: float(min(i, 3)) for i, k in enumerate(KEYS)}
    number = catalog.crowded_buckets(spark, path, "source", 4)[0]
    before = files_of(tmp_path)
    catalog.fold(spark, path, "source", [number])
    after = files_of(tmp_path)
    assert {f: after[f] for f in before} == before
    new = [f for f in after if f not in before and f.endswith(".parquet")]
    assert new and all(f"catalog_by_source/commit=" in f and f"/bucket={number}/" in f for f in new)
    assert all(in_layout(spark, path, layout) == newest for layout in catalog.LAYOUTS)
    gone = catalog.droppable(spark, path)
    assert len(gone) == 4 and all(g.endswith(f"/bucket={number}") for g in gone)
    for folder in gone:
        for file in Path(folder).glob("*"):
            file.unlink()
    assert all(in_layout(spark, path, layout) == newest for layout in catalog.LAYOUTS)


def test_folds_and_later_batches(spark, tmp_path, few_buckets):
    """Batches after a fold, a fold of folds, and a batch that is stored again with fewer rows."""
    path = str(tmp_path / "catalog")
    catalog.append_batch(batch(spark, 1, *KEYS), path, 0, "a")
    catalog.append_batch(batch(spark, 2, *KEYS[:20]), path, 0, "b")
    assert set(catalog.compact_buckets(spark, path, least=2)) == set(catalog.LAYOUTS)
    assert catalog.stored(spark, path).count() == 60
    catalog.append_batch(batch(spark, 3, *KEYS[10:30]), path, 1, "a")
    newest = {k: 3.0 if 10 <= i < 30 else 2.0 if i < 20 else 1.0 for i, k in enumerate(KEYS)}
    assert all(in_layout(spark, path, layout) == newest for layout in catalog.LAYOUTS)
    catalog.compact_buckets(spark, path, least=2)
    assert catalog.crowded_buckets(spark, path, "href", 2) == []
    assert all(in_layout(spark, path, layout) == newest for layout in catalog.LAYOUTS)
    # Stored again, the first batch keeps its place in time and loses the rows it no longer has.
    catalog.append_batch(batch(spark, 0.5, *KEYS[:50]), path, 0, "a")
    newest = {k: v if v > 1 else 0.5 for k, v in list(newest.items())[:50]}
    assert all(in_layout(spark, path, layout) == newest for layout in catalog.LAYOUTS)


# -- sessions --------------------------------------------------------------------------------


def run_script(code, **env):
    clean = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_CONF_DIR")}
    return subprocess.run(
        [sys.executable, "-c", code], cwd="/", env=clean | env, capture_output=True, text=True, timeout=300
    )


SESSION = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
"""


def test_a_local_session_without_settings(tmp_path):
    code = SESSION + """
from linkscore.storage import SETTING, materialized, shared_folder
assert spark.conf.get(SETTING, None) is None
assert materialized(spark.range(5), "x").count() == 5
assert shared_folder(spark) == shared_folder(spark)
print("fine")
"""
    done = run_script(code, TMPDIR=str(tmp_path), SPARK_CONF_DIR=str(tmp_path))
    assert "fine" in done.stdout, done.stderr[-2000:]


def test_the_package_can_be_sent_to_executors(tmp_path):
    code = SESSION + """
from linkscore.session import ship_package
from linkscore.functions.text import tokens
from linkscore.storage import SETTING
ship_package(spark)
def names(batches):
    import linkscore.schemas
    for b in batches:
        yield b
print("rows", spark.range(3).mapInPandas(names, "id long").count())
"""
    done = run_script(code, TMPDIR=str(tmp_path))
    assert "rows 3" in done.stdout, done.stderr[-2000:]
