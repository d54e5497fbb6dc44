"""The link catalog: one row per (keyword, source_url, href_url), the last one stored.

Storing a batch only writes that batch (:func:`append_batch`), once for every kind of lookup: by keyword,
by source URL, and, without the items themselves, by link target. In each of these layouts rows hash into
buckets by what is looked up and are sorted by it, so a lookup reads the files of one bucket, and of
these the row groups that may have the value. Readers resolve the newest row per key
(:func:`current`). Rewriting the table for every batch would cost the size of the table each time;
:func:`compact_buckets` folds the writes of single buckets when they are many.

Writes count when they are recorded (:mod:`linkscore.commits`), all layouts of a batch at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from linkscore import commits
from linkscore.schemas import CATALOG, struct
from linkscore.storage import materialized

KEY = ("keyword", "source_url", "href_url")
CATALOG_COLUMNS = (
    "id", "keyword", "source_url", "href_url", "relevance_score", "raw_data", "processed_date",
)
RESULT_COLUMNS = ("id", "keyword", "source_url", "href_url", "relevance_score", "raw_data")
HREF_COLUMNS = ("href_url", "source_url", "keyword", "relevance_score")

# Values hash into this many folders, so that a filter prunes without one folder per value. The count is
# part of the layout: it cannot change for a stored catalog.
BUCKETS = 32
# What orders the stored rows of a key, the newest last.
STORED_ORDER = ("version", "writer", "batch_id", "seq")


@dataclass(frozen=True)
class Layout:
    """One copy of the rows, placed by ``column`` and sorted by it and the ``rest`` of the key."""

    column: str
    rest: tuple[str, ...]
    columns: tuple[str, ...]

    def bucket(self, value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(BUCKETS)).cast("int")


LAYOUTS = {
    "keyword": Layout("keyword", ("href_url", "source_url"), CATALOG_COLUMNS),
    "source": Layout("source_url", ("keyword", "href_url"), CATALOG_COLUMNS),
    "href": Layout("href_url", ("keyword", "source_url"), HREF_COLUMNS),
}


def row_id() -> Column:
    """Stable id of a catalog row: a hash of its key, with null told from empty."""
    parts = (F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in KEY)
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def catalog_rows(scored_items: DataFrame) -> DataFrame:
    """Scored items as catalog rows, with their arrival order ``seq``; unscored ones are left out."""
    record = F.col("relevance_analysis")
    raw = F.struct(*(F.col(c) for c in scored_items.columns))
    rows = scored_items.filter(record.isNotNull()).select(
        record["keyword"].alias("keyword"),
        record["source_url"].alias("source_url"),
        record["href_url"].alias("href_url"),
        record["score"].alias("relevance_score"),
        F.to_json(raw).alias("raw_data"),
        F.current_timestamp().alias("processed_date"),
        "seq",
    )
    return rows.withColumn("id", row_id()).select(*CATALOG_COLUMNS, "seq")


def last_per_key(rows: DataFrame, *order: str) -> DataFrame:
    """The last row of each key by ``order``.

    An aggregate and not a window: the copies of a frequent key are dropped before the shuffle.
    """
    rest = [c for c in rows.columns if c not in KEY]
    newest = F.max_by(F.struct(*rest), F.struct(*order) if len(order) > 1 else F.col(order[0]))
    return rows.groupBy(*KEY).agg(newest.alias("_row")).select(*KEY, "_row.*").select(*rows.columns)


def upsert(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """``existing`` with the rows of ``batch`` put in: same key replaced, last one of a batch wins.

    ``batch`` has the columns of ``existing`` and ``seq``. Both join sides are unique in the key.
    """
    incoming = last_per_key(batch, "seq").drop("seq")
    keys = incoming.select(*(F.col(c).alias(f"_{c}") for c in KEY))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY]
    kept = existing.join(keys, same, "left_anti")
    return kept.unionByName(incoming.select(*existing.columns))


# -- stored form -------------------------------------------------------------------------------


def _log(path: str) -> str:
    return f"{path.rstrip('/')}_commits"


def _root(path: str, layout: str) -> str:
    return path.rstrip("/") if layout == "keyword" else f"{path.rstrip('/')}_by_{layout}"


def _batches(records: list[Row]) -> dict[tuple, Row]:
    """The record that counts of each batch: the last one."""
    found = {}
    for r in sorted((r for r in records if r["covers"] is None), key=lambda r: (r["attempt"], r["commit"])):
        found[r["writer"], r["batch_id"]] = r
    return found


def append_batch(rows: DataFrame, path: str, batch_id: int, writer: str = "run") -> None:
    """Store one batch; storing the same batch again replaces it, so a retried write is harmless.

    Each writer numbers its own batches: ``writer`` names a job or a stream, and no writer touches
    another one's rows. Which row of a key is the newest is decided by the commit version, a time in
    microseconds that a batch keeps when it is written again. Rows may bring their own.

    Range partitioning by the whole key spreads a keyword or a source that has most of the rows
    over many tasks and files, and sorts each file for row-group skipping on the key.
    """
    spark = rows.sparkSession
    earlier = _batches(commits.recorded(spark, _log(path))).get((writer, batch_id))
    version = earlier["version"] if earlier else commits.now()
    commit = uuid.uuid4().hex
    if "version" not in rows.columns:
        rows = rows.withColumn("version", F.lit(version))
    rows = rows.withColumns({"writer": F.lit(writer), "batch_id": F.lit(batch_id).cast("bigint"), "origin": F.lit(commit)})
    newest = materialized(last_per_key(rows, "seq"), "batch")
    # The writes are independent; small ones are mostly waiting for files.
    with ThreadPoolExecutor(len(LAYOUTS)) as pool:
        list(pool.map(lambda layout: _write(newest, path, layout, commit), LAYOUTS))
    attempt = earlier["attempt"] + 1 if earlier else 0
    commits.record(
        spark, _log(path), commit, version=version, writer=writer, batch_id=batch_id, attempt=attempt
    )


def _write(rows: DataFrame, path: str, layout: str, commit: str) -> None:
    kind = LAYOUTS[layout]
    columns = dict.fromkeys([*KEY, *kind.columns, *STORED_ORDER, "origin"])
    placed = rows.select(*columns).withColumn("bucket", kind.bucket(F.col(kind.column)))
    order = ("bucket", kind.column, *kind.rest)
    (
        placed.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.partitionBy("bucket")
        .parquet(f"{_root(path, layout)}/commit={commit}")
    )


def stored(spark: SparkSession, path: str, layout: str = "keyword") -> DataFrame:
    """All stored rows of a layout, replaced ones included, with ``seq``, ``version`` and their batch.

    Which writes count is told by the records; the rest is partition filters, so nothing else is read.
    """
    kind = LAYOUTS[layout]
    kinds = {f.name: f for f in struct(CATALOG).fields}
    fields = [kinds[c].simpleString().replace(":", " ", 1) for c in dict.fromkeys([*KEY, *kind.columns])]
    schema = struct(
        ", ".join(fields) + ", seq decimal(38,0), version bigint, writer string, batch_id bigint, "
        "origin string, bucket int, commit string"
    )
    records = commits.recorded(spark, _log(path))
    live = _batches(records)
    folds = [r for r in records if r["covers"] is not None and r["layout"] == layout]
    names = [r["commit"] for r in live.values()] + [r["commit"] for r in folds]
    if not names:
        return spark.createDataFrame([], schema)
    root = _root(path, layout)
    rows = spark.read.schema(schema).option("basePath", root).parquet(*(f"{root}/commit={n}" for n in names))
    for bucket in sorted({b for r in folds for b in r["buckets"]}):
        covered = {c for r in folds if bucket in r["buckets"] for c in r["covers"]}
        rows = rows.filter(~((F.col("bucket") == bucket) & F.col("commit").isin(sorted(covered))))
    # Rows of a batch that was folded and has been stored again since.
    known = {r["commit"] for r in live.values()} | {r["commit"] for r in records if r["covers"] is not None}
    replaced = sorted({c for r in folds for c in r["covers"]} - known)
    if replaced:
        rows = rows.filter(~F.col("origin").isin(replaced))
    return rows


def current(
    stored_rows: DataFrame, keyword: str | None = None, columns: Sequence[str] = CATALOG_COLUMNS
) -> DataFrame:
    """The catalog: of the stored rows, the newest of each key.

    With ``keyword`` only that keyword's rows, and only its directory is read. ``columns`` limits
    what is read; without ``raw_data`` the rows are small.
    """
    if keyword:
        stored_rows = _only(stored_rows, "keyword", keyword)
    needed = stored_rows.select(*dict.fromkeys([*KEY, *columns, *STORED_ORDER]))
    return last_per_key(needed, *STORED_ORDER).select(*columns)


def _only(rows: DataFrame, layout: str, value: str) -> DataFrame:
    """Rows with this value, from its bucket alone."""
    kind = LAYOUTS[layout]
    return rows.filter((F.col("bucket") == kind.bucket(F.lit(value))) & (F.col(kind.column) == value))


def fold(spark: SparkSession, path: str, layout: str, buckets: Sequence[int]) -> None:
    """Fold all writes of some buckets of a layout into one. Only these buckets are read and written.

    The record of the fold is what swaps the old rows for the new ones; until then readers take the old
    ones, and rows that are stored meanwhile are none of the fold's.
    """
    rows = stored(spark, path, layout).filter(F.col("bucket").isin(list(buckets)))
    covers = sorted(r["commit"] for r in rows.select("commit").distinct().collect())
    commit = uuid.uuid4().hex
    _write(last_per_key(rows.drop("commit", "bucket"), *STORED_ORDER), path, layout, commit)
    commits.record(spark, _log(path), commit, layout=layout, buckets=list(buckets), covers=covers)


def crowded_buckets(spark: SparkSession, path: str, layout: str, least: int) -> list[int]:
    """Buckets that are made of at least so many writes."""
    pieces = stored(spark, path, layout).select("bucket", "commit").distinct()
    many = pieces.groupBy("bucket").count().filter(F.col("count") >= least)
    return sorted(r["bucket"] for r in many.select("bucket").collect())


def compact_buckets(spark: SparkSession, path: str, least: int = 8) -> dict[str, list[int]]:
    """Fold, in place, the buckets that are made of at least ``least`` writes; gives them by layout."""
    found = {layout: crowded_buckets(spark, path, layout, least) for layout in LAYOUTS}
    for layout, buckets in found.items():
        if buckets:
            fold(spark, path, layout, buckets)
    return found


def droppable(spark: SparkSession, path: str) -> list[str]:
    """Folders that no reader who starts now will read: folded, or written again since.

    Readers that started earlier may still need them; drop them when those are done.
    """
    records = commits.recorded(spark, _log(path))
    live = {r["commit"] for r in _batches(records).values()}
    out = []
    for layout in LAYOUTS:
        folds = [r for r in records if r["covers"] is not None and r["layout"] == layout]
        for r in records:
            root = f"{_root(path, layout)}/commit={r['commit']}"
            if r["covers"] is None and r["commit"] not in live:
                out.append(root)
            elif r["covers"] is None or r["layout"] == layout:
                gone = {b for f in folds if r["commit"] in f["covers"] for b in f["buckets"]}
                out += [f"{root}/bucket={b}" for b in sorted(gone)]
    return out


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the newest rows of ``path`` as the only batch of a new catalog ``target``."""
    newest = last_per_key(stored(spark, path), *STORED_ORDER)
    append_batch(newest.drop("bucket", "batch_id", "writer", "origin", "commit"), target, 0, "compacted")


# -- queries -----------------------------------------------------------------------------------


def by_score() -> list[Column]:
    """Best first, null scores before all others; the id spreads equal scores over the sort."""
    return [F.desc_nulls_first("relevance_score"), F.asc("id")]


def matching(
    catalog: DataFrame,
    keyword: str | Column | None = None,
    source_url: str | Column | None = None,
) -> DataFrame:
    """Rows with this keyword (exact, case-sensitive) and source; an empty value filters nothing."""
    for column, value in (("keyword", keyword), ("source_url", source_url)):
        if isinstance(value, Column) or value:
            catalog = catalog.filter(F.col(column) == value)
    return catalog


def query(
    catalog: DataFrame,
    keyword: str | Column | None = None,
    source_url: str | Column | None = None,
) -> DataFrame:
    """Matching rows, best score first."""
    found = matching(catalog, keyword, source_url).select(*RESULT_COLUMNS)
    return found.orderBy(*by_score())


def result_count(
    catalog: DataFrame,
    keyword: str | Column | None = None,
    source_url: str | Column | None = None,
) -> DataFrame:
    """Number of rows :func:`query` gives, without sorting them."""
    return matching(catalog, keyword, source_url).agg(F.count(F.lit(1)).alias("count"))


def by_href(catalog: DataFrame, href_url: str | Column | None) -> DataFrame:
    """One row with this link target, empty when there is none; the first by keyword and source."""
    if href_url is None or (isinstance(href_url, str) and not href_url):
        raise ValueError("href_url parameter is required")
    found = catalog.filter(F.col("href_url") == href_url).select(*HREF_COLUMNS)
    return found.orderBy("keyword", "source_url").limit(1)


# -- lookups in the stored form ------------------------------------------------------------------


def _matching_stored(
    spark: SparkSession, path: str, keyword: str | None, source_url: str | None, columns: Sequence[str]
) -> DataFrame:
    """Newest rows with this keyword and source from the layout that serves them: a source has far fewer
    rows than a keyword."""
    if source_url:
        rows = _only(stored(spark, path, "source"), "source", source_url)
    else:
        rows = stored(spark, path)
    if keyword:
        rows = rows.filter(F.col("keyword") == keyword) if source_url else _only(rows, "keyword", keyword)
    return current(rows, columns=columns)


def find(
    spark: SparkSession, path: str, keyword: str | None = None, source_url: str | None = None
) -> DataFrame:
    """:func:`query` on the catalog stored at ``path``, reading one bucket if there is a filter."""
    return query(_matching_stored(spark, path, keyword, source_url, RESULT_COLUMNS))


def find_count(
    spark: SparkSession, path: str, keyword: str | None = None, source_url: str | None = None
) -> DataFrame:
    """:func:`result_count` on the catalog stored at ``path``; only keys are read."""
    return result_count(_matching_stored(spark, path, keyword, source_url, KEY))


def find_href(spark: SparkSession, path: str, href_url: str | None) -> DataFrame:
    """:func:`by_href` on the catalog stored at ``path``, from one bucket of slim rows."""
    if not href_url:
        raise ValueError("href_url parameter is required")
    rows = _only(stored(spark, path, "href"), "href", href_url)
    return by_href(current(rows, columns=HREF_COLUMNS), href_url)
