"""Ranking of scored links per target (source page and keyword)."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkscore.operators.skew import HOT_ROWS, row_number_in_group, salted_join
from linkscore.storage import materialized

TARGET = ("source_url", "keyword")
# Rows of a target's result are listed in chunks of this size, so that no row grows with the data.
RESULTS_PER_CHUNK = 1000


def best_links(scored_items: DataFrame) -> DataFrame:
    """Best score of each link target, and when it was first seen.

    Items without analysis are left out; a missing score counts as 0, a missing target as ``''``.
    Both aggregates have fixed-size buffers: a hash aggregate, partial before the shuffle.
    """
    record = F.col("relevance_analysis")
    flat = scored_items.filter(record.isNotNull()).select(
        record["source_url"].alias("source_url"),
        record["keyword"].alias("keyword"),
        F.coalesce(record["href_url"], F.lit("")).alias("href_url"),
        F.coalesce(record["score"], F.lit(0.0)).alias("score"),
        "seq",
    )
    return flat.groupBy(*TARGET, "href_url").agg(
        F.max("score").alias("score"), F.min("seq").alias("first_seq")
    )


def rank_links(best: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rank within the target: best score first, equal scores in the order first seen.

    The best links are written down first: they are few and narrow next to the pages they come
    from, and both the look at the group sizes and the ranking read them.
    """
    table = materialized(best.select(*TARGET, "href_url", "score", "first_seq"), "best")
    return row_number_in_group(table, TARGET, _order(), "rank", hot_rows)


def _order() -> list[Column]:
    return [F.desc("score"), F.asc("first_seq"), F.asc("href_url")]


def top_links(best: DataFrame, k: int, salts: int = 32) -> DataFrame:
    """The ``k`` best links of each target, ranked.

    Each target is first cut to ``k`` rows in up to ``salts`` parts, so the final window sees at
    most ``k * salts`` rows of any target.
    """
    parts = best.withColumn("_part", F.pmod(F.xxhash64("href_url"), F.lit(salts)))
    in_part = F.row_number().over(Window.partitionBy(*TARGET, "_part").orderBy(*_order()))
    leading = parts.withColumn("rank", in_part).filter(F.col("rank") <= k).drop("_part", "rank")
    in_target = F.row_number().over(Window.partitionBy(*TARGET).orderBy(*_order()))
    return leading.withColumn("rank", in_target.cast("bigint")).filter(F.col("rank") <= k)


def scrape_results(ranked: DataFrame, per_chunk: int = RESULTS_PER_CHUNK) -> DataFrame:
    """Result of each target: ``results`` best first, and the ``count`` of all its links.

    A target with more links than fit one chunk has several rows, ``chunk`` 0, 1, ...; taken
    together they are the whole result.
    """
    entry = F.struct("rank", F.col("href_url").alias("url"), "score")
    chunk = F.floor((F.col("rank") - 1) / per_chunk).cast("bigint")
    chunks = (
        ranked.withColumn("chunk", chunk)
        .groupBy(*TARGET, "chunk")
        .agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    )
    counts = ranked.groupBy(*TARGET).agg(F.max("rank").alias("count"))
    without_rank = F.transform("entries", lambda e: F.struct(e["url"], e["score"]))
    return salted_join(chunks, counts, TARGET, F.col("chunk"), "inner").select(
        *TARGET, "chunk", without_rank.alias("results"), "count"
    )


def percentage(score: Column) -> Column:
    """Score as shown to people: percent with one decimal, of the exact binary value, ties up.

    The fraction of a double is a double, so it compares exactly with the double next to a limit
    (0.05, 0.15, ...). Where they are equal, it counts on which side of the limit that double is.
    """
    percent = F.abs(score * 100)
    whole = F.floor(percent)
    fraction = percent - whole
    tenths = F.lit(0)
    for k in range(1, 11):
        limit = (2 * k - 1) / 20
        reached = fraction >= limit if Fraction(limit) >= Fraction(2 * k - 1, 20) else fraction > limit
        tenths = tenths + reached.cast("int")
    value = whole * 10 + tenths
    sign = F.when((score < 0) & (value > 0), "-").otherwise("")
    return F.concat(sign, F.floor(value / 10), F.lit("."), F.pmod(value, F.lit(10)), F.lit("%"))
