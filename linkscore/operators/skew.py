"""Joins and numbering that hold when one key has a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkscore.storage import materialized

# A group with fewer rows than this fits a task and is not treated as large.
HOT_ROWS = 1_000_000
# A key's rows are dealt out in pieces: so many make up the work of a task, or a piece has so many rows.
PIECES_PER_TASK = 32
LEAST_PIECE = 50_000
# At most this many group keys are broadcast; beyond it all rows are numbered slice by slice.
MAX_LARGE_GROUPS = 100_000
# No more text than this is broadcast.
MAX_BROADCAST_CHARS = 64_000_000


def fits(table: DataFrame, max_rows: int, max_chars: int = MAX_BROADCAST_CHARS) -> bool:
    """Whether a table of strings is small enough to be broadcast, by its rows and its text."""
    chars = F.lit(0).cast("bigint")
    for column, kind in table.dtypes:
        if kind == "string":
            chars = chars + F.coalesce(F.length(column), F.lit(0))
    rows, size = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(chars), F.lit(0))).first()
    return rows <= max_rows and size <= max_chars


def matching_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str) -> DataFrame:
    """Join on equal columns where null equals null; the columns come out once."""
    names = {c: f"_right_{c}" for c in on}
    renamed = right.withColumnsRenamed(names)
    same = [left[c].eqNullSafe(renamed[n]) for c, n in names.items()]
    return left.join(renamed, same, how).drop(*names.values())


def pieces(table: DataFrame, on: Sequence[str], least: int = LEAST_PIECE) -> DataFrame:
    """In how many pieces to deal out the rows of the frequent keys of ``table``: (hash of the key, number).

    A piece has ``least`` rows, or more in a large table: then all pieces together are
    ``PIECES_PER_TASK`` for each shuffle partition, so there are never more frequent keys than that,
    however the keys are distributed, and the result can be broadcast. Keys whose hashes collide are
    dealt out alike, which changes no result. ``table`` is read twice: hand in a few columns of a
    written table or a scan.
    """
    spark = table.sparkSession
    most = PIECES_PER_TASK * int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = max(least, -(-table.count() // most))
    counts = table.groupBy(F.xxhash64(*on).alias("_key")).agg(F.count(F.lit(1)).alias("_rows"))
    number = F.ceil(F.col("_rows") / size).cast("int")
    return counts.filter(F.col("_rows") > size).select("_key", number.alias("_pieces"))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread: Column,
    how: str,
    salts: int | DataFrame = 16,
) -> DataFrame:
    """Join (null equals null) a large table to a smaller one whose keys may be hot on the left.

    The rows of one key on the left go to ``salts`` tasks, by the value of ``spread``; the right
    side is copied once per salt. With :func:`pieces` of the left as ``salts`` each key has as many as
    its rows need, one for most. Neither side is broadcast, so neither needs a size bound.
    """
    if isinstance(salts, int):
        of_left = of_right = F.lit(salts)
    else:
        dealt = F.broadcast(salts)
        left = left.withColumn("_key", F.xxhash64(*on)).join(dealt, "_key", "left").drop("_key")
        right = right.withColumn("_key", F.xxhash64(*on)).join(dealt, "_key", "left").drop("_key")
        of_left = of_right = F.coalesce("_pieces", F.lit(1))
    salted_left = left.withColumn("_salt", F.pmod(F.xxhash64(spread), of_left).cast("int"))
    every_salt = F.explode(F.sequence(F.lit(0), of_right.cast("int") - 1))
    salted_right = right.withColumn("_salt", every_salt)
    return matching_join(
        salted_left.drop("_pieces"), salted_right.drop("_pieces"), [*on, "_salt"], how
    ).drop("_salt")


def lookup_join(left: DataFrame, right: DataFrame, key: str, least: int = LEAST_PIECE) -> DataFrame:
    """Left join to a large table that is unique in ``key``, also for very frequent keys.

    Rows of a frequent key are dealt out over tasks, and the one row of the right side is copied to
    them. ``left`` is read three times, its order must not change in between: hand in a written table.
    """
    known = right.filter(F.col(key).isNotNull())
    spread = F.monotonically_increasing_id()
    return salted_join(left, known, [key], spread, "left", pieces(left.select(key), [key], least))


def row_number_in_group(
    table: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    name: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """``row_number()`` per group that does not put a very large group into one task.

    Groups of ordinary size use the plain window. The rows of large groups are range-partitioned
    by group and order, so a group lies in consecutive slices; they are numbered inside each slice
    and shifted by the group's rows in the slices before. At most one group per slice continues
    from an earlier slice, so there are fewer offsets than slices and they can be broadcast.

    ``order`` must be total within the group. ``table`` is read several times: hand in a table, not
    a long computation.
    """
    plain = F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint")
    large = table.groupBy(*group).count().filter(F.col("count") > hot_rows).select(*group)
    if large.isEmpty():
        return table.withColumn(name, plain)
    if fits(large, MAX_LARGE_GROUPS):
        keys = F.broadcast(large)
        ordinary = matching_join(table, keys, group, "left_anti").withColumn(name, plain)
        slicing = matching_join(table, keys, group, "left_semi")
    else:
        ordinary, slicing = None, table

    ranged = slicing.repartitionByRange(*group, *order)
    # The slice of a row must not change between the two uses below, so it is written down.
    sliced = materialized(ranged.withColumn("_slice", F.spark_partition_id()), "slices")
    in_slice = Window.partitionBy("_slice", *group).orderBy(*order)
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        sliced.groupBy(*group, "_slice")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.sum("_rows").over(earlier))
        .filter(F.col("_before") > 0)
        .drop("_rows")
    )
    in_order = sliced.withColumn(name, F.row_number().over(in_slice))
    numbered = (
        matching_join(in_order, F.broadcast(offsets), [*group, "_slice"], "left")
        .withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
        .drop("_slice", "_before")
        .select(*table.columns, name)
    )
    return numbered if ordinary is None else ordinary.unionByName(numbered)
