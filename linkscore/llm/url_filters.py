"""URL rules by hash prefixes.

A rule is a host, a path and a verdict; it fits its host and all subdomains if the path of the URL
starts with the rule's path. Each URL is expanded into the expressions under which a rule could be
listed (host suffix + path prefix). Expressions and rules meet in an equi-join on a short prefix of
their digests; the full digest then confirms a match, and the longest rule wins (the longer host
decides between rules of one length, then the text order of rule and verdict).

All of it is Spark SQL functions. Cost: the distinct (host, path) pairs are expanded, never the rows, to
suffixes and prefixes of the sizes that rules have, so a host of thousands of labels takes no more than
others; the verdicts go back to the rows over salted keys, so one very frequent URL does no harm.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and gets
the default verdict; the host is everything up to ``/``, ``?``, ``#`` (ports and user names stay);
an empty rule table gives the default verdict throughout; rules with a null host, path or verdict
are ignored; repeated rows and other columns pass through (columns of the names added here are
replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkscore.operators.skew import fits, salted_join

#: Hexadecimal digits of the digest that the join compares first.
PREFIX_DIGITS = 8
#: Rules are broadcast up to this number of rows (and 64 million characters), beyond it shuffled.
MAX_BROADCAST_RULES = 200_000
ADDED = ("host", "path", "rule", "verdict")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """Add ``host`` and ``path`` of ``url``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col("url"), F.lit(""))
    return pages.withColumns(
        {
            "host": lower_ascii(F.regexp_extract(url, pattern, 1)),
            "path": F.regexp_extract(url, pattern, 2),
        }
    )


def expressions(keys: DataFrame, path_lengths: list[int], host_labels: list[int]) -> DataFrame:
    """(host, path) to one row per expression: every suffix of the host that has as many labels as some
    rule's host, with every prefix of the path that has the length of some rule's path."""
    labels = F.array(*(F.lit(n) for n in host_labels))
    known = F.filter(labels, lambda n: n <= F.size(F.split("host", r"\.", -1)))
    suffixes = F.transform(known, lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    lengths = F.filter(
        F.array(*(F.lit(n) for n in path_lengths)), lambda n: n <= F.length("path")
    )
    hosts = keys.filter(F.col("host") != "").select(
        "host", "path", F.explode(suffixes).alias("_host"), lengths.alias("_lengths")
    )
    return hosts.select("host", "path", "_host", F.explode("_lengths").alias("_length")).select(
        "host", "path", "_host", F.expr("substring(path, 1, _length)").alias("_path")
    )


def _digest(host: Column, path: Column) -> Column:
    # The path starts with "/" or is empty, the host has neither "/" nor a line of its own: the
    # length in front keeps pairs apart that read the same when joined.
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` with host, path, the rule that decides (host + path, or null) and the verdict.

    ``rules`` has the string columns host, path, verdict.
    """
    spark = pages.sparkSession
    plain = pages.drop(*ADDED)
    parted = with_host_and_path(plain)
    usable = (
        rules.select(lower_ascii(F.col("host")).alias("_host"), F.col("path").alias("_path"), "verdict")
        .dropna()
        .distinct()
    )
    lengths, labels = (
        sorted(r[0] for r in usable.select(size).distinct().collect())
        for size in (F.length("_path"), F.size(F.split("_host", r"\.", -1)))
    )
    if not lengths:
        return parted.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    digest = _digest(F.col("_host"), F.col("_path"))
    hashed = usable.select(
        F.substring(digest, 1, PREFIX_DIGITS).alias("_prefix"),
        digest.alias("_rule_digest"),
        F.concat("_host", "_path").alias("rule"),
        F.length("_host").alias("_host_length"),
        "verdict",
    )
    asked = (
        expressions(parted.select("host", "path").distinct(), lengths, labels)
        .withColumn("_digest", digest)
        .withColumn("_prefix", F.substring("_digest", 1, PREFIX_DIGITS))
        .drop("_host", "_path")
    )
    if fits(usable, MAX_BROADCAST_RULES):
        met = asked.join(F.broadcast(hashed), "_prefix")
    else:
        met = salted_join(asked, hashed, ["_prefix"], F.struct("host", "path"), "inner")
    best = (
        met.filter(F.col("_digest") == F.col("_rule_digest"))
        .groupBy("host", "path")
        .agg(
            F.max(F.struct(F.length("rule").alias("n"), "_host_length", "rule", "verdict")).alias("_b")
        )
        .select("host", "path", F.col("_b.rule").alias("rule"), F.col("_b.verdict").alias("verdict"))
    )
    # Any value serves that differs between the rows of one URL.
    judged = salted_join(parted, best, ["host", "path"], F.monotonically_increasing_id(), "left")
    return judged.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


#: The rules of the registered query: host, path, verdict. Fixed values.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    judged = judge_urls(pages, rule_table(spark))
    return judged.select("page_id", *ADDED)


ORACLE_SQL = r"""
WITH rules(rhost, rpath, rverdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
         ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), parted AS (
  SELECT row_number() OVER () AS r, page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages
), best AS (
  SELECT r, arg_max(rhost || rpath, length(rhost || rpath) * 1000 + length(rhost)) AS rule,
    arg_max(rverdict, length(rhost || rpath) * 1000 + length(rhost)) AS verdict
  FROM parted JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parted LEFT JOIN best USING (r)
"""
