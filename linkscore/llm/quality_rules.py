"""Quality rules as weak supervision.

Every rule looks at a few statistics of a text and votes good, votes bad or abstains. How far a rule can
be trusted is not set by hand: expectation-maximisation over the votes of all documents estimates each
rule's chance of voting good, bad or not at all on good and on bad documents, and the posterior of
"good" given all votes is a document's quality. It takes the place of "all rules must pass".

Statistics and votes are Spark SQL functions on the row, without a shuffle. The votes are counted per
pattern (at most 3^rules patterns, whatever the corpus), which is all that the estimation needs; the
posteriors of the patterns then go back to the rows by a broadcast join of that bounded table.

Defined cases: a null text has no words and all statistics 0; texts without words get a posterior like
any other, and ``base_failed``; repeated rows are judged alike and counted each; an empty table gives
an empty result; columns with the names added here are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkscore.storage import materialized

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

GOOD, BAD, ABSTAIN = 1, -1, 0

#: Rules: name, vote, and the ranges of statistics that must all hold; outside of them a rule abstains.
RULES = (
    ("many symbols", BAD, (("symbol_share", 0.04, 1.0),)),
    ("mostly capitals", BAD, (("capital_share", 0.40, 1.0),)),
    ("repeated passages", BAD, (("repeat_share", 0.30, 1.0),)),
    ("repeated lines", BAD, (("line_share", 0.30, 1.0),)),
    ("few different words", BAD, (("distinct_share", 0.0, 0.15),)),
    ("exclamations", BAD, (("exclaim_share", 0.03, 1.0),)),
    ("no function words", BAD, (("function_share", 0.0, 0.02),)),
    ("odd word lengths", BAD, (("mean_word", 0.0, 2.0),)),
    ("overlong words", BAD, (("mean_word", 14.0, math.inf),)),
    (
        "reads like prose",
        GOOD,
        (("function_share", 0.06, 0.7), ("symbol_share", 0.0, 0.01), ("capital_share", 0.0, 0.2)),
    ),
    (
        "says something new",
        GOOD,
        (("repeat_share", 0.0, 0.15), ("line_share", 0.0, 0.1), ("symbol_share", 0.0, 0.02)),
    ),
)
#: Function words of the languages in the corpus. Fixed values.
FUNCTION_WORDS = (
    "the of and a to in is that it was for on with "
    "der die und das den ein zu von mit sich auf für "
    "le la de les des un une et en que du est "
    "el los las y por con para no lo del se"
).split()

ROUNDS = 60
#: Votes added to every count, so that no chance becomes 0.
PRIOR_VOTES = 1.0


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _repeated_window_words(words: Column) -> Column:
    """Words lying in a 3-word window that the text has at least twice."""

    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        )

    def starts(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            def same(i, j):
                return F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))

            marked = F.transform(
                s, lambda x, i: F.when(same(i, i - 1) | same(i, i + 1), x["i"])
            )
            return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))

        return _let(ordered, twice)

    def covered(positions: Column) -> Column:
        first = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(
            positions,
            first,
            lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(p - a["last"], F.lit(3))).alias("n")),
            lambda a: a["n"],
        )

    def counted(hashes: Column) -> Column:
        none_twice = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(none_twice, F.lit(0)).otherwise(covered(starts(hashes)))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(_let(windows(words), counted))


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def with_statistics(docs: DataFrame) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the shares that
    the rules look at (in ``_s``)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE, -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = F.struct(
        F.size("_words").cast("bigint").alias("n_words"),
        _without(text, " \t\n\x0b\x0c\r").cast("bigint").alias("word_chars"),
        (F.length(text) - _without(text, SYMBOLS)).cast("bigint").alias("n_symbols"),
        _repeated_window_words(F.col("_words")).cast("bigint").alias("n_repeat_words"),
        (F.length(text) - _without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÊÀÇÑÓÍÁÚ")).alias("capitals"),
        (F.length(text) - _without(text, "!?")).alias("exclaims"),
        F.size(F.array_distinct("_words")).alias("distinct"),
        F.size(F.filter("_words", lambda w: w.isin(FUNCTION_WORDS))).alias("function_words"),
    )
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    kept = [c for c in docs.columns if c not in (*ADDED, "text")]
    counted = (
        docs.drop(*ADDED)
        .withColumns({"_words": words, "_lines": lines})
        .select(
            *kept,
            "text",
            base.alias("_b"),
            F.size("_lines").cast("bigint").alias("_n_lines"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        )
        .select(*kept, "text", "_b.*", "_n_lines", "n_dup_lines")
    )
    shares = {
        "symbol_share": F.col("n_symbols") / chars,
        "capital_share": F.col("capitals") / chars,
        "mean_word": F.col("word_chars") / n,
        "repeat_share": F.col("n_repeat_words") / n,
        "line_share": F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)),
        "distinct_share": F.col("distinct") / n,
        "exclaim_share": F.col("exclaims") / chars,
        "words_per_line": n / F.greatest(F.col("_n_lines"), F.lit(1)),
        "function_share": F.col("function_words") / n,
    }
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumns(
        {"base_failed": failed, "_s": F.struct(*(v.alias(k) for k, v in shares.items()))}
    ).drop("capitals", "exclaims", "distinct", "function_words", "_n_lines")


def vote(rule) -> Column:
    _, says, ranges = rule
    # Without words there is nothing to look at.
    holds = F.col("n_words") > 0
    for statistic, least, most in ranges:
        holds = holds & F.col(f"_s.{statistic}").between(least, most)
    return F.when(holds, F.lit(says)).otherwise(F.lit(ABSTAIN))


def pattern_of_votes() -> Column:
    """All votes as one text, a character per rule: + - 0."""
    return F.concat(
        *(F.when(v == GOOD, "+").when(v == BAD, "-").otherwise("0") for v in map(vote, RULES))
    )


def fit_accuracies(counts: dict[str, int], rounds: int = ROUNDS) -> dict[str, float]:
    """Pattern counts to posteriors of "good", by expectation-maximisation.

    Rules vote independently given the class. It starts from the majority of votes (each good vote
    counts against each bad one), so the classes keep their meaning.
    """
    if not counts:
        return {}
    total = sum(counts.values())

    def start(p: str) -> float:
        return 1 / (1 + math.exp(-(p.count("+") - 3 * p.count("-"))))

    posterior = {p: start(p) for p in counts}
    for _ in range(rounds):
        share = sum(posterior[p] * n for p, n in counts.items())
        prior = (share + PRIOR_VOTES) / (total + 2 * PRIOR_VOTES)
        good, bad = {}, {}
        for p, n in counts.items():
            for j, v in enumerate(p):
                good[j, v] = good.get((j, v), PRIOR_VOTES) + posterior[p] * n
                bad[j, v] = bad.get((j, v), PRIOR_VOTES) + (1 - posterior[p]) * n
        spare = 3 * PRIOR_VOTES
        for p in counts:
            ratio = math.log(prior / (1 - prior))
            for j, v in enumerate(p):
                ratio += math.log(good[j, v] / (share + spare))
                ratio -= math.log(bad[j, v] / (total - share + spare))
            posterior[p] = 1 / (1 + math.exp(-max(-500.0, min(500.0, ratio))))
    return posterior


ADDED = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
    "votes", "quality", "kept",
)


def judge_quality(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without its text, with the statistics, votes, posterior quality and the verdict.

    ``kept`` is false where the base rules fail, else whether the posterior is at least ``least``.
    """
    spark = docs.sparkSession
    stated = with_statistics(docs).withColumn("votes", pattern_of_votes()).drop("_s", "text")
    # Estimation and verdict both read it; texts are looked at once.
    stated = materialized(stated, "rule-votes")
    counts = {r["votes"]: r["count"] for r in stated.groupBy("votes").count().collect()}
    posteriors = spark.createDataFrame(
        sorted(fit_accuracies(counts).items()), "votes string, quality double"
    )
    judged = stated.join(F.broadcast(posteriors), "votes", "left")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge_quality(docs).select("doc_id", *ADDED)
