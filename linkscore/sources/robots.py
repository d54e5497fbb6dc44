"""Robots rules: reading the rule files and deciding which pages may be processed.

Rule files arrive as a table ``(host, robots_txt)``, one row per host in any case of letters. Pages are decided on their
``(page_id, url)`` alone; markup takes no part in a shuffled join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkscore.functions import text as tx
from linkscore.functions import urls as ux
from linkscore.operators.skew import pieces, salted_join

# Fixed value: the agent that pages are fetched as.
USER_AGENT = (
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) "
    "Chrome/91.0.4472.124 Safari/537.36"
)
# Rules up to this many hosts and characters are broadcast to the pages.
MAX_BROADCAST_HOSTS = 100_000
MAX_BROADCAST_CHARS = 64_000_000

_LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
# Lines that count as content of an agent's block.
_BLOCK_FIELDS = ("allow", "disallow", "crawl-delay", "request-rate")


def _decoded(text: Column) -> Column:
    """Percent-decoded text; a plus sign stays, malformed escapes leave the text as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def _without_empty_parts(target: Column) -> Column:
    """An empty query or fragment is not part of a target."""
    no_fragment = F.regexp_replace(target, r"#$", "")
    return F.regexp_replace(no_fragment, r"^([^?#]*)\?(#|$)", "$1$2")


def request_target(url: Column) -> Column:
    """Decoded path, query and fragment of a URL, ``/`` when there is none."""
    rest = F.regexp_extract(_decoded(url), r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?(.*)$", 1)
    target = _without_empty_parts(rest)
    return F.when(target == "", "/").otherwise(target)


def host_of(url: Column) -> Column:
    return F.lower(ux.url_netloc(url))


def _lines(files: DataFrame) -> DataFrame:
    """Rule file lines with the number of the agent block they belong to.

    Hosts are compared in lower case. Of several files of one host the first in text order counts.
    """
    one_each = files.groupBy(F.lower("host").alias("host")).agg(F.min("robots_txt").alias("robots_txt"))
    lines = one_each.select(
        "host", F.posexplode(F.split("robots_txt", _LINE_ENDS)).alias("seq", "line")
    )
    content = F.regexp_extract("line", r"^([^#]*)", 1)
    split = lines.select(
        "host",
        "seq",
        F.when(F.col("line") == "", "blank")
        .otherwise(F.lower(tx.trim_spaces(F.regexp_extract(content, r"^([^:]*):", 1))))
        .alias("field"),
        _decoded(tx.trim_spaces(F.regexp_extract(content, r"^[^:]*:(.*)$", 1))).alias("value"),
    ).filter(F.col("field").isin("blank", "user-agent", *_BLOCK_FIELDS))

    in_file = Window.partitionBy("host").orderBy("seq")
    starts = (F.col("field") == "user-agent") & (
        F.coalesce(F.lag("field").over(in_file), F.lit("blank")) != "user-agent"
    )
    numbered = split.withColumn("starts", starts.cast("int")).withColumn(
        "block", F.sum("starts").over(in_file)
    )
    # A blank line ends its block: rules behind it, up to the next agent line, are nobody's.
    blank = (F.col("field") == "blank").cast("int")
    ended = F.max(blank).over(Window.partitionBy("host", "block").orderBy("seq"))
    return numbered.withColumn("ended", ended).filter((F.col("block") > 0) & (F.col("ended") == 0))


def agent_rules(files: DataFrame, user_agent: str = USER_AGENT) -> DataFrame:
    """``(host, rules)``: the rules that apply to the agent, as an array in file order.

    Of the blocks that name the agent the first applies, otherwise the first block for ``*``; a
    block that also names ``*`` is one for ``*``. Blocks without content do not count. An array
    holds rules of one file, so it is no longer than one input row.
    """
    agent = user_agent.split("/")[0].lower()
    is_agent = F.col("field") == "user-agent"
    is_rule = F.col("field").isin("allow", "disallow")
    rule = F.struct(
        "seq",
        ((F.col("field") == "allow") | (F.col("value") == "")).alias("allow"),
        _without_empty_parts(F.col("value")).alias("prefix"),
    )
    names_agent = F.lit(agent).contains(F.lower("value"))
    blocks = _lines(files).groupBy("host", "block").agg(
        F.max(F.when(is_agent, F.col("value") == "*")).alias("is_default"),
        F.max(F.when(is_agent, names_agent)).alias("names_agent"),
        F.max(~is_agent).alias("has_content"),
        F.sort_array(F.collect_list(F.when(is_rule, rule))).alias("rules"),
    )
    usable = blocks.filter(
        F.col("has_content") & (F.col("is_default") | F.col("names_agent"))
    )
    preference = F.struct("is_default", "block")
    return usable.groupBy("host").agg(F.min_by("rules", preference).alias("rules"))


def is_allowed(target: Column, rules: Column) -> Column:
    """The first rule whose prefix fits decides; no rule, no restriction."""
    fitting = F.filter(rules, lambda r: F.startswith(target, r["prefix"]))
    return F.coalesce(F.get(fitting, F.lit(0))["allow"], F.lit(True))


def rules_are_small(rules: DataFrame) -> bool:
    """Whether the rules are small enough to be sent to every executor."""
    chars = F.aggregate("rules", F.lit(0), lambda n, r: n + F.length(r["prefix"]) + 16)
    hosts, size = rules.agg(F.count(F.lit(1)), F.coalesce(F.sum(chars), F.lit(0))).first()
    return hosts <= MAX_BROADCAST_HOSTS and size <= MAX_BROADCAST_CHARS


def with_decision(pages: DataFrame, rules: DataFrame, small: bool | None = None) -> DataFrame:
    """Pages with ``allowed``.

    Small rules are broadcast and the pages stay where they are. Otherwise both sides are shuffled
    by host, the pages of a host over many tasks: then hand in ``(page_id, url)`` only.
    """
    small = rules_are_small(rules) if small is None else small
    keyed = pages.withColumn("host", host_of(F.col("url")))
    if small:
        joined = keyed.join(F.broadcast(rules), "host", "left")
    else:
        dealt = pieces(keyed.select("host"), ["host"])
        joined = salted_join(keyed, rules, ["host"], F.col("page_id"), "left", dealt)
    allowed = is_allowed(request_target(F.col("url")), F.col("rules"))
    return joined.withColumn("allowed", allowed).drop("host", "rules")


def robots_errors(decided: DataFrame) -> DataFrame:
    """Error records of the pages that rules disallow."""
    reason = F.concat(
        F.lit("Refused by the rules of its host: "),
        F.col("url"),
    )
    return decided.filter(~F.col("allowed")).select(
        F.lit("robots_txt_error").alias("error"), reason.alias("message"), "url"
    )
