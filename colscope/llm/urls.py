"""URL verdicts: host and path rules, and pattern rules indexed by their rarest literal token.

A pattern is a piece of URL in lower case with ``*`` (anything), ``^`` (a separator or the end), ``||`` in front (a
label of the host) and ``|`` at either end (that end of the URL).  Its whole tokens, runs of letters and digits with a
literal border on both sides, must stand in every URL it fits; it is filed under the one that is rarest in the URLs at
hand.  A URL's tokens fetch the rules filed under them, and only those run as regular expressions.  All of it is
DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, named

# Host and path rules, the longest that fits wins.
HOST_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
              ("block", "com/de/")]
# Pattern rules that block.
PATTERNS = [
    "||cheap-pills.", "||casino.", "||poker-online.", "||free-money.", "||click-bait.", "||spam.", "||malware.",
    "/adserver/", "/banner-ads/", "/affiliate-id=", "/wp-login.php|", "/.git/config|", "/phpmyadmin^", "?sessionid=",
    "&sid=*&tracking=", "/xxx^", ".exe|", ".apk|", "/torrent^*magnet",
]
TOKEN = "[a-z0-9]+"
MAX_BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of a short list of host and path rules that fits, else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + start))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def pattern_table(spark: SparkSession, patterns: list[str]) -> DataFrame:
    return spark.createDataFrame([(p,) for p in patterns], "pattern string")


def _regex(pattern: Column) -> Column:
    """The pattern as a regular expression over a lower-case URL."""
    out = F.regexp_replace(F.translate(pattern, "^", "\x01"), r"([.+?(){}\[\]\\$-])", r"\\$1")
    out = F.regexp_replace(out, r"\*", ".*")
    out = F.regexp_replace(out, r"^\|\|", "^[^/]*://([^/?#]*[.])?")
    out = F.regexp_replace(F.regexp_replace(out, r"^\|", "^"), r"\|$", r"\$")
    return F.regexp_replace(out, "\x01", "([^a-z0-9._%-]|\\$)")


def _tokens(pattern: Column) -> Column:
    """Whole tokens of a pattern: bordered by literal characters, so never part of a longer run in a URL."""
    return F.regexp_extract_all(pattern, F.lit(rf"(?<![a-z0-9*])(?<!^)({TOKEN})(?![a-z0-9*])(?!$)"), F.lit(1))


def rule_index(patterns: DataFrame, urls: DataFrame) -> DataFrame:
    """(token, pattern, regex): each pattern under its token that the fewest URLs have; none: under the empty token."""
    patterns = patterns.filter(F.col("pattern").isNotNull()).select(ascii_lower(F.col("pattern")).alias("pattern"))
    patterns = patterns.distinct()
    own = patterns.select("pattern", F.explode_outer(_tokens(F.col("pattern"))).alias("token"))
    wanted = own.select("token").filter(F.col("token").isNotNull()).distinct()
    seen = urls.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ranked = own.join(seen.join(wanted, "token", "left_semi"), "token", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("token", F.lit("")).alias("token")))
    chosen = ranked.groupBy("pattern").agg(rarest.alias("r"))
    return chosen.select("r.token", "pattern", _regex(F.col("pattern")).alias("regex"))


def match_patterns(pages: DataFrame, patterns: DataFrame, url: str = "url") -> DataFrame:
    """(url, pattern): for each distinct URL that some pattern fits, the first of those in order of their text.

    The index is broadcast up to ``MAX_BROADCAST_RULES`` rules, which are counted; beyond, it is joined by token, and
    tokens that no rule is filed under are taken out first, so frequent tokens are not dealt to one task.
    """
    urls = pages.select(named(url).cast("string").alias("url")).filter(F.col("url").isNotNull()).distinct()
    urls = urls.select("url", ascii_lower(F.col("url")).alias("small"))
    urls = urls.withColumn("tokens", F.array_distinct(F.regexp_extract_all("small", F.lit(TOKEN), F.lit(0))))
    index = rule_index(patterns, urls)
    if patterns.count() <= MAX_BROADCAST_RULES:
        index = F.broadcast(index)
    each = urls.select("url", "small", F.explode(F.array_append("tokens", "")).alias("token"))
    fetched = each.join(index, "token").filter("small rlike regex")
    return fetched.groupBy("url").agg(F.min("pattern").alias("pattern"))


def judge(pages: DataFrame, patterns: DataFrame, rules: list[tuple[str, str]] | None = None, id: str = "page_id",
          url: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, pattern) of every row.

    The longest host and path rule decides; without one, a URL that a pattern fits is blocked and any other allowed.
    A null URL, or one without ``://``, has an empty host and path.  Repeated rows are judged alike, null ids stay,
    other columns are not looked at, and no rows give no rows.
    """
    rules = HOST_RULES if rules is None else rules
    matched = match_patterns(pages, patterns, url).withColumnRenamed("url", "u")
    own = pages.select(named(id).alias("i"), named(url).cast("string").alias("u")).join(matched, "u", "left")
    own = own.withColumn("host", host_of(F.col("u"))).withColumn("path", path_of(F.col("u")))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    by_pattern = F.when(F.col("pattern").isNotNull(), "block").otherwise("allow")
    return own.select(F.col("i").alias(id), "host", "path", rule.alias("rule"),
                      F.coalesce(verdict, by_pattern).alias("verdict"), "pattern")
