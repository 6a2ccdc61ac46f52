"""URL filter: rules indexed by their rarest literal token.

A rule is a host and a path prefix. It fits its host and all subdomains when the path of the
URL starts with its own; the longest rule that fits wins. Every rule becomes one regular
expression and is filed under the one of its literal tokens that the fewest URLs hold, counted
over all URLs. The tokens of a URL fetch candidate rules by a join, and only candidates run
their expression. URLs are first reduced to distinct (host, path), so hot URLs cost one row.

Defined results: a URL that is null or has no `://` has an empty host and path, fits no rule
and gets the default verdict; repeated pages give repeated rows; a rule without a token (an
empty host and path, or signs only) is a candidate of every URL; an empty rule table leaves
every URL to the default.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a literal token is, in URLs and in rules.
TOKEN = "[A-Za-z0-9]+"
#: At most so many rules are sent to every task; more are joined by shuffle.
BROADCAST_RULES = 200_000


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rows (action, host, path) as a rule table: rule, action, pattern, tokens.

    The pattern is matched against host, U+0000 and path. A token that ends the path may go on in a
    URL, so it is none of the rule's tokens.
    """
    rows = []
    for action, host, path in rules:
        pattern = rf"^(?:[^\x00]*\.)?{_literal(host)}\x00{_literal(path)}"
        rows.append((host + path, action, pattern, sorted(set(re.findall(TOKEN, f"{host} {re.sub(f'{TOKEN}$', '', path)}")))))
    return spark.createDataFrame(rows, "rule string, action string, pattern string, tokens array<string>")


def _literal(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", text)


def host_of(url: Column) -> Column:
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"(?s)^[^/?#]*(/[^?#]*)?", 1), F.lit(""))


def _rest(url: Column) -> Column:
    """What follows the first `://`, or null."""
    return F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))


def _tokens(targets: DataFrame) -> DataFrame:
    words = F.array_distinct(F.regexp_extract_all(F.concat_ws(" ", "host", "path"), F.lit(f"({TOKEN})"), F.lit(1)))
    return targets.select("host", "path", F.explode(words).alias("token"))


def rule_index(targets: DataFrame, rules: DataFrame, small: bool) -> DataFrame:
    """Each rule under its rarest literal token; ties by the token itself."""
    of_rule = rules.select("rule", "action", "pattern", F.explode("tokens").alias("token"))
    wanted = of_rule.select("token").distinct()
    held = _tokens(targets).join(F.broadcast(wanted) if small else wanted, "token", "left_semi")
    seen = held.groupBy("token").agg(F.count(F.lit(1)).alias("seen"))
    counted = of_rule.join(seen, "token", "left").na.fill({"seen": 0})
    return (counted.groupBy("rule", "action", "pattern")
            .agg(F.min(F.struct("seen", "token"))["token"].alias("token")))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id",
               url_col: str = "url", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """Per page: page_id, host, path, rule (null if none fits) and verdict."""
    parsed = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"),
                          path_of(F.col(url_col)).alias("path"))
    small = rules.limit(broadcast_rules + 1).count() <= broadcast_rules
    targets = parsed.select("host", "path").distinct()
    index = rule_index(targets, rules.filter(F.size("tokens") > 0), small)
    pairs = _tokens(targets).join(F.broadcast(index) if small else index, "token").drop("token")
    bare = rules.filter(F.size("tokens") == 0).select("rule", "action", "pattern").withColumn("always", F.lit(1))
    pairs = pairs.select("host", "path", "rule", "action", "pattern").unionByName(
        targets.withColumn("always", F.lit(1)).join(bare, "always").drop("always"))
    fits = pairs.filter(F.expr("concat(host, '\\0', path) rlike pattern"))
    best = fits.groupBy("host", "path").agg(
        F.max(F.struct(F.char_length("rule").alias("length"), "rule", "action")).alias("best"))
    return parsed.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"))
