"""URL filters: pattern rules, indexed by their rarest literal token.

A rule is a host and the start of a path, written together, as example.org/es/. It fits the host and all its subdomains if the
path starts with the rule's. Each rule is filed under one token that every URL it fits must hold: of the labels of its host
and the segments of its path that end in a slash, the one that fewest rules hold (of those the longest, then the last by code
points). The tokens of a URL fetch candidates from this index, and only those run their regular expression. DataFrame
functions only.

Cases: a null URL, or one without ://, has an empty host and path and fits no rule; so does a URL whose path is empty, as
every rule has a slash; of the rules that fit the longest decides, of equally long ones a block, then the first by code points;
no rule: `otherwise`; repeated rows each get their row; an empty table of pages or of rules is no special case; other
columns are left alone, and one named like a result, in capitals or not, gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import other_columns

RULES = "host string, path string, verdict string"
#: Bytes of the rule index up to which it goes to every executor; a larger one is shuffled to the tokens instead.
SMALL = 8 << 20


def url_host(url: Column) -> Column:
    """From the first :// to the next /, ?, # or the end, A-Z lower-cased; else empty."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), upper, lower)


def url_path(url: Column) -> Column:
    """From the end of the host to ?, # or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def literals(host: Column, path: Column) -> Column:
    """The distinct tokens of a host and a path: labels, and segments that end in a slash. Labels start with a dot, segments with a slash."""
    labels = F.transform(F.split(host, r"\."), lambda t: F.concat(F.lit("."), t))
    parts = F.split(path, "/")
    segments = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda t: F.concat(F.lit("/"), t))
    return F.array_distinct(F.concat(labels, segments))


def rule_index(rules: DataFrame) -> DataFrame:
    """token, rule, verdict, pattern: one row a distinct rule, under its rarest token."""
    quoted = F.regexp_replace("rule", r"([^A-Za-z0-9/])", r"\\$1")
    own = rules.where("host is not null and path is not null").select(
        F.concat("host", "path").alias("rule"), "verdict", F.explode(literals(F.col("host"), F.col("path"))).alias("token")
    )
    held = own.groupBy("token").agg(F.countDistinct("rule").alias("n"))
    rarest = F.max(F.struct((-F.col("n")).alias("few"), F.length("token").alias("chars"), "token")).alias("best")
    one = own.join(held, "token").groupBy("rule").agg(rarest, F.max("verdict").alias("verdict"))  # block, where a rule says both
    return one.select(F.col("best.token").alias("token"), "rule", "verdict", F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), quoted).alias("pattern"))


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", otherwise: str = "allow", small: int = SMALL) -> DataFrame:
    """The columns of pages, with host, path, rule (null if none fits) and verdict; columns of these names are replaced."""
    index = rule_index(rules)
    bytes_ = index.agg(F.coalesce(F.sum(F.length("token") + F.length("rule") + F.length("pattern") + F.length("verdict") + 64), F.lit(0))).first()[0]
    if bytes_ <= small:
        index = F.broadcast(index)
    whole = pages.select(F.struct("*").alias("row"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    found = (
        whole.select("host", "path")
        .distinct()  # what a URL gets depends on these alone
        .select("host", "path", F.explode(literals(F.col("host"), F.concat("path", F.lit("/")))).alias("token"))
        .join(index, "token")
        .where(F.expr("concat(host, path) rlike pattern"))
        .groupBy("host", "path")
        .agg(F.min(F.struct((-F.length("rule")).alias("short"), F.when(F.col("verdict") == "block", 0).otherwise(1).alias("kind"), "rule", "verdict")).alias("best"))
    )
    kept = [F.col("row").getField(c).alias(c) for c in other_columns(pages, "host", "path", "rule", "verdict")]
    out = whole.join(found, ["host", "path"], "left")
    return out.select(*kept, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
