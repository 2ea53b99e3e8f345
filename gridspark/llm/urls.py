"""URL rules matched by hash: host-suffix and path-prefix expressions, short hash prefixes, then full digests.

Every distinct URL expands to its host and parent domains combined with the path prefixes whose lengths occur among the
rules. Expressions meet rules in an equi-join on the first 32 bits of SHA-256, the full digests confirm the match, and the
longest rule wins. URLs are made distinct before expanding, so a frequent URL is expanded once; the rules are joined like
any table (Spark broadcasts them only if their size allows).

Rules are rows (host, path, verdict). A rule fits its host and all subdomains if the URL's path starts with the rule's
path. Precedence: longest host and path together, then the longer host, then block over allow, then the rule's text.

Defined cases: a null URL or one without "://" has an empty host and path and fits no rule; an empty path fits only rules
with an empty path; without a fitting rule `rule` is null and the verdict is `otherwise`; repeated pages each get a row;
rules repeated or null in a column are dropped; empty tables work; other columns of the pages are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1),
                                  "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def judge_urls(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict of every page."""
    rules = rules.select("host", "path", "verdict").dropna().distinct().withColumns({
        "rule": F.concat("host", "path"), "digest": F.sha2(F.concat("host", F.lit("\n"), "path"), 256)})
    # the lengths of rule paths: as many numbers as there are different lengths
    lengths = sorted(r.n for r in rules.select(F.length("path").alias("n")).distinct().collect())
    urls = pages.select(F.col(url_col).alias("u")).filter(F.col("u").contains("://")).distinct() \
        .withColumns({"host": host_of(F.col("u")), "path": path_of(F.col("u"))})
    tries = urls.select("u", "path", F.explode(_suffixes(F.col("host"))).alias("suffix"))
    fitting = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("path"))
    tries = tries.select("u", "suffix", F.explode(F.transform(fitting, lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("prefix"))
    tries = tries.withColumn("sought", F.sha2(F.concat("suffix", F.lit("\n"), "prefix"), 256))
    short = lambda c: F.conv(F.substring(c, 1, 8), 16, 10).cast("long")
    found = tries.withColumn("short", short("sought")).join(rules.withColumn("short", short("digest")), "short") \
        .filter("sought = digest")
    rank = F.struct(F.length("rule"), F.length("host"), (F.col("verdict") == "block"), F.col("rule"))
    best = found.groupBy("u").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("best"))
    out = pages.select(F.col(id_col), F.col(url_col).alias("u")).join(best, "u", "left")
    return out.select(id_col, host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"), F.col("best.rule").alias("rule"),
                      F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
