"""URL filters: host-suffix and path-prefix expressions joined with rules on short hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import even_join, hot_keys

#: Rules are broadcast up to this many; more are joined by shuffling.
FEW_RULES = 200_000
#: Longest host or path of a broadcast rule, so that the broadcast's bytes are bounded too.
LONG_RULE = 500
PREFIX = 8  # hex digits of the digest that are joined on


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and all its parents: ``a.b.c``, ``b.c``, ``c``; none for an empty host."""
    labels = F.split(host, r"\.")
    count = F.size(labels)
    return F.when(host != "", F.transform(
        F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(labels, i, count - i + 1), "."))).otherwise(
        F.array().cast("array<string>"))


def path_prefixes(path: Column, lengths: Column) -> Column:
    """The path's beginnings of the lengths that rules have."""
    return F.transform(F.filter(lengths, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))


def judged(
    pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", default: str = "allow",
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each page.

    ``rules`` has ``host, path, verdict``.  A rule fits its host and all subdomains if the
    url's path starts with the rule's.  Of the fitting rules the longest wins (host and path
    in characters; then the longer host, then block before allow).  Pages without one get
    ``default``.  Every url becomes its host-suffix and path-prefix expressions; these meet
    the rules on the first digits of a SHA-256, and the whole digests are compared after.

    Null urls, urls without ``://`` and empty hosts fit no rule.  Null and repeated page ids
    keep one row each; repeated rules count once; rules with nulls or an empty host never
    fit.  Other columns are not read.  The rule table is broadcast only up to ``FEW_RULES``
    rules, none longer than ``LONG_RULE``.
    """
    rules = rules.where("host IS NOT NULL AND host <> '' AND path IS NOT NULL AND verdict IS NOT NULL").select(
        F.col("host").alias("r_host"), F.col("path").alias("r_path"), "verdict").distinct()
    digest = F.sha2(F.concat("r_host", "r_path"), 256)
    # Host and path are joined without a mark, so the split place is part of the key.
    rules = rules.select(
        F.struct(
            (F.length("r_host") + F.length("r_path")).alias("size"), F.length("r_host").alias("host_size"),
            (F.col("verdict") == "block").alias("block"), F.concat("r_host", "r_path").alias("rule"),
            "verdict").alias("best"),
        F.length("r_path").alias("path_size"), F.substring(digest, 1, PREFIX).alias("prefix"), digest.alias("digest"))
    # One rule for each expression: the strongest.
    rules = rules.groupBy("prefix", "digest", "path_size").agg(F.max("best").alias("best"))
    sizes = rules.agg(F.sort_array(F.collect_set("path_size")), F.count(F.lit(1)), F.max("best.size")).first()
    lengths = F.array(*[F.lit(n) for n in sizes[0]]).cast("array<int>")

    cut = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("_url")).select(
        "page_id", url_host(F.col("_url")).alias("host"), url_path(F.col("_url")).alias("path"),
        F.monotonically_increasing_id().alias("row"))
    hosts = cut.withColumn("suffix", F.explode_outer(host_suffixes(F.col("host"))))
    spread = hosts.withColumn("start", F.explode_outer(path_prefixes(F.col("path"), lengths)))
    expression = F.sha2(F.concat("suffix", "start"), 256)
    keyed = spread.select(
        "page_id", "host", "path", "row", F.length("start").alias("path_size"), expression.alias("url_digest"),
        F.substring(expression, 1, PREFIX).alias("prefix"))
    if sizes[1] <= FEW_RULES and (sizes[2] or 0) <= LONG_RULE:
        met = keyed.join(F.broadcast(rules.withColumnRenamed("path_size", "rule_path_size")), "prefix", "left")
    else:
        counts = keyed.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
        grouped = rules.withColumnRenamed("path_size", "rule_path_size").groupBy("prefix").agg(
            F.collect_list(F.struct("digest", "rule_path_size", "best")).alias("found"))
        met = even_join(keyed, grouped, ["prefix"], hot_keys(counts, ["prefix"], "n"), "left").withColumn(
            "one", F.explode_outer("found")).select("*", "one.*").drop("found", "one")
    fits = (F.col("digest") == F.col("url_digest")) & (F.col("rule_path_size") == F.col("path_size"))
    best = met.groupBy("row").agg(
        F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"),
        F.max(F.when(fits, F.col("best"))).alias("best"))
    return best.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
