"""URL rules by host-suffix and path-prefix expressions.

A rule is a host and a path (``example.org`` + ``/en/1``); it fits its host, all subdomains and
every URL whose path starts with the rule's path. Each distinct URL expands to expressions (each
suffix of its host's labels with each prefix of its path whose length some rule has). Expressions
meet the rules by equi-join on the first 32 bits of their SHA-256; the full digests then
confirm. The longest rule (characters of host and path; then host and path in order) decides; ``block`` goes
before ``allow`` where one expression has both. DataFrame functions only.

Null URLs, and URLs without ``://``, have an empty host and path and no rule. Repeated rows are
judged alike. Rules with a null host or path are ignored; repeated rules count once. An empty
table gives an empty result. Columns other than the id and the URL are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules are broadcast up to this many; beyond it both sides are shuffled on the hash prefix.
BROADCAST_RULES = 20_000
RULES_SCHEMA = "host string, path string, verdict string"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` gives ``a.b.c``, ``b.c``, ``c``; an empty host gives none."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    return F.when(host != "", F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))).otherwise(
        F.array().cast("array<string>")
    )


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def _prefix(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def match_rules(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """urls: (url); rules: (host, path, verdict). One row for each distinct url: url, host, path, rule, verdict."""
    rules = (
        rules.select(lower_ascii(F.col("host")).alias("host"), "path", "verdict")
        .where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(F.concat("host", "path").alias("rule"), "verdict", F.length("path").alias("path_length"))
        .withColumn("rule_digest", _digest(F.col("rule")))
        .withColumn("short", _prefix(F.col("rule_digest")))
    )
    stats = rules.agg(F.count("*").alias("n"), F.collect_set("path_length").alias("lengths")).first()
    lengths = sorted(stats["lengths"]) if stats["n"] else []  # at most the longest path's length
    side = F.broadcast(rules) if stats["n"] <= BROADCAST_RULES else rules

    parts = urls.select("url").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    cuts = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    prefixes = F.transform(F.filter(cuts, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    made = (
        parts.withColumn("prefix", F.explode(prefixes))
        .withColumn("suffix", F.explode(host_suffixes(F.col("host"))))
        .withColumn("digest", _digest(F.concat("suffix", "prefix")))
        .withColumn("short", _prefix(F.col("digest")))
        .select("url", "digest", "short")
    )
    hits = (
        made.join(side, "short")
        .where(F.col("digest") == F.col("rule_digest"))
        .groupBy("url")
        .agg(F.max(F.struct(F.length("rule").alias("len"), "rule", "verdict")).alias("best"))
        .select("url", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    return (
        parts.join(hits.withColumnRenamed("url", "hit_url"), F.col("url").eqNullSafe(F.col("hit_url")), "left")
        .select("url", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
    )


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row for each row of ``pages``: its id, host, path, rule (null if none fits) and verdict."""
    rows = pages.select(F.col(id_col).alias("row_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    judged = match_rules(rows, rules, default)
    return rows.join(judged, "url").select(F.col("row_id").alias(id_col), "host", "path", "rule", "verdict")
