"""URL filter: rules on host suffixes and path prefixes, found by hash prefix.

A url is expanded into the expressions (host suffix, path prefix) that any rule could have,
the expressions meet the rules on the first 32 bits of their SHA-256, full digests confirm the
match, and the longest fitting rule decides. Only built-in functions; no Python runs in tasks.

Defined cases: a null url, or one without ``://``, has an empty host and path and gets the
default verdict; so does a url that no rule fits. Of several rules of one length the one with
the longer host wins; of rules with the same host and path, ``block`` wins. Repeated rows are
judged alike and all kept. Empty tables of urls or rules are allowed. Rules are taken as
written but for A-Z in hosts, which are lower-cased; rules with a null field are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexalia.llm.rows import stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_AUTHORITY = "^[^/?#]*"
PREFIX_HEX = 8
#: Every expression is dealt over this many salts, each with its own copy of the rules, so that
#: one suffix shared by most urls does not meet in one task.
SALTS = 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path of a url; empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, _AUTHORITY, 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, _AUTHORITY + "([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _depth(host: Column) -> Column:
    return F.size(F.split(host, r"\.", -1))


def rule_table(rules: DataFrame) -> DataFrame:
    """``host, path, verdict`` -> one row per rule with its digest and hash prefix."""
    host = F.translate("host", _UPPER, _LOWER)
    return (rules.select(host.alias("_rh"), F.col("path").alias("_rp"), F.col("verdict").alias("_v"))
            .dropna()
            .groupBy("_rh", "_rp").agg(F.max("_v").alias("_v"))
            .withColumn("_digest", F.sha2(F.concat("_rh", "_rp"), 256))
            .withColumn("_prefix", F.substring("_digest", 1, PREFIX_HEX)))


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """Columns of ``pages`` with ``host, path, rule, verdict``; a column of these names is replaced.

    ``rules`` has ``host, path, verdict`` (``allow`` or ``block``). Urls are judged once each,
    however many rows have them. Only the shapes of rules, (labels in the host, length of the
    path), come to the driver: one row for each such pair, not for each rule.
    """
    table = rule_table(rules)
    shapes = [(r[0], r[1]) for r in
              table.select(_depth(F.col("_rh")), F.length("_rp")).distinct().collect()]
    host, path = host_and_path(F.col("_url"))
    urls = (pages.select(F.col(url_col).alias("_url")).where(F.instr("_url", "://") > 0).distinct()
            .select("_url", host.alias("_host"), path.alias("_path"))
            .withColumn("_labels", F.split("_host", r"\.", -1)))
    n = F.size("_labels")

    def expression(depth: int, length: int) -> Column:
        suffix = F.array_join(F.slice("_labels", n - depth + 1, F.lit(depth)), ".")
        fits = (n >= depth) & (F.length("_path") >= length)
        return F.when(fits, F.concat(suffix, F.substring("_path", 1, length)))

    if not shapes:
        shapes = [(1, 0)]
    expressions = (
        urls.select("_url", F.explode(F.array_compact(F.array(*[expression(*s) for s in shapes]))).alias("_e"))
        .select("_url", F.sha2("_e", 256).alias("_digest"),
                F.pmod(F.xxhash64("_url"), F.lit(SALTS)).cast("int").alias("_salt"))
        .withColumn("_prefix", F.substring("_digest", 1, PREFIX_HEX)))
    salted = (table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
              .withColumnRenamed("_digest", "_rule_digest"))
    found = (expressions.join(salted, ["_prefix", "_salt"])
             .where(F.col("_digest") == F.col("_rule_digest"))
             .groupBy("_url")
             .agg(F.max(F.struct(F.length(F.concat("_rh", "_rp")).alias("n"), F.length("_rh").alias("h"),
                                 F.concat("_rh", "_rp").alias("rule"), F.col("_v").alias("verdict")))
                  .alias("_best")))
    # Written, so that the join deals out both sides and Spark can split a url with many rows.
    found = stage(found, "judged-urls")
    host, path = host_and_path(F.col(url_col))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return (pages.join(found, pages[url_col] == found["_url"], "left")
            .select(*[pages[c] for c in kept], host.alias("host"), path.alias("path"),
                    F.col("_best.rule").alias("rule"),
                    F.coalesce("_best.verdict", F.lit(default)).alias("verdict")))
