"""URL rules looked up by host suffixes and path prefixes.

A rule is a host and a path; it fits its host and all subdomains when the url's path starts
with the rule's. Each url is expanded into the expressions (host suffix + path prefix) that a
rule could have: suffixes with as many labels, prefixes as long as some rule's. Expressions
are joined with the rules on 32 bits of their SHA-256, then the whole digests are compared.
The longest fitting rule wins; of two equal ones the blocking rule.

Null urls and urls without ``://`` have an empty host and path and fit no rule; a url that no
rule fits gets the default verdict. Rules with a null or empty host are ignored, a null path
counts as empty. Without rules every url gets the default. Urls are judged by their text, so
repeated rows keep their rows. A column named like an added one is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamlog.llm.common import ascii_lower, digest, other_columns

ADDED = ("host", "path", "rule", "verdict")
#: Rules (about 100 bytes each) up to which they are sent to every executor; more are joined
#: by a shuffle, whose hot prefixes adaptive execution splits.
BROADCAST_RULES = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _hashed(expression: Column) -> list[Column]:
    full = F.unhex(F.sha2(expression, 256))
    return [F.substring(full, 1, 4).alias("short"), full.alias("full")]


def _rules(rules: DataFrame) -> DataFrame:
    host, path = ascii_lower(F.col("host")), F.coalesce(F.col("path"), F.lit(""))
    return rules.where((F.col("host") != "") & F.col("verdict").isin("allow", "block")).select(
        F.size(F.split(host, r"\.")).alias("labels"),
        F.length(path).alias("length"),
        F.concat(host, path).alias("rule"),
        F.col("verdict"),
        *_hashed(F.concat(host, F.lit("\n"), path)),
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow"
) -> DataFrame:
    """The pages with ``host, path, rule, verdict``; rules have ``verdict, host, path``."""
    rules = _rules(rules)
    # Label counts and path lengths of the rules: numbers below a few thousand, not rules.
    sizes = rules.agg(
        F.count("*").alias("n"), F.collect_set("labels").alias("labels"), F.collect_set("length").alias("lengths")
    ).first()
    if sizes["n"] <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    host, path = host_and_path(F.col(url))
    urls = pages.select(digest(F.col(url)).alias("key"), host.alias("host"), path.alias("path")).distinct()
    parts = urls.withColumn("names", F.split("host", r"\."))
    numbers = lambda values: F.array(*[F.lit(v) for v in sorted(values)]).cast("array<int>")
    parts = parts.select("key", "path", "names", F.explode(numbers(sizes["labels"])).alias("labels"))
    parts = parts.where(F.size("names") >= F.col("labels"))
    parts = parts.select("key", "path", "names", "labels", F.explode(numbers(sizes["lengths"])).alias("length"))
    parts = parts.where(F.length("path") >= F.col("length"))
    suffix = F.array_join(F.slice("names", -F.col("labels"), F.col("labels")), ".")
    expression = F.concat(suffix, F.lit("\n"), F.substring("path", F.lit(1), F.col("length")))
    asked = parts.select("key", *_hashed(expression))
    fits = asked.join(rules.withColumnRenamed("full", "whole"), "short").where("full = whole")
    best = F.max(F.struct(F.length("rule").alias("n"), F.col("verdict") == "block", "rule", "verdict"))
    found = fits.groupBy("key").agg(best.alias("best"))
    found = found.select(
        F.col("key").alias("__key"),
        F.col("best.rule").alias("__rule"),
        F.col("best.verdict").alias("__verdict"),
    )
    return (
        pages.withColumn("__key", digest(F.col(url)))
        .join(found, "__key", "left")
        .select(
            *other_columns(pages, *ADDED),
            host.alias("host"),
            path.alias("path"),
            F.col("__rule").alias("rule"),
            F.coalesce("__verdict", F.lit(default)).alias("verdict"),
        )
    )
