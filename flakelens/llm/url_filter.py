"""URL rules by hashed host-suffix and path-prefix expressions.

A URL is expanded into the suffixes of its host joined with the prefixes of its
path; of these only those are made that have as many labels as the host, and are as long
as the path, of some rule.  So a URL gives no more expressions than the rules have such
pairs, however long it is.  Expressions meet rules
by an equi join on the first hex digits of their digest, full digests confirm the
match, and the longest rule decides.

Defined cases: null URLs and URLs without ``://`` have an empty host and path and
get the default verdict; a rule without a host fits nothing; of two rules that
differ in the action alone ``block`` wins, of two of one length the longer host;
repeated rows stay; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flakelens.llm.common import ascii_lower, fresh, small, stored

PREFIX_DIGITS = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return ascii_lower(host), path


def label_count(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def expressions(host: Column, path: Column, shapes: Sequence[tuple[int, int]]) -> Column:
    """Host suffixes of so many labels with path prefixes of such a length, for each shape."""
    pairs = F.array(*[F.struct(F.lit(k).alias("labels"), F.lit(n).alias("length")) for k, n in shapes])
    fitting = F.filter(
        pairs.cast("array<struct<labels:int,length:int>>"),
        lambda s: (s["labels"] <= label_count(host)) & (s["length"] <= F.length(path)),
    )
    made = F.transform(
        fitting,
        lambda s: F.concat(F.call_function("substring_index", host, F.lit("."), -s["labels"]), F.substr(path, F.lit(1), s["length"])),
    )
    return F.when(host != "", made)


def hashed_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, action) by digest; equal rules keep ``block``."""
    rule = F.concat("host", "path")
    return (
        rules.filter("host <> '' and path is not null")
        .groupBy(rule.alias("rule"), F.length("host").alias("host_length"), F.length("path").alias("path_length"),
                 label_count(F.col("host")).alias("labels"))
        .agg(F.max("action").alias("action"))
        .withColumn("digest", F.sha2("rule", 256))
        .withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """Per page: id, host, path, the rule that decides (or null) and the verdict."""
    by_digest = stored(hashed_rules(rules), "rules")
    # at most as many as the longest rule has characters, times its labels
    shapes = sorted((r.labels, r.path_length) for r in by_digest.select("labels", "path_length").distinct().collect())
    host, path = host_and_path(F.col(url_col))
    row, = fresh(pages, "_row")
    parsed = pages.select(
        F.col(id_col).alias("id"), host.alias("host"), path.alias("path"),
        F.monotonically_increasing_id().alias(row),
    )
    expanded = parsed.withColumn(
        "expression", F.explode_outer(expressions(F.col("host"), F.col("path"), shapes))
    ).withColumn("full", F.sha2("expression", 256))
    met = expanded.withColumn("short", F.substring("full", 1, PREFIX_DIGITS)).join(
        small(by_digest), "short", "left"
    )
    fits = F.when(
        F.col("full") == F.col("digest"),
        F.struct(F.length("rule").alias("length"), "host_length", "rule", "action"),
    )
    return (
        met.groupBy(row, "id", "host", "path").agg(F.max(fits).alias("best"))
        .select(
            F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
            F.coalesce("best.action", F.lit(default)).alias("verdict"),
        )
    )
