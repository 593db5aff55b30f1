"""Tables of methods, helpers and fields cut out of sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import javacode, text
from ..functions.text import let


def method_table(sources: DataFrame, keys: Sequence[str], content: str = "content") -> DataFrame:
    """One row per method or constructor with its lines and annotations.

    ``is_unclosed`` marks sources whose braces do not match: their spans are not to
    be trusted.  Outer generators here and below keep the scan from being evaluated a second
    time in an inferred size filter.
    """
    found = sources.select(*keys, content, javacode.scan(F.col(content)).alias("_scan"))
    rows = found.select(
        *keys, content, F.col("_scan.unclosed").alias("is_unclosed"), F.inline_outer("_scan.methods")
    ).filter("name is not null")
    return rows.select(
        *keys,
        F.col("start.line").alias("start_line"),
        F.col("start.column").alias("start_column"),
        F.col("end.line").alias("end_line"),
        F.col("end.column").alias("end_column"),
        "name",
        text.span_slice(F.col(content), F.col("start.line"), F.col("end.line")).alias("code"),
        "annotations",
        "is_constructor",
        "is_unclosed",
    )


def field_table(sources: DataFrame, keys: Sequence[str], content: str = "content") -> DataFrame:
    """One row per field declaration; of several names the first counts."""
    found = sources.select(*keys, content, javacode.scan(F.col(content)).alias("_scan"))
    rows = found.select(
        *keys, content, F.col("_scan.unclosed").alias("is_unclosed"), F.inline_outer("_scan.fields")
    ).filter("name is not null")
    return rows.select(
        *keys, "name", F.col("start_line").alias("line_no"),
        text.span_slice(F.col(content), F.col("start_line"), F.col("end_line")).alias("declaration"),
        "is_unclosed",
    )


def last_method(methods: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last method per name, by position: an aggregate, no window."""
    rest = [c for c in methods.columns if c not in keys and c != "name"]
    picked = methods.groupBy(*keys, "name").agg(
        F.max_by(F.struct(*rest), F.struct("start_line", "start_column")).alias("_m")
    )
    return picked.select(*keys, "name", "_m.*")


def method_of_test(tests: DataFrame, methods: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tests joined with the method of their name; tests without one are kept."""
    return tests.join(last_method(methods, keys), [*keys, "name"], "left")


def helper_rows(methods: DataFrame, keys: Sequence[str],
                before: Sequence[str] = rules.BEFORE_ANNOTATIONS,
                after: Sequence[str] = rules.AFTER_ANNOTATIONS) -> DataFrame:
    """Lifecycle methods, first per (phase, name)."""
    tagged = methods.withColumn("_a", F.explode_outer(F.array_distinct("annotations"))).withColumn(
        "phase",
        F.when(F.col("_a").isin(*before), F.lit("before"))
        .when(F.col("_a").isin(*after), F.lit("after")),
    ).filter("phase is not null")
    picked = tagged.groupBy(*keys, "phase", "name").agg(
        F.min_by(F.struct("start_line", "code"), F.struct("start_line", "start_column")).alias("_m")
    )
    return picked.select(*keys, "phase", "name", "_m.*")


def earliest_lines(table: DataFrame, keys: Sequence[str], line: str = "start_line") -> DataFrame:
    return table.groupBy(*keys).agg(F.min(line).alias("earliest_line"))


def source_structure(content, before: Sequence[str] = rules.BEFORE_ANNOTATIONS,
                     after: Sequence[str] = rules.AFTER_ANNOTATIONS):
    """Everything a prompt needs from a source, per row and without a shuffle.

    ``struct<before, after, earliest_line, helper_method_names, global_vars,
    methods, unclosed>``
    """

    def first_wins(found, wanted):
        hits = F.filter(
            found, lambda m: F.arrays_overlap(m["annotations"], F.array(*map(F.lit, wanted)))
        )
        named = F.array_distinct(F.transform(hits, lambda m: m["name"]))
        return F.transform(
            named,
            lambda n: F.struct(
                n.alias("key"),
                javacode.code_of(
                    content, F.element_at(F.filter(hits, lambda m: m["name"] == n), 1)
                ).alias("value"),
            ),
        )

    def last_wins(found):
        named = F.array_distinct(F.transform(found, lambda f: f["name"]))

        def declaration(n):
            f = F.element_at(F.filter(found, lambda x: x["name"] == n), -1)
            return text.span_slice(content, f["start_line"], f["end_line"])

        return F.transform(
            named, lambda n: F.struct(n.alias("key"), declaration(n).alias("value"))
        )

    def build(s):
        lifecycle = F.filter(
            s["methods"],
            lambda m: F.arrays_overlap(
                m["annotations"], F.array(*map(F.lit, [*before, *after]))
            ),
        )
        return F.struct(
            F.map_from_entries(first_wins(s["methods"], before)).alias("before"),
            F.map_from_entries(first_wins(s["methods"], after)).alias("after"),
            F.array_min(F.transform(s["methods"], lambda m: m["start"]["line"]))
            .alias("earliest_line"),
            F.array_distinct(F.transform(lifecycle, lambda m: m["name"]))
            .alias("helper_method_names"),
            F.map_from_entries(last_wins(s["fields"])).alias("global_vars"),
            s["methods"].alias("methods"),
            s["unclosed"].alias("unclosed"),
        )

    return let(javacode.scan(content), build)
