"""Line tables: logs and sources as ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import logs, text


def generate(df: DataFrame, keys: Sequence[str], values: Column, name: str) -> DataFrame:
    """One row per array element.

    The outer form plus a null test: a plain ``explode`` makes the optimizer add
    a filter on the array's size, which evaluates a costly ``values`` twice.
    """
    return df.select(*keys, F.explode_outer(values).alias(name)).filter(F.col(name).isNotNull())


def line_table(df: DataFrame, keys: Sequence[str], content: str = "content") -> DataFrame:
    """``(keys..., line_no, line)``, 1-based.  A generator, so no shuffle."""
    return df.select(*keys, F.posexplode(text.lines(F.col(content))).alias("pos", "line")).select(
        *keys, (F.col("pos") + 1).alias("line_no"), "line"
    )


def first_occurrences(table: DataFrame, keys: Sequence[str], value: str = "line",
                      order: str = "line_no") -> DataFrame:
    """Ordered distinct in row form: each value with its first position.

    A hash aggregate with map-side partial results, so a key that holds most
    rows costs one row per distinct value and map task.
    """
    return table.groupBy(*keys, value).agg(F.min(order).alias(order))


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str], *values: str) -> DataFrame:
    """Row form of a first-write-wins map: one mergeable aggregate, no window."""
    return df.groupBy(*keys).agg(*[F.min_by(v, F.struct(*order)).alias(v) for v in values])


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str], *values: str) -> DataFrame:
    """Row form of a last-write-wins map."""
    return df.groupBy(*keys).agg(*[F.max_by(v, F.struct(*order)).alias(v) for v in values])


def joined_lines(df: DataFrame, keys: Sequence[str], *contents: str) -> DataFrame:
    """Ordered distinct lines of several texts, first text first, joined again."""
    values = F.concat(*[text.lines(F.col(c)) for c in contents])
    return df.select(*keys, text.joined(text.ordered_distinct(values)).alias("joined"))


def verdict_by_lines(table: DataFrame, keys: Sequence[str], line: str = "line",
                     verdict_rules: logs.Rules = rules.VERDICT_RULES,
                     default: str = rules.UNRECOGNIZED) -> DataFrame:
    """Verdict from a line table; equals the verdict of the whole text.

    Every marker becomes one boolean that is combined map-side, so only one
    small row per key and map task is shuffled, never a line.
    """
    markers = list(dict.fromkeys(m for _, ms in verdict_rules for m in ms))
    flags = table.groupBy(*keys).agg(
        *[F.bool_or(F.contains(F.col(line), F.lit(m))).alias(f"_m{i}")
          for i, m in enumerate(markers)]
    )
    result = F
    for name, needed in verdict_rules:
        cond = None
        for m in needed:
            flag = F.col(f"_m{markers.index(m)}")
            cond = flag if cond is None else cond & flag
        result = result.when(cond, F.lit(name))
    return flags.select(*keys, result.otherwise(F.lit(default)).alias("verdict"))


def error_line_rows(table: DataFrame, line: str = "line", prefix: str = rules.ERROR_PREFIX,
                    noise: Sequence[str] = rules.ERROR_NOISE) -> DataFrame:
    """Error lines without noise, marker removed."""
    column = F.col(line)
    return table.filter(logs.is_error_line(column, prefix, noise)).withColumn(
        line, text.strip_marker(column, prefix)
    )


def build_outcome_lines(table: DataFrame, line: str = "line",
                        marker: str = rules.BUILD_MARKER) -> DataFrame:
    return table.filter(F.contains(F.col(line), F.lit(marker)))


def build_results(df: DataFrame, keys: Sequence[str], content: str = "content",
                  marker: str = rules.BUILD_MARKER) -> DataFrame:
    """One summary per build log: its keys and its outcome lines on one line."""
    outcome = text.squeeze(F.array_join(logs.build_lines(F.col(content), marker), " "))
    result = F.concat_ws(" ", F.lit("build-result:"), *keys, F.nullif(outcome, F.lit("")))
    return df.select(*keys, result.alias("build_result"))


def merge_update(base: DataFrame, update: DataFrame, keys: Sequence[str],
                 order: Sequence[str] | None = None) -> DataFrame:
    """Left join where the update's non-null values win; new columns are added.

    An update may hold several rows of a key if it has an ``order``: of each column the
    last value that is not null wins, as if the rows were merged one after the other (a
    mergeable aggregate, so a key with many rows is reduced before it is shuffled).
    Without an order its keys must be distinct.
    """
    if order is not None:
        values = [c for c in update.columns if c not in keys and c not in order]
        at = F.struct(*order)
        update = update.groupBy(*keys).agg(
            *[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in values]
        )
    shared = [c for c in update.columns if c in base.columns and c not in keys]
    renamed = update.select(
        *keys, *[F.col(c).alias(f"_new_{c}") for c in update.columns if c not in keys]
    )
    joined = base.join(renamed, list(keys), "left")

    def pick(name: str) -> Column:
        return F.coalesce(F.col(f"_new_{name}"), F.col(name)).alias(name)

    added = [c for c in update.columns if c not in base.columns]
    return joined.select(
        *[pick(c) if c in shared else F.col(c) for c in base.columns],
        *[F.col(f"_new_{c}").alias(c) for c in added],
    )


def merge_maps(old: Column, new: Column) -> Column:
    """Map union where the entries of ``new`` win, independent of session settings."""
    kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_concat(kept, new))
