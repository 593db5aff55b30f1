"""The repair loop as windows over a table of attempts.

Every operator first cuts a test's attempts to the allowed number.  Spark turns
that row-number filter into a per-task group limit before the shuffle, so a test
with any number of rows sends a handful per map task, and all later windows and
lists hold at most that many rows per test.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.fqn import elapsed_seconds


def number_attempts(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                    limit: int = rules.MAX_ATTEMPTS) -> DataFrame:
    """Add ``iter`` 0..limit-1 in the given order; later attempts are dropped."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= limit)
        .withColumn("iter", F.col("_rn") - 1)
        .drop("_rn")
    )


def mark_kept(attempts: DataFrame, keys: Sequence[str], passed: Column) -> DataFrame:
    """Add ``kept``: no earlier attempt of the test has passed."""
    before = Window.partitionBy(*keys).orderBy("iter").rowsBetween(Window.unboundedPreceding, -1)
    return attempts.withColumn("kept", ~F.coalesce(F.bool_or(passed).over(before), F.lit(False)))


def until_pass(attempts: DataFrame, keys: Sequence[str], passed: Column) -> DataFrame:
    """Attempts up to and including the first that passes."""
    return mark_kept(attempts, keys, passed).filter("kept").drop("kept")


def previous_evidence(attempts: DataFrame, keys: Sequence[str], evidence: Column,
                      initial: Column, applied: Column, name: str = "seen") -> DataFrame:
    """Evidence attempt k is shown: that of the last applied attempt, else the initial run's."""
    before = Window.partitionBy(*keys).orderBy("iter").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(applied, evidence), ignorenulls=True).over(before)
    return attempts.withColumn(name, F.coalesce(last, initial))


def carry_forward(attempts: DataFrame, keys: Sequence[str], values: dict[str, Column],
                  applied: Column) -> DataFrame:
    """Values after attempt k; an attempt that was not applied keeps the earlier ones."""
    upto = Window.partitionBy(*keys).orderBy("iter").rowsBetween(Window.unboundedPreceding, 0)
    return attempts.withColumns(
        {n: F.last(F.when(applied, v), ignorenulls=True).over(upto) for n, v in values.items()}
    )


def outcome_columns(passed: Column, patch: Column | None = None, ts: str | None = None,
                    limit: int = rules.MAX_ATTEMPTS) -> list[Column]:
    """Aggregates over the numbered attempts of a test.

    ``is_fixed``, ``fixed_at``, ``attempts_used``, the patch of the first pass,
    and the seconds from the first to the last attempt used.
    """
    first = F.min(F.when(passed, F.col("iter")))
    n = F.count(F.lit(1))
    aggs = [
        first.isNotNull().alias("is_fixed"),
        first.alias("fixed_at"),
        F.coalesce(first + 1, F.least(n, F.lit(limit))).cast("int").alias("attempts_used"),
    ]
    if patch is not None:
        aggs.append(F.min_by(patch, F.when(passed, F.col("iter"))).alias("final_patch"))
    if ts is not None:
        aggs.append(elapsed_seconds(F.min(ts), finish_time(passed, ts)).alias("elapsed_s"))
    return aggs


def finish_time(passed: Column, ts: str) -> Column:
    """Time of the first pass, else of the last attempt (an aggregate)."""
    return F.coalesce(F.min_by(ts, F.when(passed, F.col("iter"))), F.max(ts))


def loop_outcome(attempts: DataFrame, keys: Sequence[str], passed: Column,
                 patch: Column | None = None, ts: str | None = None,
                 limit: int = rules.MAX_ATTEMPTS) -> DataFrame:
    """Outcome of numbered attempts per test in one aggregate."""
    return attempts.groupBy(*keys).agg(*outcome_columns(passed, patch, ts, limit))


def repair_outcomes(initial: DataFrame, attempts: DataFrame, order: Sequence[str],
                    key: str = "test_id", limit: int = rules.MAX_ATTEMPTS,
                    started: str | None = None, ended: str | None = None,
                    extra: Sequence[Column] = ()) -> DataFrame:
    """Outcome of every test.

    ``initial`` has ``test_id, initial_summary``; ``attempts`` has ``test_id,
    applied, summary, patch, ts``.  Tests whose initial run passes are skipped,
    those whose initial run is not a failure keep that verdict as their status,
    the others are fixed or unresolved.  With the names of the initial run's
    ``started`` and ``ended`` columns the time counts from its start, also for
    tests without attempts.  ``extra`` aggregates join the one pass over the
    attempts and may use the flag ``kept``.
    """
    failing = initial.filter(F.col("initial_summary") == rules.FAILURE).select(key)
    tried = number_attempts(
        attempts.join(failing, key, "left_semi"), [key], order, limit
    )
    passed = F.col("applied") & (F.col("summary") == rules.PASS)
    aggs = [*outcome_columns(passed, F.col("patch"), "ts", limit), *extra]
    if started and ended:
        aggs.append(finish_time(passed, "ts").alias("_finished"))
    if extra:
        tried = mark_kept(tried, [key], passed)
    done = tried.groupBy(key).agg(*aggs)
    status = (
        F.when(F.col("initial_summary") == rules.PASS, F.lit(rules.SKIPPED))
        .when(F.col("initial_summary") != rules.FAILURE, F.col("initial_summary"))
        .when(F.col("is_fixed"), F.lit(rules.FIXED))
        .otherwise(F.lit(rules.UNRESOLVED))
    )
    out = (
        initial.join(done, key, "left")
        .withColumn("status", status)
        .withColumn("attempts_used", F.coalesce("attempts_used", F.lit(0)))
        .drop("is_fixed")
    )
    if started and ended:
        finish = F.coalesce(F.col("_finished"), F.col(ended))
        out = out.withColumn("elapsed_s", elapsed_seconds(F.col(started), finish))
    return out.drop("_finished")


def log_column(values: Sequence[str], logged: Column | None = None) -> Column:
    """Aggregate of numbered attempts: map from iteration (text) to its values."""
    entry = F.struct(F.col("iter"), F.struct(*values).alias("value"))
    # by the iteration alone: values may hold maps, which have no order
    listed = F.array_sort(
        F.collect_list(entry if logged is None else F.when(logged, entry)), lambda a, b: a["iter"] - b["iter"]
    )
    return F.map_from_entries(
        F.transform(
            listed,
            lambda e: F.struct(e["iter"].cast("string").alias("key"), e["value"].alias("value")),
        )
    ).alias("intermediate_log")


def attempt_log(attempts: DataFrame, keys: Sequence[str], *values: str,
                limit: int = rules.MAX_ATTEMPTS) -> DataFrame:
    """Nested log: map from iteration (text) to its values.

    Needs numbered attempts; the list per test holds at most ``limit`` entries.
    """
    return attempts.filter(F.col("iter") < limit).groupBy(*keys).agg(log_column(values))
