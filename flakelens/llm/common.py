"""Helpers shared by the operators: texts, names, stored tables and size-checked joins."""

from __future__ import annotations

import string
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flakelens.session import stored  # noqa: F401  (operators import it from here)

# A broadcast side of a few narrow columns stays under some 100 MB per executor.
BROADCAST_ROWS = 1_000_000
ARROW_ROWS = 500


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; texts of one byte per character take the faster function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not use."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession) -> None:
    """Hand rows to Python 500 at a time: with long texts, Spark's default of 10,000 rows
    takes tens of megabytes on both sides of every task.  A lower setting is kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def small(table: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stored table for broadcast if its counted rows allow it.

    Beyond the limit the join shuffles, and adaptive execution splits hot keys.
    """
    return F.broadcast(table) if table.count() <= limit else table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
