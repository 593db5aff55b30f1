"""Running values over ordered sequences of unbounded length.

A window partitioned by a key puts all rows of the key into one task.  Here every
sequence is cut into chunks that follow its order (for example hours): values run
inside each chunk, a small table of chunk totals gives every chunk its start value,
and both are joined on (key, chunk).  The rows are shuffled once, by (key, chunk), so
a key with a third of all rows is spread over its chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = Sequence[str]
# Keys and chunk as structs: never null themselves, and equal when their null
# fields agree, so windows, totals and the join share one hash partitioning.
_KEY, _CHUNK = "_key", "_chunk"


def time_chunk(ts: str, unit: str = "hour") -> Column:
    """Chunk by calendar unit; choose it so that one key's unit fits one task."""
    return F.date_trunc(unit, F.col(ts))


def _chunked(df: DataFrame, keys: Sequence[str], chunk: Column, values: dict[str, Column]) -> DataFrame:
    """Add key, chunk and value columns."""
    return df.withColumns({
        _KEY: F.struct(*keys), _CHUNK: F.struct(chunk.alias("c")),
        **{f"_v_{name}": value for name, value in values.items()},
    })


def _inside(order: Order, upper: int):
    by = Window.partitionBy(_KEY, _CHUNK).orderBy(*order)
    return by.rowsBetween(Window.unboundedPreceding, upper)


def _before():
    by = Window.partitionBy(_KEY).orderBy(_CHUNK)
    return by.rowsBetween(Window.unboundedPreceding, -1)


def _finish(local: DataFrame, starts: DataFrame, values: dict[str, Column], combine) -> DataFrame:
    out = local.join(starts, [_KEY, _CHUNK])
    out = out.withColumns({n: combine(F.col(f"_s_{n}"), F.col(f"_l_{n}")) for n in values})
    return out.drop(_KEY, _CHUNK, *[f"_{p}_{n}" for n in values for p in "vsl"])


def running_sums(df: DataFrame, keys: Sequence[str], order: Order, chunk: Column,
                 values: dict[str, Column]) -> DataFrame:
    """Add inclusive running sums of ``values`` per key in the given order."""
    rows = _chunked(df, keys, chunk, values)
    totals = rows.groupBy(_KEY, _CHUNK).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    starts = totals.select(
        _KEY, _CHUNK,
        *[F.coalesce(F.sum(f"_t_{n}").over(_before()), F.lit(0)).alias(f"_s_{n}") for n in values],
    )
    local = rows.withColumns(
        {f"_l_{n}": F.sum(f"_v_{n}").over(_inside(order, 0)) for n in values}
    )
    return _finish(local, starts, values, lambda start, inside: start + inside)


def last_known(df: DataFrame, keys: Sequence[str], order: Order, chunk: Column,
               values: dict[str, Column], include_current: bool = True) -> DataFrame:
    """Add the last non-null value so far (with or without the current row)."""
    rows = _chunked(df, keys, chunk, values)
    position = F.struct(*order)
    totals = rows.groupBy(_KEY, _CHUNK).agg(
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), position)).alias(f"_t_{n}")
          for n in values]
    )
    starts = totals.select(
        _KEY, _CHUNK,
        *[F.last(f"_t_{n}", ignorenulls=True).over(_before()).alias(f"_s_{n}") for n in values],
    )
    upper = 0 if include_current else -1
    local = rows.withColumns(
        {f"_l_{n}": F.last(f"_v_{n}", ignorenulls=True).over(_inside(order, upper))
         for n in values}
    )
    return _finish(local, starts, values, lambda start, inside: F.coalesce(inside, start))


def balanced_regions(df: DataFrame, keys: Sequence[str], order: Order, chunk: Column,
                     opens: Column, closes: Column) -> DataFrame:
    """Balanced regions of an ordered row sequence.

    Depth is the running ``opens - closes``.  A region ends where the depth
    comes back to 0 from above; ``region_id`` counts the ends before a row.
    Rows keep ``position`` (1-based), ``depth`` and ``is_close``.
    """
    delta = opens - closes
    depth = running_sums(
        df.withColumn("_delta", delta), keys, order, chunk,
        {"depth": F.col("_delta"), "position": F.lit(1)},
    )
    ends = (F.col("depth") == 0) & (F.col("_delta") < 0)
    closed = running_sums(
        depth.withColumn("is_close", ends), keys, order, chunk,
        {"_ends": F.col("is_close").cast("int")},
    )
    return closed.withColumn(
        "region_id", F.col("_ends") - F.col("is_close").cast("int")
    ).drop("_delta", "_ends")


def region_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per region: bounds, size, closed, and a flag for negative depth."""
    return rows.groupBy(*keys, "region_id").agg(
        F.min("position").alias("start_pos"),
        F.max("position").alias("end_pos"),
        F.count(F.lit(1)).alias("n_rows"),
        F.bool_or("is_close").alias("is_closed"),
        (F.min("depth") < 0).alias("is_negative"),
    )
