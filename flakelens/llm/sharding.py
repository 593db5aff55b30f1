"""Sharding by weighted rendezvous hashing.

Every shard scores a record's key; the highest score wins.  With a further shard
only records move that score highest there.  Slots number the rows of a shard
without a global order: rows are numbered inside each input partition, and a
small table of counts gives every partition its first slot.

Defined cases: a null text has no bytes (size 1, checksum 0); null keys share one
shard; repeated rows get slots of their own; an empty table gives an empty table;
other columns of the input never matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flakelens.llm.common import small, stored


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest score -weight / ln(u); ties go to the later shard."""
    ids = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])

    def score(shard: Column) -> Column:
        unit = F.shiftrightunsigned(F.xxhash64(F.xxhash64(key), shard["i"]), 11) + F.lit(0.5)
        return F.struct((-shard["w"] / F.ln(unit / F.lit(float(1 << 53)))).alias("s"), shard["i"].alias("i"))

    return F.array_max(F.transform(ids, score))["i"]


def assign_shards(docs: DataFrame, weights: Sequence[float], id_col: str = "doc_id",
                  text_col: str = "text", added_weight: float = 1.0) -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot and the shard after adding one."""
    if not weights or min(*weights, added_weight, 1.0) <= 0:
        raise ValueError("weights are positive, one per shard")
    key = F.col(id_col)
    rows = stored(
        docs.select(
            key.alias("id"),
            (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
            shard_of(key, weights).alias("shard"),
            shard_of(key, [*weights, added_weight]).alias("grown_shard"),
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shards",
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(
        rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")),
        "starts",
    )
    inside = Window.partitionBy("shard", "part").orderBy("row")
    return (
        rows.withColumn("place", F.row_number().over(inside) - 1)
        .join(small(starts), ["shard", "part"])
        .select(
            F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("start") + F.col("place")).alias("slot"), "grown_shard",
        )
    )
