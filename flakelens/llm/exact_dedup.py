"""Exact deduplication by two passes over a Bloom filter of repeated hashes.

Pass one reads every text once and keeps its digest.  Hashes of digests are counted
with map-side combining (one record for each different hash of a task is shuffled), and
those that occur more than once fill the filter: words of 64 bits, two bits for each
hash.  Pass two probes every row.  Rows whose bits are not all set are unique and pass
straight through; only the others are shuffled and compared by digest.

The filter follows the repeated hashes and never has more than ``bits.MAX_WORDS`` words, so
it is always broadcast.  Beyond some eight million repeated hashes more unique rows pass
it and are shuffled too, with their digests, never with their texts.

Defined cases: null texts equal empty ones; rows with a null id are the smallest;
of rows that repeat both id and text one stays; an empty table gives an empty
table; other columns of the input never matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flakelens.llm.bits import Filter
from flakelens.llm.common import ascii_lower, fresh, stored


def digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8 with A-Z lower-cased; null counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


def _judged(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows that are surely unique, and the others with their groups."""
    digests = stored(
        docs.select(
            F.col(id_col).alias("id"), digest(F.col(text_col)).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row"),
        ).withColumn("hash", F.xxhash64("text_sha256")),
        "digests",
    )
    repeated = stored(
        digests.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"), "repeated"
    )
    probed = Filter(repeated).probe(digests, F.col("hash"), "maybe")
    candidates = stored(probed.filter("maybe").drop("maybe", "hash"), "candidates")
    groups = (
        candidates.groupBy("text_sha256")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "row")).alias("last"))
    )
    copies = candidates.join(groups, "text_sha256").select(
        "id", F.col("last.id").alias("keep_id"), "group_size", (F.col("last.row") == F.col("row")).alias("kept"), "text_sha256",
    )
    single = probed.filter("not maybe").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    return single, copies


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id is kept.
    """
    single, copies = _judged(docs, id_col, text_col)
    return single.unionByName(copies).withColumnRenamed("id", id_col)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, one row of each group of equal texts.

    Rows that go are marked by id and digest.  A second filter lets all others pass
    where they are; only rows it holds meet the marks.
    """
    _, copies = _judged(docs, id_col, text_col)
    marks = stored(
        copies.groupBy(F.col("id").alias("mark_id"), F.col("text_sha256").alias("mark_sha"))
        .agg(F.count_if("kept").alias("stay"), F.count(F.lit(1)).alias("rows"))
        .filter("rows > stay").withColumn("hash", F.xxhash64("mark_sha", "mark_id")),
        "marks",
    )
    sha, maybe = fresh(docs, "_sha", "_maybe")
    hashed = docs.withColumn(sha, digest(F.col(text_col)))
    probed = Filter(marks.select("hash")).probe(hashed, F.xxhash64(sha, id_col), maybe)
    surely, unsure = probed.filter(~F.col(maybe)).drop(maybe), probed.filter(maybe).drop(maybe)
    condition = unsure[id_col].eqNullSafe(F.col("mark_id")) & (unsure[sha] == F.col("mark_sha"))
    out = surely.unionByName(unsure.join(marks.select("mark_id", "mark_sha"), condition, "left_anti"))
    again = marks.filter("stay > 0").select("mark_id", "mark_sha")
    if not again.isEmpty():  # rows that repeat both id and text: one of each stays
        out = out.unionByName(unsure.join(again, condition, "left_semi").dropDuplicates([id_col, sha]))
    return out.drop(sha)
