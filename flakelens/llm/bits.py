"""Bit tables of bounded size: filters that tasks read before anything is shuffled.

``bit_table`` gives one as an array for tasks in Python, ``Filter`` as a table that Spark
broadcasts.  A table holds 64-bit hashes of keys and answers "maybe" for others, so whatever it
lets through must be settled afterwards, by exact counts or an exact join.  It is
filled by an aggregation and never larger than ``MAX_WORDS`` words of 64 bits (16 MB),
however many keys there are; beyond some eight million keys it lets more pass.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flakelens.llm.common import fresh, stored
from flakelens.llm.words import U

MAX_WORDS = 1 << 21
KEYS_PER_WORD = 4


def bit_table(keys: DataFrame, column: str) -> np.ndarray:
    """The table of a stored column of 64-bit hashes; its length is a power of two."""
    words = 64
    rows = keys.count()
    while words < MAX_WORDS and words * KEYS_PER_WORD < rows:
        words *= 2
    h = F.col(column)
    one = F.lit(1).cast("long")
    low = (h.bitwiseAND(F.lit(63))).cast("int")
    high = (F.shiftright(h, 6).bitwiseAND(F.lit(63))).cast("int")
    mask = F.call_function("shiftleft", one, low).bitwiseOR(F.call_function("shiftleft", one, high))
    place = F.shiftrightunsigned(h, 65 - words.bit_length())
    found = keys.select(place.alias("place"), mask.alias("mask")).groupBy("place").agg(F.bit_or("mask").alias("mask")).toPandas()
    table = np.zeros(words, U)
    table[found["place"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64).view(U)
    return table


def maybe_in(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be keys of the table."""
    shift = U(65 - len(table).bit_length())
    one, six = U(1), U(63)
    mask = (one << (h & six)) | (one << ((h >> U(6)) & six))
    return (table[(h >> shift).astype(np.int64)] & mask) == mask


class Filter:
    """Bloom filter of a stored table's column ``hash``, as a table of words."""

    def __init__(self, keys: DataFrame, max_words: int = MAX_WORDS):
        rows, self.words = keys.count(), 64
        while self.words < max_words and self.words * KEYS_PER_WORD < rows:
            self.words *= 2
        word, mask = self._place(F.col("hash"))
        self.table = stored(keys.groupBy(word.alias("word")).agg(F.bit_or(mask).alias("bits")), "bloom")

    def _place(self, h: Column) -> tuple[Column, Column]:
        one = F.lit(1).cast("long")
        low = h.bitwiseAND(F.lit(63)).cast("int")
        high = F.shiftright(h, 6).bitwiseAND(F.lit(63)).cast("int")
        mask = F.call_function("shiftleft", one, low).bitwiseOR(F.call_function("shiftleft", one, high))
        return F.shiftrightunsigned(h, 65 - self.words.bit_length()), mask

    def probe(self, rows: DataFrame, h: Column, maybe: str) -> DataFrame:
        """Add ``maybe``: false only where no key has this hash.  Nothing is shuffled."""
        word, mask = self._place(h)
        w, m, t, b = fresh(rows, "_word", "_mask", "_at", "_bits")
        table = F.broadcast(self.table.select(F.col("word").alias(t), F.col("bits").alias(b)))
        met = rows.withColumns({w: word, m: mask}).join(table, F.col(w) == F.col(t), "left")
        found = F.coalesce(F.col(b).bitwiseAND(F.col(m)) == F.col(m), F.lit(False))
        return met.withColumn(maybe, found).drop(w, m, t, b)
