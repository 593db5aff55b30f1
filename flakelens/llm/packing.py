"""Packing of token sequences by linear grouping and best fit.

Documents are tokenised and cut where Spark reads them.  The optimisation sees only
how many pieces there are of each length, at most ``capacity`` numbers whatever the
size of the corpus:

1. Lengths over ``capacity / SMALL`` are dealt into groups of equal cardinality and
   rounded up to the largest of their group.
2. Configurations of these few sizes are chosen, fullest first, each used as often
   as its sizes last.
3. Actual lengths are substituted for the rounded ones, which frees room.
4. Small lengths go best-fit into the least room that holds them.

Where a plan needs more sequences than the tokens fill, finer groups are tried, up to
one for each length, and at most half of its sequences, the emptiest, are taken apart
after step 3 and go best-fit into the room of the others.  The plan with the fewest
sequences is used; each comes from linear grouping.  A plan consists of runs: the
pieces of one length with ranks from a to b go to consecutive sequences at one
offset.  Ranks come from per-partition counts, so no task sees all pieces of a
common length.

Defined cases: null texts are empty; an empty text is the end mark alone; repeated
rows are packed each; an empty table gives an empty table; other columns never
matter.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flakelens.llm.common import small, small_batches, stored

CAPACITY = 1024
SMALL = 8
GROUPS = 256
FINER = (1, 4, 16, 0)  # times ``GROUPS``; 0: every length is a group
AGAIN = (0.0, 0.25, 0.5)  # shares of the sequences that are taken apart
END_ID = 2
PART = 200_000  # characters encoded at once
# The pattern of the byte-level vocabulary that splits text before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BREAK = re.compile(r" (?=\S)")
# Other characters than these may be letters in one Unicode version only.
_UNSURE = re.compile(
    "[^\x00-\u024f\u2010-\u2027\u2030-\u205e\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]"
)


def _bytes_of() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable bytes for
    themselves, the others in order from code point 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes.

    The vocabulary's merges are in the order of its ids, so the same vocabulary as
    ranks gives the same ids, faster.  Texts with characters that the two libraries
    may classify differently go through the tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        byte = _bytes_of()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        self.ranked = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if _UNSURE.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        elif len(text) <= PART:
            ids = self.ranked.encode_ordinary(text)
        else:  # a space before a non-space always starts a new pre-token
            ids, at = [], 0
            while at < len(text):
                end = _BREAK.search(text, at + PART)
                stop = end.start() if end else len(text)
                ids += self.ranked.encode_ordinary(text[at:stop])
                at = stop
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = encode(text or "") + end
                n = len(ids) // 4
                stops = range((n - 1) % capacity + 1, n + 1, capacity)
                at = 0
                for k, stop in enumerate(stops):
                    doc.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(stop - at)
                    crc.append(zlib.crc32(ids[4 * at : 4 * stop]))
                    at = stop
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()),
                 pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )
    return run


class _Bins:
    """Sets of equal sequences: (how many, lengths inside), found by their free room."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: dict[int, list] = {}

    def add(self, count: int, lengths: tuple) -> None:
        if count:
            self.by_room.setdefault(self.capacity - sum(lengths), []).append((count, lengths))

    def best_fit(self, length: int, count: int) -> None:
        while count:
            room = min((r for r, sets in self.by_room.items() if r >= length and sets), default=None)
            if room is None:
                each = self.capacity // length
                self.add(count // each, (length,) * each)
                self.add(1 if count % each else 0, (length,) * (count % each))
                return
            have, lengths = self.by_room[room].pop()
            taken = min(have, count)
            self.add(have - taken, lengths)
            self.add(taken, (*lengths, length))
            count -= taken

    def sets(self) -> list:
        return [s for sets in self.by_room.values() for s in sets]


def _grouped(counts: dict[int, int], groups: int) -> list[tuple[int, deque]]:
    """Groups of equal cardinality in falling order: (rounded size, actual (length, count))."""
    total = sum(counts.values())
    each = max(1, -(-total // groups))
    out: list[tuple[int, deque]] = []
    space = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not space:
                out.append((length, deque()))
                space = each
            taken = min(space, left)
            out[-1][1].append((length, taken))
            space -= taken
            left -= taken
    # groups of one rounded size are one size
    merged: list[tuple[int, deque]] = []
    for size, members in out:
        if merged and merged[-1][0] == size:
            merged[-1][1].extend(members)
        else:
            merged.append((size, members))
    return merged


def _configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """(uses, group indices): the largest size left, topped up to the fullest sum."""
    left, out = list(demand), []
    ascending = list(range(len(sizes) - 1, -1, -1))
    head = 0
    while True:
        while head < len(sizes) and not left[head]:
            head += 1
        if head == len(sizes):
            return out
        room = capacity - sizes[head]
        # sums[j]: bitset of what j further sizes can add up to
        alive = [g for g in ascending if left[g] > (g == head) and sizes[g] <= room]
        limit = (1 << (room + 1)) - 1
        sums = [1]
        while alive and len(sums) <= room // sizes[alive[0]]:
            nxt = 0
            for g in alive:
                nxt |= sums[-1] << sizes[g]
            nxt &= limit
            if not nxt:
                break
            sums.append(nxt)
        best = max(range(len(sums)), key=lambda j: (sums[j].bit_length(), -j))
        chosen, at = [head], sums[best].bit_length() - 1
        for j in range(best, 0, -1):
            for g in reversed(alive):
                if sizes[g] <= at and sums[j - 1] >> (at - sizes[g]) & 1:
                    chosen.append(g)
                    at -= sizes[g]
                    break
        need = {g: chosen.count(g) for g in chosen}
        if any(left[g] < n for g, n in need.items()):  # a size not left that often: keep what fits
            kept: list[int] = []
            for g in chosen:
                if kept.count(g) < left[g]:
                    kept.append(g)
            chosen, need = kept, {g: kept.count(g) for g in kept}
        uses = min(left[g] // n for g, n in need.items())
        for g, n in need.items():
            left[g] -= uses * n
        out.append((uses, chosen))


def _substituted(uses: int, chosen: list[int], groups: list[tuple[int, deque]]) -> list[tuple[int, tuple]]:
    sets = [(uses, ())]
    for g in chosen:
        members, after = groups[g][1], []
        for count, lengths in sets:
            while count:
                length, have = members.popleft()
                taken = min(have, count)
                if have > taken:
                    members.appendleft((length, have - taken))
                after.append((taken, (*lengths, length)))
                count -= taken
        sets = after
    return sets


def _planned(rest: dict[int, int], large: dict[int, int], dealt: list[tuple[int, deque]], capacity: int,
             again: float) -> list[tuple[int, tuple]]:
    """Sets by one grouping; the share ``again`` of its sequences, the emptiest, is taken apart
    and goes best-fit into the room of the others, before the small lengths."""
    sets: list[tuple[int, tuple]] = []
    for uses, chosen in _configurations([s for s, _ in dealt], [sum(c for _, c in m) for _, m in dealt], capacity):
        sets += _substituted(uses, chosen, dealt)
    left = {n: c for n, c in rest.items() if n not in large}
    apart = int(sum(count for count, _ in sets) * again)
    bins = _Bins(capacity)
    for count, lengths in sorted(sets, key=lambda s: sum(s[1])):
        taken = min(apart, count)
        apart -= taken
        for n in lengths if taken else ():
            left[n] = left.get(n, 0) + taken
        bins.add(count - taken, lengths)
    for n in sorted(left, reverse=True):
        bins.best_fit(n, left[n])
    return bins.sets()


def plan_sets(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, tuple]]:
    """Sets of equal sequences that hold all counted lengths."""
    full = [(counts[capacity], (capacity,))] if counts.get(capacity) else []
    rest = {n: c for n, c in counts.items() if n < capacity and c}
    large = {n: c for n, c in rest.items() if n * SMALL > capacity}
    least = -(-sum(n * c for n, c in rest.items()) // capacity)
    best: list[tuple[int, tuple]] | None = None
    fewest = 0
    for finer in FINER:
        for again in AGAIN:
            if best is not None and fewest <= least:
                return full + best
            # the finest grouping has one length a group
            dealt = _grouped(large, groups * finer) if finer else [(n, deque([(n, large[n])])) for n in sorted(large, reverse=True)]
            sets = _planned(rest, large, dealt, capacity, again)
            n = sum(c for c, _ in sets)
            if best is None or n < fewest:
                best, fewest = sets, n
    return full + best


def runs_of(sets: list[tuple[int, tuple]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, sequence of the first rank, offset)."""
    ranks: dict[int, int] = {}
    out, sequence = [], 0
    for count, lengths in sets:
        offset = 0
        for n in lengths:
            a = ranks.get(n, 0)
            out.append((n, a, a + count - 1, sequence, offset))
            ranks[n] = a + count
            offset += n
        sequence += count
    return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    pieces = stored(
        texts.mapInArrow(_pieces(tokenizer, capacity, end_id),
                         f"id {id_type}, piece int, start long, length long, ids_crc32 long")
        .withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}),
        "pieces",
    )
    by_part = stored(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    # at most ``capacity`` rows
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.createDataFrame(
        runs_of(plan_sets(counts, capacity)), "length long, a long, b long, sequence long, offset long"
    )
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(
        by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "starts"
    )
    inside = Window.partitionBy("length", "part").orderBy("row")
    ranked = (
        pieces.withColumn("place", F.row_number().over(inside) - 1)
        .join(small(starts), ["length", "part"])
        .withColumn("rank", F.col("first") + F.col("place"))
    )
    # the number of runs depends on the capacity alone
    return ranked.join(
        F.broadcast(runs),
        (ranked["length"] == runs["length"]) & F.col("rank").between(F.col("a"), F.col("b")),
    ).select(
        F.col("id").alias(id_col), "piece", "start", ranked["length"], "ids_crc32",
        (F.col("sequence") + F.col("rank") - F.col("a")).alias("sequence_id"), "offset",
    )
