"""Benchmark decontamination by a prefix-filtered join of word shingles.

A benchmark item is cut into windows (ten words; a shorter item is one window).
All shingles of a window must occur in a document that contains it, so one of them
suffices as join key: the rarest, by counts over all documents.  A shingle met in
a document gives the place where its window would start (positional bound), the
window must fit into the document there (length bound), and then its hash and
finally its words are compared.

The window table is sent to the tasks in parts of at most ``PART`` windows, so
memory does not follow the benchmark; documents are read once to count and once to
match for each part, and never shuffled.

Defined cases: null texts have no words; items without words are left out; a null
item id counts as empty; windows that several items share count for each of them,
rows that repeat an item id as one item; repeated documents are judged each; empty
tables give empty results or clean documents; other columns never matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flakelens.llm.common import small_batches, stored
from flakelens.llm.words import NOT_ALNUM, U, Words, inside, sequence_hashes, slices

WINDOW = 10
SHINGLE = 3
PART = 200_000  # windows in one broadcast, some 150 bytes each


def _windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, length, whash, text, keys = [], [], [], [], []
            ids = batch.column("item").to_pylist()
            for words in slices(batch.column("text"), NOT_ALNUM, True):
                h = words.hashes()
                for d in range(words.n_docs):
                    a, b = int(words.first[d]), int(words.first[d + 1])
                    n = min(size, b - a)
                    if not n:
                        continue
                    runs = sequence_hashes(h[a:b], n).view(np.int64)
                    tokens = sequence_hashes(h[a:b], min(SHINGLE, n)).view(np.int64)
                    said = words.texts(a, b)
                    for i, w in enumerate(runs):
                        item.append(ids[words.row + d])
                        length.append(n)
                        whash.append(int(w))
                        text.append(b" ".join(said[i : i + n]))
                        keys.append(tokens[i : i + n - min(SHINGLE, n) + 1].tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.string()), pa.array(length, pa.int32()), pa.array(whash, pa.int64()),
                 pa.array(text, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["item", "length", "whash", "words", "keys"],
            )
    return run


def _find(sorted_keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``values`` that are among the keys, and the index of the key."""
    if not len(sorted_keys) or not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(sorted_keys, values)
    at[at == len(sorted_keys)] = 0
    hit = np.flatnonzero(sorted_keys[at] == values)
    return hit, at[hit]


def _counts(shared):
    """Occurrences of the benchmark's shingles, summed in each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size = shared.value
        totals = {k: np.zeros(len(v), np.int64) for k, v in by_size.items()}
        for batch in batches:
            for words in slices(batch.column("text"), NOT_ALNUM, True):
                h = words.hashes()
                for k, known in by_size.items():
                    _, at = _find(known, sequence_hashes(h, k)[inside(words, k)])
                    totals[k] += np.bincount(at, minlength=len(known))
        for k, known in by_size.items():
            some = totals[k] > 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(known[some].view(np.int64)), pa.array(totals[k][some])], names=["token", "n"]
            )
    return run


class _Index:
    """Windows by their rarest shingle, as flat arrays."""

    def __init__(self, windows: list, counts: dict[int, int]):
        self.items = [w.item for w in windows]
        self.words = [bytes(w.words) for w in windows]
        self.length = np.array([w.length for w in windows], np.int64)
        self.whash = np.array([w.whash for w in windows], np.int64).view(U)
        rarest, offset, kept = [], [], []
        for i, w in enumerate(windows):
            n, key, at = min((counts.get(t, 0), t, j) for j, t in enumerate(w.keys))
            if n:  # a shingle that no document has: the window occurs nowhere
                rarest.append(key)
                offset.append(at)
                kept.append(i)
        rarest = np.array(rarest, np.int64).view(U)
        order = np.argsort(rarest, kind="stable")
        self.window = np.array(kept, np.int64)[order]
        self.offset = np.array(offset, np.int64)[order]
        size = np.minimum(SHINGLE, self.length[self.window]) if len(kept) else np.zeros(0, np.int64)
        self.by_size = {}
        for k in range(1, SHINGLE + 1):
            rows = np.flatnonzero(size == k)
            keys, first, count = np.unique(rarest[order][rows], return_index=True, return_counts=True)
            if len(keys):
                self.by_size[k] = (keys, rows[first], count)


def _places(words: Words, index: _Index) -> tuple[list[list], list[set]]:
    """Where windows occur in each document, and of which items."""
    places, who = [[] for _ in range(words.n_docs)], [set() for _ in range(words.n_docs)]
    h = words.hashes()
    for k, (keys, first, count) in index.by_size.items():
        hit, at = _find(keys, sequence_hashes(h, k))
        many = count[at]
        entry = np.repeat(first[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
        window = index.window[entry]
        start = np.repeat(hit, many) - index.offset[entry]
        length = index.length[window]
        doc = np.searchsorted(words.first, np.repeat(hit, many), "right") - 1
        fits = (start >= words.first[doc]) & (start + length <= words.first[doc + 1])
        start, window, length, doc = (x[fits] for x in (start, window, length, doc))
        for n in np.unique(length):
            all_of_n = sequence_hashes(h, int(n))
            rows = np.flatnonzero(length == n)
            for r in rows[all_of_n[start[rows]] == index.whash[window[rows]]]:
                s, w, d = int(start[r]), int(window[r]), int(doc[r])
                if b" ".join(words.texts(s, s + int(n))) == index.words[w]:
                    base = int(words.first[d])
                    places[d].append((s - base, s - base + int(n)))
                    who[d].add(index.items[w])
    return places, who


def _hits(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in slices(batch.column("text"), NOT_ALNUM, True):
                places, who = _places(words, shared.value)
                rows = slice(words.row, words.row + words.n_docs)
                spots = [[{"a": a, "b": b} for a, b in _union(p)] for p in places]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[rows], batch.column("row")[rows],
                     pa.array(words.counts(), pa.int64()),
                     pa.array(spots, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
                     pa.array([sorted(x) for x in who], pa.list_(pa.string()))],
                    names=["id", "row", "n_words", "spots", "items"],
                )
    return run


def _clean(shared, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = []
            for words in slices(batch.column(batch.schema.get_field_index(text_col)), NOT_ALNUM, True):
                clean += [not p for p in _places(words, shared.value)[0]]
            yield batch.filter(pa.array(clean, pa.bool_()))
    return run


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_COVERED = """aggregate(array_sort(spots), named_struct('n', 0L, 'end', 0L),
    (s, x) -> named_struct('n', s.n + greatest(x.b - greatest(x.a, s.end), 0L), 'end', greatest(s.end, x.b)),
    s -> s.n)"""


def _indexes(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, window: int, part: int):
    """The window table in parts, each as a broadcast index."""
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    windows = stored(
        benchmark.select(
            F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
            F.col("text").alias("text"),
        ).mapInArrow(_windows(window), "item string, length int, whash long, words binary, keys array<long>")
        .distinct(),
        "windows",
    )
    # rows by a hash of item and window: a part is bounded even if one item or window is most of them
    parts = max(1, -(-windows.count() // part))
    numbered = windows.withColumn("part", F.pmod(F.xxhash64("item", "whash", "length"), F.lit(parts)))
    for p in range(parts):
        rows = numbered.filter(F.col("part") == p).collect()
        tokens: dict[int, set] = {}
        for w in rows:
            tokens.setdefault(min(SHINGLE, w.length), set()).update(w["keys"])
        known = {k: np.sort(np.array(list(v), np.int64).view(U)) for k, v in tokens.items()}
        texts = docs.select(F.col(text_col).alias("text"))
        counts = texts.mapInArrow(_counts(context.broadcast(known)), "token long, n long")
        # at most one row for each shingle of the part
        total = {r.token: r.n for r in counts.groupBy("token").agg(F.sum("n").alias("n")).collect()}
        yield context.broadcast(_Index(rows, total))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", window: int = WINDOW, part: int = PART) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    texts = docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text")
    )
    id_type = texts.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, row long, n_words long, spots array<struct<a:long,b:long>>, items array<string>"
    parts = [texts.mapInArrow(_hits(i), schema)
             for i in _indexes(docs, benchmark, text_col, item_col, window, part)]
    found = parts[0]
    for one in parts[1:]:
        found = found.unionByName(one)
    if len(parts) > 1:
        found = found.groupBy("row").agg(
            F.first("id").alias("id"), F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("spots")).alias("spots"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
    n_hit = F.expr(_COVERED)
    return found.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                         item_col: str = "item_id", window: int = WINDOW, part: int = PART) -> DataFrame:
    """The documents, with all their columns, that contain no window of an item."""
    out = docs
    for index in _indexes(docs, benchmark, text_col, item_col, window, part):
        out = out.mapInArrow(_clean(index, text_col), docs.schema)
    return out
