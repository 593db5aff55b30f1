"""Removal of word windows that occur earlier in the corpus.

This is not done by automata of all repeated phrases, whose cost grows with the square of
the corpus (figures in the README), but by joins:

Every window of ``WINDOW`` words contains one chosen phrase (the leftmost of its
six-word phrases with the least hash), and equal windows choose equal phrases.
Consecutive windows with one phrase occurrence are a run of at most 15.

1. Phrases are counted over all documents, hashes only.  A phrase that occurs once
   belongs to no repeated window; everything below concerns recurring phrases.  Their
   hashes fill a bit table of bounded size, and runs of other phrases never leave the
   task that reads the document.  The few that pass by chance are texts that occur once,
   which the next step leaves alone.
2. Runs of equal text are grouped: all windows of a run that is not the first of
   its text are repeated.  This settles whole copies and the inside of passages
   with one row for each run.
3. First runs of a phrase that recurs in several texts (edges of passages, edited
   copies) are compared window by window.
4. Repeated stretches return to their documents, where their words are cut.
   Documents without any pass straight through.

The order of windows is (doc_id, start); rows that repeat an id are one document
in this order, so none of them is earlier than another at one start.

Defined cases: null texts have no words; a null id comes first in order; texts
shorter than a window stay whole; repeated rows are judged each; an empty table
gives an empty table; other columns of the input never matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flakelens.llm.bits import Filter, bit_table, maybe_in
from flakelens.llm.common import small, small_batches, stored
from flakelens.llm.words import _STEP, SPACES, U, Words, inside, rolling, sequence_hashes, slices, spans

WINDOW = 20
PHRASE = 6
SLOT = U((1 << 40) - 1)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost least value of each ``width`` consecutive ones."""
    at, have = np.arange(len(h)), 1
    while have < width:
        step = min(have, width - have)
        if len(at) <= step:
            return np.zeros(0, np.int64)
        left, right = at[:-step], at[step:]
        at = np.where(h[right] < h[left], right, left)
        have += step
    return at


def _runs(words: Words, window: int):
    """Runs of windows with one phrase occurrence: slot, text hash, document, start, count."""
    h = words.hashes()
    phrases = sequence_hashes(h, PHRASE)
    whole = inside(words, window)
    start = np.flatnonzero(whole)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none.view(U), none.view(U), none, none, none
    chosen = _least(phrases, window - PHRASE + 1)[start]
    doc = np.searchsorted(words.first, start, "right") - 1
    new = np.ones(len(start), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    begin = start[first]
    text = spans(rolling(h, _STEP), begin, begin + count + window - 1, _STEP)
    # runs of one text have their phrase at one place: the hash covers the count by its span
    return phrases[chosen[first]] & SLOT, text + count.astype(U), doc[first], begin - words.first[doc[first]], count


def _spread_out(slot):
    """A slot of 40 bits (array or column) as a hash of 64: all of it above, its low part below."""
    if isinstance(slot, np.ndarray):
        return (slot << U(24)) | (slot & U((1 << 24) - 1))
    return F.shiftleft(slot, 24).bitwiseOR(slot.bitwiseAND(F.lit((1 << 24) - 1)))


def _emit_slots(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in slices(batch.column("text"), SPACES, False):
                slot = _runs(words, window)[0]
                yield pa.RecordBatch.from_arrays([pa.array(slot.view(np.int64))], names=["slot"])
    return run


def _emit_runs(window: int, keys: list[str], recurring):
    """Runs whose phrase may recur, by the bit table ``recurring``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in slices(batch.column("text"), SPACES, False):
                found = _runs(words, window)
                kept = maybe_in(recurring.value, _spread_out(found[0]))
                slot, text, doc, start, count = (column[kept] for column in found)
                rows = pa.array(doc + words.row)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).take(rows) for k in keys], pa.array(slot.view(np.int64)),
                     pa.array(text.view(np.int64)), pa.array(start.astype(np.int32)),
                     pa.array(count.astype(np.int32))],
                    names=[*keys, "slot", "fc", "start", "n"],
                )
    return run


def _emit_windows(window: int, keys: list[str]):
    """Hashes of the windows of the runs listed in ``runs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("runs")
            for words in slices(batch.column("text"), SPACES, False):
                all_windows = sequence_hashes(words.hashes(), window)
                rows = listed[words.row : words.row + words.n_docs]
                sizes = np.array([len(r) for r in rows], np.int64)
                flat = rows.flatten()
                fc, begin, n = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                doc = np.repeat(np.arange(words.n_docs), sizes)
                offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(begin, n) + offset
                of = np.repeat(doc, n)
                made = all_windows[words.first[of] + start]
                taken = pa.array(of + words.row)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(k).take(taken) for k in keys], pa.array(np.repeat(fc, n)),
                     pa.array(offset.astype(np.int32)), pa.array(start.astype(np.int32)),
                     pa.array(made.view(np.int64))],
                    names=[*keys, "fc", "o", "start", "whash"],
                )
    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, shas = [], [], []
        for text, cuts in zip(batch.column("text"), batch.column("cuts"), strict=True):
            words = (text.as_py() or "").encode().split()
            keep = np.ones(len(words), bool)
            for cut in cuts.as_py() or ():
                keep[cut["a"] : cut["b"]] = False
            kept = int(keep.sum())
            n_words.append(len(words))
            n_removed.append(len(words) - kept)
            body = b" ".join(words if kept == len(words) else compress(words, keep))
            shas.append(hashlib.sha256(body).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas)],
            names=["id", "n_words", "n_removed", "kept_sha256"],
        )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """Documents with a key; ``order`` is the id itself unless ids repeat."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    again = stored(
        texts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or id is null").select("id"),
        "again",
    )
    if again.isEmpty():
        return texts.withColumn("key", F.col("id")), ["key"]
    twice = again.withColumnRenamed("id", "twice").withColumn("found", F.lit(True))
    marked = texts.join(small(twice), F.col("id").eqNullSafe(F.col("twice")), "left")
    key = F.when(F.col("found"), F.xxhash64("id", "text")).otherwise(F.col("id"))
    return marked.select("id", "text", key.alias("key"), F.col("id").alias("order")), ["key", "order"]


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     window: int = WINDOW) -> DataFrame:
    """Per document: id, n_words, n_removed, kept_sha256."""
    small_batches(docs.sparkSession)
    texts, keys = _keyed(docs, id_col, text_col)
    order = keys[-1]
    columns = texts.select(*keys, "text")
    slots = texts.select("text").mapInArrow(_emit_slots(window), "slot long")
    phrases = stored(
        slots.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select(_spread_out(F.col("slot")).alias("hash")),
        "phrases",
    )
    recurring = docs.sparkSession.sparkContext.broadcast(bit_table(phrases, "hash"))
    key_schema = ", ".join(f"{k} long" for k in keys)
    runs = stored(
        columns.mapInArrow(
            _emit_runs(window, keys, recurring), f"{key_schema}, slot long, fc long, start int, n int"
        ),
        "runs",
    )
    firsts = stored(
        runs.groupBy("fc").agg(
            F.min(F.struct(F.col(order).alias("order"), "start", "key", "n", "slot")).alias("first"),
            F.count(F.lit(1)).alias("times"),
        ),
        "firsts",
    )
    several = firsts.groupBy("first.slot").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("slot")
    edges = firsts.withColumn("slot", F.col("first.slot")).join(several, "slot", "left_semi")
    wanted = stored(
        edges.groupBy(F.col("first.key").alias("key"), F.col("first.order").alias("order"))
        .agg(F.collect_list(F.struct("fc", "first.start", "first.n")).alias("runs")),
        "edges",
    )
    windows = stored(
        _with_text(columns.select("key", "text"), wanted)
        .mapInArrow(_emit_windows(window, ["order"]), "order long, fc long, o int, start int, whash long"),
        "edge_windows",
    )
    earliest = stored(
        windows.groupBy("whash").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("order", "start")).alias("first"))
        .filter("n > 1").select("whash", "first"),
        "earliest",
    )
    later = (
        windows.join(earliest, "whash").filter(F.struct("order", "start") > F.col("first"))
        .groupBy("fc").agg(F.collect_set("o").alias("offsets"))
    )
    verdicts = stored(
        firsts.join(later, "fc", "left").filter("times > 1 or offsets is not null")
        .select("fc", "first.order", "first.start", "offsets")
        .withColumnsRenamed({"order": "order_", "start": "start_"}),
        "verdicts",
    )
    judged = runs.join(verdicts, "fc")
    is_later = F.struct(F.col(order).alias("order"), "start") > F.struct(F.col("order_").alias("order"), F.col("start_").alias("start"))
    spots = F.when(is_later, F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n") + window - 1).alias("b")))).otherwise(
        F.transform("offsets", lambda o: F.struct((F.col("start") + o).alias("a"), (F.col("start") + o + window).alias("b")))
    )
    cuts = stored(
        judged.select("key", F.explode(spots).alias("spot")).distinct()
        .groupBy("key").agg(F.collect_list("spot").alias("cuts")),
        "cuts",
    )
    return _finish(texts.select("key", "id", "text"), cuts).withColumnRenamed("id", id_col)


def _apart(texts: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts that surely have no list, and the others; nothing is shuffled."""
    keys = stored(lists.select(F.xxhash64("key").alias("hash")), "listed_keys")
    probed = Filter(keys).probe(texts, F.xxhash64("key"), "listed")
    return probed.filter("not listed").drop("listed"), probed.filter("listed").drop("listed")


def _with_text(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """Join lists with their texts; texts without a list stay where they are."""
    return _apart(texts, lists)[1].join(lists, "key")


def _finish(texts: DataFrame, cuts: DataFrame) -> DataFrame:
    schema = "id long, n_words long, n_removed long, kept_sha256 string"
    none = F.lit(None).cast(cuts.schema["cuts"].dataType)
    whole, listed = _apart(texts, cuts)
    whole = whole.select("id", "text", none.alias("cuts"))
    partly = listed.join(cuts, "key", "left").select("id", "text", "cuts")
    return whole.mapInArrow(_cut, schema).unionByName(partly.mapInArrow(_cut, schema))
