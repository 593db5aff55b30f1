"""Ranked lexical search: best-first over document intervals with range-maximum queries.

1. One scan of the documents gives blocks: documents of a task with the postings of
   those terms that some query has (a bit table of bounded size lets wrong ones through;
   the exact join with the queries drops them).  Nothing is shuffled but the counts of
   each block's terms, which add up to the document frequencies.
2. In a block the posting lists lie one after the other.  A sparse table over all of
   them gives the largest impact, and its document, of any range of a list.
3. For each query a frontier of document intervals is kept.  An interval's bound is the
   weighted sum of its lists' range maxima.  The best intervals are taken out, each is
   split at the document with the largest single contribution, that document is scored,
   and the two sides return with their own bounds.  A side whose bound is below the
   query's k-th score so far is dropped: none of its documents can be among the first k.
   The k best of a task's earlier blocks count too.
4. The best k of each task meet in one ranking per query.

Documents lie in a block by their most frequent query term and a minimum hash of their
terms: texts of one language and copies are neighbours, which makes bounds tight.

Terms are told apart by 64-bit hashes while a block is made; their texts decide the join
with the queries.

Defined cases: null texts have no terms; documents without terms do not count; items
without terms, or whose terms no document holds, give no rows; rows that repeat an item's
id are one item with the terms of all (a null id likewise); rows that repeat a document's
id are ranked each; null document ids come after others of equal score; empty tables
give an empty table; other columns never matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flakelens.llm.bits import bit_table, maybe_in
from flakelens.llm.common import small_batches, stored
from flakelens.llm.words import NOT_ALNUM, U, Words, mix, slices

BLOCK_DOCS = 1 << 15
BLOCK_POSTINGS = 1 << 20
CHUNK_TERMS = 200_000  # (item, term) rows that a task searches for at once
BROADCAST_TERMS = 1_000_000
HELD_ITEMS = 100_000
STEPS = (16, 512)  # intervals taken out at once: at first, at most
_ORDER = np.int64((1 << 32) - 1)

BLOCK = "ids array<long>, lengths array<long>, terms array<string>, sizes array<int>, docs array<int>, tfs array<int>"


def _strings(words: Words, at: np.ndarray) -> list[str]:
    raw = words.data
    return [raw[words.start[i] : words.stop[i]].tobytes().decode() for i in at.tolist()]


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, term, hash) of every term of the queries."""
    for batch in batches:
        for words in slices(batch.column("text"), NOT_ALNUM, True):
            rows = pa.array(np.repeat(np.arange(words.n_docs), words.counts()) + words.row)
            terms = _strings(words, np.arange(len(words.start)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(rows), pa.array(terms, pa.string()),
                 pa.array(words.hashes().view(np.int64))],
                names=["item", "term", "hash"],
            )


class _Block:
    """Documents and postings gathered until they fill one row."""

    def __init__(self):
        self.ids, self.lengths, self.parts = [], [], []
        self.names: dict[int, str] = {}
        self.n_docs = self.n_postings = 0

    def add(self, ids: pa.Array, words: Words, table: np.ndarray) -> None:
        counts = words.counts()
        full = np.flatnonzero(counts)
        self.ids += ids.take(pa.array(full)).to_pylist()
        self.lengths.append(counts[full])
        h = words.hashes()
        kept = np.flatnonzero(maybe_in(table, h))
        doc = (np.cumsum(counts > 0) - 1)[np.searchsorted(words.first, kept, "right") - 1]
        h = h[kept]
        order = np.lexsort((doc, h))
        h, doc, kept = h[order], doc[order], kept[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        tf = np.diff(np.append(at, len(h)))
        self.parts.append((h[at], doc[at] + self.n_docs, tf))
        term = np.ones(len(at), bool)
        term[1:] = h[at][1:] != h[at][:-1]
        unseen = [i for i in at[term].tolist() if int(h[i]) not in self.names]
        for i, name in zip(unseen, _strings(words, kept[unseen]) if unseen else (), strict=True):
            self.names[int(h[i])] = name
        self.n_docs += len(full)
        self.n_postings += len(at)

    def row(self) -> pa.RecordBatch:
        h, doc, tf = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        lengths = np.concatenate(self.lengths)
        # neighbours: same most frequent term, then same least hash of a term
        most = np.lexsort((h, -tf, doc))
        first = np.ones(len(h), bool)
        first[1:] = doc[most][1:] != doc[most][:-1]
        main = np.zeros(self.n_docs, U)
        main[doc[most][first]] = h[most][first]
        least = np.full(self.n_docs, U(2**64 - 1))
        np.minimum.at(least, doc, mix(h))
        order = np.lexsort((least, main))
        place = np.empty(self.n_docs, np.int64)
        place[order] = np.arange(self.n_docs)
        doc = place[doc]
        by_term = np.lexsort((doc, h))
        h, doc, tf = h[by_term], doc[by_term], tf[by_term]
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
        columns = {
            "ids": pa.array(self.ids, pa.int64()).take(pa.array(order)),
            "lengths": pa.array(lengths[order]),
            "terms": pa.array([self.names[x] for x in h[start].tolist()], pa.string()),
            "sizes": pa.array(np.diff(np.append(start, len(h))).astype(np.int32)),
            "docs": pa.array(doc.astype(np.int32)),
            "tfs": pa.array(tf.astype(np.int32)),
        }
        lists = [
            pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values) for values in columns.values()
        ]
        return pa.RecordBatch.from_arrays(lists, names=list(columns))


def _blocks(shared, most_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for batch in batches:
            ids = batch.column("id")
            for words in slices(batch.column("text"), NOT_ALNUM, True):
                block.add(ids.slice(words.row, words.n_docs), words, shared.value)
                if block.n_docs >= most_docs or block.n_postings >= BLOCK_POSTINGS:
                    yield block.row()
                    block = _Block()
        if block.n_docs:
            yield block.row()
    return run


class Postings:
    """Posting lists of some terms of a block, with one sparse table over all lists."""

    def __init__(self, terms: list[str], sizes: np.ndarray, docs: np.ndarray, impacts: np.ndarray):
        self.index = {t: i for i, t in enumerate(terms)}
        self.stop = np.cumsum(sizes)
        self.start = self.stop - sizes
        self.docs, self.impacts = docs, impacts
        self.width = int(docs.max()) + 1 if len(docs) else 1
        self.keys = np.repeat(np.arange(len(sizes)), sizes) * self.width + docs
        # impact above, place below, so that a maximum tells its leftmost place too
        level = (impacts << np.int64(32)) | (_ORDER - np.arange(len(docs)))
        levels, step = [level], 1
        while 2 * step <= (int(sizes.max()) if len(sizes) else 0):
            longer = level.copy()
            longer[: len(level) - step] = np.maximum(level[:-step], level[step:])
            levels.append(longer)
            level, step = longer, 2 * step
        self.table = np.stack(levels)

    def best(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Packed maximum of each range; 0 for an empty one."""
        size = stop - start
        some = size > 0
        level = np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1
        last = np.where(some, stop - (np.int64(1) << level), 0)
        first = np.where(some, start, 0)
        return np.where(some, np.maximum(self.table[level, first], self.table[level, last]), 0)

    def find(self, lists: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """First place of each list (columns) with at least each document (rows)."""
        order = np.argsort(doc, kind="stable")
        places = np.empty((len(doc), len(lists)), np.int64)
        places[order] = np.searchsorted(self.keys, (lists[:, None] * self.width + doc[order][None, :]).ravel()).reshape(
            len(lists), len(doc)
        ).T
        return places


class Best:
    """The first k (score, id) of an item; equal scores by id, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.score = np.zeros(0, np.int64)
        self.order = np.zeros(0, np.int64)  # id, or the largest number for null
        self.null = np.zeros(0, bool)
        self.least = 1

    def add(self, score: np.ndarray, order: np.ndarray, null: np.ndarray) -> None:
        good = score >= self.least
        if not good.any():
            return
        score = np.concatenate([self.score, score[good]])
        order = np.concatenate([self.order, order[good]])
        null = np.concatenate([self.null, null[good]])
        first = np.lexsort((order, null, -score))[: self.k]
        self.score, self.order, self.null = score[first], order[first], null[first]
        if len(first) == self.k:
            self.least = max(1, int(self.score[-1]))


def search_block(postings: Postings, terms: np.ndarray, weights: np.ndarray, order: np.ndarray,
                 null: np.ndarray, best: Best) -> int:
    """Enter a block's documents that are among the first k; returns how many were scored."""
    def valued(start, stop):
        """Bound of each interval and the document at which to split it."""
        packed = postings.best(start, stop)
        parts = (packed >> np.int64(32)) * weights
        lead = parts.argmax(axis=1)
        place = _ORDER - (packed[np.arange(len(packed)), lead] & _ORDER)
        return parts.sum(axis=1), postings.docs[np.minimum(place, len(postings.docs) - 1)]

    start, stop = postings.start[terms][None, :], postings.stop[terms][None, :]
    bound, split = valued(start, stop)
    scored, step = 0, STEPS[0]
    while True:
        alive = bound >= best.least
        if not alive.all():
            start, stop, bound, split = start[alive], stop[alive], bound[alive], split[alive]
        if not len(bound):
            return scored
        if len(bound) > step:
            ranked = np.argpartition(-bound, step)
            out, rest = ranked[:step], ranked[step:]
        else:
            out, rest = np.arange(len(bound)), np.zeros(0, np.int64)
        s, e, doc = start[out], stop[out], split[out]
        middle = np.clip(postings.find(terms, doc), s, e)
        here = np.minimum(middle, len(postings.docs) - 1)
        has = (middle < e) & (postings.docs[here] == doc[:, None])
        score = (np.where(has, postings.impacts[here], 0) * weights).sum(axis=1)
        best.add(score, order[doc], null[doc])
        scored += len(out)
        s, e = np.concatenate([s, middle + has]), np.concatenate([middle, e])
        b, d = valued(s, e)
        good = b >= best.least
        start, stop = np.concatenate([start[rest], s[good]]), np.concatenate([stop[rest], e[good]])
        bound, split = np.concatenate([bound[rest], b[good]]), np.concatenate([split[rest], d[good]])
        step = min(2 * step, STEPS[1])


def _postings_of(row: dict, wanted: set, documents: int, words: int) -> Postings:
    sizes = row["sizes"].astype(np.int64)
    use = np.array([t in wanted for t in row["terms"]], bool)
    mine = np.repeat(use, sizes)
    docs, tf = row["docs"][mine].astype(np.int64), row["tfs"][mine].astype(np.int64)
    m = 50 + (50 * row["lengths"][docs] * documents) // words
    return Postings(
        [t for t, u in zip(row["terms"], use.tolist(), strict=True) if u], sizes[use], docs,
        (1_000_000_000 * tf) // (1000 * tf + 20 * m),
    )


def _arrays(batch: pa.RecordBatch, row: int) -> dict:
    out = {}
    for name in ("lengths", "sizes", "docs", "tfs"):
        out[name] = batch.column(name)[row].values.to_numpy(zero_copy_only=False)
    out["terms"] = batch.column("terms")[row].values.to_pylist()
    ids = batch.column("ids")[row].values
    out["null"] = ids.is_null().to_numpy(zero_copy_only=False)
    out["order"] = ids.fill_null(2**63 - 1).to_numpy(zero_copy_only=False)
    return out


def _found(tops: dict) -> pa.RecordBatch:
    some = [(i, b) for i, b in tops.items() if len(b.score)]
    sizes = [len(b.score) for _, b in some]
    none = np.zeros(0, np.int64)
    null = np.concatenate([b.null for _, b in some] or [none.astype(bool)])
    return pa.RecordBatch.from_arrays(
        [pa.array([i for (i, _), n in zip(some, sizes, strict=True) for _ in range(n)], pa.int64()),
         pa.array(np.concatenate([b.order for _, b in some] or [none]), mask=null),
         pa.array(np.concatenate([b.score for _, b in some] or [none]))],
        names=["item", "doc", "score"],
    )


def _search(k: int, documents: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict = {}
        chunks: tuple = (None, None, None)
        for batch in batches:
            for row in range(batch.num_rows):
                chunk = batch.column("chunk")[row].as_py()
                if chunks[0] != chunk:
                    queries = batch.column("queries")[row].as_py()
                    chunks = (chunk, queries, {t["term"] for q in queries for t in q["terms"]})
                block = _arrays(batch, row)
                postings = _postings_of(block, chunks[2], documents, words)
                for query in chunks[1]:
                    pairs = [(postings.index[t["term"]], t["w"]) for t in query["terms"] if t["term"] in postings.index]
                    if pairs:
                        best = tops.setdefault(query["item"], Best(k))
                        terms, weights = (np.array(c, np.int64) for c in zip(*pairs, strict=True))
                        search_block(postings, terms, weights, block["order"], block["null"], best)
                if len(tops) > HELD_ITEMS:
                    yield _found(tops)
                    tops = {}
        yield _found(tops)
    return run


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Per item its k best documents: item id, rank, document id, score."""
    spark = docs.sparkSession
    small_batches(spark)
    terms = stored(
        items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).alias("text"))
        .mapInArrow(_query_terms, "item long, term string, hash long").distinct(),
        "query_terms",
    )
    table = spark.sparkContext.broadcast(bit_table(stored(terms.select("hash").distinct(), "hashes"), "hash"))
    blocks = stored(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(_blocks(table, block_docs), BLOCK),
        "blocks",
    )
    total = blocks.select(
        F.sum(F.size("lengths").cast("long")).alias("documents"),
        F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("words"),
    ).first()
    documents, words = total.documents or 0, total.words or 0
    frequency = (
        blocks.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t"))
        .groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.sizes").alias("df"))
    )
    weight = F.floor(1000 * F.log((F.lit(2.0 * documents + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighted = terms.join(frequency, "term").select("item", "term", weight.alias("w")).filter("w > 0")
    queries = stored(
        weighted.groupBy("item").agg(F.collect_list(F.struct("term", "w")).alias("terms")), "queries"
    )
    sizes = queries.agg(F.sum(F.size("terms").cast("long")).alias("terms")).first()
    chunks = -(-(sizes.terms or 0) // CHUNK_TERMS) or 1
    chunked = queries.groupBy(F.pmod(F.xxhash64("item"), F.lit(chunks)).cast("int").alias("chunk")).agg(
        F.collect_list(F.struct("item", "terms")).alias("queries")
    )
    if (sizes.terms or 0) <= BROADCAST_TERMS:
        chunked = F.broadcast(chunked)
    met = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).join(chunked, "chunk")
    found = stored(met.mapInArrow(_search(k, documents, words), "item long, doc long, score long"), "found")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    return (
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
    )
