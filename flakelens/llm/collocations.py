"""Phrase collocation mining: best-first branch and bound over first words.

A phrase of 2 to ``LONGEST`` words that occurs ``least`` times or more in a language is
a candidate; its score is that of its lowest cut, floor(1000 * a * n / (l * r)).

1. Words are counted by language.  Only words that occur often enough can be in a
   candidate; a bit table of them is what later scans read.
2. The frontier.  A phrase occurs no more often than what is left of it after a cut, so
   the cut after the first word bounds the score of everything that grows from a word by
   1000 * n / f(word); by the cut before the last word the same holds of the last word.
   The rarest words have the highest bounds and are expanded first: at first those
   that make up half of a language's occurrences.
3. Expansion.  One scan counts pairs of words that touch an expanded word, by hash; the
   often ones fill a second bit table.  One more scan grows phrases along such pairs
   and counts them by their text, so these hashes only ever let too much through.
   (A task adds up equal 64-bit hashes of whole phrases before it hands their text on.)
4. A candidate is dropped if a phrase longer by one word occurs as often; a longer one
   that contains it in another way implies such a phrase.  Once a language has ``top``
   survivors, the score s of the last of them settles it: words with
   1000 * n / f(word) >= s, ties included, are the only ones still to expand.  A language
   with fewer survivors is expanded completely.  So two rounds are enough.

Languages settle independently, and later rounds read only the documents of the others.

Defined cases: null texts are empty; a null language is ``und``; rows that repeat count
each; fewer candidates than ``top`` give fewer rows; an empty table gives an empty table;
other columns never matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flakelens.llm.bits import bit_table, maybe_in
from flakelens.llm.common import small_batches, stored
from flakelens.llm.words import U, Words, byte_class, mix, slices

LONGEST = 5
UNKNOWN = "und"
HELD = 1 << 20  # hashes that a task gathers before it hands them on
PIECE_ENDS = byte_class(lambda b: b in b".,;:!?" or 0x0A <= b <= 0x0D)
WORD_ENDS = PIECE_ENDS | byte_class(lambda b: b in b" \t")
_NEXT = U(0x9FB21C651E98DF25)


def _language_hashes(langs: list[str]) -> np.ndarray:
    """A number for each name, the same in every task."""
    return np.array([int.from_bytes(lang.encode(), "little") % ((1 << 61) - 1) for lang in langs], U)


class _Slice:
    """Words of some documents with the hash of (language, word) and where pieces end."""

    def __init__(self, words: Words, langs: pa.DictionaryArray, hashes: np.ndarray):
        self.words = words
        rows = langs.indices.to_numpy(zero_copy_only=False)[words.row : words.row + words.n_docs]
        doc = np.repeat(np.arange(words.n_docs), words.counts())
        self.lang = rows[doc]
        self.hash = mix(words.hashes() + mix(hashes[self.lang]))
        if len(doc):
            ends = np.cumsum(PIECE_ENDS[words.data])[words.start]
            # joined[i]: words i and i + 1 are neighbours in one piece
            self.joined = np.append((ends[1:] == ends[:-1]) & (doc[1:] == doc[:-1]), False)
        else:
            self.joined = np.zeros(0, bool)

    def phrases(self, at: np.ndarray, size: int) -> list[str]:
        texts = self.words.texts
        return [b" ".join(texts(i, i + size)).decode() for i in at.tolist()]


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Slice, list[str]]]:
    for batch in batches:
        langs = pc.fill_null(batch.column("lang"), UNKNOWN).dictionary_encode()
        names = langs.dictionary.to_pylist()
        hashes = _language_hashes(names)
        for words in slices(batch.column("text"), WORD_ENDS, True):
            if len(words.start):
                yield _Slice(words, langs, hashes), names


def _tally(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, a place of each, and their counts."""
    return np.unique(h, return_index=True, return_counts=True)


class _Gathered:
    """Counted texts of a task, merged by hash once enough have come together."""

    def __init__(self):
        self.parts: list = []
        self.held = 0

    def add(self, h: np.ndarray, counts: np.ndarray, langs: list, texts: list) -> None:
        self.parts.append((h, counts, pa.array(langs, pa.string()), pa.array(texts, pa.string())))
        self.held += len(h)

    def take(self) -> pa.RecordBatch:
        h, counts = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
        langs, texts = (pa.concat_arrays([p[i] for p in self.parts]) for i in (2, 3))
        distinct, at, back = np.unique(h, return_index=True, return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, back, counts)
        self.parts, self.held = [], 0
        return pa.RecordBatch.from_arrays(
            [langs.take(pa.array(at)), texts.take(pa.array(at)), pa.array(distinct.view(np.int64)), pa.array(total)],
            names=["lang", "phrase", "hash", "f"],
        )


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    gathered = _Gathered()
    for part, names in _sliced(batches):
        h, at, counts = _tally(part.hash)
        gathered.add(h, counts, [names[i] for i in part.lang[at].tolist()], part.phrases(at, 1))
        if gathered.held >= HELD:
            yield gathered.take()
    if gathered.held:
        yield gathered.take()


class Frontier:
    """Bit tables of one round: often words, words expanded now and before, often pairs."""

    def __init__(self, often: np.ndarray, now: np.ndarray, before: list[np.ndarray]):
        self.often, self.now, self.before = often, now, before
        self.pairs: np.ndarray | None = None

    def marks(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known = maybe_in(self.often, h)
        done = np.zeros(len(h), bool)
        for table in self.before:
            done |= maybe_in(table, h)
        return known, maybe_in(self.now, h) & known & ~done, done & known


def _pair_hashes(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * _NEXT + mix(h[1:]))


def _count_pairs(shared):
    """Hashes of the pairs in which an expanded word has its part, with counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def merged() -> pa.RecordBatch:
            h, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            distinct, back = np.unique(h, return_inverse=True)
            total = np.zeros(len(distinct), np.int64)
            np.add.at(total, back, counts)
            return pa.RecordBatch.from_arrays(
                [pa.array(distinct.view(np.int64)), pa.array(total)], names=["hash", "f"]
            )

        frontier, parts, held = shared.value, [], 0
        for part, _ in _sliced(batches):
            known, new, done = frontier.marks(part.hash)
            here = part.joined[:-1] & known[:-1] & known[1:]
            here &= (new[:-1] | new[1:]) & ~(done[:-1] | done[1:])
            h, _, counts = _tally(_pair_hashes(part.hash)[here])
            parts.append((h, counts))
            held += len(h)
            if held >= HELD:
                yield merged()
                parts, held = [], 0
        if held:
            yield merged()
    return run


def _grow(shared, earlier: list):
    """Phrases that begin or end with an expanded word, grown along often pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frontier, gathered = shared.value, _Gathered()
        pair_tables = [table.value for table in earlier]
        for part, names in _sliced(batches):
            h = part.hash
            known, new, done = frontier.marks(h)
            pairs = _pair_hashes(h)
            link = part.joined[:-1] & known[:-1] & known[1:]
            # pairs of words that no round has expanded were never counted: they pass
            often = maybe_in(frontier.pairs, pairs)
            for table in pair_tables:
                often |= maybe_in(table, pairs)
            link &= often | ~(new[:-1] | new[1:] | done[:-1] | done[1:])
            whole, sequence = np.ones(len(h), bool), h
            for size in range(2, LONGEST + 1):
                n = len(h) - size + 1
                if n <= 0:
                    break
                whole = whole[:n] & link[size - 2 : size - 2 + n]
                sequence = mix(sequence[:n] * _NEXT + mix(h[size - 1 :]))
                ends = (new[:n] | new[size - 1 :]) & ~(done[:n] | done[size - 1 :])
                at = np.flatnonzero(whole & ends)
                if not len(at):
                    continue
                distinct, place, counts = _tally(sequence[at])
                place = at[place]
                gathered.add(distinct, counts, [names[i] for i in part.lang[place].tolist()], part.phrases(place, size))
            if gathered.held >= HELD:
                yield gathered.take()
        if gathered.held:
            yield gathered.take()
    return run


def _words_of(phrase: str | Column) -> Column:
    return F.split(phrase, " ")


def _joined(words: Column, start: int | Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def _candidates(phrases: DataFrame, words: DataFrame, state: DataFrame) -> DataFrame:
    """Scores of the phrases whose first and last words have been expanded.

    ``phrases`` (lang, phrase, f) holds every often phrase that begins or ends with an
    expanded word, so all parts of a candidate are in it or in ``words``.
    """
    parts = phrases.select("lang", "phrase", "f").unionByName(words.select("lang", F.col("word").alias("phrase"), "f"))
    split = _words_of("phrase")
    size = F.size(split)
    ends = (
        phrases.withColumns({"first": F.element_at(split, 1), "last": F.element_at(split, -1)})
        .join(state.select("lang", "expanded", "n"), "lang")
    )
    inside = words.select("lang", F.col("word").alias("end_word"), F.col("f").alias("end_f"))
    for end in ("first", "last"):
        ends = ends.join(
            inside.withColumnsRenamed({"end_word": end, "end_f": f"{end}_f"}), ["lang", end]
        ).filter(F.col(f"{end}_f") <= F.col("expanded"))
    cuts = ends.select(
        "lang", "n", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k")
    ).withColumns({"left": _joined(split, 1, F.col("k")), "right": _joined(split, F.col("k") + 1, size - F.col("k"))})
    left = parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    wide = lambda name: F.col(name).cast("decimal(17,0)")
    cuts = (
        cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
        .withColumn("above", F.lit(1000).cast("decimal(4,0)") * (wide("a") * wide("n")))
        .withColumn("below", wide("l") * wide("r"))
        .withColumn("score", F.expr("above div below"))
    )
    scored = cuts.groupBy("lang", "phrase").agg(
        F.first("n").alias("n"), F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut")
    )
    longer = phrases.withColumn("words", split).filter(F.size("words") > 2)
    inner = longer.select(
        "lang", F.col("f").alias("longer_f"),
        F.explode(F.array(_joined(F.col("words"), 1, F.size("words") - 1), _joined(F.col("words"), 2, F.size("words") - 1))).alias("phrase"),
    ).groupBy("lang", "phrase").agg(F.max("longer_f").alias("longer_f"))
    return (
        scored.join(inner, ["lang", "phrase"], "left").filter("longer_f is null or longer_f < a")
        .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    )


def collocations(docs: DataFrame, top: int = 2000, least: int = 100, lang_col: str = "lang",
                 text_col: str = "text") -> DataFrame:
    """Per language the first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    counted = stored(
        texts.mapInArrow(_count_words, "lang string, phrase string, hash long, f long")
        .groupBy("lang", F.col("phrase").alias("word")).agg(F.sum("f").alias("f"), F.first("hash").alias("hash")),
        "words",
    )
    words = counted.filter(F.col("f") >= least)
    totals = stored(counted.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    often = bit_table(words, "hash")
    # the rarest words that make up half of a language's often ones; at least the rarest
    steps = words.groupBy("lang", "f").agg(F.sum("f").alias("total"))
    up = Window.partitionBy("lang").orderBy("f")
    half = (
        steps.withColumns({"sum": F.sum("total").over(up), "all": F.sum("total").over(Window.partitionBy("lang")),
                           "lowest": F.min("f").over(Window.partitionBy("lang"))})
        .groupBy("lang").agg(F.greatest(F.max(F.when(2 * F.col("sum") <= F.col("all"), F.col("f"))),
                                        F.first("lowest")).alias("wanted"))
    )
    state = stored(totals.join(half, "lang").withColumn("expanded", F.lit(0).cast("long")), "state")
    phrases: DataFrame | None = None
    before, pairs_before = [], []
    while True:
        open_words = words.join(state.filter("wanted > expanded").select("lang", "wanted", "expanded"), "lang")
        now = bit_table(stored(open_words.filter("f > expanded and f <= wanted").select("hash"), "now"), "hash")
        reading = texts.join(state.filter("wanted > expanded").select("lang"), "lang", "left_semi")
        frontier = Frontier(often, now, list(before))
        shared = spark.sparkContext.broadcast(frontier)
        pairs = stored(
            reading.mapInArrow(_count_pairs(shared), "hash long, f long")
            .groupBy("hash").agg(F.sum("f").alias("f")).filter(F.col("f") >= least).select("hash"),
            "pairs",
        )
        frontier = Frontier(often, now, list(before))
        frontier.pairs = bit_table(pairs, "hash")
        shared = spark.sparkContext.broadcast(frontier)
        grown = stored(
            reading.mapInArrow(_grow(shared, list(pairs_before)), "lang string, phrase string, hash long, f long")
            .groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least),
            "phrases",
        )
        before.append(now)
        pairs_before.append(spark.sparkContext.broadcast(frontier.pairs))
        phrases = grown if phrases is None else phrases.unionByName(grown)
        state = state.withColumn("expanded", F.greatest("expanded", "wanted"))
        found = stored(_candidates(phrases, words, state), "candidates")
        order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
        ranked = stored(
            found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top), "ranked"
        )
        last = ranked.filter(F.col("rank") == top).select("lang", F.col("score").alias("last"))
        most = words.groupBy("lang").agg(F.max("f").alias("most"))
        # words whose bound reaches the last score, all where there are too few phrases yet
        reach = F.when(F.col("last") > 0, F.expr("cast(1000 as decimal(4,0)) * cast(n as decimal(17,0)) div cast(last as decimal(20,0))"))
        state = stored(
            state.select("lang", "n", "expanded").join(last, "lang", "left").join(most, "lang")
            .select("lang", "n", "expanded",
                    F.greatest("expanded", F.least("most", F.coalesce(reach, F.col("most")))).alias("wanted")),
            "state",
        )
        if state.filter("wanted > expanded").isEmpty():
            return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
