"""Quality classifier: weak labellers, their accuracies by EM, a hashed linear scorer.

1. Overlapping heuristics vote on every document: low, good or no opinion.  Votes
   are counted by pattern over all documents; there are at most 3^L patterns.
2. Expectation-maximisation on the pattern counts estimates how each labeller votes
   on good and low documents, and from that a posterior for every pattern.
3. A bounded sample of documents with their posteriors trains a logistic scorer on
   hashed features: words, shapes of words, pairs of shapes and repeated words.  The
   sample is the ``TRAIN_ROWS`` different texts with the smallest hashes, or all texts
   where there are fewer: copies do not crowd others out.
4. The scorer judges every document by its whole text.

Labels given by people are not used; they serve to measure the result.

Defined cases: texts without words (null, empty, blank) score 0 and are rejected, so a
table that has no others keeps nothing; a sample whose labels all agree keeps or rejects
every text like it;
repeated rows are judged alike; an empty table gives an empty table; other columns
never matter and are kept by ``good_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flakelens.llm.common import small_batches, stored
from flakelens.llm.words import SPACES, U, Words, byte_class, mix, slices

SHAPES, WORDS = 1 << 14, 1 << 16  # buckets of shapes and of words
BUCKETS = SHAPES + WORDS
TRAIN_ROWS = 8_000  # bound of the training sample
THRESHOLD = 0.5
FEATURES = 4  # of each word
PRIOR_WORDS = 4  # neutral words added to each text, so that a few words decide little
LOW, NONE, GOOD = 0, 1, 2

_UPPER = byte_class(lambda b: 0x41 <= b <= 0x5A)
_LOWER = byte_class(lambda b: 0x61 <= b <= 0x7A or b >= 0x80)
_MARKS = byte_class(lambda b: b in b"#$%&*+/<=>@\\^_`{|}~")
_BANG = byte_class(lambda b: b == 0x21)
_DIGIT = byte_class(lambda b: 0x30 <= b <= 0x39)
_END = byte_class(lambda b: b in b".!?")
# byte -> shape: letters of one kind, digits, anything else as it is
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[_UPPER], _SHAPE[_LOWER], _SHAPE[_DIGIT] = 65, 97, 48


def _per_doc(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(total[first])


def _vote(value: np.ndarray, good: np.ndarray, low: np.ndarray) -> np.ndarray:
    return np.where(low, LOW, np.where(good, GOOD, NONE))


class Signals:
    """What the labellers look at, for each document of a slice."""

    def __init__(self, words: Words):
        n = words.counts()
        self.n = np.maximum(n, 1)
        data, first = words.data, words.first

        def words_with(kind: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])
            return total[words.stop] - total[words.start]

        length = words.stop - words.start
        upper, lower = words_with(_UPPER), words_with(_LOWER)
        marks, bangs = words_with(_MARKS), words_with(_BANG)
        self.hash = words.hashes()
        same = np.zeros(len(self.hash), bool)
        same[1:] = self.hash[1:] == self.hash[:-1]
        same[first[:-1][n > 0]] = False
        self.same = same
        ends = _END[data[words.stop - 1]] if len(length) else np.zeros(0, bool)
        share = lambda flags: _per_doc(flags, first) / self.n
        self.marked = share(marks > 0)
        self.shouted = share((upper > 1) & (lower == 0))
        self.banged = share(bangs > 1)
        self.bars = share((marks > 0) & (marks == length))
        self.repeats = share(same)
        self.ends = share(ends)
        letters = upper + lower
        # a word in mixed or lower case with at most one mark around it
        self.plain = share((length - letters <= 1) & ((lower > 0) | (letters == 1)))
        total = np.maximum(_per_doc(length, first), 1)
        self.lower = _per_doc(lower, first) / total
        self.letters = _per_doc(letters, first) / total

    def votes(self) -> np.ndarray:
        """One column for each labeller; thresholds are the labellers' definitions.

        Most of them detect one kind of fault and else have no opinion; kinds
        overlap.  Two know plain prose as well.
        """
        never = np.zeros(len(self.n), bool)
        long = self.n >= 12
        clean = (self.plain > 0.85) & (self.repeats < 0.05)
        return np.stack([
            _vote(self.n, never, self.marked > 0.25),
            _vote(self.n, never, self.shouted > 0.40),
            _vote(self.n, never, self.banged > 0.20),
            _vote(self.n, never, self.bars > 0.15),
            _vote(self.n, never, self.repeats > 0.25),
            _vote(self.n, clean, (self.plain < 0.60) | (self.repeats > 0.40)),
            _vote(self.n, never, self.letters < 0.78),
            _vote(self.n, never, (self.lower < 0.50) & long),
            _vote(self.n, (self.ends > 0.02) & (self.ends < 0.45) & clean, (self.ends > 0.75) & long),
        ], axis=1)


LABELLERS = 9
BELIEF = 0.02
# of an imagined low and good document: the share of labellers that vote low, abstain, vote good
_MEANT = np.array([[0.3, 0.7, 0.0], [0.0, 0.7, 0.3]])
_CODES = 3 ** np.arange(LABELLERS)
_PICKS = 1 << 62  # texts are sampled by a hash below it


def features(words: Words, signals: Signals) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features (bucket of each) and the first one of every document.

    For every word: the word, its shape (runs of one kind of character count once), its
    shape with the one before, and whether it repeats the one before.
    """
    kinds = _SHAPE[words.data]
    keep = np.ones(len(kinds), bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[words.start] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    shapes = Words(0, kinds[keep], at[words.start], at[words.stop], words.first).hashes(seed=11)
    pairs = shapes.copy()
    pairs[1:] += mix(shapes[:-1])
    pairs[words.first[:-1][words.counts() > 0]] = U(0)
    same = np.where(signals.same, U(1), U(2))
    each = np.stack([mix(shapes), mix(pairs + U(3)), mix(same + U(77))], axis=1) % U(SHAPES)
    each = np.column_stack([mix(signals.hash + U(5)) % U(WORDS) + U(SHAPES), each])
    return each.reshape(-1).astype(np.int64), FEATURES * words.first


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros(3**LABELLERS, np.int64)
    for batch in batches:
        for words in slices(batch.column("text"), SPACES, False):
            some = words.counts() > 0
            totals += np.bincount((Signals(words).votes() @ _CODES)[some], minlength=len(totals))
    found = np.flatnonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(totals[found])], names=["pattern", "n"])


def posteriors(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[dict[int, float], np.ndarray]:
    """P(good) of every vote pattern, and each labeller's accuracy where it votes.

    Labellers are taken as independent given the class; the first guess is that a
    document is low where any labeller says so.  A share of ``BELIEF`` imagined documents
    of each class, on which labellers mean what they say, keeps the classes from trading
    places where there are few patterns.
    """
    votes = patterns[:, None] // _CODES[None, :] % 3
    good = np.where((votes == LOW).any(axis=1), 0.1, 0.9)
    table = np.zeros((2, LABELLERS, 3))
    belief = BELIEF * counts.sum() * _MEANT
    for _ in range(rounds):
        for c, weight in enumerate((counts * (1 - good), counts * good)):
            for v in (LOW, NONE, GOOD):
                table[c, :, v] = ((votes == v) * weight[:, None]).sum(axis=0) + 1.0 + belief[c, v]
        table /= table.sum(axis=2, keepdims=True)
        prior = np.clip((counts * good).sum() / max(counts.sum(), 1), 0.01, 0.99)
        logs = np.log(table)
        each = np.arange(LABELLERS)[None, :]
        odds = np.log(prior / (1 - prior)) + (logs[1][each, votes] - logs[0][each, votes]).sum(axis=1)
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        moved = np.abs(new - good).max(initial=0)
        good = new
        if moved < 1e-9:
            break
    right = np.where(votes == GOOD, good[:, None], 1 - good[:, None]) * counts[:, None]
    voted = (votes != NONE) * counts[:, None]
    accuracy = ((votes != NONE) * right).sum(axis=0) / np.maximum(voted.sum(axis=0), 1)
    return dict(zip(patterns.tolist(), good.tolist(), strict=True)), accuracy


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pattern and feature shares of each document with words."""
    for batch in batches:
        for words in slices(batch.column("text"), SPACES, False):
            signals = Signals(words)
            codes = signals.votes() @ _CODES
            bucket, first = features(words, signals)
            pattern, index, value, pick = [], [], [], []
            for d in np.flatnonzero(words.counts() > 0):
                i, c = np.unique(bucket[first[d] : first[d + 1]], return_counts=True)
                pattern.append(int(codes[d]))
                index.append(i)
                value.append(c / (c.sum() + FEATURES * PRIOR_WORDS))
                pick.append(int(d) + words.row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("pick").take(pa.array(pick, pa.int64())), pa.array(pattern, pa.int64()),
                 pa.array(index, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))],
                names=["pick", "pattern", "index", "value"],
            )


def train(rows: pa.Table, good: dict[int, float], rounds: int = 300, rate: float = 0.3,
          shrink: float = 1e-5) -> np.ndarray:
    """Logistic weights (the last one is the constant) on posterior labels, by Adam."""
    weights = np.zeros(BUCKETS + 1)
    if not rows.num_rows:
        return weights
    rows = rows.combine_chunks()
    target = np.array([good.get(p, 0.5) for p in rows["pattern"].to_pylist()])
    lists = [pa.chunked_array(rows[c]).combine_chunks() for c in ("index", "value")]
    column, value = (c.flatten().to_numpy(zero_copy_only=False) for c in lists)
    value = value.astype(np.float64)
    owner = np.repeat(np.arange(rows.num_rows), np.diff(lists[0].offsets.to_numpy()))
    one, two = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, rounds + 1):
        z = weights[-1] + np.bincount(owner, value * weights[column], minlength=rows.num_rows)
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) / rows.num_rows
        step = np.append(np.bincount(column, value * error[owner], minlength=BUCKETS), error.sum())
        step += shrink * weights
        one = 0.9 * one + 0.1 * step
        two = 0.999 * two + 0.001 * step**2
        weights -= rate * (one / (1 - 0.9**t)) / (np.sqrt(two / (1 - 0.999**t)) + 1e-9)
    return weights


def _scores(texts: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Score and vote pattern of each text."""
    score, pattern = np.zeros(len(texts)), np.full(len(texts), -1, np.int64)
    for words in slices(texts, SPACES, False):
        signals = Signals(words)
        bucket, first = features(words, signals)
        total = np.concatenate([[0.0], np.cumsum(weights[bucket])])
        z = weights[-1] + (total[first[1:]] - total[first[:-1]]) / (FEATURES * (words.counts() + PRIOR_WORDS))
        some = words.counts() > 0
        rows = slice(words.row, words.row + words.n_docs)
        score[rows] = np.where(some, 1 / (1 + np.exp(-np.clip(z, -40, 40))), 0.0)
        pattern[rows] = np.where(some, signals.votes() @ _CODES, -1)
    return score, pattern


class Model:
    def __init__(self, weights: np.ndarray, good: dict[int, float], accuracy: np.ndarray):
        self.weights, self.good, self.accuracy = weights, good, accuracy


def fit(docs: DataFrame, text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Model:
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("text"))
    votes = stored(texts.mapInArrow(_patterns, "pattern long, n long"), "votes")
    # at most 3 ** LABELLERS rows
    rows = votes.groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    patterns = np.array([r.pattern for r in rows], np.int64)
    counts = np.array([r.n for r in rows], np.int64)
    good, accuracy = posteriors(patterns, counts)
    # the smallest hashes of different texts lie in a share that an estimate of their number
    # gives with room to spare; copies meet before the texts are read
    picked = texts.filter(F.col("text").isNotNull()).withColumn(
        "pick", F.xxhash64("text").bitwiseAND(F.lit(_PICKS - 1))
    )
    different = picked.agg(F.approx_count_distinct("pick")).first()[0]
    limit = int(min(1.0, 1.5 * train_rows / max(different, 1)) * _PICKS)
    chosen = (
        picked.filter(F.col("pick") < F.lit(limit)).groupBy("pick").agg(F.any_value("text").alias("text"))
        .orderBy("pick").limit(train_rows)
    )
    schema = "pick long, pattern long, index array<int>, value array<float>"
    # at most train_rows rows, as Arrow: some thousand numbers each
    sample = chosen.mapInArrow(_sample, schema).orderBy("pick").limit(train_rows).toArrow()
    return Model(train(sample, good), good, accuracy)


def quality_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: id, the labellers' posterior, the scorer's score and whether it is kept."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col, train_rows))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            score, pattern = _scores(batch.column("text"), m.weights)
            posterior = [m.good.get(p, 0.0) for p in pattern.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(posterior, pa.float64()), pa.array(score), pa.array(score >= threshold)],
                names=["id", "posterior", "score", "kept"],
            )

    id_type = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {id_type}, posterior double, score double, kept boolean").select(
        F.col("id").alias(id_col), F.round("posterior", 6).alias("posterior"),
        F.round("score", 6).alias("score"), "kept",
    )


def good_documents(docs: DataFrame, text_col: str = "text", train_rows: int = TRAIN_ROWS,
                   threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are kept, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col, train_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, _ = _scores(batch.column(batch.schema.get_field_index(text_col)), model.value.weights)
            yield batch.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)
