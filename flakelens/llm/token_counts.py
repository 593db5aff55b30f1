"""Token counts of a unigram tokenizer by a count-only Viterbi pass.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each
character; dynamic programming carries the best score and the number of pieces,
nothing else.  Ties follow the public implementations: of equal scores the path
whose last piece starts first wins, a character without a piece of its own may be
unknown at a score ten below the least, and each of its UTF-8 bytes counts as one
token (byte fallback).

No piece holds a space mark after another character, and none holds a line end if
the vocabulary has none, so the best path of a text is made of the best paths of its
segments between such places.  Segments repeat, and their results are remembered
up to a fixed number.

Scores come from a SentencePiece model file; its pieces and scores are read as a
unigram vocabulary.

Defined cases: null and empty texts have no tokens and score 0; repeated rows are
counted each; an empty table gives an empty table; other columns never matter.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flakelens.llm.common import small_batches

MARK = "▁"  # fixed value: stands for a space in the pieces
UNKNOWN_PENALTY = 10.0
MEMO = 300_000
_LONGEST = 64


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Ordinary pieces of a model file with their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return [
        (model.id_to_piece(i), model.get_score(i))
        for i in range(model.get_piece_size())
        if not any(test(i) for test in special)
    ]


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        inner = any(MARK in piece.lstrip(MARK) for piece, _ in vocabulary)
        lines = any("\n" in piece for piece, _ in vocabulary)
        self.segments = (
            (lambda text: [text]) if inner
            else re.compile(f"{MARK}+[^{MARK}]*").findall if lines
            else re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+").findall
        )
        self.memo: dict[str, tuple[float, int]] = {}

    def best(self, segment: str) -> tuple[float, int]:
        """Score and number of pieces of the best path through a segment."""
        n = len(segment)
        scores, counts = array("d", bytes(8 * n + 8)), array("q", bytes(8 * n + 8))
        matches = self.automaton.iter(segment)
        ahead = next(matches, None)
        for end in range(1, n + 1):
            here = []
            while ahead is not None and ahead[0] == end - 1:
                here.append(ahead[1])
                ahead = next(matches, None)
            top, count, single = None, 0, False
            for length, piece_score in sorted(here, reverse=True):  # earliest start first
                score = scores[end - length] + piece_score
                single = single or length == 1
                if top is None or score > top:
                    top, count = score, counts[end - length] + 1
            if not single:
                score = scores[end - 1] + self.unknown
                if top is None or score > top:
                    top, count = score, counts[end - 1] + len(segment[end - 1].encode())
            scores[end], counts[end] = top, count
        return scores[n], counts[n]

    def __call__(self, text: str) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        score, count, memo = 0.0, 0, self.memo
        for segment in self.segments(MARK + text.replace(" ", MARK)):
            found = memo.get(segment)
            if found is None:
                found = self.best(segment)
                if len(segment) <= _LONGEST:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[segment] = found
            score += found[0]
            count += found[1]
        return score, count


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(read_vocabulary(path))


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_tokens and the score of the best path."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model)
        for batch in batches:
            found = [count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([n for _, n in found], pa.int64()),
                 pa.array([s for s, _ in found], pa.float64())],
                names=["id", "n_tokens", "score"],
            )

    id_type = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {id_type}, n_tokens long, score double").withColumnRenamed("id", id_col)
