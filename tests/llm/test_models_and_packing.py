"""Token counts, quality scores, packing and the pipeline."""

import random
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_dedup_queries import awkward, brute, documents, frame

from flakelens.llm import decontamination, exact_dedup, near_dedup, packing, quality, queries, token_counts

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a  b", "a \nb  c", "  x", " ", "", None, "\n", " \n x", "it's we'll 12 34x", "日本 語 text 😀😀", "<|endoftext|> x", "a\x1c b \x1cc",
       "x " * 5, "tab\t b", "▁a ▁b", "w" * 3000, "a b", "  x"]


@pytest.fixture(scope="module")
def unigram():
    import sentencepiece
    from tokenizers import Tokenizer, models

    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    vocabulary = [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())]
    tokenizer = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    return lambda text: len(tokenizer.encode("▁" + text.replace(" ", "▁")).ids) if text else 0


def test_token_counts_equal_the_tokenizer(spark, unigram):
    docs = documents(spark) + [(-1 - i, t) for i, t in enumerate(ODD)]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(frame(spark, docs), MODEL).collect()}
    assert got == {i: unigram(t) for i, t in docs}


def brute_best(text, vocabulary, unknown):
    """Best path by trying all starts in order: of equal scores the earliest start stays."""
    scores, counts = [0.0], [0]
    for end in range(1, len(text) + 1):
        best = None
        for start in range(end):
            piece = text[start:end]
            if piece in vocabulary:
                option = (scores[start] + vocabulary[piece], counts[start] + 1)
            elif end - start == 1:
                option = (scores[start] + unknown, counts[start] + len(piece.encode()))
            else:
                continue
            if best is None or option[0] > best[0]:
                best = option
        scores.append(best[0])
        counts.append(best[1])
    return scores[-1], counts[-1]


@settings(max_examples=150, deadline=None)
@given(st.text("abcé ▁\n", max_size=25))
def test_ties_follow_the_earliest_start(text):
    vocabulary = {"▁": -2.0, "a": -1.0, "b": -1.0, "ab": -2.0, "▁a": -3.0, "ba": -1.0, "aba": -2.0, "▁ab": -3.0, "bb": -9.0}
    counter = token_counts.Counter(list(vocabulary.items()))
    want = brute_best("▁" + text.replace(" ", "▁"), vocabulary, -19.0) if text else (0.0, 0)
    assert counter(text) == want


def test_encoder_equals_the_tokenizer(spark):
    encode = packing.Encoder(BYTES)
    texts = [t or "" for _, t in documents(spark)] + [t or "" for t in ODD]
    for text, want in zip(texts, encode.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(encode(text), "<u4").tolist() == want.ids


def check_packing(got, docs, capacity):
    encode = packing.encoder(BYTES)
    want = Counter()
    for i, t in docs:
        ids = encode(t or "") + np.array([2], "<u4").tobytes()
        n, at, k = len(ids) // 4, 0, 0
        while at < n:
            size = (n - 1) % capacity + 1 if not at else capacity
            want[i, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])] += 1
            at, k = at + size, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity", [1024, 64])
def test_packing(spark, capacity):
    docs = documents(spark) + [(-1 - i, t) for i, t in enumerate(ODD)] + [(5, "same row"), (5, "same row"), (None, "no id")]
    got = packing.pack(frame(spark, docs), BYTES, capacity=capacity).collect()
    used = check_packing(got, docs, capacity)
    assert used <= -(-sum(r.length for r in got) // capacity) + 2


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 30), max_size=20), st.sampled_from([1, 3, 16, 256]))
def test_plans_hold_every_length(counts, groups):
    sets = packing.plan_sets(counts, 100, groups)
    held = Counter()
    for n, lengths in sets:
        assert sum(lengths) <= 100
        for x in lengths:
            held[x] += n
    assert held == Counter(counts)
    room: list[int] = []  # first fit, longest first
    for k in sorted(counts, reverse=True):
        for _ in range(counts[k]):
            at = next((i for i, r in enumerate(room) if r >= k), None)
            if at is None:
                room.append(100 - k)
            else:
                room[at] -= k
    assert sum(n for n, _ in sets) <= len(room) * 1.05 + 1


@pytest.mark.parametrize("groups", [1, 16, 256])
def test_plans_come_from_groups(monkeypatch, groups):
    """No plan is a best fit of all lengths, and none needs more sequences than that."""
    placed: list[Counter] = []
    made, fit = packing._Bins.__init__, packing._Bins.best_fit

    def init(self, capacity):
        made(self, capacity)
        self.placed = Counter()
        placed.append(self.placed)

    def best_fit(self, length, count):
        self.placed[length] += count
        fit(self, length, count)

    rnd = random.Random(groups)
    counts = {n: rnd.randint(1, 20) for n in range(130, 1024)}
    plain = packing._Bins(1024)
    for n in sorted(counts, reverse=True):
        plain.best_fit(n, counts[n])
    monkeypatch.setattr(packing._Bins, "__init__", init)
    monkeypatch.setattr(packing._Bins, "best_fit", best_fit)
    sets = packing.plan_sets(counts, 1024, groups)
    assert placed and all(p.total() < 0.8 * sum(counts.values()) for p in placed)
    assert sum(n for n, _ in sets) <= sum(n for n, _ in plain.sets())


def test_quality_on_held_out_labels(spark):
    """No label is used to train, so all of them are held out."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op4_quality(spark, sf).join(labels, "doc_id").select("quality", "kept").collect()
    good = [r.kept for r in got if r.quality]
    low = [not r.kept for r in got if not r.quality]
    assert sum(good) / len(good) > 0.98 and sum(low) / len(low) > 0.95


def test_quality_of_awkward_rows(spark):
    rows = awkward()
    scored = quality.quality_scores(frame(spark, rows))
    assert scored.count() == len(rows)
    blank = {i for i, t in rows if not (t or "").split()}
    assert all(r.score == 0 and not r.kept for r in scored.collect() if r.doc_id in blank)
    kept = quality.good_documents(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "kept", "row", "id"]
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in scored.filter("kept").collect())


JUNK = ["### $$$ BUY NOW!!! >>> <<< $$$ ###", "AAAA BBBB!!! CCCC!!! $$$ $$$ $$$ %%% !!!", "| | | | == == == ## ## ## || |"]


@pytest.mark.parametrize("copies", [1, 1000, 20_000])
def test_quality_of_a_few_texts_of_many_copies(spark, copies):
    """The sample is of different texts, however many copies there are."""
    junk = spark.createDataFrame(list(enumerate(JUNK)), "doc_id long, text string").repartition(3)
    rows = junk.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    assert quality.quality_scores(rows).filter("kept").isEmpty()
    assert quality.good_documents(rows).isEmpty()


def test_quality_of_one_class_and_of_none(spark):
    sf = "/root/testdata/sf0.001"
    good = (
        spark.read.parquet(f"{sf}/documents.parquet")
        .join(spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1"), "doc_id").select("doc_id", "text")
    )
    assert quality.quality_scores(good).filter("not kept").count() <= 1
    blank = frame(spark, [(1, None), (2, ""), (3, " \n"), (None, None)])
    assert [(r.score, r.kept) for r in quality.quality_scores(blank).collect()] == [(0.0, False)] * 4
    assert quality.good_documents(blank).isEmpty()


def test_the_sample_is_of_the_smallest_hashes(spark):
    """A bound on the sample changes the scores little and not at all where it is not reached."""
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    whole = {r.doc_id: r.score for r in quality.quality_scores(rows).collect()}
    assert whole == {r.doc_id: r.score for r in quality.quality_scores(rows.unionByName(rows), train_rows=5000).collect()}
    part = {r.doc_id: r.score for r in quality.quality_scores(rows, train_rows=120).collect()}
    assert np.mean([(part[i] >= 0.5) == (whole[i] >= 0.5) for i in whole]) > 0.9


def test_em_finds_accuracies():
    rnd = np.random.default_rng(3)
    truth = rnd.random(60_000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.9, 0.6, 0.8])
    votes = np.where(rnd.random((len(truth), 9)) < right, truth[:, None], ~truth[:, None]) * 2
    votes[rnd.random(votes.shape) < 0.2] = quality.NONE
    patterns, counts = np.unique(votes @ quality._CODES, return_counts=True)
    good, accuracy = quality.posteriors(patterns, counts)
    plain = brute.posteriors(patterns.tolist(), counts.tolist(), quality.BELIEF, quality._MEANT.tolist())
    assert all(abs(good[p] - plain[p]) < 1e-6 for p in plain)
    found = np.array([good[p] > 0.5 for p in votes @ quality._CODES])
    assert (found == truth).mean() > 0.97
    assert np.abs(accuracy - right).max() < 0.03


@pytest.mark.parametrize("make", [
    lambda d: packing.pack(d, BYTES), lambda d: token_counts.token_counts(d, MODEL), quality.quality_scores, quality.good_documents,
    near_dedup.distinct_documents,
])
def test_empty_tables(spark, make):
    assert make(frame(spark, [(1, "a")]).filter("doc_id = 2")).count() == 0


def test_distinct_documents(spark):
    rows = awkward()
    got = Counter(r.doc_id for r in near_dedup.distinct_documents(frame(spark, rows), shingle=3, per_cent=85).collect())
    by_place = brute.near([(k, t) for k, (_, t) in enumerate(rows)])  # ids repeat, places do not
    assert sum(got.values()) == sum(kept for *_, kept in by_place)
    unique = [(3 * i, t) for i, (_, t) in enumerate(rows)]
    got = {r.doc_id for r in near_dedup.distinct_documents(frame(spark, unique), shingle=3, per_cent=85).collect()}
    assert got == {i for i, _, _, kept in brute.near(unique) if kept}


def test_pipeline_by_its_stages(spark):
    """Each stage against plain Python on the stage's own input."""
    sys.modules.pop("corpus_pipeline", None)
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality classifier", "exact dedup", "near dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pairs = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    good = p.good(spark, docs, SF).cache()
    assert good.columns == docs.columns and good.exceptAll(docs).isEmpty()
    exact = p.exact(spark, good, SF).cache()
    assert {i for i, _ in pairs(exact)} == {i for i, _, _, kept, _ in brute.exact(pairs(good)) if kept}
    near = p.near(spark, exact, SF).cache()
    assert {i for i, _ in pairs(near)} == {i for i, _, _, kept in brute.near(pairs(exact), 5, 80) if kept}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = p.clean(spark, near, SF).cache()
    assert {i for i, _ in pairs(clean)} == {r[0] for r in brute.decontaminate(pairs(near), bench) if not r[-1]}
    assert clean.columns == docs.columns
    check_packing(p.packed(spark, clean, SF).collect(), pairs(clean), 1024)
    whole = p.run(spark, SF)
    assert {r.doc_id for r in whole.select("doc_id").collect()} == {i for i, _ in pairs(clean)}
    for df in (good, exact, near, clean):
        df.unpersist()


def test_without_contaminated_in_parts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = decontamination.without_contaminated(docs, bench)
    many = decontamination.without_contaminated(docs, bench, part=500)
    assert one.count() == many.count() < docs.count() and one.exceptAll(many).isEmpty()


def test_exact_digest_is_of_lower_cased_text(spark):
    df = spark.createDataFrame([("AÄb",), ("ABC",)], "t string").select(exact_dedup.digest(F.col("t")))
    assert [r[0] for r in df.collect()] == [brute.sha("aÄb"), brute.sha("abc")]
