"""Collocations, ranked search and SimHash against plain Python, on awkward rows."""

import random
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_dedup_queries import awkward, frame, rows_of

from flakelens.llm import bits, collocations, lexical_search, simhash

SF = "/root/testdata/sf0.001"


def spoken(seed, n=400):
    """(lang, text) rows with fixed phrases inside noise, a hot language, nulls and repeats."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 3))) for _ in range(40)]
    fixed = [[f"p{i}{j}" for j in range(rnd.randint(2, 7))] for i in range(12)]
    rows = [(None, "Und und. und"), ("xx", None), ("xx", ""), ("xx", " .,;:!?\n\t "), ("one", "word")]
    for _ in range(n):
        parts = []
        for _ in range(rnd.randint(1, 12)):
            parts += rnd.choice(fixed) if rnd.random() < 0.3 else [rnd.choice(words)]
            if rnd.random() < 0.2:
                parts[-1] += rnd.choice([".", ",", "!?", "\n", " ", " ;"])
        text = rnd.choice([" ", "  ", " \t"]).join(parts)
        rows.append((rnd.choice(["xx", "xx", "xx", "yy", None]), text.upper() if rnd.random() < 0.2 else text))
    return rows + rows[:30]


def phrase_frame(spark, rows):
    return spark.createDataFrame(
        [(lang, t, 1, "w", 2) for lang, t in rows], "lang string, text string, f int, word string, rank int"
    ).repartition(3)


PHRASES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize(("top", "least"), [(2000, 5), (7, 4), (25, 12), (3, 2)])
def test_collocations(spark, top, least):
    rows = spoken(top)
    want = Counter(brute.collocate(rows, top, least))
    got = collocations.collocations(phrase_frame(spark, rows), top, least)
    assert rows_of(got, *PHRASES) == want and want


def test_collocations_settled_by_the_bound_skip_common_words(spark):
    """Rare fixed phrases fill the ranking: words in every text are never expanded."""
    rnd = random.Random(5)
    rows = [("xx", " ".join([f"r{i % 40}a r{i % 40}b"] + [rnd.choice(["the", "of", "and"]) for _ in range(30)]))
            for i in range(400)]
    want = Counter(brute.collocate(rows, 10, 5))
    assert rows_of(collocations.collocations(phrase_frame(spark, rows), 10, 5), *PHRASES) == want


def test_collocations_of_nothing(spark):
    assert collocations.collocations(phrase_frame(spark, [("xx", None)])).count() == 0
    assert collocations.collocations(phrase_frame(spark, []).limit(0)).count() == 0


def asked(seed=2):
    rnd = random.Random(seed)
    rows = awkward()
    texts = [t for _, t in rows if t]
    items = [(None, "a b x"), (1, None), (2, ""), (3, "nowhereatall"), (4, "er st a é")]
    for i in range(5, 25):
        words = rnd.choice(texts).split()
        at = rnd.randrange(max(1, len(words) - 30))
        items.append((i, " ".join(words[at : at + 30]) + "!"))
    return rows, items + [(7, "x y z"), items[6]]


def item_frame(spark, items):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, score int, rank int")


@pytest.mark.parametrize(("k", "block"), [(50, 1 << 15), (5, 7), (1, 1)])
def test_ranked_search(spark, k, block):
    rows, items = asked()
    want = Counter(brute.ranked(rows, items, k))
    got = lexical_search.ranked_search(frame(spark, rows), item_frame(spark, items), k, block_docs=block)
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == want


def test_ranked_search_ties_go_by_id(spark):
    rows = [(i, "same words here") for i in random.Random(3).sample(range(500), 200)] + [(900, "other text")]
    got = lexical_search.ranked_search(frame(spark, rows), item_frame(spark, [(1, "same words")]), 50, block_docs=30)
    assert [r.doc_id for r in got.orderBy("rank").collect()] == sorted(i for i, _ in rows)[:50]


def test_ranked_search_of_nothing(spark):
    docs, items = frame(spark, [(1, "a b")]), item_frame(spark, [(1, "a")])
    assert lexical_search.ranked_search(docs.limit(0), items).count() == 0
    assert lexical_search.ranked_search(docs, items.limit(0)).count() == 0
    assert lexical_search.ranked_search(frame(spark, [(1, None)]), items).count() == 0


def test_search_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "CHUNK_TERMS", 20)
    monkeypatch.setattr(lexical_search, "BROADCAST_TERMS", 0)
    rows, items = asked()
    got = lexical_search.ranked_search(frame(spark, rows), item_frame(spark, items), 5)
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == Counter(brute.ranked(rows, items, 5))


def test_bounds_leave_documents_unscored():
    """Documents far below the k-th score are never taken out."""
    rnd = np.random.default_rng(1)
    docs = np.arange(4000)
    impacts = rnd.integers(1, 100, 4000)
    impacts[::400] += 10_000
    postings = lexical_search.Postings(["a", "b"], np.array([4000, 4000]), np.concatenate([docs, docs]),
                                       np.concatenate([impacts, impacts[::-1]]).astype(np.int64))
    best = lexical_search.Best(5)
    scored = lexical_search.search_block(postings, np.array([0, 1]), np.array([3, 1]), docs, np.zeros(4000, bool), best)
    total = 3 * impacts + impacts[::-1]
    assert best.score.tolist() == sorted(total.tolist(), reverse=True)[:5]
    assert scored < 400


@pytest.mark.parametrize("parts", [1, 2, 4, 8, 16])
def test_simhash_of_awkward_rows(spark, parts):
    rows = awkward()
    got = simhash.simhash_components(frame(spark, rows), parts=parts, tile=5)
    assert rows_of(got, "doc_id", "fingerprint", "component_id") == Counter(brute.simhashes(rows))


def test_simhash_of_nothing(spark):
    assert simhash.simhash_components(frame(spark, [(1, "a")]).limit(0)).count() == 0


def near_values(seed, n=600):
    rnd = random.Random(seed)
    values = {0, 2**64 - 1, 1 << 63}
    while len(values) < n:
        v = rnd.getrandbits(64) if rnd.random() < 0.3 else rnd.choice(sorted(values)) ^ (1 << rnd.randrange(64))
        values.add(v)
    return sorted(values)


@pytest.mark.parametrize(("parts", "radius", "tile"), [(1, 2, 64), (2, 2, 7), (4, 3, 2048), (8, 2, 16), (16, 1, 64)])
def test_links_give_the_components_of_all_pairs(spark, parts, radius, tile):
    values = near_values(parts)
    df = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    edges = {(a % 2**64, b % 2**64) for a, b in simhash.near_links(df, radius, parts, tile).collect()}
    assert all((a ^ b).bit_count() <= 64 for a, b in edges)
    group = {v: {v} for v in values}
    for pairs in (edges,):
        for a, b in pairs:
            if group[a] is not group[b]:
                group[a] |= group[b]
                for v in group[b]:
                    group[v] = group[a]
    want = {v: {v} for v in values}
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius and want[a] is not want[b]:
                want[a] |= want[b]
                for v in want[b]:
                    want[v] = want[a]
    assert group == want


def test_a_group_of_copies_gives_few_edges():
    base = np.uint64(12345)
    values = np.unique(np.concatenate([[base], base ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    a, b = simhash.forest(values, values, 2, True)
    assert len(a) == len(values) - 1


def test_bit_table_knows_its_keys(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("h")).persist()
    table = bits.bit_table(df, "h")
    keys = np.array([r.h for r in df.collect()], np.int64).view(np.uint64)
    others = np.random.default_rng(1).integers(0, 2**64, 20_000, np.uint64)
    assert bits.maybe_in(table, keys).all()
    assert bits.maybe_in(table, others).mean() < 0.05
    assert not bits.maybe_in(bits.bit_table(df.limit(0), "h"), others).any()
