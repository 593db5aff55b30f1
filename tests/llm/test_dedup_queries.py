"""Operators against plain Python on awkward rows and on the smallest given tables."""

import random
from collections import Counter

import brute
import pytest
from pyspark.sql import functions as F

from flakelens.llm import decontamination, exact_dedup, near_dedup, queries, sharding, substring_dedup, url_filter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, kept string, row string, id string"


def awkward(seed=1):
    """Nulls, empty and long texts, ties, repeated rows and ids, copies and edited copies."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6)))
    prose = lambda n: [word() for _ in range(n)]
    base = prose(300)
    texts = [None, "", "  \n\t ", "a", "A b", "a  B", "x y z", "X\u00a0y z", "É é", "é é"]
    texts += [" ".join(base), " ".join(base).upper(), " ".join(base)]
    for k in (1, 3, 9, 14, 20, 40):
        copy = base[:]
        for _ in range(k):
            copy[rnd.randrange(300)] = word()
        texts += [" ".join(copy), "\n".join(copy)]
    passage = prose(45)
    for _ in range(6):
        texts.append(" ".join(prose(rnd.randint(0, 60)) + passage + prose(rnd.randint(0, 60))))
    texts += [" ".join(["er"] * 90), " ".join(["er", "st"] * 40), " ".join(passage * 4), "w" * 5000]
    texts.append(" ".join(prose(30_000)))
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(3, "a"), (3, "a"), (10, texts[10]), (11, "another text with the same id"), (None, "a"), (None, texts[20])]
    rnd.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA).repartition(3)


def rows_of(df, *names):
    return Counter(tuple(r) for r in df.select(*names).collect())


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def rows():
    return awkward()


EXACT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_exact_duplicates_of_awkward_rows(spark, rows):
    got = exact_dedup.exact_duplicates(frame(spark, rows))
    want = brute.exact([(-1 if i is None else i, t) for i, t in rows])
    clean = [(None if i == -1 else i, None if k == -1 else k, n, s) for i, k, n, _, s in want]
    assert rows_of(got, "doc_id", "keep_id", "group_size", "text_sha256") == Counter(clean)
    kept = got.filter("kept")
    assert kept.count() == kept.select("text_sha256").distinct().count() == len({r[4] for r in want})
    assert kept.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).isEmpty()


def test_without_copies_keeps_columns_and_one_row_of_each_text(spark, rows):
    got = exact_dedup.without_copies(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "kept", "row", "id"]
    want = {}
    for i, _, _, _, s in brute.exact([(-1 if i is None else i, t) for i, t in rows]):
        want[s] = max(want.get(s, -1), i)
    low = Counter((-1 if r.doc_id is None else r.doc_id) for r in got.collect())
    assert low == Counter(want.values())


def test_filter_passes_unique_rows(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") % 19_990).cast("string")).alias("text"))
    hashes = docs.select(F.xxhash64("text").alias("hash"), "text").cache()
    repeated = hashes.groupBy("hash").count().filter("count > 1").select("hash")
    found = exact_dedup.Filter(repeated).probe(hashes, F.col("hash"), "maybe")
    assert 20 <= found.filter("maybe").count() <= 60
    single, copies = exact_dedup._judged(docs, "doc_id", "text")
    assert copies.count() <= 60 and single.count() + copies.count() == 20_000
    # a row that the filter rules out is in no exchange: the plan of these rows has broadcasts only
    plan = single._jdf.queryExecution().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    hashes.unpersist()


def test_a_full_filter_loses_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(exact_dedup.Filter, "__init__", _tiny)
    got = exact_dedup.exact_duplicates(frame(spark, rows))
    want = brute.exact([(-1 if i is None else i, t) for i, t in rows])
    assert Counter((r.text_sha256, r.group_size) for r in got.collect()) == Counter((s, n) for _, _, n, _, s in want)
    kept = exact_dedup.without_copies(frame(spark, rows))
    assert kept.count() == len({s for *_, s in want})


def _tiny(self, keys, max_words=64, made=exact_dedup.Filter.__init__):
    """A filter of 64 words that holds many other keys too."""
    noise = keys.sparkSession.range(5000).select(F.xxhash64("id").alias("hash"))
    made(self, keys.unionByName(noise), 64)


def test_sharding(spark, rows):
    df = frame(spark, rows)
    got = sharding.assign_shards(df, [1.0] * 8).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r["size"], r.text_crc32) for r in got} == brute.sizes(rows)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 8) and r.law == "key" for r in got)
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})


def test_sharding_is_even_weighted_and_stable(spark):
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = sharding.assign_shards(df, [1.0, 1.0, 2.0]).cache()
    share = {r.shard: r["count"] / 40_000 for r in got.groupBy("shard").count().collect()}
    assert abs(share[0] - 0.25) < 0.02 and abs(share[2] - 0.5) < 0.02
    moved = got.filter("grown_shard <> shard")
    assert abs(moved.count() / 40_000 - 0.2) < 0.02 and moved.filter("grown_shard <> 3").isEmpty()
    got.unpersist()


@pytest.mark.parametrize("weights", [[1.0] * 8, [1.0, 2.5, 0.5], [3.0]])
def test_shards_equal_plain_rendezvous(spark, weights):
    ids = [*range(-50, 600), 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string")
    got = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.assign_shards(df, weights, added_weight=1.5).collect()}
    assert got == {i: (brute.shard(i, weights), brute.shard(i, [*weights, 1.5])) for i in ids}


NEAR = ("doc_id", "n_shingles", "component_id", "kept")


def test_near_duplicates_of_awkward_rows(spark, rows):
    distinct = [(i, t) for i, t in rows if i is not None]
    got = near_dedup.near_duplicates(frame(spark, distinct), shingle=3, per_cent=85)
    assert rows_of(got, *NEAR) == Counter(brute.near(distinct))


def test_near_duplicates_with_null_ids(spark, rows):
    got = near_dedup.near_duplicates(frame(spark, rows), shingle=3, per_cent=85)
    assert got.count() == len(rows)


def test_chains_of_edited_copies_lose_no_link(spark):
    rnd = random.Random(5)
    text = [str(rnd.randrange(10**6)) for _ in range(240)]
    docs = []
    for i in range(60):  # neighbours are linked, distant ones are not
        docs.append((i, " ".join(text)))
        text[rnd.randrange(240)] = str(rnd.randrange(10**6))
        text[rnd.randrange(240)] = str(rnd.randrange(10**6))
    docs = [(int(i), t) for i, (_, t) in zip(rnd.sample(range(1000), 60), docs, strict=True)]
    got = near_dedup.near_duplicates(frame(spark, docs), shingle=3, per_cent=85)
    assert rows_of(got, *NEAR) == Counter(brute.near(docs))


def test_near_duplicates_of_given_documents(spark):
    got = queries.op5_minhash(spark, SF)
    assert rows_of(got, *NEAR) == Counter(brute.near(documents(spark)))


CLEAN = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def items(rows):
    long = next(t for _, t in rows if t and len(t.split()) == 300)
    return [(1, " ".join(long.split()[20:60])), (1, " ".join(long.split()[20:60])), (2, " ".join(long.split()[40:52])),
            (10, "er er"), (11, "ER"), (12, ""), (None, None), (13, "x, y; z"), (14, " ".join(["er"] * 12)),
            (None, " ".join(long.split()[100:115])), (15, "no such words anywhere at all in these texts i hope")]


@pytest.mark.parametrize("part", [decontamination.PART, 7])
def test_contamination_of_awkward_rows(spark, rows, part):
    bench = spark.createDataFrame(items(rows), "item_id long, text string")
    got = decontamination.contamination(frame(spark, rows), bench, part=part)
    assert rows_of(got, *CLEAN) == Counter(brute.decontaminate(rows, items(rows)))


def test_contamination_of_given_documents(spark):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = Counter(brute.decontaminate(documents(spark), bench))
    assert rows_of(queries.op7_decontamination(spark, SF), *CLEAN) == want
    assert sum(r[-1] for r in want) > 0


URLS = ["https://a.example.net/en/1?x#y", "http://EXAMPLE.net/en/", "http://example.net/EN/", "x", None, "", "://", "://net",
        "http://net/", "http://a.net?x/", "http://example.com/de/1", "http://w.example.com/de", "http://m.x.org/fr/", "http://org/fr/",
        "http://borg/fr/", "http://..net/", "a://b://c.net/", "http://x.net:80/", "http://é.org/fr/é", "http://a.example.com./de/",
        "http://example.com\n/de/", "http://" + "a." * 300 + "net/" + "b/" * 3000]


def test_urls(spark):
    rules = [*queries.RULES, ("", "/", "block"), ("x.org", "/fr/", "block"), ("x.org", "/fr/", "allow"), ("é.org", "/fr/é", "block"), ("org", "", "block")]
    pages = spark.createDataFrame([(i % 20, u, "h", "p") for i, u in enumerate(URLS + URLS[:3])], "page_id long, url string, host string, path string")
    got = url_filter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, action string"))
    want = Counter((i % 20, *brute.judge(u, rules)) for i, u in enumerate(URLS + URLS[:3]))
    assert rows_of(got, "page_id", "host", "path", "rule", "verdict") == want
    none = url_filter.judge_urls(pages, spark.createDataFrame([], "host string, path string, action string"))
    assert none.filter("rule is null and verdict = 'allow'").count() == len(URLS) + 3


CUT = ("doc_id", "n_words", "n_removed", "kept_sha256")


def test_repeated_windows_of_awkward_rows(spark, rows):
    assert rows_of(substring_dedup.repeated_windows(frame(spark, rows)), *CUT) == Counter(brute.repeats(rows))


def test_repeated_windows_with_unique_ids(spark, rows):
    unique = [(3 * i, t) for i, (_, t) in enumerate(rows)]
    got = substring_dedup.repeated_windows(frame(spark, unique))
    want = Counter(brute.repeats(unique))
    assert rows_of(got, *CUT) == want and sum(r[2] for r in want) > 500


def test_repeated_windows_of_given_documents(spark):
    assert rows_of(queries.op9_substring_dedup(spark, SF), *CUT) == Counter(brute.repeats(documents(spark)))


@pytest.mark.parametrize("make", [
    exact_dedup.exact_duplicates, exact_dedup.without_copies, near_dedup.near_duplicates, substring_dedup.repeated_windows,
    lambda d: sharding.assign_shards(d, [1.0]), lambda d: url_filter.judge_urls(
        d.withColumnsRenamed({"doc_id": "page_id", "text": "url"}), d.sparkSession.createDataFrame(queries.RULES, "host string, path string, action string")),
    lambda d: decontamination.contamination(d, d.withColumnRenamed("doc_id", "item_id")),
])
def test_empty_tables(spark, make):
    assert make(frame(spark, [(1, "a")]).filter("doc_id = 2")).count() == 0


def test_urls_with_many_labels_take_no_longer(spark):
    import time

    rules = spark.createDataFrame(queries.RULES + [("a.b.c.net", "/", "allow")], "host string, path string, action string")
    rows = [(1, "http://" + "l." * 20_000 + "net/en/x"), (2, "http://x.a.b.c.net/"), (3, "http://" + "." * 20_000 + "example.com/de/"),
            (4, "http://a.b.c.net." + "/" * 50_000), (5, "http://net/" + "e" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    url_filter.judge_urls(pages.limit(1), rules).collect()
    start = time.perf_counter()
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert time.perf_counter() - start < 15
    assert got == {1: ("net/", "block"), 2: ("a.b.c.net/", "allow"), 3: ("example.com/de/", "block"), 4: (None, "allow"), 5: ("net/", "block")}
