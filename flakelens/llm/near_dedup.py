"""Near-duplicates: one-permutation MinHash, banded buckets, star-shaped candidates.

1. Each text becomes its set of word shingles.  One hash of every shingle fills
   ``BINS`` bins (the minimum of each), empty bins borrow by optimal densification,
   and bands of bins give bucket keys.  Equal sets are one class from here on.
2. A bucket of classes yields a star: its smallest class is linked to each other
   one, so a bucket of m classes gives m - 1 pairs.
3. Pairs are confirmed on the full sets.
4. Buckets whose other classes are still in several components form groups, each
   with the shingles that more than half of it holds (its base).  The class nearest
   to the base is the centre of one more star.  For what is still apart, a class is
   described by the shingles it gained and lost against the base.  Two classes
   without a common gain can be linked only if the counts allow it; others share one
   of their rarest gains (prefix filter).  Both conditions are exact, so no link is
   lost, and a large group of edited copies gives few pairs.
5. Components of the links by repeated minimum and pointer jumping.

Candidates come from the bands alone: with 36 bands of 5 bins a pair of
similarity 0.85 shares no bucket with a probability of 7e-10.

Defined cases: null and blank texts have an empty set and no links; texts shorter
than a shingle have one shingle, the whole sequence; rows that repeat an id are
nodes of their own; rows with a null id take the smallest id of their component;
an empty table gives an empty table; other columns of the input never matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from flakelens.llm.bits import Filter, bit_table, maybe_in
from flakelens.llm.common import fresh, small, small_batches, stored
from flakelens.llm.words import SPACES, U, Words, inside, mix, sequence_hashes, slices

BANDS, WIDTH = 36, 5
BINS = BANDS * WIDTH
_TRIES = 64
_BAND_SEEDS = mix(np.arange(1, BANDS + 1, dtype=U) * U(0x632BE59BD9B4E019))
_WEIGHTS = mix(np.arange(101, 101 + WIDTH, dtype=U)) | U(1)
# donor[i, j]: the bin that empty bin i asks in its j-th try
_DONORS = (
    mix(np.arange(BINS, dtype=U)[:, None] * U(1 << 20) + np.arange(_TRIES, dtype=U)[None, :] + U(99))
    % U(BINS)
).astype(np.int64)


def densified(sorted_hashes: np.ndarray) -> np.ndarray:
    """One-permutation signature of a sorted set of distinct hashes, no bin empty.

    The upper half of a hash gives its bin, so the first hash of each bin in sorted
    order is the bin's minimum.
    """
    bins = ((sorted_hashes >> U(32)) * U(BINS) >> U(32)).astype(np.int64)
    first = np.ones(len(bins), bool)
    first[1:] = bins[1:] != bins[:-1]
    signature = np.zeros(BINS, U)
    full = np.zeros(BINS, bool)
    signature[bins[first]] = sorted_hashes[first]
    full[bins[first]] = True
    empty = np.flatnonzero(~full)
    if len(empty):
        found = full[_DONORS[empty]]
        # a bin that found no donor in all its tries asks the following bins
        ring = np.flatnonzero(full)
        donor = ring[np.searchsorted(ring, empty) % len(ring)]
        tried = found.any(axis=1)
        donor[tried] = _DONORS[empty[tried], found[tried].argmax(axis=1)]
        signature[empty] = signature[donor]
    return signature


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = mix(signature).reshape(BANDS, WIDTH) * _WEIGHTS
    return mix(rows.sum(axis=1, dtype=U) + _BAND_SEEDS)


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    h = words.hashes()
    runs = sequence_hashes(h, k)
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        n = b - a
        if n >= k:
            yield np.unique(runs[a : b - k + 1])
        elif n:
            yield mix(sequence_hashes(h[a:b], n) + U(n))
        else:
            yield np.zeros(0, U)


def _prints(s: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set; equal sets are taken to be sets with equal prints."""
    a = mix(s + U(0x1234567)).sum(dtype=U)
    b = mix(s ^ U(0x9E3779B97F4A7C15)).sum(dtype=U)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in slices(batch.column("text"), SPACES, True):
                sizes, one, two, keys = [], [], [], []
                for s in shingle_sets(words, k):
                    sizes.append(len(s))
                    a, b = _prints(s)
                    one.append(a)
                    two.append(b)
                    keys.append(band_keys(densified(s)).view(np.int64) if len(s) else None)
                rows = slice(words.row, words.row + words.n_docs)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[rows], pa.array(sizes, pa.int64()), pa.array(one, pa.int64()),
                     pa.array(two, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["id", "n", "one", "two", "bands"],
                )
    return run


def _sets(k: int, wanted):
    """Sets of the rows whose id may be wanted, by the bit table ``wanted``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = maybe_in(wanted.value, batch.column("hash").to_numpy(zero_copy_only=False).view(U))
            batch = batch.filter(pa.array(some))
            for words in slices(batch.column("text"), SPACES, True):
                one, two, sets = [], [], []
                for s in shingle_sets(words, k):
                    a, b = _prints(s)
                    one.append(a)
                    two.append(b)
                    sets.append(s.view(np.int64))
                rows = slice(words.row, words.row + words.n_docs)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[rows], pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                     pa.array(sets, pa.list_(pa.int64()))],
                    names=["id", "one", "two", "hashes"],
                )
    return run


def _printed(k: int, text_col: str, one: str, two: str):
    """The rows with the prints of their sets; both are 0 for an empty set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [
                _prints(s) for words in slices(batch.column(batch.schema.get_field_index(text_col)), SPACES, True)
                for s in shingle_sets(words, k)
            ]
            a, b = (pa.array([p[i] for p in prints], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, a, b], names=[*batch.schema.names, one, two])
    return run


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of an edge table (a, b); the component is its smallest node.

    Each round takes the least label among neighbours, then the label of the label;
    both tables are stored, so lineage stays short.
    """
    both = stored(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))),
        "edges",
    )
    labels = stored(both.groupBy(F.col("a").alias("node"))
                    .agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        lower = stored(
            labels.join(near, labels["node"] == near["a"])
            .select("node", F.least("component", "near").alias("component"),
                    (F.col("near") < F.col("component")).alias("moved")),
            "labels",
        )
        if not lower.filter("moved").limit(1).count():
            return labels
        jump = lower.select(F.col("node").alias("at"), F.col("component").alias("to"))
        labels = stored(
            lower.join(jump, lower["component"] == jump["at"])
            .select("node", F.least("component", "to").alias("component")),
            "labels",
        )


class _Confirmer:
    """Confirms pairs of classes on full sets, fetching the texts of new classes only."""

    def __init__(self, texts: DataFrame, classes: DataFrame, k: int, per_cent: int):
        self.texts, self.classes, self.k, self.per_cent = texts, classes, k, per_cent
        self.sets: DataFrame | None = None

    def sets_of(self, wanted: DataFrame) -> DataFrame:
        """(cid, hashes) of at least the wanted classes."""
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("cid"), "cid", "left_anti")
        wanted = stored(wanted.join(self.classes.select("cid", "doc", "one", "two"), "cid"), "wanted")
        # texts stay where they are: a bit table tells which may be wanted, and only sets are joined
        keys = stored(wanted.select(F.xxhash64("doc").alias("hash")).distinct(), "wanted_keys")
        table = self.texts.sparkSession.sparkContext.broadcast(bit_table(keys, "hash"))
        made = self.texts.withColumn("hash", F.xxhash64("id")).mapInArrow(
            _sets(self.k, table), "id long, one long, two long, hashes array<long>"
        )
        made = made.join(
            wanted.withColumnRenamed("one", "one_").withColumnRenamed("two", "two_"),
            F.col("id").eqNullSafe(F.col("doc")) & (F.col("one") == F.col("one_")) & (F.col("two") == F.col("two_")),
        )
        new = stored(made.select("cid", "hashes"), "sets")
        # rows that repeat an id and a text bring one set several times
        if new.count() > wanted.count():
            new = stored(new.dropDuplicates(["cid"]), "sets")
        self.sets = new if self.sets is None else self.sets.unionByName(new)
        return self.sets

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """Pairs and whether they are linked."""
        sets = self.sets_of(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct())
        a = sets.select(F.col("cid").alias("a"), F.col("hashes").alias("set_a"))
        b = sets.select(F.col("cid").alias("b"), F.col("hashes").alias("set_b"))
        common = F.size(F.array_intersect("set_a", "set_b"))
        measured = (
            pairs.join(b, "b").join(a, "a")
            .select("a", "b", common.alias("common"),
                    (F.size("set_a") + F.size("set_b") - common).alias("union"))
        )
        return stored(
            measured.select(
                "a", "b", (100 * F.col("common") >= self.per_cent * F.col("union")).alias("linked"),
            ),
            "pairs",
        )


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 5, per_cent: int = 80) -> DataFrame:
    """Per document: id, n_shingles, component_id, kept (the smallest id stays)."""
    return _components(docs, id_col, text_col, shingle, per_cent).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = 5, per_cent: int = 80) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest id.

    Of rows that repeat this id the one with the least set prints stays; of those
    whose sets are equal too, any one.  Documents without words all stay.
    """
    rows = stored(_components(docs, id_col, text_col, shingle, per_cent), "components")
    again = rows.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1 or id is null")
    one, two, drop = fresh(docs, "_one", "_two", "_drop")
    if again.isEmpty():
        gone = stored(
            rows.filter("id <> component_id").select(F.col("id").alias(drop), F.xxhash64("id").alias("hash")), "gone"
        )
        # most documents pass the filter where they are; the others meet the list of those that go
        maybe, = fresh(docs, "_maybe")
        probed = Filter(gone.select("hash")).probe(docs, F.xxhash64(F.col(id_col).cast("long")), maybe)
        stays = probed.filter(~F.col(maybe)).drop(maybe)
        unsure = probed.filter(maybe).drop(maybe)
        return stays.unionByName(unsure.join(gone.select(drop), unsure[id_col] == gone[drop], "left_anti"))
    stays = stored(
        rows.filter("n > 0").groupBy("component")
        .agg(F.min(F.struct(F.col("id").isNull(), "id", "one", "two")).alias("s"))
        .select(F.col("s.id").alias(drop), F.col("s.one").alias("one_"), F.col("s.two").alias("two_")),
        "stays",
    )
    schema = StructType([*docs.schema.fields, StructField(one, LongType()), StructField(two, LongType())])
    printed = docs.mapInArrow(_printed(shingle, text_col, one, two), schema)
    full = printed.join(
        small(stays),
        printed[id_col].eqNullSafe(F.col(drop)) & (F.col(one) == F.col("one_")) & (F.col(two) == F.col("two_")),
        "left_semi",
    ).dropDuplicates([id_col, one, two])
    empty = printed.filter((F.col(one) == 0) & (F.col(two) == 0))
    return full.unionByName(empty).drop(one, two)


def _components(docs: DataFrame, id_col: str, text_col: str, shingle: int, per_cent: int) -> DataFrame:
    """Per document: id, n, prints of its set, component and its smallest id."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = stored(
        texts.mapInArrow(_signatures(shingle), "id long, n long, one long, two long, bands array<long>"),
        "signatures",
    )
    classes = stored(
        rows.filter("n > 0").groupBy("one", "two", "n")
        .agg(F.min("id").alias("doc"), F.any_value("bands").alias("bands"))
        .withColumn("cid", F.monotonically_increasing_id()),
        "classes",
    )
    entries = classes.select(F.explode("bands").alias("key"), "cid")
    buckets = stored(
        entries.groupBy("key").agg(F.min("cid").alias("centre"), F.count(F.lit(1)).alias("size"))
        .filter("size > 1").select("key", "centre"),
        "buckets",
    )
    members = stored(entries.join(buckets, "key"), "members")
    confirm = _Confirmer(texts, classes, shingle, per_cent)
    pairs = members.filter("cid <> centre").select(*_pair("centre", "cid")).distinct()
    tested = confirm(stored(pairs, "candidates"))
    components = connected_components(tested.filter("linked"))
    groups = _groups(members, buckets, components)
    if not groups.isEmpty():
        apart = _differences(groups, confirm.sets_of(groups.select("cid").distinct()))
        star = _medoid_star(apart)
        tested = tested.unionByName(confirm(_untested(star, tested)))
        apart = _regrouped(apart, connected_components(tested.filter("linked")))
        found = _sharing_gains(apart, per_cent).unionByName(_near_base(apart, per_cent))
        tested = tested.unionByName(confirm(_untested(found, tested)))
        components = connected_components(tested.filter("linked"))
    return _labelled(rows, classes, components)


def _untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    return stored(pairs.distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti"), "candidates")


def _placed(classes: DataFrame, components: DataFrame) -> DataFrame:
    return classes.join(components.withColumnRenamed("node", "cid"), "cid", "left").withColumn(
        "component", F.coalesce("component", "cid")
    )


def _groups(members: DataFrame, buckets: DataFrame, components: DataFrame) -> DataFrame:
    """(g, cid, component) of buckets that hold, beside their centre, more than one component.

    A bucket belongs to the group of its most frequent component.
    """
    placed = stored(_placed(members.select("key", "cid"), components), "placed")
    others = placed.join(buckets.select("key", F.col("centre").alias("cid")), ["key", "cid"], "left_anti")
    active = (
        others.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .filter("low < high").select("key")
    )
    counted = placed.join(active, "key").groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    group = stored(
        counted.groupBy("key").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("g")), "group"
    )
    return stored(placed.join(group, "key").select("g", "cid", "component").distinct(), "groups")


def _differences(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Each class of a group against the base: its gains, the count of its losses, the base's size."""
    held = stored(groups.join(sets, "cid"), "held")
    size = groups.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    often = (
        held.select("g", F.explode("hashes").alias("hash")).groupBy("g", "hash").agg(F.count(F.lit(1)).alias("n"))
        .join(size, "g").filter("2 * n > size")
    )
    # at most twice as many shingles as the classes have on average
    base = stored(often.groupBy("g").agg(F.collect_list("hash").alias("base")), "base")
    none = F.array().cast("array<long>")
    joined = held.join(small(base), "g", "left").withColumn("base", F.coalesce("base", none))
    return stored(
        joined.select("g", "cid", "component", F.array_except("hashes", "base").alias("gains"),
                      F.size(F.array_except("base", "hashes")).alias("lost"), F.size("base").alias("base_size")),
        "differences",
    )


def _medoid_star(apart: DataFrame) -> DataFrame:
    nearest = stored(
        apart.groupBy("g").agg(F.min(F.struct(F.size("gains") + F.col("lost"), "cid", "component")).alias("m"))
        .select("g", F.col("m.cid").alias("centre"), F.col("m.component").alias("own")),
        "medoids",
    )
    return apart.select("g", "cid", "component").join(small(nearest), "g").filter("component <> own").select(
        *_pair("centre", "cid")
    )


def _regrouped(apart: DataFrame, components: DataFrame) -> DataFrame:
    """Groups that still hold several components, with the present ones."""
    placed = _placed(apart.drop("component"), components)
    active = placed.groupBy("g").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    return stored(placed.join(active.select("g"), "g"), "apart")


def _least_common(per_cent: int) -> Column:
    """Gains that a class must share with any class it is linked to; 0 or less: none.

    With base size p, losses l and gains x, the intersection of two sets is at most
    p - max(l) plus the common gains, and their union is at least p plus both gains
    minus min(l) minus the common gains.
    """
    return F.ceil(
        (per_cent * F.size("gains") + (100 - per_cent) * (F.col("lost") - F.col("base_size"))) / F.lit(100)
    )


def _sharing_gains(apart: DataFrame, per_cent: int) -> DataFrame:
    """Pairs of different components that share one of their rarest gains."""
    gains = stored(
        apart.select("g", "cid", "component", (F.size("gains") - F.greatest(_least_common(per_cent), F.lit(1)) + 1).alias("prefix"),
                     F.explode("gains").alias("hash")).filter("prefix > 0"),
        "gains",
    )
    often = gains.groupBy("g", "hash").agg(
        F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high")
    )
    # a gain that only one class or component has makes no pair, but keeps its place in the order
    own = often.select("g", "hash", "n", (F.col("low") < F.col("high")).alias("crosses"))
    order = Window.partitionBy("g", "cid").orderBy("n", "hash")
    rare = stored(
        gains.join(own, ["g", "hash"]).withColumn("place", F.row_number().over(order))
        .filter("place <= prefix and crosses").select("g", "cid", "component", "hash"),
        "rare_gains",
    )
    x, y = rare.alias("x"), rare.alias("y")
    return (
        x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.hash") == F.col("y.hash")) & (F.col("x.cid") < F.col("y.cid"))
               & (F.col("x.component") != F.col("y.component")))
        .select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"))
    )


def _near_base(apart: DataFrame, per_cent: int) -> DataFrame:
    """Pairs of different components whose counts allow a link without common gains."""
    near = stored(
        apart.filter(_least_common(per_cent) <= 0)
        .select("g", "cid", "component", F.size("gains").alias("gained"), "lost", "base_size"),
        "near",
    )
    counted = near.groupBy("g", "component").agg(F.count(F.lit(1)).alias("n"))
    main = counted.groupBy("g").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("main"))
    placed = near.join(main, "g")
    x, y = placed.filter("component <> main").alias("x"), placed.alias("y")
    fits = (
        100 * (F.col("x.base_size") - F.greatest("x.lost", "y.lost"))
        >= per_cent * (F.col("x.base_size") + F.col("x.gained") + F.col("y.gained") - F.least("x.lost", "y.lost"))
    )
    return (
        x.join(y, F.col("x.g") == F.col("y.g"))
        .filter((F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.main")) | (F.col("x.cid") < F.col("y.cid"))) & fits)
        .select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b"))
    )


def _labelled(rows: DataFrame, classes: DataFrame, components: DataFrame) -> DataFrame:
    placed = (
        classes.select("cid", "doc", "one", "two", "n")
        .join(components.withColumnRenamed("node", "cid"), "cid", "left")
        .withColumn("component", F.coalesce("component", "cid"))
    )
    least = placed.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = stored(
        placed.join(least, "component").select("one", "two", "n", "component", "component_id"), "named"
    )
    narrow = rows.select("id", "n", "one", "two")
    full = narrow.filter("n > 0").join(small(named), ["one", "two", "n"])
    empty = narrow.filter("n = 0").withColumns({"component": F.lit(None).cast("long"), "component_id": F.col("id")})
    return full.unionByName(empty)
