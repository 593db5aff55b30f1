"""Near-duplicates by SimHash: tiled exact comparison of fingerprints.

1. A document's fingerprint holds the bits that more than half of its shingle hashes
   have set.  Equal fingerprints are one row from here on.
2. Fingerprints are dealt into tiles by the population counts of their ``parts`` (1 to
   16 equal pieces of the 64 bits).  Two fingerprints differ in at least as many bits
   as the counts of their parts differ in sum, so pairs of tiles whose counts differ
   by more than the radius are never formed: each tile is joined by an equi join with
   the keys that its own counts allow.  A tile of more than ``TILE`` fingerprints is
   split; its pieces meet pairwise.
3. Each pair of tiles is compared completely with numpy (exclusive-or, bit counts).
   Links inside one comparison are reduced to a spanning forest, so a group of copies
   gives no more edges than it has members in the pair of tiles.
4. Components of the links; every document takes the smallest id of its component.

The result does not depend on ``parts``: more parts mean smaller tiles and fewer
comparisons, so their number follows the count of distinct fingerprints.

Defined cases: null and blank texts have fingerprint 0 and are linked like others;
texts shorter than a shingle have one shingle, the whole sequence; rows that repeat an
id are judged each; rows with a null id take the smallest id of their component (null
if it has none); an empty table gives an empty table; other columns never matter.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flakelens.llm.common import small_batches, stored
from flakelens.llm.near_dedup import connected_components
from flakelens.llm.words import U

SEED = 42
TILE = 2048
ROWS = 64  # rows of a tile compared at once: 64 x 2048 values of 8 bytes
CHUNK = 1 << 16
# Cells that hold most fingerprints when the 64 bits are cut into so many parts.
_CELLS = {1: 17, 2: 137, 4: 4_700, 8: 1_300_000, 16: 4_000_000_000}
_CROWDED = 4_000


def fingerprint(text: bytes, shingle: int) -> int:
    """Majority of the bits of the XXH64 hashes of all word shingles."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.concatenate([[0], stop[:-1] + 1])
    k = min(shingle, len(words))
    first, last = start[: len(words) - k + 1].tolist(), stop[k - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(first), CHUNK):
        spans = zip(first[at : at + CHUNK], last[at : at + CHUNK], strict=True)
        h = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(first)).tolist())


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array(
                [fingerprint((text.as_py() or "").encode(), shingle) for text in batch.column("text")], U
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(prints.view(np.int64))], names=["id", "fp"]
            )
    return run


def _parts_for(rows: int) -> int:
    for parts, cells in _CELLS.items():
        if rows <= cells * _CROWDED:
            return parts
    return max(_CELLS)


def _base(parts: int, radius: int) -> int:
    """Counts of a part run from -radius to bits + radius once a difference is added."""
    return 64 // parts + 2 * radius + 1


def cell_key(fp, parts: int, radius: int):
    """Population counts of the parts as digits of one number."""
    bits, base = 64 // parts, _base(parts, radius)
    mask = F.lit(-1 if parts == 1 else (1 << bits) - 1).cast("long")
    key = F.lit(0).cast("long")
    for i in range(parts):
        count = F.bit_count(F.shiftrightunsigned(fp, i * bits).bitwiseAND(mask)).cast("long")
        key = key + (count + radius) * F.lit(base**i)
    return key


def differences(parts: int, radius: int) -> list[int]:
    """Differences of keys whose counts differ by at most the radius in sum; of d and -d one."""
    base = _base(parts, radius)
    found = {0}
    for places in itertools.combinations_with_replacement(range(parts), radius):
        for signs in itertools.product((-1, 0, 1), repeat=radius):
            counts = np.zeros(parts, np.int64)
            for place, sign in zip(places, signs, strict=True):
                counts[place] += sign
            found.add(sum(int(c) * base**i for i, c in enumerate(counts)))
    return sorted(d for d in found if d >= 0)


def forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of all links between (or in) the tiles, as values."""
    values = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)
    label = np.arange(len(values))
    for at in range(0, len(a), ROWS):
        near = np.bitwise_count(a[at : at + ROWS, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        i, j = i + at, j + shift
        if same:
            i, j = i[i < j], j[i < j]
        while len(i):
            x, y = label[i], label[j]
            apart = x != y
            if not apart.any():
                break
            x, y, i, j = x[apart], y[apart], i[apart], j[apart]
            # the larger root takes the smaller one; then every label moves to its root
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    linked = np.flatnonzero(label != np.arange(len(label)))
    return values[label[linked]], values[linked]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(name) for name in ("fps_a", "fps_b")]
            same = batch.column("same").to_pylist()
            out_a, out_b = [np.zeros(0, U)], [np.zeros(0, U)]
            for row in range(batch.num_rows):
                a, b = (column[row].values.to_numpy(zero_copy_only=False).view(U) for column in lists)
                x, y = forest(a, b, radius, same[row])
                out_a.append(x)
                out_b.append(y)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(o).view(np.int64)) for o in (out_a, out_b)], names=["a", "b"]
            )
    return run


def near_links(prints: DataFrame, radius: int, parts: int | None = None, tile: int = TILE) -> DataFrame:
    """Links (a, b) that join the same values as all pairs of a stored table of distinct
    fingerprints ``fp`` within the radius do."""
    parts = parts or _parts_for(prints.count())
    placed = prints.select("fp", cell_key(F.col("fp"), parts, radius).alias("cell"))
    cells = stored(
        placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("pieces")), "cells"
    )
    tiles = stored(
        placed.join(cells, "cell")
        .groupBy("cell", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int").alias("piece"))
        .agg(F.collect_list("fp").alias("fps")),
        "tiles",
    )
    steps = F.array(*[F.lit(d).cast("long") for d in differences(parts, radius)])
    left = cells.select(
        F.col("cell").alias("cell_a"), F.col("pieces").alias("pieces_a"), F.explode(steps).alias("step")
    ).withColumn("cell", F.col("cell_a") + F.col("step"))
    pairs = (
        left.join(cells, "cell")
        .select("cell_a", F.col("cell").alias("cell_b"), "pieces",
                F.explode(F.sequence(F.lit(0), F.col("pieces_a") - 1)).alias("piece_a"))
        .select("cell_a", "cell_b", "piece_a", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece_b"))
        .filter("cell_a <> cell_b or piece_a <= piece_b")
    )
    a, b = (
        tiles.select(F.col("cell").alias(f"cell_{s}"), F.col("piece").alias(f"piece_{s}"), F.col("fps").alias(f"fps_{s}"))
        for s in "ab"
    )
    met = pairs.join(a, ["cell_a", "piece_a"]).join(b, ["cell_b", "piece_b"])
    same = (F.col("cell_a") == F.col("cell_b")) & (F.col("piece_a") == F.col("piece_b"))
    return met.select("fps_a", "fps_b", same.alias("same")).mapInArrow(_compare(radius), "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                       radius: int = 2, parts: int | None = None, tile: int = TILE) -> DataFrame:
    """Per document: id, fingerprint (16 hexadecimal digits), component_id."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = stored(texts.mapInArrow(_fingerprints(shingle), "id long, fp long"), "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct_prints")
    components = connected_components(near_links(prints, radius, parts, tile).distinct())
    placed = prints.join(components.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(placed.join(least, "component").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
