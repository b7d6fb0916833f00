"""SimHash near-duplicates by segment-popcount embedding: a grid join under a Manhattan lower bound, then exact distances."""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, features, graph

#: Odd bits of a long, as Spark's signed long.
LOW_BITS = 0x5555555555555555
#: Pairs a row up to which a cell of the grid gives all its pairs at once; these are compared where they are.
PAIRS_PER_ROW = 1024


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of so many words, repeats included; A-Z in lower case; fewer words: one shingle; none: no hash."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.empty(0, np.uint64)
    joined, h = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([h(joined, seed)], np.uint64)
    ends = list(accumulate(map(len, w), lambda at, n: at + 1 + n))
    starts = [0, *(e + 1 for e in ends[: len(w) - words])]
    return np.array([h(joined[i:j], seed) for i, j in zip(starts, ends[words - 1 :], strict=True)], np.uint64)


def fold(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is 1 if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint, as a signed long, of each row's whole text (null or no words: zero)."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([fold(shingle_hashes(t, words, seed)) for t in batch.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(common.by_batch(step), "doc_id long, fp long")


def popcounts(fp: Column) -> Column:
    """The embedding: bit counts (0 to 2) of the 32 segments of two bits, each written as that many ones, in one long.

    The Manhattan distance of two embeddings is bit_count(x ^ y), and never more than the fingerprints' Hamming distance.
    """
    high = F.shiftrightunsigned(fp, 1)
    both, any_ = fp.bitwiseAND(high).bitwiseAND(F.lit(LOW_BITS)), fp.bitwiseOR(high).bitwiseAND(F.lit(LOW_BITS))
    return F.shiftleft(both, 1).bitwiseOR(any_)


def grid_masks(radius: int) -> list[int]:
    """Masks of the grid: the 32 segments in radius + 3 blocks, three blocks to a mask.

    Vectors at Manhattan distance up to radius differ in at most radius blocks, so three blocks at least are equal.
    """
    blocks = radius + 3
    edges = [64 * k // (2 * blocks) * 2 for k in range(blocks)] + [64]
    part = [((1 << edges[k + 1]) - 1) & ~((1 << edges[k]) - 1) for k in range(blocks)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(part[i] | part[j] | part[k]) for i, j, k in combinations(range(blocks), 3)]


def within(pairs: DataFrame, radius: int) -> DataFrame:
    """The pairs (a, b) of fingerprints that differ in at most radius bits; the Manhattan distance of their embeddings is asked first."""
    apart = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    bound = apart(popcounts(F.col("a")), popcounts(F.col("b"))) <= radius
    return pairs.where(F.when(bound, apart(F.col("a"), F.col("b")) <= radius).otherwise(False))


def linked(fps: DataFrame, radius: int = 3, per_row: int = PAIRS_PER_ROW) -> DataFrame:
    """(node, root) of those of the distinct fingerprints `fp` that lie within radius bits of others: connected ones have one root."""
    embedded = fps.select("fp", popcounts(F.col("fp")).alias("u"))
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("u").bitwiseAND(F.lit(m))) for i, m in enumerate(grid_masks(radius))])
    members = graph.shared_cells(embedded.select(F.explode(keys).alias("cell"), F.col("fp").alias("id")))
    return graph.linked(members, lambda pairs: within(pairs, radius), per_row)


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, per_row: int = PAIRS_PER_ROW) -> DataFrame:
    """(doc_id, fp, component_id) for each row: component_id is the smallest doc_id reachable over links, itself included.

    Rows whose fingerprints differ in at most radius bits are linked; equal fingerprints (copies, and all texts without words)
    form one class and cost one row in the search. Repeated rows come out as often as they came in; a null doc_id is never the
    smallest. An empty table gives an empty one.
    """
    fps = common.cut(fingerprints(docs, words))
    classes = common.cut(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    found = linked(classes, radius, per_row)
    rooted = common.cut(found.join(classes, found["node"] == classes["fp"]).select("fp", "root", "low"))
    smallest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    joined = rooted.join(smallest, "root").select("fp", F.col("component_id").alias("linked"))
    of = classes.join(joined, "fp", "left").select("fp", F.coalesce("linked", "low").alias("component_id"))
    return fps.join(of, "fp").select("doc_id", "fp", "component_id")


#: Bands of the search by similarity, and min-hashes to a band. Two texts of Jaccard similarity j share no band with probability
#: (1 - j ** ROWS) ** BANDS: 1.5e-5 at 0.8, 4e-11 at 0.9.
BANDS, ROWS = 28, 5
#: Longs of a sketch, which holds a bit of each of 64 times as many min-hashes: sets of similarity j agree in (1 + j) / 2 of the bits. A pair
#: is verified if its sketches differ in no more bits than SIGMAS standard deviations over the mean allow (miss rate 3.2e-5 at 0.8).
SKETCH, SIGMAS = 24, 4.0
_RNG = np.random.default_rng(5)
SALTS, FACTORS = (_RNG.integers(0, 1 << 64, (64 * SKETCH, 1), np.uint64) for _ in range(2))
FACTORS |= np.uint64(1)
#: Pairs a row up to which a cell of bands gives all its pairs at once; these are texts to fetch.
TEXT_PAIRS_PER_ROW = 4
#: Ids up to which a list of texts to fetch is broadcast (8 bytes each), and pairs (16 bytes each); beyond, they are joined by a shuffle.
BROADCAST_IDS, BROADCAST_PAIRS = 1_000_000, 200_000


def min_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The least of the shingles' hashes under each of the first n hash functions."""
    low = np.full(n, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(low, ((hashes[at : at + 512] ^ SALTS[:n]) * FACTORS[:n]).min(axis=1), out=low)
    return low


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band, from ROWS min-hashes of its own (no shingles: fixed keys)."""
    key = features.mixed(np.arange(BANDS, dtype=np.uint64), 99)
    if len(hashes):
        for k, column in enumerate(min_hashes(hashes, BANDS * ROWS).reshape(BANDS, ROWS).T):
            key = features.mixed(key + column, 100 + k)
    return key.view(np.int64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """A random bit of each min-hash, in SKETCH longs."""
    return np.packbits(features.mixed(min_hashes(hashes, 64 * SKETCH), 98) >> np.uint64(63) != 0).view("<i8")


def alike(similarity: float) -> Column:
    """Whether a pair, by its sizes and sketches, may have this similarity."""
    bits, share = 64 * SKETCH, (1 - similarity) / 2
    most = int(bits * share + SIGMAS * (bits * share * (1 - share)) ** 0.5)
    apart = sum((F.bit_count(F.col(f"s{k}_a").bitwiseXOR(F.col(f"s{k}_b"))) for k in range(1, SKETCH)), F.bit_count(F.col("s0_a").bitwiseXOR(F.col("s0_b"))))
    # Sets of too different sizes cannot be that similar (less by a trifle, as this product is rounded).
    return (F.least("size_a", "size_b") >= (similarity - 1e-9) * F.greatest("size_a", "size_b")) & (apart <= most)


def _listed(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is among ids."""
    ids = common.cut(ids.distinct())
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b), each given once, whose sets have a Jaccard similarity of at least `similarity`."""

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(both >= similarity * (len(x) + len(y) - both))
        return batch.filter(pa.array(good, pa.bool_())).select([0, 1])

    of_a, of_b = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    if pairs.count() <= BROADCAST_PAIRS:
        both = of_a.join(F.broadcast(pairs), "a").join(of_b.join(F.broadcast(pairs.select("b").distinct()), "b"), "b")
    else:
        both = pairs.join(of_a, "a").join(of_b, "b")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(common.by_batch(verify), "a long, b long")


def similar(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """(node, root) of texts that may be in one group with another text: node and root are xxhash64 of the texts (null: empty).

    A link is a pair of texts whose sets of shingles of `words` words have a Jaccard similarity of at least `similarity`, which is
    computed exactly (shingles by 64-bit hash). Candidates are all pairs of texts whose SimHash fingerprints over these shingles are
    connected within `radius` bits, by the grid search, and, since a similarity of 0.8 moves some ten bits, all pairs that share a band
    of min-hashes and do not differ too much in size or in a sketch. Each is verified unless links found before connect its ends
    already, which leaves the groups as they are.
    """
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("id", F.xxhash64("text"))

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [shingle_hashes(t, words) for t in batch.column(0).to_pylist()]
        return pa.record_batch([batch.column(1), pa.array([fold(h) for h in hashes], pa.int64()), pa.array([band_keys(h) for h in hashes], pa.list_(pa.int64()))], names=["id", "fp", "keys"])

    known = common.cut(rows.mapInArrow(common.by_batch(keys), "id long, fp long, keys array<long>").dropDuplicates(["id"]))
    close = linked(known.select("fp").distinct(), radius).withColumnRenamed("node", "fp")
    closest = known.select("id", "fp").join(close, "fp", "left").select(F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")).alias("cell"), "id")
    members = graph.shared_cells(known.select(F.explode("keys").alias("cell"), "id").unionByName(closest))

    marks = [f"s{k}" for k in range(SKETCH)]

    def shingles(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [np.unique(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()]
        sketches = np.array([sketch(h) for h in hashes]).T
        return pa.record_batch([batch.column(0), pa.array([h.astype("<u8").tobytes() for h in hashes], pa.binary()), pa.array([len(h) for h in hashes], pa.int64()), *map(pa.array, sketches)], names=["id", "set", "size", *marks])

    texts = _listed(rows, members.select("id")).dropDuplicates(["id"]).select("id", "text")
    sets = common.stash(texts.mapInArrow(common.by_batch(shingles), "id long, set binary, size long, " + ", ".join(f"{m} long" for m in marks)), "shingles")
    # A pair that shares several cells is verified in the least of them: each member knows its cells, of which there are few.
    members = common.cut(members.join(members.groupBy("id").agg(F.collect_list("cell").alias("cells")), "id").join(sets.drop("set"), "id"))
    first = F.array_min(F.array_intersect("cells_a", "cells_b")) == F.col("cell")
    return graph.linked(members, lambda pairs: _alike(common.cut(pairs.where(alike(similarity) & first).select("a", "b")), sets, similarity), TEXT_PAIRS_PER_ROW)


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs without copies and near copies: of each group of similar texts the row with the smallest doc_id stays.

    Of rows that share that doc_id and group, one stays; a null doc_id comes last. Columns are those of docs. Texts are told apart by a
    64-bit hash: among n different texts n * n / 2 ** 65 rows are expected to be taken for a copy wrongly (3 of 10 ** 10).
    """
    columns = docs.columns
    names = [f"__c{i}" for i in range(len(columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)])
    text = F.coalesce(F.col(names[columns.index("text")]).cast("string"), F.lit(""))
    doc = F.coalesce(F.col(names[columns.index("doc_id")]).cast("long"), F.lit((1 << 63) - 1).cast("long"))
    groups = similar(docs, words, similarity).withColumnRenamed("node", "id")
    light = rows.select(doc.alias("__doc"), F.xxhash64(text).alias("id")).groupBy("id").agg(F.min("__doc").alias("low"))
    rooted = light.join(groups, "id", "left").select("id", "low", F.coalesce("root", "id").alias("root"))
    winners = rooted.groupBy("root").agg(F.min_by("id", "low").alias("__id"), F.min("low").alias("__low")).select("__id", "__low")
    kept = rows.withColumn("__id", F.xxhash64(text)).withColumn("__low", doc).join(common.cut(winners), ["__id", "__low"])
    return kept.dropDuplicates(["__id", "__low"]).select(*[F.col(n).alias(c) for c, n in zip(columns, names, strict=True)])
