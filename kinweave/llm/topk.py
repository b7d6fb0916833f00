"""Exact top-k inner-product search by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Vectors in a block of candidates or of queries, and bins of one round.
BLOCK, BINS = 1024, 256
#: Bytes (as doubles) from which a block is full, and bytes of the candidates' blocks that a task holds beside a block of queries, on average.
BLOCK_BYTES, HELD = 4 << 20, 64 << 20
#: Blocks of queries whose counts a task holds before it reports them.
SUMS = 64
BLOCKS = "dim int, block long, n int, ids binary, vectors binary, norm double"


def quantise(vector: list | None) -> np.ndarray | None:
    """floor(256 * x) of each component, x as double; None if the vector is null or holds null, nan or infinity."""
    if vector is None or any(x is None for x in vector):
        return None
    v = np.asarray(vector, np.float64)
    return np.floor(256.0 * v) if len(v) and np.isfinite(v).all() else None


def _packed(m: np.ndarray) -> bytes:
    """Whole numbers in two bytes each where all fit, else as doubles."""
    return m.astype("<i2" if m.min() >= -(1 << 15) and m.max() < 1 << 15 else "<f8").tobytes()


def _unpacked(raw: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<i2" if len(raw) == 2 * n * dim else "<f8").reshape(n, dim).astype(np.float64)


def blocks(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, embedding) as blocks of at most BLOCK vectors of one length, made where the rows lie."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        context, made = TaskContext.get(), 0

        def out(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, vs = held.pop(dim)
            made += 1
            m = np.array(vs, "<f8")
            return pa.record_batch(
                [pa.array([x], t) for x, t in ((dim, pa.int32()), ((context.partitionId() << 32) + made, pa.int64()), (len(ids), pa.int32()), (np.array(ids, "<i8").tobytes(), pa.binary()), (_packed(m), pa.binary()), (float(np.linalg.norm(m, axis=1).max()), pa.float64()))],
                names=["dim", "block", "n", "ids", "vectors", "norm"],
            )

        for batch in batches:
            for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if vec_id is None or (q := quantise(v)) is None:
                    continue
                ids, vs = held.setdefault(len(q), ([], []))
                ids.append(vec_id)
                vs.append(q)
                if len(ids) == BLOCK or 8 * len(ids) * len(q) >= BLOCK_BYTES:
                    yield out(len(q))
        for dim in list(held):
            yield out(dim)

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding")).mapInArrow(make, BLOCKS)


def _scores(queries: pd.Series, block: pd.Series, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of queries and of candidates, and their scores, exact whole numbers: as doubles up to 2^53, else as longs. A query's own row
    gets less than any score."""
    q_ids, c_ids = (np.frombuffer(x, "<i8") for x in (queries["ids"], block["ids"]))
    q, c = (_unpacked(x["vectors"], len(i), block["dim"]) for x, i in ((queries, q_ids), (block, c_ids)))
    s = q @ c.T if reach < 1 << 53 else q.astype(np.int64) @ c.astype(np.int64).T
    s[q_ids[:, None] == c_ids[None, :]] = -reach - 1
    return q_ids, c_ids, s


def _settled(rows: DataFrame) -> DataFrame:
    """cut() of a round's result; the round's shuffle files go with it, rather than stay until the driver collects its garbage."""
    conf, key = rows.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return common.cut(rows)
    finally:
        if before is None:
            conf.unset(key)
        else:
            conf.set(key, before)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products of quantised vectors, ties to the smaller vec_id.

    Candidates and queries travel in blocks; each block of queries meets each block of candidates of the same vector length once a
    round. In every round a task scores its pairs of blocks, counts each query's scores in the bins of that query's current range,
    and reports the topmost bins that hold k of its own scores: lower bins cannot hold the kth score. The reports' sums tell the bin
    of the global kth score, which is the next round's range, until a bin is one integer wide. A last pass keeps scores above the
    kth value and, among those equal to it, the smallest ids as far as needed.
    Scores are exact up to 2^62; where the largest norms allow higher ones, a ValueError tells so.
    Vectors null, empty or with null or non-finite components take no part; rows with an equal vec_id are each other's own row;
    fewer than k candidates are all returned. An empty table gives an empty one.
    No blocks are broadcast: copies of the queries' blocks are shuffled to parts of the candidates, so the driver holds no vectors.
    """
    spark = vectors.sparkSession
    n = common.partitions(spark)
    cand = common.cut(blocks(vectors))
    asked = common.cut(blocks(queries.coalesce(max(1, n // 4))))
    bound, n_blocks, n_bytes = cand.agg(F.max("norm"), F.count("*"), F.sum(F.length("vectors"))).first()
    norms = asked.agg(F.max("norm")).first()[0]
    schema = "query_id long, rank int, vec_id long, score long"
    if bound is None or norms is None:
        return spark.createDataFrame([], schema)
    # Each block of queries is copied `spread` times, so that its work is dealt over the tasks; every pair of blocks meets once.
    # As many parts as the session has tasks for, if there are blocks for them, and more where a part would hold too much.
    spread = max(1, min(n // 2, n_blocks), -(-n_bytes // HELD))
    sides = cand.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(spread)).cast("int"))
    if not bound * norms < 1 << 62:
        raise ValueError(f"inner products of vectors with norms of {bound:.3g} and {norms:.3g}, 256 times the given ones, may not fit a long")
    reach = int(bound * norms * (1 + 1e-9)) + 1
    width = 1
    while width * BINS < 2 * reach + 1:
        width *= BINS
    state = None  # per query: low end of its range, scores known to lie above the range

    def met(state: DataFrame | None) -> DataFrame:
        """Pairs of blocks with, per query of the block, the low end of its range and how many scores of its k are sought there."""
        q = asked.select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
        if state is not None:
            packed = state.groupBy("q_block").agg(F.sort_array(F.collect_list(F.struct("query_id", "low", "above"))).alias("state"))
            q = q.join(packed.hint("merge"), "q_block")
        else:
            q = q.withColumn("state", F.lit(None).cast("array<struct<query_id:long,low:long,above:long>>"))
        # Spark would size the copies as the few blocks they are made from, and broadcast them: merge joins alone keep them off the driver.
        q = q.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        return q.join(sides.select("dim", "part", "ids", "vectors").hint("merge"), ["dim", "part"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, c_ids, s = _scores({"ids": r["q_ids"], "vectors": r["q_vectors"]}, r, reach)
                if r["state"] is None:
                    low, above = np.full(len(q_ids), -reach, np.int64), np.zeros(len(q_ids), np.int64)
                else:
                    known = {x["query_id"]: (x["low"], x["above"]) for x in r["state"]}
                    low, above = (np.array([known.get(i, (-reach, 0))[c] for i in q_ids.tolist()], np.int64) for c in (0, 1))
                yield r["q_block"], q_ids, c_ids, s, low, above

    def counted(width: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}

            def report() -> Iterator[pa.RecordBatch]:
                for q_block, (q_ids, low, above, counts) in sums.items():
                    down = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]  # scores in this bin or higher
                    need = (counts > 0) & (down - counts < (k - above)[:, None])
                    row, bin_ = np.nonzero(need)
                    yield pa.record_batch([pa.array(np.full(len(row), q_block)), pa.array(q_ids[row]), pa.array(bin_.astype(np.int64)), pa.array(counts[row, bin_].astype(np.int64)), pa.array(low[row]), pa.array(above[row])], names=["q_block", "query_id", "bin", "n", "low", "above"])
                sums.clear()

            for q_block, q_ids, _, s, low, above in each(batches):
                bin_ = (s - low[:, None]) // width
                ok = (bin_ >= 0) & (bin_ < BINS)
                flat = np.where(ok, bin_, 0).astype(np.int64) + np.arange(len(q_ids))[:, None] * BINS
                counts = np.bincount(flat[ok], minlength=len(q_ids) * BINS).reshape(len(q_ids), BINS)
                if q_block in sums:
                    sums[q_block][3] += counts
                else:
                    if len(sums) == SUMS:
                        yield from report()
                    sums[q_block] = [q_ids, low, above, counts]
            yield from report()

        return run

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, q_ids, c_ids, s, low, above in each(batches):
            for i in np.flatnonzero((s >= low[:, None]).any(axis=1)).tolist():
                over, tied = np.flatnonzero(s[i] > low[i]), np.flatnonzero(s[i] == low[i])
                tied = tied[np.argsort(c_ids[tied], kind="stable")][: k - above[i]]
                at = np.concatenate([over, tied])
                yield pa.record_batch([pa.array(np.full(len(at), q_ids[i])), pa.array(c_ids[at]), pa.array(s[i, at].astype(np.int64))], names=["query_id", "vec_id", "score"])

    while True:
        seen = met(state).mapInArrow(counted(width), "q_block long, query_id long, bin long, n long, low long, above long")
        sums = seen.groupBy("q_block", "query_id", "bin", "low", "above").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.col("bin").desc())
        sums = sums.withColumn("higher", F.sum("n").over(down) - F.col("n"))
        # The kth score's bin: the lowest bin with fewer than k scores above it (queries with fewer than k candidates: their lowest).
        top = F.min_by(F.struct((F.col("low") + F.col("bin") * width).alias("low"), (F.col("higher") + F.col("above")).alias("above")), "bin")
        chosen = sums.where(F.col("higher") + F.col("above") < k).groupBy("q_block", "query_id").agg(top.alias("at")).select("q_block", "query_id", "at.*")
        state = _settled(chosen)
        if width == 1:
            break
        width //= BINS
    rows = met(state).mapInArrow(kept, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
