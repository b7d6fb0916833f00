"""Best-fit packing of token sequences, improved by a swap-based local search."""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"
#: Pieces packed together by one call, and the fill below which a sequence is opened again for the second round.
GROUP, REOPEN = 2000, 0.985
#: Most rounds that open sequences again.
ROUNDS = 40
#: Largest items of a bin that are tried two at a time.
PAIRED = 24


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, most: int = 4096) -> DataFrame:
    """One row per piece of at most `most` tokens of each document (its ids, then end_id; a null text is empty).

    Only longer documents are cut, the last piece may be shorter. Every row of docs counts, repeated ones too.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], [], []]
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for doc, ids in zip(batch.column(0).to_pylist(), tokens.encoder(tokenizer).batch(texts), strict=True):
            raw = np.append(ids, end_id).astype("<u4")
            for k, at in enumerate(range(0, len(raw), most)):
                part = raw[at : at + most]
                for c, v in zip(cols, (doc, k, at, len(part), zlib.crc32(part.tobytes())), strict=True):
                    c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.by_batch(step), PIECES)


def best_fit(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Bins by best fit, longest first: each item goes to the fullest bin that still holds it."""
    bins: list[list[int]] = []
    gaps: list[tuple[int, int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect.bisect_left(gaps, (n, -1))
        if at < len(gaps):
            gap, b = gaps.pop(at)
        else:
            gap, b = most, len(bins)
            bins.append([])
        bins[b].append(i)
        if gap > n:
            bisect.insort(gaps, (gap - n, b))
    return bins


def local_search(lengths: np.ndarray, bins: list[list[int]], most: int) -> list[list[int]]:
    """Empties bins, the least filled first, until there are as few as the lengths allow or every underfull bin has been tried: their items move to other bins, or one or two of them change places with one item there.

    Every step makes the sum of squared fills larger, so the search ends. A bin that ends up empty is dropped; a bin is only
    changed for good if the search finds a place for all of it, or if the steps leave it emptier and another bin fuller.
    """
    lengths = lengths.astype(np.int64)
    where = np.empty(len(lengths), np.int64)
    for b, items in enumerate(bins):
        where[items] = b
    fill = np.bincount(where, lengths, len(bins)).astype(np.int64)
    fewest, used = -(-int(lengths.sum()) // most), len(bins)
    for source in np.argsort(fill, kind="stable").tolist():
        if used <= fewest or fill[source] >= most:
            break
        while True:
            own = np.flatnonzero(where == source)
            if not len(own):
                used -= 1
                break
            gap = most - fill[where]
            other = (where != source) & (gap > 0)
            best = None  # (gain of squared fill / 2, items that go, item that comes, target)
            own = own[np.argsort(-lengths[own], kind="stable")]
            for a in own.tolist():  # moves
                n = lengths[a]
                to = np.flatnonzero(other & (gap >= n))
                if len(to):
                    t = to[np.argmin(gap[to])]
                    gain = n * (fill[where[t]] - fill[source] + n)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, (a,), None, where[t])
            if best is None:  # one for one, then two for one
                pairs = [(a,) for a in own.tolist()] + [(a, b) for i, a in enumerate(own[:PAIRED].tolist()) for b in own[i + 1 : PAIRED].tolist()]
                for go in pairs:
                    n = int(lengths[list(go)].sum())
                    d = n - lengths
                    ok = np.flatnonzero(other & (d > 0) & (d <= gap))
                    if len(ok):
                        gains = d[ok] * (fill[where[ok]] - fill[source] + d[ok])
                        k = int(np.argmax(gains))
                        if gains[k] > 0 and (best is None or gains[k] > best[0]):
                            best = (gains[k], go, int(ok[k]), where[ok[k]])
            if best is None:
                break
            _, go, come, target = best
            for a in go:
                where[a] = target
            if come is not None:
                where[come] = source
            moved = int(lengths[list(go)].sum()) - (int(lengths[come]) if come is not None else 0)
            fill[target] += moved
            fill[source] -= moved
    out: dict[int, list[int]] = {}
    for i, b in enumerate(where.tolist()):
        out.setdefault(b, []).append(i)
    return list(out.values())


def _packer(level: int, most: int):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].to_numpy()
        bins = local_search(lengths, best_fit(lengths, most), most)
        seq, offset, full = (np.zeros(len(rows), np.int64) for _ in range(3))
        for b, items in enumerate(bins):
            ends = np.cumsum(lengths[items])
            seq[items], offset[items], full[items] = (level << 56) + (int(key[0]) << 20) + b, ends - lengths[items], ends[-1]
        return rows.drop(columns="__part").assign(sequence_id=seq, offset=offset, __filled=full)

    return pack


def pack(pieces: DataFrame, most: int = 4096) -> DataFrame:
    """Places pieces (rows with a long `length` from 1 to most) in sequences: adds sequence_id and offset.

    Groups of about GROUP pieces, dealt at random so that no document, source or run of equal rows makes one larger, are packed by
    best fit and local search. What lies in sequences filled under REOPEN of `most` is dealt anew and packed again, so that groups
    share what they had left, until one group holds it all or there are no fewer such sequences than before. Pieces of full length
    take no part. Columns of pieces keep their names; sequence_id and offset must not be among them. An empty table gives an empty one.
    """
    columns = pieces.columns
    dealt = lambda df, n: df.withColumn("__part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)))
    held = common.cut(pieces)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema) + ", sequence_id long, offset long, __filled long"
    out = [*columns, "sequence_id", "offset"]
    packed = held.where(F.col("length") >= most).withColumn("sequence_id", F.lit(3 << 60) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).select(out)
    left, n, level, before = held.where(F.col("length") < most), None, 0, None
    while True:
        n = left.count()
        done = common.cut(dealt(left, max(1, -(-n // GROUP))).groupBy("__part").applyInPandas(_packer(level, most), schema))
        open_ = F.col("__filled") < int(most * REOPEN)
        now = done.where(open_).select("sequence_id").distinct().count()
        if n <= GROUP or level == ROUNDS or (before is not None and now >= before):
            return packed.unionByName(done.select(out))
        packed = packed.unionByName(done.where(~open_).select(out))
        left, before, level = done.where(open_).select(columns), now, level + 1


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, most: int = 4096) -> DataFrame:
    """All documents as pieces placed in sequences of at most `most` tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(token_pieces(docs, tokenizer, end_id, most), most)


