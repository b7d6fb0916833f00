"""Suffix-array deduplication: every byte that a string of WIDTH bytes covers which also starts elsewhere goes.

Equal windows of WIDTH bytes choose equal anchors (anchors.py), so windows are compared anchor by anchor. Stretches of windows that
are equal as a whole need no more; what is left is dealt in shards of bounded size, whose suffix arrays, by induced sorting, and
permuted common prefixes tell which windows recur.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors, common

WIDTH = 400
#: Window starts that are judged together, bytes from which a shard is full, and bytes of one group of like windows that a suffix array
#: takes; a shard holds less than the sum of both.
STEP, SHARD, GROUP = 64, 1 << 18, 1 << 19
#: A byte that no UTF-8 text holds.
BETWEEN = 0xFF


#: Positions a bucket on average from which buckets are induced as a whole.
WIDE = 256


def _by_char(char: np.ndarray) -> np.ndarray:
    return np.argsort(char, kind="stable")


def _induce(t: np.ndarray, s_type: np.ndarray, seeds: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The array of all suffixes induced from leftmost-smaller (LMS) suffixes in the order given: bucket by bucket, first the
    larger-type ones from the left, then the smaller-type ones from the right."""
    n = len(t)
    sa = np.full(n, -1, np.int64)
    present = np.flatnonzero(ends > starts)
    seed_char = t[seeds]
    order = _by_char(seed_char)
    by_char = seeds[order]
    edge = np.searchsorted(seed_char[order], np.arange(len(starts) + 1))
    head = starts.copy()

    def push(p: np.ndarray) -> None:
        """Appends suffixes to the heads of their buckets, in order."""
        c = t[p]
        o = _by_char(c)
        c, p = c[o], p[o]
        first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        size = np.diff(np.r_[first, len(c)])
        sa[np.repeat(head[c[first]] - first, size) + np.arange(len(c))] = p
        head[c[first]] += size

    last = np.array([n - 1])
    if not s_type[n - 1]:
        push(last)
    for c in present.tolist():
        done = starts[c]
        while done < head[c]:
            j = sa[done : head[c]]
            done = head[c]
            p = j[j > 0] - 1
            p = p[~s_type[p]]
            if len(p):
                push(p)
        j = by_char[edge[c] : edge[c + 1]]
        p = j[j > 0] - 1
        p = p[~s_type[p]]
        if len(p):
            push(p)
    tail = ends.copy()

    def push_back(p: np.ndarray) -> None:
        """Puts suffixes before the tails of their buckets; p comes from right to left."""
        c = t[p]
        o = _by_char(c)
        c, p = c[o], p[o]
        first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
        size = np.diff(np.r_[first, len(c)])
        sa[np.repeat(tail[c[first]] - 1 + first, size) - np.arange(len(c))] = p
        tail[c[first]] -= size

    for c in present[::-1].tolist():
        done = ends[c]
        while done > tail[c]:
            j = sa[tail[c] : done][::-1]
            done = tail[c]
            p = j[j > 0] - 1
            p = p[s_type[p]]
            if len(p):
                push_back(p)
        j = sa[starts[c] : head[c]][::-1]
        p = j[j > 0] - 1
        p = p[s_type[p]]
        if len(p):
            push_back(p)
    return sa


def _induce_each(t: np.ndarray, s_type: np.ndarray, seeds: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """As _induce, suffix by suffix: for short strings and for those of many different numbers, whose buckets are small."""
    char, small, tail = t.tolist(), s_type.tolist(), ends.tolist()
    sa = [-1] * len(char)
    for p in reversed(seeds.tolist()):
        c = char[p]
        tail[c] -= 1
        sa[tail[c]] = p
    head, end = starts.tolist(), len(char) - 1
    sa[head[char[end]]] = end  # the last suffix is of the larger type
    head[char[end]] += 1
    for at in range(len(char)):
        p = sa[at] - 1
        if p >= 0 and not small[p]:
            c = char[p]
            sa[head[c]] = p
            head[c] += 1
    tail = ends.tolist()
    for at in range(end, -1, -1):
        p = sa[at] - 1
        if p >= 0 and small[p]:
            c = char[p]
            tail[c] -= 1
            sa[tail[c]] = p
    return np.array(sa, np.int64)


def _named(t: np.ndarray, ordered: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The rank of each LMS substring t[p:stop[p]], p in sorted order: like ones have one. Hashes part most, the bytes decide."""
    first, second = ordered[:-1], ordered[1:]
    digest = anchors.Hashed(t.astype(np.uint64)).of(ordered, stop[ordered])
    length = stop[ordered] - ordered
    # The last one ends with the string, so it is like no other.
    same = (digest[1:] == digest[:-1]) & (length[1:] == length[:-1]) & (stop[second] < len(t)) & (stop[first] < len(t))
    k = np.flatnonzero(same)
    if len(k):
        size = length[k]
        edge = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(edge, size)
        equal = t[np.repeat(first[k], size) + step] == t[np.repeat(second[k], size) + step]
        same[k] = np.logical_and.reduceat(equal, edge)
    return np.r_[0, np.cumsum(~same)]


def suffix_array(t: np.ndarray, wide: int = WIDE) -> np.ndarray:
    """The suffix array of small whole numbers, by induced sorting; a suffix that is a prefix of another comes first.

    Suffixes are classified as smaller or larger than the next one; leftmost-smaller (LMS) substrings are sorted by inducing from
    their unsorted places and named, the string of names is solved by recursion unless all differ, and inducing from the LMS suffixes
    in that order gives the rest. Inducing goes bucket by bucket where these hold `wide` positions on average, else suffix by suffix.
    """
    n = len(t)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    less, more = t[:-1] < t[1:], t[:-1] > t[1:]
    # The type of the next position that differs; the last suffix is of the larger type, as the end is smaller than all.
    decided = np.r_[less | more, True]
    nxt = np.minimum.accumulate(np.where(decided, np.arange(n), n)[::-1])[::-1]
    s_type = np.r_[less, False][nxt]
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    size = np.bincount(t)
    ends = np.cumsum(size)
    starts = ends - size
    induce = _induce if n >= wide * np.count_nonzero(size) else _induce_each
    if len(lms) > 1:
        sa = induce(t, s_type, lms, starts, ends)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        ordered = sa[is_lms[sa]]
        stop = np.full(n, n)
        stop[lms[:-1]] = lms[1:] + 1  # an LMS substring reaches to the next LMS place
        name = _named(t, ordered, stop)
        if name[-1] + 1 == len(lms):
            lms = ordered
        else:
            by_place = np.empty(n, np.int64)
            by_place[ordered] = name
            lms = lms[suffix_array(by_place[lms], wide)]
    return induce(t, s_type, lms, starts, ends)


def permuted_lcp(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each place, the common prefix (up to most) of its suffix and the one before it in the array.

    Where the bytes before both suffixes agree, the value is one less than at the place before; only the other places, few where
    much recurs, are compared, eight bytes at a time.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    fresh = (phi <= 0) | (at == 0)
    fresh[1:] |= t[:-1] != t[np.maximum(phi[1:] - 1, 0)]
    padded = np.r_[t.astype(np.uint8), np.zeros(16, np.uint8)]
    words = np.lib.stride_tricks.as_strided(padded, (n + 8, 8), (1, 1))
    i = np.flatnonzero(fresh & (phi >= 0))
    j = phi[i]
    got, live, step = np.zeros(len(i), np.int64), np.arange(len(i)), 0
    while len(live):  # values beyond `most` count too: places after a fresh one inherit from it
        x, y = words[np.minimum(i[live] + step, n + 7)], words[np.minimum(j[live] + step, n + 7)]
        equal = (x == y).all(axis=1) & (np.maximum(i[live], j[live]) + step < n)
        stop = live[~equal]
        x, y = x[~equal], y[~equal]
        got[stop] = step + np.where((x == y).all(axis=1), 8, np.argmax(x != y, axis=1))
        live, step = live[equal], step + 8
    value = np.zeros(n, np.int64)
    value[i] = np.minimum(got, n - np.maximum(i, j))
    source = np.maximum.accumulate(np.where(fresh, at, 0))
    return np.minimum(np.maximum(value[source] - (at - source), 0), most)


def repeated_starts(strings: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """For each string (without BETWEEN), which of its windows of `width` bytes start elsewhere too, in it or in another."""
    raw = bytes([BETWEEN]).join(strings) + bytes([BETWEEN])
    t = np.frombuffer(raw, np.uint8)
    sa = suffix_array(t)
    common_prefix = permuted_lcp(t, sa, width)
    # A window recurs if its suffix shares `width` bytes with the one before it in the array, or the one after.
    here = common_prefix >= width
    both = here.copy()
    both[sa[:-1]] |= here[sa[1:]]
    out, at = [], 0
    for s in strings:
        out.append(both[at : at + max(0, len(s) - width + 1)])
        at += len(s) + 1
    return out


def _found(docs: DataFrame, width: int, cores: bool) -> DataFrame:
    """Stretches of window starts by anchor: h, rh (hash of the stretch's bytes), d, t, lo, hi, a; with the hashes of their steps' cores."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(8 if cores else 7)]
        for d, t, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            raw = text.encode()
            for h, lo, hi, a in anchors.regions(raw, width) if len(raw) >= width else ():
                row = [h, xxhash.xxh3_64_intdigest(raw[lo : hi + width]) - (1 << 63), d, t, lo, hi, a]
                if cores:
                    row.append([xxhash.xxh3_64_intdigest(raw[a - s * STEP : a - s * STEP - STEP + 1 + width]) - (1 << 63) for s in range((a - hi) // STEP, (a - lo) // STEP + 1)])
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
        kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.list_(pa.int64())] * cores
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["h", "rh", "d", "t", "lo", "hi", "a", "cores"][: len(cols)])

    return docs.mapInArrow(common.by_batch(step), "h long, rh long, d long, t long, lo int, hi int, a int" + ", cores array<long>" * cores)


def _strings(rows: DataFrame, width: int) -> DataFrame:
    """(group, d, t, start, n, far, text) of requested stretches: n windows from start, the first of them `far` bytes before its anchor."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(7)]
        for d, t, text, wanted in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            raw = text.encode() if wanted else b""
            for w in wanted or ():
                for c, v in zip(cols, (w["group"], d, t, w["start"], w["n"], w["far"], raw[w["start"] : w["start"] + w["n"] + width - 1]), strict=True):
                    c.append(v)
        return pa.record_batch([pa.array(c, k) for c, k in zip(cols, (*[pa.int64()] * 3, *[pa.int32()] * 3, pa.binary()), strict=True)], names=["group", "d", "t", "start", "n", "far", "text"])

    return rows.mapInArrow(common.by_batch(step), "group long, d long, t long, start int, n int, far int, text binary")


def _judged(strings: DataFrame, width: int, most: int, shard: int) -> DataFrame:
    """(d, t, start, end) of the repeated windows of strings that share a group, as merged intervals.

    Equal strings count as one, and all their places are marked. A group whose different strings have more than `most` bytes is
    split by the bytes that all windows of a quarter of its step share, down to single windows, which are equal or not as a whole;
    all other groups are dealt in shards of about `shard` bytes and judged by suffix array.
    """
    marks = []
    step = STEP
    while True:
        held = common.stash(strings, "strings").withColumn("text_hash", F.xxhash64("text"))
        alike = common.cut(held.groupBy("group", "far", "n", "text_hash").agg(F.count("*").alias("copies"), F.min(F.struct("d", "t", "start", "text")).alias("one")))
        twice = common.cut(alike.where("copies > 1").select("group", "far", "n", "text_hash"))
        marks.append(held.join(twice, ["group", "far", "n", "text_hash"]).select("d", "t", "start", (F.col("start") + F.col("n") + width - 1).alias("end")))
        if step == 1:
            break
        sizes = common.cut(alike.groupBy("group").agg(F.count("*").alias("strings"), F.sum(F.col("n") + width).alias("bytes")).where("strings > 1"))
        different = alike.join(sizes, "group").select("group", "far", "n", "copies", "one.*", "bytes")
        marks.append(_by_shard(different.where(F.col("bytes") <= most), width, shard))
        large = common.cut(different.where(F.col("bytes") > most).drop("bytes", "copies"))
        if large.isEmpty():
            break
        step //= 4
        # Window i of a string lies far - i before its anchor; the parts of like groups hold the distances of one quarter.
        part = F.explode(F.sequence(F.floor((F.col("far") - F.col("n") + 1) / step).cast("int"), F.floor(F.col("far") / step).cast("int")))
        parts = large.withColumn("part", part)
        parts = parts.withColumn("skip", F.greatest(F.lit(0), F.col("far") - F.col("part") * step - (step - 1))).withColumn("upto", F.least(F.col("n") - 1, F.col("far") - F.col("part") * step))
        core = F.substring("text", F.col("far") - F.col("part") * step + 1, F.lit(width - step + 1))
        strings = parts.select(F.xxhash64("group", "part", core).alias("group"), "d", "t", (F.col("start") + F.col("skip")).alias("start"), (F.col("upto") - F.col("skip") + 1).alias("n"), (F.col("far") - F.col("skip")).alias("far"), F.substring("text", F.col("skip") + 1, F.col("upto") - F.col("skip") + width).alias("text"))
        # Every string that one of the split ones stands for must get its marks: equal strings are marked above, in whole.
    out = marks[0]
    for m in marks[1:]:
        out = out.unionByName(m)
    return out


def _by_shard(dealt: DataFrame, width: int, shard: int) -> DataFrame:
    """The repeated windows of the strings of each group, by suffix array and permuted common prefixes.

    A shard is so many whole groups that lie side by side in a sorted partition that they have `shard` bytes.
    """

    def judge(rows: list[dict]) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for row, hit in zip(rows, repeated_starts([r["text"] for r in rows], width), strict=True):
            edge = np.flatnonzero(np.diff(np.r_[False, hit, False].view(np.int8)))
            for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                for c, v in zip(out, (row["d"], row["t"], row["start"] + i, row["start"] + j - 1 + width), strict=True):
                    c.append(v)
        return pa.record_batch([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["d", "t", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if held >= shard and rows[-1]["group"] != r["group"]:
                    yield judge(rows)
                    rows, held = [], 0
                rows.append(r)
                held += len(r["text"])
        if rows:
            yield judge(rows)

    cols = dealt.select("group", "d", "t", "start", "text")
    return cols.repartition("group").sortWithinPartitions("group").mapInArrow(run, "d long, t long, start int, end int")


def removals(docs: DataFrame, width: int = WIDTH, most: int = GROUP, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """The rows of docs with d and t, which tell texts apart, and (d, t, spans): the intervals to remove from each text that has some."""
    none = F.lit(-(1 << 63)).cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), none).alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))
    seen = common.cut(_found(rows, width, False).groupBy("h").agg(F.count("*").alias("n"), (F.min("rh") != F.max("rh")).alias("varied")).where("n > 1").drop("n"))
    again = common.stash(_found(rows, width, True).join(seen, "h"), "anchors")
    kinds = common.cut(again.groupBy("h", "rh").agg(F.count("*").alias("n"), F.max("varied").alias("varied"), F.min(F.struct("d", "t", "lo", "hi", "a", "cores")).alias("one")))
    whole = again.join(common.cut(kinds.where("n > 1").select("h", "rh")), ["h", "rh"]).select("d", "t", F.col("lo").alias("start"), (F.col("hi") + width).alias("end"))
    steps = kinds.where("varied").select("h", "one.*").select("h", "d", "t", "lo", "hi", "a", F.posexplode("cores").alias("k", "core"))
    s = F.floor((F.col("a") - F.col("hi")) / STEP).cast("int") + F.col("k")
    low, high = F.greatest("lo", F.col("a") - F.col("s") * STEP - (STEP - 1)), F.least("hi", F.col("a") - F.col("s") * STEP)
    steps = common.cut(steps.withColumn("s", s).select(F.xxhash64("h", "s", "core").alias("group"), "d", "t", low.alias("start"), (high - low + 1).alias("n"), (F.col("a") - low).alias("far")))
    shared = common.cut(steps.groupBy("group").agg(F.count("*").alias("strings")).where("strings > 1").drop("strings"))
    wanted = steps.join(shared, "group").groupBy("d", "t").agg(F.collect_list(F.struct("group", "start", "n", "far")).alias("wanted"))
    strings = _strings(rows.join(wanted, ["d", "t"]).select("d", "t", "text", "wanted"), width)
    marks = whole.unionByName(_judged(strings, width, most, shard))
    return rows, marks.groupBy("d", "t").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def merged(spans: list | None) -> list[tuple[int, int]]:
    """Intervals joined where they overlap or touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside the intervals."""
    at, kept = 0, []
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


def deduplicated(docs: DataFrame, width: int = WIDTH, most: int = GROUP, shard: int = SHARD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of docs.

    Every byte of a text (null: empty) that is covered by a string of `width` bytes which also starts elsewhere, in the same text
    or another one, goes; overlaps count, and texts do not run into each other. Repeated rows are each other's copies. Texts
    shorter than `width` lose nothing. An empty table gives an empty one.
    """
    rows, spans = removals(docs, width, most, shard)
    none = F.lit(-(1 << 63)).cast("long")

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for text, marked in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw, gone = text.encode(), merged(marked)
            for c, v in zip(out, (len(raw), sum(b - a for a, b in gone), len(gone), hashlib.sha256(without(raw, gone)).hexdigest()), strict=True):
                c.append(v)
        return pa.record_batch([batch.column(0), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = rows.join(common.cut(spans), ["d", "t"], "left").select(F.nullif("d", none).alias("doc_id"), "text", "spans")
    return joined.mapInArrow(common.by_batch(finish), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def trim(docs: DataFrame, width: int = WIDTH, most: int = GROUP, shard: int = SHARD) -> DataFrame:
    """The rows of docs with what deduplicated() removes taken out of their texts; characters that lose a byte go. A null text stays null."""
    _, spans = removals(docs, width, most, shard)
    columns = docs.columns
    names = [f"__c{i}" for i in range(len(columns))]
    kinds = dict(zip(names, [f.dataType.simpleString() for f in docs.schema], strict=True))
    at, key = names[columns.index("text")], names[columns.index("doc_id")]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)])
    rows = rows.withColumn("d", F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)).cast("long"))).withColumn("t", F.xxhash64(F.coalesce(F.col(at).cast("string"), F.lit(""))))
    joined = rows.join(common.cut(spans), ["d", "t"], "left").select(*names, "spans")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t if t is None or not s else without(t.encode(), merged(s)).decode(errors="ignore") for t, s in zip(batch.column(at).to_pylist(), batch.column("spans").to_pylist(), strict=True)]
        return pa.record_batch([pa.array(texts, batch.schema.field(at).type) if n == at else batch.column(n) for n in names], names=names)

    out = joined.mapInArrow(common.by_batch(step), ", ".join(f"{n} {kinds[n]}" for n in names))
    return out.select(*[F.col(n).alias(c) for c, n in zip(columns, names, strict=True)])
