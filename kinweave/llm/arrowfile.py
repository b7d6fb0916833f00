"""Token ids as Arrow files of fixed-size-list batches: equal-length sequences and their masks, readable at random without a copy.

A corpus is a folder of shards in ascending order of doc_id. A shard is `tokens-N.arrow` (IPC file format: the stream format plus a
footer; columns ids and mask, both fixed-size lists of one length, batches of one number of rows but for the last) and
`docs-N.arrow` (doc_id, start in the shard, n_tokens). The ids of a shard run on from sequence to sequence; the last sequence is
filled up with zeros, which its mask tells.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

#: Ids in a sequence, sequences in a batch.
LENGTH, ROWS = 1024, 64
MANIFEST = "shard int, tokens string, docs string, n_docs long, n_tokens long"


class TokenWriter:
    """Takes documents' ids one after another and writes a shard."""

    def __init__(self, uri: str, docs_uri: str, dtype, length: int = LENGTH, rows: int = ROWS):
        self.length, self.rows, self.dtype = length, rows, np.dtype(dtype)
        self.tokens, self.docs = common.Publisher(uri), common.Publisher(docs_uri)
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(self.tokens.out, self.schema)
        self.doc_writer = pa.ipc.new_file(self.docs.out, pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]))
        self.held: list[np.ndarray] = []
        self.n_held = self.n = self.n_docs = 0
        self.index: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.index.append((doc_id, self.n, len(ids)))
        self.n_docs += 1
        self.n += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.length * self.rows:
            self._flush(False)
        if len(self.index) >= 10_000:
            self._flush_index()

    def _flush(self, last: bool) -> None:
        have = np.concatenate(self.held) if self.held else np.empty(0, self.dtype)
        size = self.length * self.rows
        whole = len(have) // size * size
        for at in range(0, whole, size):
            self._batch(have[at : at + size], size)
        have = have[whole:]
        if last and len(have):
            padded = np.zeros(-(-len(have) // self.length) * self.length, self.dtype)
            padded[: len(have)] = have
            self._batch(padded, len(have))
            have = have[:0]
        self.held, self.n_held = [have], len(have)

    def _batch(self, ids: np.ndarray, valid: int) -> None:
        mask = np.arange(len(ids)) < valid
        self.writer.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids.astype(self.dtype), mask)], schema=self.schema))

    def _flush_index(self) -> None:
        cols = list(zip(*self.index, strict=True)) or [(), (), ()]
        self.doc_writer.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens"]))
        self.index = []

    def close(self) -> None:
        self._flush(True)
        self._flush_index()
        self.writer.close()
        self.doc_writer.close()
        self.tokens.done()
        self.docs.done()


class TokenReader:
    """Random access to a shard. On a local file system the file is mapped, and ids within a batch come without a copy."""

    def __init__(self, uri: str):
        fs, path = common.place(uri)
        self.file = pa.ipc.open_file(pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path))
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0
        self.kept: tuple[int, np.ndarray] | None = None

    def _batch(self, k: int) -> np.ndarray:
        if self.kept is None or self.kept[0] != k:
            self.kept = (k, self.file.get_batch(k).column("ids").flatten().to_numpy(zero_copy_only=True))
        return self.kept[1]

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of the k-th sequence."""
        batch, row = self.file.get_batch(k // self.rows), k % self.rows
        at = slice(row * self.length, (row + 1) * self.length)
        return batch.column("ids").flatten().to_numpy()[at], batch.column("mask").flatten().to_numpy(zero_copy_only=False)[at]

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from a place in the shard's run of ids."""
        size, parts = self.length * self.rows, []
        while n > 0:
            at = start % size
            got = self._batch(start // size)[at : at + n]
            parts.append(got)
            start, n = start + len(got), n - len(got)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.int64)

    def n_valid(self) -> int:
        """Ids that the masks call valid."""
        return sum(self.file.get_batch(k).column("mask").flatten().true_count for k in range(self.file.num_record_batches))


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, shards: int | None = None) -> DataFrame:
    """Encodes every document, end_id after each, and writes the shards. Returns the manifest: a row per shard.

    Rows go to shards by ranges of doc_id (rows with equal doc_id by their text; a null doc_id comes first; a null text is empty),
    so shard after shard has the ids in ascending doc_id order. An empty table gives shards without documents, or none.
    """
    n = shards or common.partitions(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        enc = tokens.encoder(tokenizer)
        names = [f"{folder}/{kind}-{shard:08d}.arrow" for kind in ("tokens", "docs")]
        out = TokenWriter(*names, enc.dtype)
        for big in batches:
            for batch in common.sliced(big):
                for doc, ids in zip(batch.column(0).to_pylist(), enc.batch([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                    out.add(doc, np.append(ids, np.array(end_id, enc.dtype)))
        out.close()
        yield pa.record_batch([pa.array([shard], pa.int32()), *(pa.array([x]) for x in names), pa.array([out.n_docs]), pa.array([out.n])], names=["shard", "tokens", "docs", "n_docs", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranged = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return common.cut(ranged.mapInArrow(write, MANIFEST))


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the files alone."""
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                tokens_file = TokenReader(shard["tokens"])
                if tokens_file.n_valid() != shard["n_tokens"]:
                    raise ValueError(f"{shard['tokens']} has not the ids that the manifest tells")
                fs, path = common.place(shard["docs"])
                with fs.open_input_file(path) as f:
                    docs = pa.ipc.open_file(f)
                    for k in range(docs.num_record_batches):
                        got = docs.get_batch(k)
                        starts, lengths = (got.column(c).to_numpy() for c in ("start", "n_tokens"))
                        crc = [zlib.crc32(tokens_file.ids(a, n).astype("<u4").tobytes()) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
                        yield pa.record_batch([got.column("doc_id"), pa.array(starts + shard["base"], pa.int64()), got.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = common.partitions(manifest.sparkSession)
    return manifest.withColumn("base", before).repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
