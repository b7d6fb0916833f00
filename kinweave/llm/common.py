"""What the operators of this subpackage share: table access, lineage cuts and the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus by name. Only Spark opens the path, so any Hadoop file system will do."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches for Python workers: at most 1000 rows and 16 MB, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where that is unset, a local master gets a temporary folder of its own; a cluster gets an error, as its machines share no such folder.
    """
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="kinweave-")
        shared_dir.own = place
    return place


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses, until release() takes it away."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    STASHED.append(path)
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: later steps neither recompute them nor lose them with an executor."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """stash() for narrow rows between the steps of an operator. One job, and few rows come back in few partitions."""
    return stash(df, "cut")


#: Folders that operators have written, until release() takes them away.
STASHED: list[str] = []


def release(spark: SparkSession, keep: list[str] | None = None) -> None:
    """Deletes what stash() has written, but for the folders to keep. Only for when no frame that reads them is still to be used."""
    for path in [p for p in STASHED if p not in (keep or [])]:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        STASHED.remove(path)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_batch(step: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from one that maps a batch to a batch (None: no rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in sliced(batch):
                out = step(piece)
                if out is not None and out.num_rows:
                    yield out

    return run


def sliced(batch: pa.RecordBatch, most_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes, so that long texts do not add up in a Python worker."""
    if batch.nbytes <= most_bytes or batch.num_rows <= 1:
        yield batch
        return
    step = max(1, batch.num_rows * most_bytes // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def crc_mod(column: str, n: int):
    """crc32 of the column's decimal text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return pafs.FileSystem.from_uri(uri)


class Publisher:
    """A file written beside its place and moved there when whole, so that a task run twice leaves one whole file."""

    def __init__(self, uri: str):
        self.fs, self.path = place(uri)
        context = TaskContext.get()
        self.draft = f"{self.path}.{context.taskAttemptId() if context else os.getpid()}.draft"
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.fs.open_output_stream(self.draft)

    def done(self) -> None:
        self.out.close()
        self.fs.move(self.draft, self.path)
