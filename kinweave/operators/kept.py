"""Cuts of lineage: rows that later steps read again."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def keep(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table in the checkpoint folder, or from disk blocks where none is set.

    Parquet takes a fraction of the room of a checkpoint's rows, and its true size lets Spark broadcast what is small. Shuffle files
    of the step go with it, rather than stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    conf, key = spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, path = conf.get(key, None), f"{folder.rstrip('/')}/kept-{uuid.uuid4().hex}"
    conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            conf.unset(key)
        else:
            conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def discard(df: DataFrame) -> None:
    """Frees the room of a kept table. Only for when no frame that reads it is still to be used."""
    path = getattr(df, "kept_at", None)
    if path is None:
        df.unpersist()
        return
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
