"""Tables as versioned snapshots in a folder: a version is written whole, then the pointer moves to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Store:
    """Snapshots under a root that any Hadoop file system may hold. Once a version has been committed, readers see the tables as of
    that one, and nothing that was written for later ones; without any commit they see the last whole version of each."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self, table: str) -> list[int]:
        """Whole versions of a table, in order."""
        place = self._path(f"{self.root}/{table}")
        if not self._fs.exists(place):
            return []
        found = [s.getPath() for s in self._fs.listStatus(place)]
        return sorted(int(p.getName()[1:]) for p in found if p.getName().startswith("v") and self._fs.exists(self._path(p, "_SUCCESS")))

    def committed(self) -> int | None:
        """The last committed version."""
        place = self._path(f"{self.root}/_committed")
        found = [int(s.getPath().getName()[1:]) for s in self._fs.listStatus(place)] if self._fs.exists(place) else []
        return max(found, default=None)

    def commit(self, version: int) -> None:
        """Lets readers see what was written up to a version: one empty file, whose making is the moment."""
        self._fs.mkdirs(self._path(f"{self.root}/_committed"))
        self._fs.create(self._path(f"{self.root}/_committed/v{version}"), True).close()

    def read(self, table: str, upto: int | None = None) -> DataFrame | None:
        """The last version, up to the committed one or the one given, or None."""
        most = self.committed() if upto is None else upto
        found = [v for v in self.versions(table) if most is None or v <= most]
        return self.spark.read.parquet(f"{self.root}/{table}/v{found[-1]}") if found else None

    def write(self, table: str, rows: DataFrame, version: int | None = None) -> int:
        """Writes rows as a version (the next one by default). A committed version stays as it is; any other is written anew."""
        found, done = self.versions(table), self.committed()
        v = (found[-1] + 1 if found else 1) if version is None else version
        if v not in found or done is None or v > done:
            rows.write.mode("overwrite").parquet(f"{self.root}/{table}/v{v}")
        return v

    def prune(self, table: str, keep: int = 2) -> None:
        """Deletes all but the last versions."""
        for v in self.versions(table)[:-keep]:
            self._fs.delete(self._path(f"{self.root}/{table}/v{v}"), True)
