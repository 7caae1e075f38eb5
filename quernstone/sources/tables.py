"""Tables that can be changed: each change writes a new version of a folder; readers keep the version that they opened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    """Parquet folders path/v=0, v=1, ... A version counts once it is complete. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [s.getPath() for s in fs.listStatus(root)]
        return sorted(int(p.getName()[2:]) for p in names if p.getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _write(self, df: DataFrame) -> None:
        df.write.parquet(f"{self.path}/v={max(self._versions(), default=-1) + 1}")

    def create(self, df: DataFrame) -> VersionedTable:
        """CREATE TABLE AS. A table that is there already is an error."""
        if self._versions():
            raise ValueError(f"{self.path} exists")
        self._write(df)
        return self

    def read(self, version: int | None = None) -> DataFrame:
        """The latest version, or an earlier one."""
        versions = self._versions()
        if not versions or (version is not None and version not in versions):
            raise ValueError(f"{self.path} has no such version")
        return self.spark.read.parquet(f"{self.path}/v={versions[-1] if version is None else version}")

    def insert(self, rows: DataFrame) -> None:
        now = self.read()
        self._write(now.unionByName(rows.select(*now.columns)))

    def delete(self, where: Column) -> None:
        """Rows for which the condition is true go; where it is null they stay."""
        self._write(self.read().where(~F.coalesce(where, F.lit(False))))

    def update(self, values: dict[str, Column], where: Column) -> None:
        """New values of columns in rows for which the condition is true; all see the old ones."""
        now = self.read()
        met = F.coalesce(where, F.lit(False))
        self._write(now.select(*(F.when(met, values[c].cast(now.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in now.columns)))

    def merge(self, rows: DataFrame, key: str) -> None:
        """Upsert: rows replace those with the same key, and the others are added."""
        now = self.read()
        self._write(now.join(rows.select(key), key, "left_anti").select(*now.columns).unionByName(rows.select(*now.columns)))
