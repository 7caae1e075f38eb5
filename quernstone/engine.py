"""SQL over the tables of a folder, with labels, parameters and pinned tables."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession

from quernstone.session import TABLES, table
from quernstone.sources.pins import Pins


#: Functions that read files, and the format that Spark knows them by (fixed values).
READERS = {"read_parquet": "parquet", "parquet_scan": "parquet", "read_csv": "csv", "read_csv_auto": "csv", "read_json": "json", "read_orc": "orc"}


class Engine:
    """One session's tables by name. Names that a query doesn't mention are not opened."""

    def __init__(self, spark: SparkSession, sf_dir: str | None = None):
        self.spark, self.sf_dir = spark, sf_dir
        self.pins = Pins(spark)
        self._frames: dict[str, DataFrame] = {}
        self._label: str | None = None

    def register(self, name: str, df: DataFrame) -> None:
        """Makes df known as name."""
        self._frames[name.lower()] = df

    def label(self, text: str | None) -> None:
        """A label for the jobs of all later queries."""
        self._label = text

    def table(self, name: str, columns: list[str] | None = None) -> DataFrame:
        """A pinned table, a registered one, or one of the folder. columns: those that are read; a pin without one of them is left out. Not given: all that
        a pin has."""
        name = name.lower()
        pinned = self.pins.get(name)
        if pinned is not None and (columns is None or self.pins.serves(name, None, columns)):
            return pinned
        if name in self._frames:
            return self._frames[name]
        if self.sf_dir is None or name not in TABLES:
            raise KeyError(f"no table {name}")
        return table(self.spark, self.sf_dir, name)

    def sql(self, text: str, args: dict | list | None = None, label: str | None = None) -> DataFrame:
        """The result of a query. args: values of its parameters, `:name` or `?`. Files are read as tables: read_parquet('...'), parquet_scan('...'),
        read_csv('...') and read_json('...')."""
        text = self._files(text)
        known = {*TABLES, *self._frames, *self.pins.names()} if self.sf_dir else {*self._frames, *self.pins.names()}
        used = {w for w in set(re.findall(r"[a-z_]\w*", text.lower())) if w in known}
        for name in used:
            self._source(name).createOrReplaceTempView(name)
        run = lambda: self.spark.sql(text, args=args) if args else self.spark.sql(text)
        pinned = [name for name in used if self.pins.get(name) is not None]
        if pinned:
            read = self._read(run(), pinned)
            for name in pinned:
                self.table(name, read[name]).createOrReplaceTempView(name)
        self.spark.sparkContext.setJobDescription(label or self._label)
        return run()

    def _files(self, text: str) -> str:
        """read_parquet('path') and the like as Spark's parquet.`path`; s3:// is read through s3a. Delimited text has a header, and its types are found by reading it."""

        def named(m: re.Match) -> str:
            form, path = READERS[m[1].lower()], re.sub("^s3://", "s3a://", m[2])
            if form != "csv":
                return f"{form}.`{path}`"
            view = f"__csv_{zlib.crc32(path.encode()):08x}"
            self.spark.read.options(header=True, inferSchema=True).csv(path).createOrReplaceTempView(view)
            return view

        return re.sub(rf"\b({'|'.join(READERS)})\s*\(\s*'([^']+)'\s*\)", named, text, flags=re.IGNORECASE)

    def _source(self, name: str) -> DataFrame:
        """A table with all its columns, as if it weren't pinned; the pin where there is no other."""
        if name in self._frames or (self.sf_dir is not None and name in TABLES):
            return self._frames[name] if name in self._frames else table(self.spark, self.sf_dir, name)
        return self.pins.get(name)

    def _read(self, df: DataFrame, names: list[str]) -> dict[str, list[str]]:
        """Of each table the columns that a query's scans read, as planned; all columns where no scan of its files is left."""
        leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
        scans: dict[str, set[str]] = {}
        for k in range(leaves.size()):
            leaf = leaves.apply(k)
            if leaf.getClass().getSimpleName() == "FileSourceScanExec":
                path = leaf.relation().location().rootPaths().apply(0).toString()
                scans.setdefault(path.rstrip("/").rpartition("/")[2], set()).update(leaf.requiredSchema().fieldNames())
        return {n: sorted(scans[f"{n}.parquet"]) if f"{n}.parquet" in scans and n not in self._frames else self._source(n).columns for n in names}

    def explain(self, text: str, mode: str = "formatted") -> str:
        """The plan of a query."""
        df = self.sql(text)
        return self.spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
