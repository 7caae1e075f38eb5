"""What the operators of this subpackage share: shared storage, packed integers and words."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words (fixed values): space and U+0009 to U+000D.
SEPARATORS = (9, 10, 11, 12, 13, 32)
_SEPARATES = np.zeros(256, bool)
_SEPARATES[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Where that is unset, one machine's own temporary folder, and on a cluster an error: files
    that each executor wrote to its own disk would be missing later."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not hasattr(context, "_quernstone_folder"):
        context._quernstone_folder = tempfile.mkdtemp(prefix="quernstone-")
    return context._quernstone_folder


def _own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    context = spark.sparkContext
    if not hasattr(context, "_quernstone_run"):
        context._quernstone_run = f"{context.applicationId}-{uuid.uuid4().hex[:8]}"
    return f"{shared_folder(spark)}/quernstone/{context._quernstone_run}"


def ship(spark: SparkSession) -> None:
    """Makes this package known to Python workers, once a session; on a PYTHONPATH it is known already."""
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_quernstone", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="quernstone-")) / "quernstone.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted((root / "quernstone").rglob("*.py")):
            z.write(file, file.relative_to(root))
    context.addPyFile(str(archive))
    context._quernstone = True


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts its lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Frees what finished steps broadcast and shuffled: Spark keeps it until the driver's JVM collects all its garbage, and that waits until the heap has grown to
    its bound. For loops of many steps."""
    spark._jvm.System.gc()


def forget(spark: SparkSession) -> None:
    """Deletes all that materialise() has written for this application. Results that read it must have been written first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Bounds the rows of one Arrow batch, so that a batch of long texts stays small, where the session has Spark's own bound: one that its user chose stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def lower_az(text: Column) -> Column:
    return F.translate(text, UPPER_AZ, LOWER_AZ)


def word_array(text: Column) -> Column:
    """The words of a text as an array, inside the JVM. Null text: no words."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once: the optimizer may copy an expression into a lambda, where it runs for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def literal(values: list, kind: str) -> Column:
    """A list of numbers as one constant; folded before a plan runs, so that its size costs no expression nodes."""
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), kind)


def running(values: Column) -> Column:
    """For each place of an array of integers the sum of those before it. A chunk of the root of its length at a time, as arrays grow by copying."""

    def heads(x: Column) -> Column:
        step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(x).cast("double"))).cast("int"))
        return F.struct(x.alias("values"), step.alias("step"), F.sequence(F.lit(0), F.size(x) - 1, step).alias("heads"))

    grow = lambda s, v: F.struct((s.at + v).alias("at"), F.concat(s.out, F.array(s.at)).alias("out"))
    start = lambda at: F.struct(at.cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))

    def based(x: Column) -> Column:
        sums = F.transform(x.heads, lambda h: F.aggregate(F.slice(x.values, h + 1, x.step), F.lit(0).cast("bigint"), lambda s, v: s + v))
        return F.struct(x.values.alias("values"), x.step.alias("step"), x.heads.alias("heads"), F.aggregate(sums, start(F.lit(0)), grow, lambda s: s.out).alias("bases"))

    def chunks(x: Column) -> Column:
        return F.flatten(F.transform(x.heads, lambda h, k: F.aggregate(F.slice(x.values, h + 1, x.step), start(F.get(x.bases, k)), grow, lambda s: s.out)))

    summed = lambda x: let(let(heads(x), based), chunks)
    return let(values, lambda x: F.when(F.size(x) > 0, summed(x)).otherwise(F.array().cast("array<bigint>")))


# ---- packed integers -------------------------------------------------------------------------------------------------


def _squeeze(a: np.ndarray) -> bytes:
    """Byte planes, compressed: the planes that hardly vary cost next to nothing."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unsqueeze(b: bytes, n: int, dtype: np.dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    raw = np.frombuffer(pa.decompress(b, n * dtype.itemsize, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(dtype.itemsize, n).T).reshape(-1).view(dtype)


def pack(*arrays: np.ndarray) -> bytes:
    """Integer arrays as bytes. Sorted unsigned arrays are stored as differences."""
    out = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        code = a.dtype.str.encode().ljust(8)
        rising = a.dtype == np.uint64 and len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        body = (_squeeze(np.diff(a, prepend=a.dtype.type(0)) if rising else a)) if len(a) else b""
        out += [code, np.array([len(a), len(body), rising], np.int64).tobytes(), body]
    return b"".join(out)


def unpack(b: bytes) -> list[np.ndarray]:
    out, at = [], 8
    for _ in range(int(np.frombuffer(b, np.int64, 1)[0])):
        dtype = np.dtype(b[at : at + 8].decode().strip())
        n, size, rising = (int(x) for x in np.frombuffer(b, np.int64, 3, at + 8))
        at += 32
        a = _unsqueeze(b[at : at + size], n, dtype) if n else np.empty(0, dtype)
        out.append(np.cumsum(a, dtype=a.dtype) if rising else a)
        at += size
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finaliser; shifts and factors are fixed values)."""
    h = h.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in the order of h: a sorted h has its buckets one after another."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


# ---- words -----------------------------------------------------------------------------------------------------------


@dataclass
class Words:
    """Words of several texts, one after another. words[i] is vocabulary[codes[i]]; text k has words ends[k-1] to ends[k]."""

    words: pa.Array
    counts: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.counts)))[:-1]

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        d = self.words.dictionary_encode()
        return d.indices.to_numpy(zero_copy_only=False), d.dictionary


def text_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets of the texts. Null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(texts: pa.Array | pa.ChunkedArray, lower: bool = False, separates: np.ndarray = _SEPARATES) -> Words:
    """Cuts texts into words `[^\\x20\\x09-\\x0D]+`, A-Z in lower case if asked. separates: other separating bytes than these."""
    data, offsets = text_bytes(texts)
    keep = ~separates[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    fresh = fresh[:-1]
    fresh[1:] |= ~keep[:-1]
    starts = np.flatnonzero(fresh & keep)
    kept = data[keep]
    if lower:
        kept = _LOWER[kept]
    at = np.cumsum(keep, dtype=np.int64)[starts] - 1 if len(starts) else np.empty(0, np.int64)
    bounds = np.append(at, len(kept)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(kept)])
    return Words(words, np.diff(np.searchsorted(starts, offsets)))


def hash_values(values: pa.Array, seed: int = 42) -> np.ndarray:
    """XXH64 of each value's bytes."""
    import xxhash

    one = xxhash.xxh64_intdigest
    return np.fromiter((one(v, seed) for v in values.to_pylist()), np.uint64, len(values))


def array_of(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def slices(batch: pa.RecordBatch, most: int = 8 << 20):
    """Parts of a batch of about most bytes each; a single longer row is a part of its own."""
    each = max(1, batch.nbytes // max(1, batch.num_rows))
    rows = max(1, most // each)
    at = 0
    while at < batch.num_rows:
        part = batch.slice(at, rows)
        yield part
        at += rows


def runs_of(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    if not len(sorted_keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, len(sorted_keys)))
