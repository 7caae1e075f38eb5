"""Training-order materialisation: token sequences of one length, each at a global slot, in shards of one stride."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The pattern that splits text before merges (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A key of the permutation, tokens a sequence, sequences a shard.
KEY, LENGTH, SHARD = 0x6C62272E07BB0142, 1024, 4096
#: Bytes of text whose documents are packed together; partitions of the result, a shard each up to this number.
GROUP_BYTES, PARTS = 32 << 20, 1 << 16
ROUNDS = 6


class Tokenizer:
    """Encodes texts with a vocabulary file's content: .tiktoken ranks, a tokenizers .json or a sentencepiece .model. end: the id put after each document."""

    def __init__(self, name: str, content: bytes):
        self.kind = name.rpartition(".")[2]
        if self.kind == "tiktoken":
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
            self.model = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.end = max(ranks.values()) + 1
            self.size = self.end + 1
        elif self.kind == "json":
            import tokenizers

            self.model = tokenizers.Tokenizer.from_str(content.decode())
            self.model.encode_special_tokens = True
            self.end = self.model.token_to_id("<|endoftext|>")
            self.size = self.model.get_vocab_size()
        else:
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
            self.end = self.model.eos_id()
            self.size = self.model.vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.kind == "tiktoken":
            return [self.model.encode_ordinary(x) for x in texts]
        if self.kind == "json":
            return [x.ids for x in self.model.encode_batch(texts, add_special_tokens=False)]
        return self.model.encode(texts, num_threads=1)

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


def _half(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def slots(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """A permutation of 0 .. n - 1: a Feistel network over the least even number of bits that holds n, walked on until it falls below n."""
    half = _half(n)
    mask = np.uint64((1 << half) - 1)
    x = index.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (common.mix(right + np.uint64(key * (r + 1) % (1 << 64))) & mask)
        x[todo] = left << np.uint64(half) | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def indices(slot: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The inverse of slots()."""
    half = _half(n)
    mask = np.uint64((1 << half) - 1)
    x = slot.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for r in reversed(range(ROUNDS)):
            left, right = right ^ (common.mix(left + np.uint64(key * (r + 1) % (1 << 64))) & mask), left
        x[todo] = left << np.uint64(half) | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def grouped(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(part, doc_id, text): rows dealt to groups of about group_bytes of text by a hash of doc_id and text, each group's in the order of doc_id and text. Groups and
    their order hang on the rows alone, not on files, splits or partitions."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    groups = max(1, -(-size // group_bytes))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups))
    return docs.select(part.alias("part"), "doc_id", "text").repartition(groups, "part").sortWithinPartitions("part", "doc_id", "text")


def sequences(docs: DataFrame, vocabulary: str, length: int) -> DataFrame:
    """Each group's documents, an end after each, cut into sequences of length tokens; a group's last one is filled up with ends."""
    spark = docs.sparkSession
    common.ship(spark)
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(vocabulary, shared.value)
        part, number = -1, 0
        tokens, ids, starts = np.empty(0, tokenizer.dtype), [], np.empty(0, np.int64)

        def emit(full: np.ndarray, real: int):
            rows = len(full) // length
            ends = np.append(starts[1:], real)
            lo = np.searchsorted(ends, np.arange(rows) * length, side="right")
            hi = np.searchsorted(starts, np.arange(1, rows + 1) * length, side="left")
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array(np.full(rows, part, np.int64)),
                    "seq": pa.array(np.arange(number, number + rows)),
                    "n_tokens": pa.array(np.minimum(length, real - np.arange(rows) * length).astype(np.int32)),
                    "doc_ids": pa.array([ids[a:b] for a, b in zip(lo, hi, strict=True)], pa.list_(pa.int64())),
                    "doc_starts": pa.array([np.maximum(0, starts[a:b] - k * length) for k, (a, b) in enumerate(zip(lo, hi, strict=True))], pa.list_(pa.int32())),
                    "tokens": pa.array([x.tobytes() for x in full.reshape(rows, length)], pa.binary()),
                }
            )

        def last():
            return emit(np.pad(tokens, (0, length - len(tokens)), constant_values=tokenizer.end), len(tokens))

        for piece in (own for batch in batches for cut in common.slices(batch, 4 << 20) for own in of_one_part(cut)):
            if piece.column("part")[0].as_py() != part:
                if len(tokens):
                    yield last()
                part, number = piece.column("part")[0].as_py(), 0
                tokens, ids, starts = tokens[:0], [], starts[:0]
            coded = tokenizer.encode(piece.column("text").to_pylist())
            sizes = np.fromiter((len(x) + 1 for x in coded), np.int64, len(coded))
            fresh = np.full(int(sizes.sum()), tokenizer.end, tokenizer.dtype)
            ends = np.cumsum(sizes)
            for x, e in zip(coded, ends, strict=True):
                fresh[e - 1 - len(x) : e - 1] = x
            starts = np.concatenate((starts, len(tokens) + ends - sizes))
            ids += piece.column("doc_id").to_pylist()
            tokens = np.concatenate((tokens, fresh))
            whole = len(tokens) // length * length
            if whole:
                yield emit(tokens[:whole], len(tokens))
                number += whole // length
                first = int(np.searchsorted(np.append(starts[1:], len(tokens)), whole, side="right"))
                tokens, ids, starts = tokens[whole:], ids[first:], starts[first:] - whole
        if len(tokens):
            yield last()

    def of_one_part(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        starts, lengths = common.runs_of(batch.column("part").to_numpy())
        for start, n in zip(starts.tolist(), lengths.tolist(), strict=True):
            yield batch.slice(start, n)

    return grouped(docs).mapInArrow(run, "part long, seq long, n_tokens int, doc_ids array<long>, doc_starts array<int>, tokens binary")


def training_order(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, shard: int = SHARD, key: int = KEY) -> DataFrame:
    """Token sequences of docs (doc_id, text): slot, shard, row, sequence_id, n_tokens, doc_ids, doc_starts, tokens.

    tokens: length token ids, little-endian, two bytes each for vocabularies of up to 65,536, four for larger ones. n_tokens of them are real; the last
    sequence of a group of documents, see grouped(), ends in fillers. doc_ids: the documents that a sequence has tokens of, and doc_starts where each begins in it (0 if it began
    before). sequence_id counts sequences in the order of the groups, the same whatever files and splits the rows come from; slot is its image under a keyed permutation of 0 .. n - 1, so that reading slots in turn is
    reading in random order, and a reader that stopped at a slot goes on at slot + 1. shard is slot // shard and row slot % shard.
    Partitions of the result are ranges of slots, whole shards each, sorted by slot, one after another: written as they are, they are read in order.

    Nulls: a null or empty text is one end; a null doc_id is a null among doc_ids. Repeated rows are each encoded. An empty table gives an
    empty result. Very long texts run over as many sequences as they need. Other columns of docs are ignored. What the vocabulary calls special is ordinary text in documents.
    """
    cut = common.materialise(sequences(docs, vocabulary, length), "sequences")
    counts = sorted(tuple(r) for r in cut.groupBy("part").count().collect())  # a number for each group
    parts = np.array([p for p, _ in counts], np.int64)
    before = np.concatenate(([0], np.cumsum([n for _, n in counts])))
    total = int(before[-1])

    @F.pandas_udf("long")
    def sequence_id(part: pd.Series, seq: pd.Series) -> pd.Series:
        return pd.Series(before[np.searchsorted(parts, part.to_numpy())] + seq.to_numpy())

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(slots(index.to_numpy(), total, key))

    placed = cut.withColumn("sequence_id", sequence_id("part", "seq")).withColumn("slot", slot("sequence_id"))
    placed = placed.withColumn("shard", F.floor(F.col("slot") / shard)).withColumn("row", F.col("slot") % shard)
    out = placed.repartitionByRange(min(PARTS, max(1, -(-total // shard))), "shard").sortWithinPartitions("slot")
    return out.select("slot", "shard", "row", "sequence_id", "n_tokens", "doc_ids", "doc_starts", "tokens")


def write_shards(ordered: DataFrame, path: str) -> None:
    """One folder and file a shard, its rows in the order of their slots."""
    ordered.write.partitionBy("shard").option("compression", "zstd").parquet(path)


def read_from(spark: SparkSession, path: str, slot: int, shard: int = SHARD) -> DataFrame:
    """The rows from a slot on, in order; earlier shards are not read."""
    return spark.read.parquet(path).where((F.col("shard") >= slot // shard) & (F.col("slot") >= slot)).orderBy("slot")


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return training_order(common.table(spark, sf_dir, "documents"))


QUERIES = {"op8_token_shards": op8_token_shards}
SQL: dict[str, str] = {}
