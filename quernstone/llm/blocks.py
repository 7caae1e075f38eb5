"""Blocks of documents that ask questions of hashed buckets.

Several operators need, for every word or window of every document, a figure over the whole corpus. Joining each
occurrence with a table of figures would shuffle every occurrence twice. Instead documents are packed into blocks of a
few MB; a block asks each bucket of the hash space once about each *distinct* key that it holds, and a bucket answers each block
in the order in which it asked, so that answers hold no keys:

    documents -> blocks --(exchange by block)--> questions --(exchange by bucket)--> answers
                              |                                                         |
                              +------------------- cogroup by block <-------------------+

Nothing is collected and no table of figures is broadcast; a key met in every block costs a bucket one entry a block, so that frequent
keys are summed before they are shuffled. Memory: one block, or one bucket's questions, per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK_BYTES = 8 << 20
_BLOCK = "block long, payload binary"
_QUESTION = "bucket long, block long, sum long, payload binary"


def _freeze(tables: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, tables[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for t in tables:
            out.write_batch(t)
    return sink.getvalue().to_pybytes()


def _sum(payload: pa.Buffer) -> int:
    """A block's checksum: answers are for the very block that asked."""
    return xxhash.xxh64_intdigest(memoryview(payload)) >> 1


def _thaw(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def parts_for(docs: DataFrame) -> int:
    """Shuffle partitions of an exchange: as many as the session has, or one for each 32 MB of what the scan reads, where that is known (a PB or more is not)."""
    spark = docs.sparkSession
    read = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), read >> 25 if read < 1 << 50 else 0)


def blocks_of(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Packs the rows of docs, whatever its columns, into one compressed row per block and deals the blocks out, parts_for(docs) partitions in all.

    A partition's rows fill its blocks in turn; a block ends when it holds block_bytes or more, so the number of blocks follows the input. If an
    executor is lost, its blocks are packed again: a partition's rows must then come in the same order, as those of files do. Were they not, exchange()
    would fail by the blocks' checksums rather than mix up answers.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def close():
            return pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "payload": pa.array([_freeze(held)], pa.binary())})

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                left = batch.num_rows - at
                each = max(1, batch.nbytes // max(1, batch.num_rows))
                n = min(left, max(1, (block_bytes - size) // each))
                part = batch.slice(at, n)
                held.append(part)
                size, at = size + n * each, at + n
                if size >= block_bytes:
                    yield close()
                    number, held, size = number + 1, [], 0
        if held:
            yield close()

    common.ship(docs.sparkSession)
    return docs.mapInArrow(fill, _BLOCK).repartition(parts_for(docs), "block")


def buckets_for(docs: DataFrame) -> int:
    """Four buckets for each shuffle partition."""
    return 4 * parts_for(docs)


def exchange(
    blocks: DataFrame,
    ask: Callable[[pa.Table], Iterator[tuple[int, bytes]]],
    answer: Callable[[list[bytes]], list[bytes]],
    use: Callable[[pa.Table, dict[int, bytes]], pa.Table],
    schema: str,
    parts: int,
) -> DataFrame:
    """ask(documents) gives (bucket, question); answer(questions of a bucket) gives one answer for each; use(documents, {bucket: answer})
    gives the result rows of a block. ask must give the same questions for the same block each time. parts: partitions of both exchanges."""

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload"), strict=True):
                held, size, total = [], 0, _sum(payload.as_buffer())
                for bucket, question in ask(_thaw(payload.as_buffer())):
                    held.append((bucket, block, total, question))
                    size += len(question)
                    if size > 16 << 20:
                        yield rows(held)
                        held, size = [], 0
                if held:
                    yield rows(held)

    def rows(held: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        *numbers, questions = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), pa.array(questions, pa.binary())], ["bucket", "block", "sum", "payload"])

    def answering(t: pa.Table) -> pa.Table:
        said = answer([x.as_buffer().to_pybytes() for x in t.column("payload")])
        return t.set_column(t.schema.get_field_index("payload"), "payload", pa.array(said, pa.binary()))

    def using(left: pa.Table, right: pa.Table) -> pa.Table:
        got = dict(zip(right.column("bucket").to_pylist(), right.column("payload").to_pylist(), strict=True)) if right.num_rows else {}
        (payload,) = left.column("payload")
        if right.num_rows and set(right.column("sum").to_pylist()) != {_sum(payload.as_buffer())}:
            raise RuntimeError("a block was packed again from rows in another order: write its input to files first")
        return use(_thaw(payload.as_buffer()), got)

    questions = blocks.mapInArrow(asking, _QUESTION)
    answers = questions.repartition(parts, "bucket").groupBy("bucket").applyInArrow(answering, _QUESTION)
    return blocks.groupBy("block").cogroup(answers.repartition(parts, "block").groupBy("block")).applyInArrow(using, schema)


def held_out(doc_id: str, modulus: int, remainder: int):
    """crc32 of a doc_id's text, modulo modulus, is remainder. A null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == remainder, F.lit(False))
