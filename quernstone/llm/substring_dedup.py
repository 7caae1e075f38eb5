"""Substring deduplication: repeated fixed-length windows of words, merged into maximal removal intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, common

#: Multiplier of the rolling hash: odd, so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
_LAST = np.iinfo(np.int64).max


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2^64, of all windows of width values: each from the one before in constant time."""
    n = len(values)
    if n < width:
        return np.empty(0, np.uint64)
    power = np.full(n, BASE, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    back = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * back, dtype=np.uint64)))
    return common.mix((total[width:] - total[:-width]) * power[: n - width + 1])


def _windows(docs: pa.Table, width: int):
    """Words of a block's documents in the order of doc_id, and its windows: hash, first word and document of each."""
    ids = common.array_of(docs, "doc_id").cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    words = common.words_of(common.array_of(docs, "text").take(pa.array(order)))
    codes, vocabulary = words.coded()
    hashes = rolling(common.hash_values(vocabulary)[codes] if len(codes) else np.empty(0, np.uint64), width)
    doc_of = np.repeat(np.arange(len(order)), words.counts)
    first = np.flatnonzero(doc_of[width - 1 :] == doc_of[: len(doc_of) - width + 1]) if len(doc_of) >= width else np.empty(0, np.int64)
    return ids[order], order, words, hashes[first], first, doc_of


def _distinct(hashes: np.ndarray, doc_of_window: np.ndarray):
    """Sorted distinct hashes, the first document of each, and each window's place among them."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    place = np.empty(len(ranked), np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked[new], doc_of_window[order[new]], place


def dedup_substrings(docs: DataFrame, width: int = 13) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_words, n_removed, removed (array of [start, end) in words, maximal and in
    order), kept_text (the kept words joined by one space).

    A word goes if a window of width words that covers it also starts in a document with a smaller doc_id. Windows are judged on the
    input. Words are case-sensitive runs of anything but space and U+0009 to U+000D.

    Nulls: a null text has no words; a null doc_id counts as larger than any other. A text shorter than a window stays whole. Rows with equal
    doc_id don't remove from one another. An empty table gives an empty result. Other columns of docs are ignored.
    Windows are told apart by 64-bit hashes: among n windows about n^2 / 2^65 wrong pairs are to be expected.
    """
    buckets = blocks.buckets_for(docs)

    def ask(t: pa.Table) -> Iterator[tuple[int, bytes]]:
        ids, _, _, hashes, first, doc_of = _windows(t, width)
        keys, doc, _ = _distinct(hashes, doc_of[first])
        cuts = np.searchsorted(common.bucket_of(keys, buckets), np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            s = slice(cuts[b], cuts[b + 1])
            yield int(b), common.pack(keys[s], ids[doc[s]])

    def answer(questions: list[bytes]) -> list[bytes]:
        asked = [common.unpack(q) for q in questions]
        keys, ids = (np.concatenate(x) for x in zip(*asked, strict=True))
        order = np.lexsort((ids, keys))
        ranked, by = keys[order], ids[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        least = by[np.flatnonzero(new)][np.cumsum(new) - 1]
        late = np.empty(len(keys), bool)
        late[order] = by > least
        ends = np.cumsum([len(k) for k, _ in asked])[:-1]
        return [np.packbits(x).tobytes() for x in np.split(late, ends)]

    def use(t: pa.Table, answers: dict[int, bytes]) -> pa.Table:
        ids, order, words, hashes, first, doc_of = _windows(t, width)
        keys, doc, place = _distinct(hashes, doc_of[first])
        counts = np.bincount(common.bucket_of(keys, buckets), minlength=buckets)
        late = [np.unpackbits(np.frombuffer(answers[b], np.uint8), count=counts[b]).astype(bool) for b in np.flatnonzero(counts)]
        late = np.concatenate(late) if late else np.empty(0, bool)
        repeated = first[late[place] | (ids[doc_of[first]] > ids[doc][place])] if len(first) else first
        cover = np.zeros(len(doc_of) + 1, np.int32)
        np.add.at(cover, repeated, 1)
        np.add.at(cover, repeated + width, -1)
        gone = np.cumsum(cover[:-1]) > 0
        n = np.bincount(doc_of[~gone], minlength=len(ids))
        kept = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), words.words.filter(pa.array(~gone)).cast(pa.binary()).cast(pa.string()))
        # an interval ends where the next word stays or belongs to another document
        edge = np.ones(len(gone), bool)
        edge[1:] = (gone[1:] != gone[:-1]) | (doc_of[1:] != doc_of[:-1])
        heads = np.flatnonzero(edge)
        tails = np.append(heads[1:], len(gone))
        mine = gone[heads] if len(heads) else np.empty(0, bool)
        heads, tails = heads[mine], tails[mine]
        base = words.starts[doc_of[heads]] if len(heads) else heads
        spans = pa.StructArray.from_arrays([pa.array(heads - base, pa.int64()), pa.array(tails - base, pa.int64())], ["start", "end"])
        per = np.bincount(doc_of[heads], minlength=len(ids)) if len(heads) else np.zeros(len(ids), np.int64)
        return pa.table(
            {
                "doc_id": common.array_of(t, "doc_id").cast(pa.int64()).take(pa.array(order)),
                "n_words": pa.array(words.counts, pa.int64()),
                "n_removed": pa.array(words.counts - n, pa.int64()),
                "removed": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per))), pa.int32()), spans),
                "kept_text": pc.binary_join(kept, " "),
            }
        )

    packed = blocks.blocks_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return blocks.exchange(packed, ask, answer, use, "doc_id long, n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept_text string", blocks.parts_for(docs))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    out = dedup_substrings(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
SQL = {
    "op5_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), places AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM places
), least AS (
  SELECT s, min(doc_id) AS m FROM windows GROUP BY s
), gone AS (
  SELECT DISTINCT doc_id, i + k AS p FROM windows JOIN least USING (s), range(13) AS r(k) WHERE m < doc_id
), each_word AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM each_word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
}
