"""Language-model scoring with a weighted backoff automaton learned from the corpus itself."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, common

#: Hashes of the two tokens that are no words; as texts they hold a space, which no word does.
START, END = 0x5C1F3A9D42B76E01, 0x27D94EB2F085A16C
#: What add-constant smoothing of single tokens adds to each count.
ADD = 0.1
#: A context that holds this share of all training tokens or more is spread over several buckets; at most 1 / share such contexts exist.
HOT_SHARE, SPREAD = 1 / 512, 64


@dataclass
class Sequences:
    """Tokens of several documents in turn, each document's words and then END, as codes of a vocabulary that ends with START and END."""

    tokens: np.ndarray
    contexts: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    hashes: np.ndarray


def sequences(texts: pa.Array) -> Sequences:
    words = common.words_of(texts, lower=True)
    codes, vocabulary = words.coded()
    v = len(vocabulary)
    lengths = words.counts + 1
    ends = np.cumsum(lengths) - 1
    tokens = np.empty(int(lengths.sum()), np.int64)
    is_end = np.zeros(len(tokens), bool)
    is_end[ends] = True
    tokens[is_end] = v + 1
    tokens[~is_end] = codes
    starts = ends - lengths + 1
    contexts = np.empty_like(tokens)
    contexts[1:] = tokens[:-1]
    contexts[starts] = v
    hashes = np.concatenate((common.hash_values(vocabulary), np.array([START, END], np.uint64)))
    return Sequences(tokens, contexts, starts, lengths, hashes)


@dataclass
class Totals:
    """Of the training tokens: how many, how many distinct, and the hashes of START and of those with HOT_SHARE of them or more."""

    tokens: int
    distinct: int
    hot: np.ndarray


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, inverse = np.unique(keys, return_inverse=True)
    return u, np.bincount(inverse, counts, len(u)).astype(np.int64)


def totals(training: DataFrame, buckets: int) -> Totals:
    """Counts each token once per scan task before it is shuffled. Only sums and at most 1 / HOT_SHARE hashes reach the driver."""
    most = round(1 / HOT_SHARE)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, size = [], [], 0

        def flush():
            k, c = _summed(np.concatenate(keys), np.concatenate(counts))
            cuts = np.searchsorted(common.bucket_of(k, buckets), np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cuts))
            packed = [common.pack(k[cuts[b] : cuts[b + 1]], c[cuts[b] : cuts[b + 1]]) for b in full]
            return pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int64()), "payload": pa.array(packed, pa.binary())})

        for batch in batches:
            if not batch.num_rows:
                continue
            s = sequences(batch.column("text"))
            c = np.bincount(s.tokens, minlength=len(s.hashes))
            keys.append(s.hashes[c > 0])
            counts.append(c[c > 0])
            size += len(keys[-1])
            if size > 2_000_000:
                k, c = _summed(np.concatenate(keys), np.concatenate(counts))
                keys, counts, size = [k], [c], 0
                if len(k) > 2_000_000:
                    yield flush()
                    keys, counts = [], []
        if keys:
            yield flush()

    def add(t: pa.Table) -> pa.Table:
        parts = [common.unpack(x.as_buffer().to_pybytes()) for x in t.column("payload")]
        k, c = _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        top = np.argsort(-c, kind="stable")[:most]
        return pa.table({"n": [int(c.sum())], "v": [len(k)], "top": [[{"h": int(h), "c": int(x)} for h, x in zip(k[top].view(np.int64), c[top], strict=True)]]}, _ADDED)

    common.ship(training.sparkSession)
    summed = training.select("text").mapInArrow(count, "bucket long, payload binary").groupBy("bucket").applyInArrow(add, "n long, v long, top array<struct<h: long, c: long>>")
    summed = common.materialise(summed, "lm-totals")
    n, v = summed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    hot = summed.select(F.explode(F.filter("top", lambda x: x.c >= HOT_SHARE * n)).alias("x")).select("x.h").collect()
    return Totals(n, v, np.array([START, *(r[0] % (1 << 64) for r in hot)], np.uint64))


_ADDED = pa.schema([("n", pa.int64()), ("v", pa.int64()), ("top", pa.list_(pa.struct([("h", pa.int64()), ("c", pa.int64())])))])


@dataclass
class Asked:
    """A block's distinct bigrams, ordered by bucket, context and word. Context entry e covers runs[e] bigrams."""

    cuts: np.ndarray
    entry_hash: np.ndarray
    entry_code: np.ndarray
    runs: np.ndarray
    words: np.ndarray
    counts: np.ndarray
    place: np.ndarray


def bigrams(s: Sequences, trained: np.ndarray, hot: np.ndarray, buckets: int) -> Asked:
    """trained: for each token, whether it counts. A hot context has SPREAD entries, one for each class of next words; they are always all there."""
    v = len(s.hashes)
    spread = min(SPREAD, buckets)
    is_hot = np.isin(s.hashes, hot)
    hot_codes = np.flatnonzero(is_hot)
    used = np.zeros(v, bool)
    used[s.contexts] = True
    cold = np.flatnonzero(used & ~is_hot)
    hot_codes = hot_codes[used[hot_codes]]
    code = np.concatenate((cold, np.repeat(hot_codes, spread)))
    salt = np.concatenate((np.zeros(len(cold), np.int64), np.tile(np.arange(spread), len(hot_codes))))
    bucket = (common.bucket_of(common.mix(s.hashes[code]), buckets) + salt * max(1, buckets // spread)) % buckets
    order = np.lexsort((s.hashes[code], bucket))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at = np.zeros(v, np.int64)
    at[cold] = np.arange(len(cold))
    at[hot_codes] = len(cold) + np.arange(len(hot_codes)) * spread
    entry = at[s.contexts]
    salted = is_hot[s.contexts]
    entry[salted] += (s.hashes[s.tokens[salted]] % np.uint64(spread)).astype(np.int64)
    keys, place = np.unique(rank[entry] << 32 | s.tokens, return_inverse=True)
    counts = np.bincount(place, trained, len(keys)).astype(np.int64)
    runs = np.bincount(keys >> 32, minlength=len(order))
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    words = s.hashes[keys & 0xFFFFFFFF] >> np.uint64(16)  # 48 bits tell the words after one context apart
    return Asked(cuts, s.hashes[code[order]], code[order], runs, words, counts, place)


def answer(questions: list[bytes]) -> list[bytes]:
    """Over all blocks: the count of each bigram asked about, and of each context its tokens and its distinct next words."""
    asked = [common.unpack(q) for q in questions]
    entry_hash, runs, words, counts = (np.concatenate(x) for x in zip(*asked, strict=True))
    contexts, entry = np.unique(entry_hash, return_inverse=True)
    of = np.repeat(entry, runs)
    pairs, first, place = np.unique(common.mix(contexts[of] * np.uint64(0x9E3779B97F4A7C15) + words), return_index=True, return_inverse=True)
    count = np.bincount(place, counts, len(pairs)).astype(np.int64)
    tokens = np.bincount(of, counts, len(contexts)).astype(np.int64)
    types = np.bincount(of[first], count > 0, len(contexts)).astype(np.int64)
    out, b, e = [], 0, 0
    for h, _, w, _ in asked:
        mine = entry[e : e + len(h)]
        out.append(common.pack(count[place[b : b + len(w)]], tokens[mine], types[mine]))
        b, e = b + len(w), e + len(h)
    return out


@dataclass
class Automaton:
    """The part of the model that a block needs. State 0 is the root; each context that training has seen is a state.

    A state has an arc for each word seen after it, with the interpolated log10 probability, and a failure arc to the root with
    weight log10(discount * types / tokens). The root has an arc for every word, unknown ones included.
    """

    root: np.ndarray
    fail: np.ndarray
    state_of: np.ndarray

    def traverse(self, s: Sequences, arc: np.ndarray) -> np.ndarray:
        """Log10 probability of each document. arc: of each token, the weight of its arc from the state that its left neighbour leads
        to, NaN where there is none and the failure arc is taken."""
        state = self.state_of[s.contexts]
        weight = np.where(np.isnan(arc), self.fail[state] + self.root[s.tokens], arc)
        return np.add.reduceat(weight, s.starts) if len(s.starts) else np.empty(0)


def lm_scores(docs: DataFrame, held_out: Column, discount: float = 0.75) -> DataFrame:
    """Scores every row of docs (doc_id, text) with a bigram model of the rows for which held_out is not true.

    Tokens are the words of the text, A-Z in lower case, and then one end. Absolute discounting, interpolated:
    P(w | h) = max(c(h w) - discount, 0) / c(h) + discount * types(h) / c(h) * P(w), and P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)).
    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (of single tokens), score.

    Nulls: a null text has no words and so one token, the end; a null held_out is false; a null doc_id stays null. Rows with equal doc_id are
    scored each on its own. An empty table gives an empty result; without training rows every token has probability 1 and every score is 0.
    Other columns of docs are ignored. Contexts are told apart by 64-bit hashes and the words after one context by 48 bits.
    """
    docs = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    buckets = blocks.buckets_for(docs)
    known = totals(docs.where(~F.col("held_out")), buckets)
    n, v, hot = known.tokens, known.distinct, known.hot

    def asked_by(t: pa.Table) -> tuple[Sequences, Asked]:
        s = sequences(common.array_of(t, "text"))
        trained = np.repeat(~common.array_of(t, "held_out").to_numpy(zero_copy_only=False), s.lengths)
        return s, bigrams(s, trained, hot, buckets)

    def ask(t: pa.Table) -> Iterator[tuple[int, bytes]]:
        _, a = asked_by(t)
        ends = np.concatenate(([0], np.cumsum(a.runs)))
        for b in np.flatnonzero(np.diff(a.cuts)):
            e, w = slice(a.cuts[b], a.cuts[b + 1]), slice(ends[a.cuts[b]], ends[a.cuts[b + 1]])
            yield int(b), common.pack(a.entry_hash[e], a.runs[e], a.words[w], a.counts[w])

    def use(t: pa.Table, answers: dict[int, bytes]) -> pa.Table:
        s, a = asked_by(t)
        got = [common.unpack(answers[b]) for b in np.flatnonzero(np.diff(a.cuts))]
        count, tokens, types = (np.concatenate(x) for x in zip(*got, strict=True))
        size = len(s.hashes)
        c = np.bincount(a.entry_code, tokens, size)
        kinds = np.bincount(a.entry_code, types, size)
        seen = c.copy()
        seen[-1] = c[-2]  # an end for each start
        root = np.log10((seen + ADD) / (n + ADD * (v + 1)))
        with np.errstate(divide="ignore", invalid="ignore"):
            fail = np.concatenate(([0.0], np.where(c > 0, np.log10(discount * kinds / c), 0.0)))
            state_of = np.where(c > 0, np.arange(size) + 1, 0)
            of = s.contexts
            number = count[a.place]
            share = (number - discount) / c[of] + discount * kinds[of] / c[of] * 10 ** root[s.tokens]
            arc = np.where(number > 0, np.log10(share), np.nan)
        model = Automaton(root, fail, state_of)
        known_tokens = np.add.reduceat((seen[s.tokens] > 0).astype(np.int64), s.starts)
        return pa.table(
            {
                "doc_id": t.column("doc_id"),
                "held_out": t.column("held_out"),
                "n_tokens": pa.array(s.lengths, pa.int64()),
                "n_known": pa.array(known_tokens, pa.int64()),
                "train_tokens": pa.array(np.full(t.num_rows, n), pa.int64()),
                "base_score": np.add.reduceat(root[s.tokens], s.starts),
                "score": model.traverse(s, arc),
            }
        )

    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.exchange(blocks.blocks_of(docs), ask, answer, use, schema, blocks.parts_for(docs))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return lm_scores(common.table(spark, sf_dir, "documents"), blocks.held_out("doc_id", 10, 0))


QUERIES = {"op1_lm_scoring": op1_lm_scoring}
SQL: dict[str, str] = {}
