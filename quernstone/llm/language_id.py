"""Language identification by prediction by partial matching: exact code lengths under frozen byte statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, common

#: The longest context, in bytes, and the bits that a context must save on the sample for each of its entries to be kept.
ORDER, PRICE = 3, 3.0
#: Bounds of the training sample and of the model: documents a language and in all, bytes of a sampled document, languages; code lengths and contexts kept.
PER_LANGUAGE, SAMPLE, LONGEST, LANGUAGES, ENTRIES, NODES = 400, 4000, 1 << 15, 1024, 1 << 24, 1 << 16
UNDETERMINED = "und"
#: What comes before a document.
BLANK = 10


@dataclass
class Contexts:
    """Frozen context trees of all languages over one set of contexts. A node is a context; node 0 is the empty one. keys[k] are the contexts of k bytes in
    order, the earliest byte uppermost, and first[k] the node of their first. rows are the pairs of a node and a byte that some language has seen,
    node << 8 | byte, in order; bits[row, language] is the byte's code length after the node. escape[node, language] is what an unseen byte costs before the
    node's suffix is asked; after node 0 all bytes are alike."""

    languages: list[str]
    keys: list[np.ndarray]
    first: list[int]
    rows: np.ndarray
    bits: np.ndarray
    escape: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For lookups: the longest context kept of each history, its suffix, each byte's class, and the row of each node and class or -1."""
        node = np.zeros(1, np.int32)
        suffix = np.full(len(self.escape), -1, np.int32)
        for k in range(1, ORDER + 1):
            held = self.keys[k]
            mine = self.first[k] + np.arange(len(held), dtype=np.int32)
            suffix[mine] = node[held % 256 ** (k - 1)]
            node = np.tile(node, 256)
            node[held] = mine
        used = np.unique(self.rows & 255)
        classes = np.full(256, len(used), np.int32)
        classes[used] = np.arange(len(used))
        row = np.full(len(self.escape) * (len(used) + 1), -1, np.int32)
        row[(self.rows >> 8) * (len(used) + 1) + classes[self.rows & 255]] = np.arange(len(self.rows))
        return node, suffix, classes, row


def _lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = common.text_bytes(texts)
    return common._LOWER[data], offsets


def _with_history(symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The ORDER bytes before each byte as one number; a document begins after blanks."""
    n = np.diff(offsets)
    at = np.arange(len(symbols)) + ORDER * (np.repeat(np.arange(len(n)), n) + 1)
    padded = np.full(len(symbols) + ORDER * len(n), BLANK, np.int64)
    padded[at] = symbols
    return sum(padded[at - k] << 8 * (k - 1) for k in range(1, ORDER + 1))


@dataclass
class _Order:
    """One language's contexts of one length: pairs (context << 8 | byte) with their probability; of each context its total, kinds and escape factor."""

    pairs: np.ndarray
    p: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    escape: np.ndarray


def _orders(texts: pa.Array) -> list[_Order]:
    """PPM of method C with exclusion, frozen: of T bytes after a context, K of them different, one seen c times has c / (T + K); an unseen one has
    K / (T + K) times its share of what the next shorter context gives to the bytes unseen here. Before the shortest all bytes are alike."""
    data, offsets = _lowered(texts)
    history = _with_history(data, offsets)
    out: list[_Order] = []
    for k in range(ORDER + 1):
        pairs, counts = np.unique(history % 256**k << 8 | data, return_counts=True)
        contexts, of = np.unique(pairs >> 8, return_inverse=True)
        total, kinds = np.bincount(of, counts, len(contexts)), np.bincount(of, minlength=len(contexts))
        if k:
            below = out[-1]
            lower = below.p[np.searchsorted(below.pairs, (pairs >> 8) % 256 ** (k - 1) << 8 | pairs & 255)]
        else:
            lower = np.full(len(pairs), 1 / 256)
        rest = 1 - np.bincount(of, lower, len(contexts))
        kinds = np.where(kinds < 256, kinds, 0)
        escape = np.where(kinds > 0, kinds / (total + kinds) / np.maximum(rest, 1e-12), 0.0)
        out.append(_Order(pairs, counts / (total + kinds)[of], counts, contexts, escape))
    return out


def _gains(orders: list[_Order], k: int) -> np.ndarray:
    """Bits that each context of length k saves on the sample over the next shorter one."""
    own, below = orders[k], orders[k - 1]
    lower = below.p[np.searchsorted(below.pairs, (own.pairs >> 8) % 256 ** (k - 1) << 8 | own.pairs & 255)]
    return np.bincount(np.searchsorted(own.contexts, own.pairs >> 8), own.counts * np.log2(own.p / lower) - PRICE, len(own.contexts))


def _kept(models: list[list[_Order]]) -> list[np.ndarray]:
    """Contexts of each length: the empty one and single bytes all; of longer ones those that save most, over all languages, as far as the bounds go. A context
    is never kept without its suffix."""
    union = [np.unique(np.concatenate([m[k].contexts for m in models])) for k in range(ORDER + 1)]
    entries = [np.unique(np.concatenate([m[k].pairs for m in models])) for k in range(ORDER + 1)]
    cost, gain = [], []
    for k in range(ORDER + 1):
        cost.append(np.bincount(np.searchsorted(union[k], entries[k] >> 8), minlength=len(union[k])))
        own = np.full(len(union[k]), np.inf)
        if k >= 2:
            own = np.zeros(len(union[k]))
            for m in models:
                own[np.searchsorted(union[k], m[k].contexts)] += _gains(m, k)
            own = np.minimum(own, gain[-1][np.searchsorted(union[k - 1], union[k] % 256 ** (k - 1))])
        gain.append(own)
    order, every, price = np.repeat(np.arange(ORDER + 1), [len(u) for u in union]), np.concatenate(gain), np.concatenate(cost)
    rank = np.lexsort((order, -every))
    fits = (every[rank] == np.inf) | ((np.cumsum(price[rank]) * len(models) <= ENTRIES) & (np.arange(len(rank)) < NODES) & (every[rank] > 0))
    keep = np.zeros(len(every), bool)
    keep[rank] = fits
    return [u[keep[order == k]] for k, u in enumerate(union)]


def fit(sample: dict[str, pa.Array]) -> Contexts:
    """Counts contexts of up to ORDER bytes in each language's texts and turns them into code lengths."""
    languages = sorted(sample)
    if not languages:
        return Contexts([], [np.empty(0, np.int64)] * (ORDER + 1), [0] * (ORDER + 1), np.empty(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((1, 0), np.float32))
    models = [_orders(sample[x]) for x in languages]
    keys = _kept(models)
    first = np.concatenate(([0], np.cumsum([len(x) for x in keys])))
    rows, bits, escapes = [], [], []
    below, lower = None, None
    for k, held in enumerate(keys):
        has = [np.isin(m[k].pairs >> 8, held) for m in models]
        pairs = np.unique(np.concatenate([m[k].pairs[h] for m, h in zip(models, has, strict=True)]))
        code, escape = np.zeros((len(pairs), len(models))), np.zeros((len(held), len(models)))
        under = lower[np.searchsorted(below, (pairs >> 8) % 256 ** (k - 1) << 8 | pairs & 255)] if k else np.full((len(pairs), len(models)), 8.0)
        of = np.searchsorted(held, pairs >> 8)
        for x, (m, h) in enumerate(zip(models, has, strict=True)):
            mine = np.isin(m[k].contexts, held)
            with np.errstate(divide="ignore"):
                escape[np.searchsorted(held, m[k].contexts[mine]), x] = -np.log2(m[k].escape[mine])
            code[:, x] = escape[of, x] + under[:, x]
            code[np.searchsorted(pairs, m[k].pairs[h]), x] = -np.log2(m[k].p[h])
        rows.append((first[k] + of) << 8 | pairs & 255)
        bits.append(code.astype(np.float32))
        escapes.append(escape.astype(np.float32))
        below, lower = pairs, code
    return Contexts(languages, keys, first[:-1].tolist(), np.concatenate(rows), np.concatenate(bits), np.concatenate(escapes))


def code_lengths(model: Contexts, texts: pa.Array, tables: tuple | None = None) -> np.ndarray:
    """Bits of each whole text in each language."""
    node_of, suffix, classes, row_of = tables or model.tables()
    data, offsets = _lowered(texts)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    nodes, symbols, width = node_of[_with_history(data, offsets)], classes[data], int(classes.max(initial=0)) + 1
    width = len(row_of) // len(suffix)
    out = np.zeros((len(offsets) - 1, len(model.languages)))
    chunk = max(1, (1 << 21) // len(model.languages))
    for at in range(0, len(data), chunk):
        node, symbol, t = nodes[at : at + chunk], symbols[at : at + chunk], text[at : at + chunk]
        row = row_of[node * width + symbol]
        bits = model.bits[np.maximum(row, 0)]
        todo = np.flatnonzero(row < 0)
        bits[todo] = 0
        node, symbol = node[todo], symbol[todo]
        while len(todo):
            bits[todo] += model.escape[node]
            node = suffix[node]
            ended = node < 0
            bits[todo[ended]] += 8
            todo, node, symbol = todo[~ended], node[~ended], symbol[~ended]
            row = row_of[node * width + symbol]
            found = row >= 0
            bits[todo[found]] += model.bits[row[found]]
            todo, node, symbol = todo[~found], node[~found], symbol[~found]
        starts, _ = common.runs_of(t)
        out[t[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.float64)
    return out


def training_sample(docs: DataFrame, usable: Column) -> dict[str, pa.Array]:
    """At most PER_LANGUAGE documents of each of the LANGUAGES most frequent languages, chosen by a hash of their text; SAMPLE in all, or four each.

    Only documents of LONGEST bytes or fewer are chosen, each as a whole. The counts come from all rows; the texts of the sample, at most
    SAMPLE or 4 * LANGUAGES times LONGEST bytes, go to the driver.
    """
    able = docs.where(usable & F.col("lang").isNotNull() & (F.octet_length("text") <= LONGEST)).select("lang", "text")
    counts = able.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return {}
    most = max(4, min(PER_LANGUAGE, SAMPLE // len(counts)))
    unit = F.shiftrightunsigned(F.xxhash64("text"), 11) / float(1 << 53)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 1.5 * most / r["count"] + 20 / r["count"]))])
    rows = able.where(unit < share[F.col("lang")]).select("lang", "text", unit.alias("u")).distinct().orderBy("lang", "u", "text").limit(len(counts) * (2 * most + 60))
    table = rows.toArrow()
    lang = np.array(table.column("lang").to_pylist(), object)
    return {x: common.array_of(table.filter(pa.array(lang == x)).slice(0, most), "text") for x in sorted(set(lang))}


def identify(docs: DataFrame, learn_from: Column) -> DataFrame:
    """For each row of docs (doc_id, text, lang): doc_id, lang_pred, score, bits_per_byte.

    Learns from the rows where learn_from is true and lang and text are not null; of a prediction, lang and doc_id are no inputs. lang_pred is the
    language whose trees give the whole text the shortest code; of equal ones the first by name. score is that language's posterior under equal priors.

    Nulls: a null text, or one without a letter, gives `und` and score 0; so does every text if there is nothing to learn from. Repeated rows
    get equal results. An empty table gives an empty result. Very long texts are scored whole, in pieces. Other columns of docs, whatever their names, are
    ignored. Many languages: all share one set of contexts, kept by what they save over all languages within ENTRIES code lengths and NODES contexts, so that
    more languages keep fewer long contexts each, the least useful going first; the LANGUAGES most frequent ones are learned.
    """
    model = fit(training_sample(docs, learn_from))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ENTRIES floats, or those of single bytes, and a few figures a row and context

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        tables = m.tables() if m.languages else None
        for batch in batches:
            for part in common.slices(batch, 2 << 20):
                texts = part.column("text")
                lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                if not m.languages:
                    lettered[:] = False
                bits = code_lengths(m, texts, tables) if m.languages else np.zeros((len(lettered), 1))
                best = bits.argmin(1)
                least = bits.min(1)
                score = np.where(lettered, 1 / np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(1), 0.0)
                n = np.maximum(1, np.diff(common.text_bytes(texts)[1]))
                names = [m.languages[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "lang_pred": pa.array(names, pa.string()), "score": score, "bits_per_byte": least / n})

    common.ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, bits_per_byte double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    held = blocks.held_out("doc_id", 4, 2)
    out = identify(common.table(spark, sf_dir, "documents"), ~held)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_language_id": op3_language_id}
SQL: dict[str, str] = {}
