"""Quality classifier: a weak-label model of overlapping heuristic labellers, and a hashed linear scorer trained on its posteriors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bounds of the training sample: documents, and bytes of a sampled document. Fitting sees no others; scoring sees every whole text.
SAMPLE, LONGEST = 6000, 1 << 14
#: Features are hashed to 2^HASH_BITS places; a feature that fewer sampled documents have has no weight (a fortieth of a small sample).
HASH_BITS, LEAST_DOCUMENTS = 18, 5
GOOD, BAD, NO_VOTE = 0, 1, 2

#: Lengths, in bytes, of the beginnings of words that are counted; a feature is a beginning that a text has so often, or in that share of its words.
BEGINNINGS, OFTEN, SHARES = (4, 5, 7), (1, 2, 3), (0.01, 0.03)

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MARKS = np.zeros(256, np.int64)
_MARKS[[x for x in range(33, 127) if not chr(x).isalnum() and chr(x) not in ".,;:'\"-()?"]] = 1

#: Edges of the bins into which each shape of a text is put.
BINS = {
    "marks": (0.005, 0.02, 0.05, 0.1, 0.2),
    "shouting": (0.05, 0.15, 0.3, 0.6),
    "echo": (0.02, 0.1, 0.3, 0.6),
    "bars": (0.02, 0.1, 0.25),
    "variety": (0.1, 0.25, 0.5, 0.8),
    "word_length": (2.5, 4.0, 6.0, 9.0, 14.0),
    "sentences": (0.005, 0.03, 0.1, 0.3, 0.6),
    "words": (1, 5, 20, 100),
}


def _share(values: np.ndarray, of: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    return np.bincount(of, values, n) / np.maximum(total, 1)


def shapes(texts: pa.Array) -> dict[str, np.ndarray]:
    """Figures of each whole text, each a share or a mean."""
    data, offsets = common.text_bytes(texts)
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(offsets))
    upper = ((data >= 65) & (data <= 90)).astype(np.int64)
    letters = upper + ((data >= 97) & (data <= 122))
    words = common.words_of(texts, lower=True)
    codes, _ = words.coded()
    of = np.repeat(np.arange(n), words.counts)
    _, bounds, body = words.words.buffers()
    count = len(codes)
    bounds = np.frombuffer(bounds, np.int64)[: count + 1] if count else np.zeros(1, np.int64)
    body = np.frombuffer(body, np.uint8) if count else np.empty(0, np.uint8)
    size = np.diff(bounds)
    last = body[bounds[1:] - 1] if count else body
    first = body[bounds[:-1]] if count else body
    echo = np.zeros(count)
    echo[1:] = (codes[1:] == codes[:-1]) & (of[1:] == of[:-1])
    distinct = np.bincount(np.unique(of.astype(np.int64) << 32 | codes) >> 32, minlength=n)
    return {
        "marks": np.bincount(text, _MARKS[data], n) / np.maximum(1, np.bincount(text, ~common._SEPARATES[data], n)),
        "shouting": np.bincount(text, upper, n) / np.maximum(1, np.bincount(text, letters, n)),
        "echo": _share(echo, of, n, words.counts),
        "bars": _share((size == 1) & (first == 124), of, n, words.counts),
        "variety": distinct / np.maximum(1.0, np.sqrt(words.counts * 200.0).clip(max=words.counts)),
        "word_length": _share(size, of, n, words.counts),
        "sentences": _share(np.isin(last, (46, 63)), of, n, words.counts),
        "words": words.counts.astype(float),
    }


def quality_votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """Votes of the labellers of quality, one column each."""

    def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(bad, BAD, np.where(good, GOOD, NO_VOTE))

    return np.stack(
        [
            vote(s["marks"] > 0.08, s["marks"] < 0.03),
            vote(s["shouting"] > 0.5, s["shouting"] < 0.2),
            vote(s["echo"] > 0.3, s["echo"] < 0.05),
            vote(s["bars"] > 0.15, s["bars"] < 0.02),
            vote(s["variety"] < 0.12, s["variety"] > 0.4),
            vote((s["word_length"] < 2) | (s["word_length"] > 15), (s["word_length"] > 3) & (s["word_length"] < 10)),
            vote((s["sentences"] < 0.004) & (s["words"] > 40), s["sentences"] > 0.03),
            vote(s["words"] < 3, np.zeros(len(s["words"]), bool)),
        ],
        1,
    )


@dataclass
class Features:
    """Hashed places of each text, as (text, place) pairs without repeats."""

    text: np.ndarray
    place: np.ndarray


def features(texts: pa.Array, s: dict[str, np.ndarray], used: np.ndarray | None = None) -> Features:
    """Which words (runs of letters, A-Z in lower case) a text has, which beginnings of words how often, and into which bins its shapes fall.

    used: if given, of each place whether anything is asked about it; others are left out.
    """
    words = common.words_of(texts, lower=True, separates=~_LETTERS)
    codes, vocabulary = words.coded()
    n = len(words.counts)
    of = np.repeat(np.arange(n), words.counts)
    mask = np.uint64((1 << HASH_BITS) - 1)
    used = np.ones(1 << HASH_BITS, bool) if used is None else used
    values = vocabulary.to_pylist()
    places = (common.hash_values(vocabulary) & mask).astype(np.int64)
    asked = used[places][codes]
    pairs = [of[asked] << 32 | places[codes[asked]]]
    long = np.fromiter(map(len, values), np.int64, len(values))
    tests = [lambda count, share, k=k: count >= k for k in OFTEN] + [lambda count, share, x=x: (share >= x) & (count > 1) for x in SHARES]
    for size in BEGINNINGS:
        begins = common.hash_values(pa.array([v[:size] for v in values], pa.binary()), size) & np.uint64(0xFFFFFFFF)
        at = [(common.mix(begins + np.uint64(salt << 40)) & mask).astype(np.int64) for salt in range(1, len(tests) + 1)]
        asked = ((long > size) & np.any([used[x] for x in at], axis=0))[codes]
        key, count = np.unique(of[asked] << 32 | begins.astype(np.int64)[codes[asked]], return_counts=True)
        share = count / words.counts[key >> 32]
        for salt, test in enumerate(tests, 1):
            met = key[test(count, share)]
            place = common.mix((met & 0xFFFFFFFF).astype(np.uint64) + np.uint64(salt << 40)) & mask
            pairs.append(met >> 32 << 32 | place.astype(np.int64))
    for name, edges in BINS.items():
        at = common.hash_values(pa.array([f"{name} {b}".encode() for b in range(len(edges) + 1)])) & mask
        pairs.append(np.arange(n) << 32 | at.astype(np.int64)[np.searchsorted(edges, s[name], side="right")])
    pairs = np.concatenate(pairs)
    pairs = np.unique(pairs[used[pairs & 0xFFFFFFFF]])
    return Features(pairs >> 32, pairs & 0xFFFFFFFF)


def _apart(has: np.ndarray, ones: np.ndarray, mean: float) -> np.ndarray:
    """By how many standard errors the mean label of texts with a feature differs from the mean."""
    return (ones - has * mean) / np.sqrt(np.maximum(has, 1) * max(mean * (1 - mean), 1e-6))


def _least(n: int) -> int:
    return min(LEAST_DOCUMENTS, max(2, n // 40))


def label_model(votes: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Expectation-maximisation over votes [texts, labellers] of GOOD, BAD or NO_VOTE: posterior of BAD.

    Each labeller has, for either class, the odds of its two votes; no vote says nothing. The classes have a prior. The first guess is the
    share of BAD among a text's votes.
    """
    cast = np.stack([votes == v for v in (GOOD, BAD)], -1).astype(float)
    bad, good = cast[:, :, BAD].sum(1), cast[:, :, GOOD].sum(1)
    q = (2 * bad + 0.1) / (2 * bad + good + 1)
    for _ in range(rounds):
        log = []
        for weight in (1 - q, q):
            accuracy = np.einsum("i,ijv->jv", weight, cast) + 0.5
            accuracy /= accuracy.sum(1, keepdims=True)
            log.append(np.log((weight.sum() + 1) / (len(q) + 2)) + np.einsum("ijv,jv->i", cast, np.log(accuracy)))
        q = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return q


def train_linear(f: Features, n: int, target: np.ndarray, rounds: int = 300, penalty: float = 3e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on hashed features towards the posterior labels, by Adam over the whole sample.

    A feature takes part if LEAST_DOCUMENTS texts or more have it and their mean label is seven standard errors or more from the mean; fewer, down
    to two, in small samples, where nothing is so far from it.
    """
    has, mean = np.bincount(f.place, minlength=1 << HASH_BITS), target.mean()
    apart = _apart(has, np.bincount(f.place, target[f.text], 1 << HASH_BITS), mean)
    used = np.flatnonzero((has >= _least(n)) & (np.abs(apart) >= min(7.0, 2 + 0.1 * np.sqrt(n))))
    rank = np.full(1 << HASH_BITS, -1, np.int32)
    rank[used] = np.arange(len(used))
    keep = rank[f.place] >= 0
    text, at = f.text[keep], rank[f.place[keep]]
    w, b = np.zeros(len(used)), 0.0
    m1, m2, c1, c2 = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(text, w[at], n) + b, -40, 40)))
        g = (p - target) / max(1, n)
        gw, gb = np.bincount(at, g[text], len(used)) + penalty * w, g.sum()
        m1, m2, c1, c2 = 0.9 * m1 + 0.1 * gw, 0.999 * m2 + 0.001 * gw**2, 0.9 * c1 + 0.1 * gb, 0.999 * c2 + 0.001 * gb**2
        a, z = 1 - 0.9**k, 1 - 0.999**k
        w -= 0.1 * (m1 / a) / (np.sqrt(m2 / z) + 1e-8)
        b -= 0.1 * (c1 / a) / (np.sqrt(c2 / z) + 1e-8)
    full = np.zeros(1 << HASH_BITS, np.float32)
    full[used] = w
    return full, float(b)


@dataclass
class Scorer:
    """Weights and intercepts of the two classes that are rejected: bad form and toxic words."""

    weights: np.ndarray
    intercepts: np.ndarray

    def __call__(self, texts: pa.Array) -> np.ndarray:
        s = shapes(texts)
        f = features(texts, s, (self.weights != 0).any(0))
        n = len(texts)
        z = np.stack([np.bincount(f.text, self.weights[k][f.place], n) + self.intercepts[k] for k in (0, 1)], 1)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        p[s["words"] == 0] = (1.0, 0.0)
        return p


def telling(f: Features, label: np.ndarray, of: np.ndarray) -> np.ndarray:
    """A labeller learned from the texts of: texts with a feature that LEAST_DOCUMENTS of those or more have, 19 in 20 of them labelled 1."""
    mine = of[f.text]
    has, ones = (np.bincount(f.place[mine], w, 1 << HASH_BITS) for w in (None, (label == 1)[f.text[mine]]))
    return np.bincount(f.text, ((has >= _least(len(label))) & (ones >= 0.95 * has))[f.place], len(label)) > 0


def fit(texts: pa.Array, quality: np.ndarray, toxic: np.ndarray) -> Scorer:
    """quality, toxic: reviewers' labels (1, 0, NaN: none); they are one labeller more of either question."""
    size = 1 << HASH_BITS
    pieces = list(common.slices(pa.record_batch([texts], ["text"]), 1 << 20))
    before = np.cumsum([0, *(p.num_rows for p in pieces)])
    figures = [shapes(p.column(0)) for p in pieces]
    s = {k: np.concatenate([x[k] for x in figures]) for k in BINS}
    # first only counts of each feature, by label; then the features that are anywhere near telling, few as they are
    has, ones = np.zeros(size), [np.zeros(size), np.zeros(size)]
    labels = [quality == 0, toxic == 1]
    for p, own, at in zip(pieces, figures, before, strict=False):
        f = features(p.column(0), own)
        has += np.bincount(f.place, minlength=size)
        for k in (0, 1):
            ones[k] += np.bincount(f.place, labels[k][at + f.text], size)
    far = [np.abs(_apart(has, ones[k], labels[k].mean())) >= 2 for k in (0, 1)]
    used = (has >= _least(len(texts))) & (far[0] | far[1])
    parts = [features(p.column(0), own, used) for p, own in zip(pieces, figures, strict=True)]
    f = Features(np.concatenate([x.text + b for x, b in zip(parts, before, strict=False)]), np.concatenate([x.place for x in parts]))
    review = np.where(np.isnan(quality), NO_VOTE, np.where(quality > 0, GOOD, BAD))
    bad_form = label_model(np.column_stack((quality_votes(s), review)))
    review = np.where(np.isnan(toxic), NO_VOTE, np.where(toxic > 0, BAD, GOOD))
    # labellers of toxic words learn them from overlapping thirds of the sample, so that each errs in its own way
    third = np.arange(len(texts)) % 3
    learned = [np.where(telling(f, toxic, third != k), BAD, GOOD) for k in range(3)]
    insulting = label_model(np.column_stack((*learned, review)))
    heads = [train_linear(f, len(texts), target) for target in (bad_form, insulting)]
    return Scorer(np.stack([w for w, _ in heads]), np.array([b for _, b in heads]))


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """At most SAMPLE labelled documents of LONGEST bytes or fewer, chosen by a hash of doc_id. Of two labels of one document, the smaller."""
    able = labels.select("doc_id", "quality", "toxic").where(F.col("doc_id").isNotNull())
    n = able.count()
    unit = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    chosen = able.where(unit < min(1.0, SAMPLE / max(1, n))).groupBy("doc_id").agg(F.min("quality").cast("double").alias("quality"), F.max("toxic").cast("double").alias("toxic"))
    ids = chosen.orderBy(unit, "doc_id").limit(SAMPLE).toPandas()
    if not len(ids):
        return pa.array([], pa.string()), np.empty(0), np.empty(0)
    few = docs.sparkSession.createDataFrame(ids, "doc_id long, quality double, toxic double")  # at most SAMPLE rows
    rows = docs.where(F.octet_length("text") <= LONGEST).select("doc_id", "text").join(F.broadcast(few), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"), F.first("toxic").alias("toxic"))  # of equal ids one text
    t = rows.toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    label = lambda c: t.column(c).to_numpy().astype(float)
    return common.array_of(t, "text"), label("quality"), label("toxic")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """For each row of docs (doc_id, text): its columns, and bad_form, toxic (probabilities) and keep (neither reaches the threshold).

    labels: (doc_id, quality, toxic), reviewers' labels of some documents. On a sample of them, see SAMPLE, a weak-label model weighs
    the reviewers and the heuristic labellers against one another, and its posteriors train the scorer; every document is then scored.
    Columns of docs that are called bad_form, toxic or keep are replaced.

    Nulls: a null text, or one without words, has bad_form 1 and toxic 0 and isn't kept; null labels are no votes; a null doc_id has no label.
    Repeated rows get equal results. An empty table gives an empty result; without labelled documents the scorer is untrained, gives 0.5 less a hair to
    each text that has words, and keeps it.
    """
    texts, quality, toxic = training_sample(docs, labels)
    scorer = fit(texts, quality, toxic) if len(texts) else Scorer(np.zeros((2, 1 << HASH_BITS), np.float32), np.array([-1e-3, -1e-3]))
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # two vectors of 2^HASH_BITS floats
    docs = docs.drop("bad_form", "toxic", "keep")
    kinds = docs.schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), "bad_form double, toxic double, keep boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                p = shared.value(part.column("text"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array((p < threshold).all(1))], [*part.schema.names, "bad_form", "toxic", "keep"])

    common.ship(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def good_ones(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that classify() keeps, all columns as they are, whatever their names."""
    clash = [c for c in docs.columns if c in ("bad_form", "toxic", "keep")]
    aside = docs.withColumnsRenamed({c: f"__{c}" for c in clash})
    kept = classify(aside, labels).where("keep").select(*[F.col(f"`{c}`") for c in aside.columns])
    return kept.withColumnsRenamed({f"__{c}": c for c in clash})


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    out = classify(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "labels"))
    return out.select("doc_id", (1 - F.col("bad_form")).alias("quality"), "toxic", "keep")


QUERIES = {"op9_quality_classifier": op9_quality_classifier}
SQL: dict[str, str] = {}
