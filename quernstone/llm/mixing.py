"""Mixing to target weights by soft membership: a labelled-table classifier's domain posteriors, and projected-gradient least squares for
document rates. DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Domains of the labelled table, quality and toxicity, and the shares of all tokens that op2 aims at.
TARGETS = {"q1t0": 0.90, "q1t1": 0.04, "q0t0": 0.05, "q0t1": 0.01}
#: Figures of a text, and the bins that each is put into: quantiles of the labelled rows. Words are hashed to 2^HASH_BITS places; a place is telling if LEAST
#: labelled rows or more have it and half of them or more are not of the most frequent domain; TELLING places at most, those of most such rows.
FIGURES, BINS, HASH_BITS, LEAST, TELLING = ("marks", "bars", "capitals", "variety", "length"), 8, 16, 5, 512
#: Bound of the labelled rows that the classifier is fitted to, and the steps of a posterior: documents of one rounded posterior are of one class, so that there
#: are no more than (GRID + 3)! / (GRID! 3!) of four domains, however many documents.
SAMPLE, GRID = 6000, 100
STEPS, PULL = 60, 1e-4


def features(docs: DataFrame) -> DataFrame:
    """docs and __tokens, its words; __unit, a number in [0, 1) that hangs on doc_id and text alone; __words, the places of its distinct words (runs of letters, in
    lower case); __marks and so on, its FIGURES."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.withColumn("__text", text).withColumn("__rest", F.translate("__text", common.LOWER_AZ, ""))
    read = read.withColumn("__all", F.split(F.lower("__text"), "[^a-z\\x{DF}-\\x{FF}]+"))
    read = read.withColumn("__distinct", F.array_distinct("__all"))
    without = lambda marks: F.length("__rest") - F.length(F.translate("__rest", marks, ""))
    n = F.greatest(F.lit(1), F.length("__text"))
    figures = {
        "marks": without("#$%&*!@^~<>{}") / n,
        "bars": without("|") / n,
        "capitals": without(common.UPPER_AZ) / n,
        "variety": F.size("__distinct") / F.sqrt(F.greatest(F.lit(1), F.size("__all")).cast("double")),
        "length": F.length("__text").cast("double"),
    }
    return read.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.regexp_count("__text", F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("__tokens"),
        (F.shiftrightunsigned(F.xxhash64("doc_id", "__text"), 11) / float(1 << 53)).alias("__unit"),
        F.transform("__distinct", lambda w: F.pmod(F.xxhash64(w), F.lit(1 << HASH_BITS)).cast("int")).alias("__words"),
        *[figures[k].alias(f"__{k}") for k in FIGURES],
    )


@dataclass
class Classifier:
    """Naive Bayes: logarithms of each domain's prior, of each bin of each figure, and of each telling place's presence, what its absence would have added taken off."""

    edges: dict[str, list[float]]
    prior: list[float]
    bins: dict[str, list[list[float]]]
    places: list[int]
    words: list[list[float]]


def classifier(docs: DataFrame, labels: DataFrame, domains: list[str]) -> Classifier:
    """Learned from at most SAMPLE labelled rows, chosen by a hash of doc_id. Quantiles, and counts by domain and bin or place, reach the driver: a few thousand."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    unit = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    known = known.where(unit < min(1.0, SAMPLE / max(1, known.count())))
    rows = docs.select("doc_id", "text").join(known, "doc_id")
    rows = common.materialise(features(rows), "mix-labelled")
    cuts = [k / BINS for k in range(1, BINS)]
    found = rows.agg(*[F.percentile(f"__{k}", F.array(*map(F.lit, cuts))).alias(k) for k in FIGURES]).first()
    edges = {k: sorted({x for x in found[k] or []}) for k in FIGURES}
    listed = F.array(*[F.struct(F.lit(k).alias("f"), _bin(F.col(f"__{k}"), edges[k]).alias("b")) for k in FIGURES])
    by = {tuple(r[:3]): r[3] for r in rows.select("domain", F.explode(listed).alias("x")).groupBy("domain", "x.f", "x.b").count().collect()}
    total = {d: sum(n for (x, f, _), n in by.items() if x == d and f == FIGURES[0]) for d in domains}
    every = sum(total.values())
    prior = [math.log((total[d] + 1) / (every + len(domains))) for d in domains]
    bins = {k: [[math.log((by.get((d, k, b), 0) + 0.5) / (total[d] + 0.5 * (len(edges[k]) + 1))) for b in range(len(edges[k]) + 1)] for d in domains] for k in FIGURES}
    common_one = max(domains, key=lambda d: total[d])
    held = rows.select("domain", F.explode(F.array_distinct("__words")).alias("w")).groupBy("w", "domain").count().groupBy("w")
    held = held.agg(F.sum("count").alias("all"), F.sum(F.when(F.col("domain") != common_one, F.col("count")).otherwise(0)).alias("other"), F.map_from_entries(F.collect_list(F.struct("domain", "count"))).alias("n"))
    telling = held.where((F.col("all") >= LEAST) & (F.col("other") * 2 >= F.col("all"))).orderBy(F.desc("other"), "w").limit(TELLING).orderBy("w").collect()
    words: list[list[float]] = [[] for _ in domains]
    for r in telling:
        for k, d in enumerate(domains):
            p = (r["n"].get(d, 0) + 0.5) / (total[d] + 1)
            words[k].append(math.log(p / (1 - p)))
            prior[k] += math.log(1 - p)
    return Classifier(edges, prior, bins, [r["w"] for r in telling], words)


def _bin(value: Column, edges: list[float]) -> Column:
    return reduce(lambda b, e: b + (value >= e).cast("int"), edges, F.lit(0))


def posterior(model: Classifier) -> Column:
    """The posterior of each domain, in order, of a row of features(): to one part in GRID, so that it sums to one."""
    marks = [0] * (1 << (HASH_BITS - 5))
    for w in model.places:
        marks[w >> 5] |= 1 << (w & 31)
    bitmap, places = common.literal(marks, "array<bigint>"), common.literal(model.places, "array<int>")
    heard = F.filter(F.array_distinct("__words"), lambda w: F.bit_get(F.get(bitmap, F.shiftright(w, 5)), w.bitwiseAND(F.lit(31))) == 1)
    heard = F.transform(heard, lambda w: (F.array_position(places, w) - 1).cast("int"))

    def scored(x: Column) -> Column:
        logs = []
        for k, prior in enumerate(model.prior):
            log = F.lit(prior)
            for name, edges in model.edges.items():
                log = log + F.get(F.array(*map(F.lit, model.bins[name][k])), _bin(F.col(f"__{name}"), edges))
            logs.append(log + weighed(x, common.literal(model.words[k], "array<double>")))
        return common.let(F.array(*logs), normal)

    def weighed(x: Column, weights: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, w: s + F.get(weights, w))

    def normal(x: Column) -> Column:
        powers = common.let(F.array_max(x), lambda m: F.transform(x, lambda v: F.exp(v - m)))
        shares = common.let(powers, lambda p: F.transform(p, lambda v: F.round(GRID * v / F.aggregate(p, F.lit(0.0), lambda s, y: s + y))))
        return common.let(shares, lambda p: F.transform(p, lambda v: v / F.aggregate(p, F.lit(0.0), lambda s, y: s + y)))

    return common.let(heard, scored)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _rate(posterior: Column, history: list[list[float]], step: float, least: float, ahead: float = 0.0) -> Column:
    """A document's rate after the steps taken so far: each step's momentum and residuals, by domain, are all that it depends on. least: the smallest rate, 0
    or more. ahead: the point that so much momentum leads on to."""
    if not history:
        return F.lit(1.0)
    past = common.literal([{"m": h[0], "h": h[1:]} for h in history], "array<struct<m:double,h:array<double>>>")

    def moved(s: Column, x: Column) -> Column:
        at = lambda y: F.greatest(F.lit(least), y - step * (_dot(posterior, x.h) + PULL * (y - 1)))
        return F.struct(at(s.r + x.m * (s.r - s.before)).alias("r"), s.r.alias("before"))

    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("before"))
    return F.aggregate(past, start, moved, lambda s: s.r + ahead * (s.r - s.before))


def fit_rates(classes: DataFrame, targets: dict[str, float], total: float, least: float = 0.0) -> tuple[list[list[float]], float]:
    """Projected gradient, with Nesterov's momentum, for rates r >= least that minimise sum_k (sum_d r_d t_d p_dk - T_k)^2 / T_k and, PULL times, sum_d t_d (r_d - 1)^2, both
    over all tokens; steps are scaled by 1 / t_d. classes: (p, tokens), the tokens of all documents with one posterior, which so have one rate.
    Gives the momentum and residuals of each step, and the step size. A step is one aggregation; its few sums reach the driver."""
    k = range(len(targets))
    pairs = [F.coalesce(F.sum(F.col("tokens") * F.col("p")[i] * F.col("p")[j]), F.lit(0.0)).alias(f"g{i}_{j}") for i in k for j in k]
    mass = classes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), *pairs).first()
    if not mass.t:
        return [], 0.0
    goal = [w * total for w in targets.values()]
    weight = [1 / max(g, 0.01 * total) for g in goal]
    root = np.sqrt(weight)
    steepest = float(np.linalg.eigvalsh(np.array([[mass[f"g{i}_{j}"] * root[i] * root[j] for j in k] for i in k])).max()) + PULL
    history: list[list[float]] = []
    step, speed = 1 / steepest, 1.0
    for _ in range(STEPS):
        faster = (1 + math.sqrt(1 + 4 * speed * speed)) / 2
        momentum, speed = (speed - 1) / faster, faster
        rated = classes.select("p", (F.col("tokens") * _rate(F.col("p"), history, step, least, momentum)).alias("t"))
        now = rated.agg(*[F.coalesce(F.sum(F.col("t") * F.col("p")[i]), F.lit(0.0)).alias(f"s{i}") for i in k]).first()
        history.append([momentum, *((now[i] - goal[i]) * weight[i] for i in k)])
        if max(abs(now[i] - goal[i]) for i in k) <= 1e-4 * total or len(history) > 2 and np.abs(np.diff(history[-3:], axis=0)[:, 1:]).max() <= 1e-6:
            break
    return history, step


def _fitted(docs: DataFrame, labels: DataFrame, targets: dict[str, float], growth: float, learn_from: DataFrame | None, least: float) -> DataFrame:
    """docs and __tokens, __unit, __posterior, __rate, __copies."""
    domains = list(targets)
    model = classifier(docs if learn_from is None else learn_from, labels, domains)
    rows = features(docs).select(*[F.col(f"`{c}`") for c in docs.columns], "__tokens", "__unit", posterior(model).alias("__posterior"))
    rows = common.materialise(rows, "mix-posteriors")
    classes = rows.groupBy(F.col("__posterior").alias("p")).agg(F.sum("__tokens").alias("tokens"))
    classes = common.materialise(classes, "mix-classes")
    tokens = classes.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    share = sum(targets.values())
    history, step = fit_rates(classes, {d: w / share for d, w in targets.items()}, float(growth * tokens), least)
    rated = rows.withColumn("__rate", _rate(F.col("__posterior"), history, step, least))
    near = F.round("__rate")
    snapped = F.when(F.abs(F.col("__rate") - near) < 1e-3, near).otherwise(F.col("__rate"))
    return rated.withColumn("__copies", (F.floor(snapped) + (F.col("__unit") < snapped - F.floor(snapped)).cast("int")).cast("int"))


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float], growth: float = 1.0, learn_from: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, tokens, posterior (array in the order of targets), rate, copies.

    labels: (doc_id, domain) of some documents of learn_from (docs, if not given). targets: domains and their shares of the tokens of the mix, which are growth times those of docs. A
    document's expected tokens of a domain are rate * tokens * posterior; rates are least or more (0: any) and fit the targets by least squares: each step of the
    gradient is one sum over documents, and a document's rate follows from its posterior and the steps' residuals. copies rounds
    rate down or up by a hash of doc_id and text, up with the chance of its fraction; a rate within 0.001 of a whole number is that number.

    Nulls: a null text has no tokens, and a rate like any text of its features; a null doc_id has no label; labels that are null or no target are left
    out; of two labels of one doc_id the smaller counts. Repeated rows get equal results. An empty table gives an empty result; without labels all domains are
    equally likely. Very long texts count whole. Other columns of docs are ignored, whatever their names.
    """
    out = _fitted(docs.select("doc_id", "text"), labels, targets, growth, learn_from, least)
    return out.select("doc_id", *[F.col(f"__{c}").alias(c) for c in ("tokens", "posterior", "rate", "copies", "unit")])


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], growth: float = 1.0, learn_from: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """The rows of docs, each as often as its copies say; columns as they are. Rates are a projection: documents are neither joined nor shuffled."""
    rated = _fitted(docs, labels, targets, growth, learn_from, least)
    repeated = rated.withColumn("__i", F.explode(F.array_repeat(F.lit(0), F.col("__copies"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from reviewers' labels: q1t0 is good and not toxic."""
    return labels.select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string"), F.lit("t"), F.col("toxic").cast("string")).alias("domain"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    return mixing_rates(docs, quality_domains(labels), TARGETS).select("doc_id", "tokens", "posterior", "rate", "copies")


QUERIES = {"op2_mixing": op2_mixing}
SQL: dict[str, str] = {}
