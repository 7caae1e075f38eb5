"""op2, op3, op9 and op10, and what they do with odd rows."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernstone.llm import common, language_id, mixing, quality_classifier, topk_search

from .fixture import documents, empty, texts


SAMPLES = {
    "en": ["The cat sat on the mat; the cat ran", "this and that", "the then there these those"],
    "fr": ["le chat est là", "où est-il, le chat noir", "les chats sont là-bas"],
    "el": ["η γάτα κάθισε στο χαλί", "αυτό και εκείνο"],
    "zh": ["猫坐在垫子上", "这个和那个,猫"],
}


def brute_code(texts, text, kept):
    """PPM by its definition, one byte at a time: method C, exclusion, contexts of up to three bytes out of kept."""
    lower = lambda t: bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode())
    counts = {}
    for t in texts:
        past = b"\n\n\n"
        for b in lower(t):
            for k in range(4):
                counts.setdefault(past[3 - k :], {}).setdefault(b, 0)
                counts[past[3 - k :]][b] += 1
            past = past[1:] + bytes([b])
    memo = {}

    def p(context):
        if context is None:
            return [1 / 256] * 256
        if context not in memo:
            below = p(context[1:] if context else None)
            seen = counts.get(context, {}) if context in kept else {}
            if not seen:
                memo[context] = below
            else:
                total, kinds = sum(seen.values()), len(seen) if len(seen) < 256 else 0
                rest = sum(q for b, q in enumerate(below) if b not in seen)
                memo[context] = [seen[b] / (total + kinds) if b in seen else kinds / (total + kinds) * below[b] / rest for b in range(256)]
        return memo[context]

    bits, past = 0.0, b"\n\n\n"
    for b in lower(text):
        bits -= math.log2(p(past)[b])
        past = past[1:] + bytes([b])
    return bits


@pytest.mark.parametrize("price", [-1e9, 3.0])
def test_op3_against_brute_force(monkeypatch, price):
    monkeypatch.setattr(language_id, "PRICE", price)
    m = language_id.fit({k: pa.array(v) for k, v in SAMPLES.items()})
    kept = {int(c).to_bytes(k, "big") for k, held in enumerate(m.keys) for c in held}
    asked = ["the cat", "le chat", "γάτα χαλί", "猫和垫子", "zzz \x01 ÿ", "", None, "THE MAT", "кот"]
    got = language_id.code_lengths(m, pa.array(asked, pa.string()))
    for x, language in enumerate(m.languages):
        for y, text in enumerate(asked):
            assert got[y, x] == pytest.approx(brute_code(SAMPLES[language], text, kept), rel=1e-6, abs=1e-6)


def test_op3_codes_are_distributions():
    m = language_id.fit({k: pa.array(v) for k, v in SAMPLES.items()})
    every = pa.array([bytes([97, 98, b]).decode("latin-1") for b in range(128) if not 65 <= b <= 90])
    before = language_id.code_lengths(m, pa.array(["ab"]))[0]
    p = np.exp2(before - language_id.code_lengths(m, every)).sum(0)
    assert (p <= 1 + 1e-4).all() and p[m.languages.index("en")] > 0.8  # bytes of 128 and more have the rest


def test_op3_bounds_keep_the_best_contexts(monkeypatch):
    """Fewer entries keep fewer contexts, never one without its suffix, single bytes always."""
    sample = {k: pa.array(v) for k, v in SAMPLES.items()}
    monkeypatch.setattr(language_id, "PRICE", -1.0)
    sizes = []
    for entries in (1, 1200, 1 << 24):
        monkeypatch.setattr(language_id, "ENTRIES", entries)
        m = language_id.fit(sample)
        held = [set(x.tolist()) for x in m.keys]
        assert all(c % 256 ** (k - 1) in held[k - 1] for k in (2, 3) for c in held[k])
        sizes.append(sum(map(len, held)))
    assert 20 < sizes[0] < sizes[1] < sizes[2]


def test_op3_forty_languages_and_scripts():
    """Languages that share words but for their endings, and four scripts: no switch at any number of them."""
    rng = np.random.default_rng(8)
    stems = ["".join(rng.choice(list("abcdefghilmnoprstu"), 4)) for _ in range(120)]
    scripts = {"ru": "абвгдежзиклмнопрст", "el": "αβγδεζηθικλμνξοπρσ", "zh": "的一是不了在人有我他这个们中来上大", "ka": "აბგდევზთიკლმნოპჟრს"}
    endings = {f"l{k:02d}": ["".join(rng.choice(list("aeioukstz"), 2)) for _ in range(5)] for k in range(40)}

    def text(language):
        if language in scripts:
            return " ".join("".join(rng.choice(list(scripts[language]), 5)) for _ in range(30))
        return " ".join(rng.choice(stems) + rng.choice(endings[language]) for _ in range(30))

    languages = sorted([*endings, *scripts])
    m = language_id.fit({x: pa.array([text(x) for _ in range(30)]) for x in languages})
    assert len(m.keys[3]) > 100
    asked = [x for x in languages for _ in range(5)]
    best = language_id.code_lengths(m, pa.array([text(x) for x in asked])).argmin(1)
    assert np.mean([m.languages[b] == x for b, x in zip(best, asked)]) >= 0.97


def test_op3_held_out_accuracy(spark, sf_dir):
    got = language_id.op3_language_id(spark, sf_dir).where("held_out")
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "lang")
    right = got.join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95


def test_op3_odd_rows(spark):
    out = language_id.identify(documents(spark), F.lit(True))
    rows = {r.doc_id: r for r in out.collect() if r.doc_id is not None and r.doc_id < 12}
    assert out.count() == len(texts())
    assert all(rows[k].lang_pred == "und" and rows[k].score == 0 for k in (1, 2, 3))
    assert all(0 < rows[k].score <= 1 and rows[k].lang_pred in ("en", "fr") for k in (4, 5, 7, 8, 9, 10))
    assert {r.lang_pred for r in language_id.identify(documents(spark), F.lit(False)).collect()} == {"und"}
    assert language_id.identify(empty(spark), F.lit(True)).count() == 0
    again = {}
    for r in out.collect():
        assert again.setdefault(r.doc_id, r) == r or r.doc_id in (None, 11)  # repeated rows; ids 11 and null have two texts


def test_op9_label_model_finds_accuracies():
    rng = np.random.default_rng(2)
    truth = rng.random(3000) < 0.3
    votes = np.full((3000, 5), quality_classifier.NO_VOTE)
    for j, (right, cover) in enumerate(((0.95, 0.9), (0.9, 0.5), (0.8, 0.8), (0.7, 1.0), (0.9, 0.3))):
        cast = rng.random(3000) < cover
        agree = rng.random(3000) < right
        votes[cast, j] = np.where(agree == truth, quality_classifier.BAD, quality_classifier.GOOD)[cast]
    q = quality_classifier.label_model(votes)
    assert ((q > 0.5) == truth).mean() > 0.95
    assert quality_classifier.label_model(np.full((4, 2), quality_classifier.NO_VOTE)).shape == (4,)


def test_op9_label_model_against_brute_force():
    """Expectation and maximisation by loops."""
    rng = np.random.default_rng(6)
    votes = rng.integers(0, 3, (60, 4))
    q = [(2 * sum(v == 1 for v in r) + 0.1) / (2 * sum(v == 1 for v in r) + sum(v == 0 for v in r) + 1) for r in votes]
    for _ in range(50):
        out = []
        odds = {}
        for c in (0, 1):
            w = [x if c else 1 - x for x in q]
            for j in range(4):
                cast = [sum(w[i] for i in range(60) if votes[i][j] == v) + 0.5 for v in (0, 1)]
                odds[c, j] = [x / sum(cast) for x in cast]
            odds[c] = (sum(w) + 1) / 62
        for r in votes:
            p = [odds[c] * math.prod(odds[c, j][v] for j, v in enumerate(r) if v < 2) for c in (0, 1)]
            out.append(p[1] / sum(p))
        q = out
    assert quality_classifier.label_model(votes) == pytest.approx(q, abs=1e-9)


def test_op9_scorer_against_brute_force():
    """A score is the logistic of the summed weights of the places that a text has."""
    text = ["good words here and there", "BAD | | ||| idle idle idle", "more good words"] * 30
    scorer = quality_classifier.fit(pa.array(text), np.array([1.0, 0.0, 1.0] * 30), np.array([0.0, 1.0, 0.0] * 30))
    s = quality_classifier.shapes(pa.array(text[:3]))
    f = quality_classifier.features(pa.array(text[:3]), s)
    got = scorer(pa.array(text[:3]))
    for i in range(3):
        for k in (0, 1):
            z = sum(float(scorer.weights[k][p]) for t, p in zip(f.text, f.place) if t == i) + scorer.intercepts[k]
            assert got[i, k] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6)
    assert got[1].max() > 0.7 and got[0].max() < 0.3


def test_op9_finds_what_reviewers_reject(spark, sf_dir):
    got = quality_classifier.op9_quality_classifier(spark, sf_dir).join(common.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("good"), F.col("toxic").alias("t")), "doc_id")
    keep = got.withColumn("k", F.col("keep").cast("int"))
    assert keep.where("good = 1 and t = 0").agg(F.avg("k")).first()[0] > 0.97
    assert keep.where("good = 0").agg(F.avg("k")).first()[0] < 0.4  # two hundred documents, some eighty labels


def test_op9_odd_rows(spark):
    labels = spark.createDataFrame([(100, 1, 0), (101, 0, 1), (None, 1, 1), (102, None, None), (100, 0, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark)
    out = quality_classifier.classify(docs, labels)
    rows = out.collect()
    assert len(rows) == len(texts()) and set(out.columns) == {*docs.columns, "bad_form", "toxic"}
    assert all(not r.keep and r.bad_form == 1 for r in rows if not (r.text or "").strip())
    same = {}
    for r in rows:
        assert same.setdefault(r.text, (r.bad_form, r.toxic)) == (r.bad_form, r.toxic)
    untrained = quality_classifier.classify(docs, labels.limit(0)).collect()
    assert all(r.keep for r in untrained if (r.text or "").strip())
    assert quality_classifier.classify(empty(spark), labels).count() == 0


def test_op2_rates_meet_reachable_targets(spark):
    classes = spark.createDataFrame([([0.9, 0.1], 600), ([0.2, 0.8], 300), ([0.5, 0.5], 100)], "p array<double>, tokens long")
    history, step = mixing.fit_rates(classes, {"a": 0.4, "b": 0.6}, 1000.0)
    rows = classes.withColumn("r", mixing._rate(F.col("p"), history, step, 0.0)).collect()
    for k, goal in ((0, 400), (1, 600)):
        assert sum(r.r * r.tokens * r.p[k] for r in rows) == pytest.approx(goal, rel=0.02)
    assert all(r.r >= 0 for r in rows)


def test_op2_projection_against_brute_force(spark):
    """A target that only rates below zero would meet: the fit is the best of a fine grid of nonnegative rates."""
    classes = spark.createDataFrame([([0.9, 0.1], 500), ([0.6, 0.4], 500)], "p array<double>, tokens long")
    goal, weight = (50.0, 950.0), (1 / 50, 1 / 950)
    history, step = mixing.fit_rates(classes, {"a": 0.05, "b": 0.95}, 1000.0)
    got = [r.r for r in classes.withColumn("r", mixing._rate(F.col("p"), history, step, 0.0)).collect()]

    def loss(a, b):
        s = (500 * (0.9 * a + 0.6 * b), 500 * (0.1 * a + 0.4 * b))
        return sum((x - g) ** 2 * w for x, g, w in zip(s, goal, weight)) / 1000

    best = min(loss(a / 100, b / 100) for a in range(0, 200) for b in range(0, 300))
    assert min(got) >= 0 and loss(*got) <= best * 1.02 + 1e-6


def test_op2_odd_rows(spark):
    docs, labels = documents(spark), spark.createDataFrame([(100, "q1t0"), (101, "q0t0"), (None, "q1t0"), (102, None), (103, "zz")], "doc_id long, domain string")
    out = mixing.mixing_rates(docs, labels, mixing.TARGETS).collect()
    assert len(out) == len(texts())
    assert all(r.rate >= 0 and r.copies >= 0 and sum(r.posterior) == pytest.approx(1) for r in out)
    assert {r.tokens for r in out if r.doc_id in (1, 2)} == {0}
    mixed = mixing.mix(docs, labels, mixing.TARGETS, 2.0, least=1.0)
    assert mixed.columns == docs.columns and mixed.count() >= len(texts())
    assert mixing.mixing_rates(empty(spark), labels, mixing.TARGETS).count() == 0
    assert mixing.mix(docs, labels.limit(0), mixing.TARGETS).columns == docs.columns


def test_op2_copies_follow_rates(spark, sf_dir):
    r = mixing.op2_mixing(spark, sf_dir).agg(F.sum("rate"), F.sum("copies"), F.max(F.abs(F.col("rate") - F.col("copies"))), F.count("*")).first()
    # each document is rounded by its own chance: the sum is within four standard deviations
    assert abs(r[1] - r[0]) <= 4 * math.sqrt(r[3]) / 2 and r[2] < 1


def test_op2_words_are_words(spark):
    rows = [(1, "a  b"), (2, "   "), (3, "\t x\ny  z "), (4, None), (5, "é ß")]
    got = mixing.mixing_rates(documents(spark, rows), spark.createDataFrame([], "doc_id long, domain string"), mixing.TARGETS)
    assert {r.doc_id: r.tokens for r in got.collect()} == {1: 2, 2: 0, 3: 3, 4: 0, 5: 2}


def test_op2_posteriors_against_brute_force(spark, sf_dir):
    docs, labels = common.table(spark, sf_dir, "documents"), mixing.quality_domains(common.table(spark, sf_dir, "labels"))
    domains = list(mixing.TARGETS)
    rows = {r.doc_id: r for r in mixing.features(docs.select("doc_id", "text")).collect()}
    known = {r.doc_id: r.domain for r in labels.collect() if r.doc_id in rows}
    total = {d: sum(x == d for x in known.values()) for d in domains}
    edges = {f: sorted(set(np.quantile([rows[i][f"__{f}"] for i in known], [k / 8 for k in range(1, 8)]))) for f in mixing.FIGURES}
    at = lambda f, r: int(np.searchsorted(edges[f], r[f"__{f}"] + 1e-12, side="right"))
    bins = {(d, f, at(f, rows[i])): 0 for i, d in known.items() for f in mixing.FIGURES}
    has = {}
    for i, d in known.items():
        for f in mixing.FIGURES:
            bins[d, f, at(f, rows[i])] += 1
        for w in set(rows[i]["__words"]):
            has.setdefault(w, dict.fromkeys(domains, 0))[d] += 1
    n = sum(total.values())

    top = max(domains, key=lambda d: total[d])
    other = {w: sum(c for d, c in x.items() if d != top) for w, x in has.items()}
    telling = sorted((w for w, x in has.items() if sum(x.values()) >= mixing.LEAST and 2 * other[w] >= sum(x.values())), key=lambda w: (-other[w], w))[: mixing.TELLING]
    assert telling
    got = mixing.op2_mixing(spark, sf_dir).collect()
    for r in got[:60]:
        x, logs = rows[r.doc_id], []
        for d in domains:
            log = math.log((total[d] + 1) / (n + 4))
            for f in mixing.FIGURES:
                log += math.log((bins.get((d, f, at(f, x)), 0) + 0.5) / (total[d] + 0.5 * (len(edges[f]) + 1)))
            for w in telling:
                p = (has[w][d] + 0.5) / (total[d] + 1)
                log += math.log(p if w in x["__words"] else 1 - p)
            logs.append(log)
        p = np.exp(np.array(logs) - max(logs))
        p = np.floor(100 * p / p.sum() + 0.5)
        assert r.posterior == pytest.approx(list(p / p.sum()), abs=0.011)


def test_op2_meets_its_targets(spark, sf_dir):
    rows = mixing.op2_mixing(spark, sf_dir).collect()
    tokens = sum(r.tokens for r in rows)
    for k, share in enumerate(mixing.TARGETS.values()):
        assert sum(r.rate * r.tokens * r.posterior[k] for r in rows) / tokens == pytest.approx(share, abs=0.01)


def test_op2_mixes_without_a_join(spark, sf_dir):
    docs, labels = common.table(spark, sf_dir, "documents"), mixing.quality_domains(common.table(spark, sf_dir, "labels"))
    mixed = mixing.mix(docs, labels, mixing.TARGETS)
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and mixed.columns == docs.columns


def brute(rows, k):
    vectors = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, x in vectors:
        if q % 20 == 0:
            scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, y)))), i) for i, y in vectors if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 20])
def test_op10(spark, k, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", 64)
    monkeypatch.setattr(topk_search, "QUERIES_A_BLOCK", 4)
    monkeypatch.setattr(topk_search, "LEAF", 8)
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(size=6).astype(np.float32)]) for k in range(400)]
    rows += [(1000 + k, [0.5] * 6) for k in range(200)]  # a common vector, ties
    rows += [(5000, None), (5001, [1.0, None, 2.0]), (5020, [float("nan")] * 6), (5040, [float("inf")] * 6), (None, [1.0] * 6), (5060, []), (5061, [2.0, -1.0]), (40, [0.25] * 6)]
    df = spark.createDataFrame([(i, v, k, "x") for i, v in rows], "vec_id long, embedding array<double>, cell int, payload string")
    got = sorted(tuple(r) for r in topk_search.top_k(df, F.col("vec_id") % 20 == 0, k).collect())
    assert got == brute(rows, k)


def test_op10_huge_components(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [3e9, 2.0]), (20, [2.0**40, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk_search.top_k(df, F.col("vec_id") % 20 == 0).collect()) == brute(rows, 20)


def test_op10_few_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk_search.top_k(df, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 8192)]
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert topk_search.top_k(df, F.lit(False)).count() == 0


def test_op10_a_cell_of_one_repeated_row(spark, monkeypatch):
    """A cell whose rows all fall into one block that is not its first."""
    monkeypatch.setattr(topk_search, "BLOCK", 16)
    rows = [(i, [0.5 + j]) for i in (3, 20, 40, 60) for j in range(1) for _ in range(40)] + [(1, [9.0]), (2, [-9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk_search.top_k(df, F.col("vec_id") % 20 == 0).collect()) == brute(rows, 20)


def test_cover_tree_covers():
    x = np.random.default_rng(1).normal(size=(1000, 5))
    t = topk_search.cover_tree(x)
    assert sorted(t.points) == list(range(1000))
    for i in range(len(t.radius)):
        own = t.points[t.start[i] : t.end[i]]
        assert (np.sqrt(((x[own] - t.centre[i]) ** 2).sum(1)) <= t.radius[i]).all()
        if t.many[i]:
            of = range(t.first[i], t.first[i] + t.many[i])
            assert sorted(np.concatenate([t.points[t.start[c] : t.end[c]] for c in of])) == sorted(own)
        else:
            assert len(own) <= topk_search.LEAF


def test_cover_tree_centres_are_apart():
    x = np.random.default_rng(2).normal(size=(300, 3))
    chosen, nearest = topk_search.farthest_first(x, 40, within=0.5)
    gap = np.sqrt(((x - x[chosen[nearest]]) ** 2).sum(1)).max()
    apart = np.sqrt(((x[chosen][:, None] - x[chosen][None]) ** 2).sum(2))
    assert apart[~np.eye(len(chosen), dtype=bool)].min() >= gap


def test_op10_prunes_clusters_and_says_how_much(spark, sf_dir):
    rng = np.random.default_rng(5)
    centres = 20 * rng.normal(size=(40, 16))
    rows = [(k, [float(v) for v in centres[k % 40] + 0.2 * rng.normal(size=16)]) for k in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    taken: list[int] = []
    got = sorted(tuple(r) for r in topk_search.top_k(df, F.col("vec_id") % 20 == 0, products_taken=taken).collect())
    assert got == brute(rows, 20)
    assert 0 < taken[0] < 0.25 * 200 * 4000
    # the driver's vectors are spread evenly over a sphere: nothing to prune, and never more products than pairs
    table = common.table(spark, sf_dir, "embeddings")
    n, queries = table.count(), table.where("vec_id % 20 = 0").count()
    taken = []
    topk_search.top_k(table, F.col("vec_id") % 20 == 0, products_taken=taken)
    assert 0 < taken[0] <= n * queries
