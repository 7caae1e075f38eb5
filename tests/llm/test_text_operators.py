"""op1, op4 and op5 against brute force, and what they do with odd rows."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quernstone.llm import blocks, common, lm_scoring, simhash_dedup, substring_dedup
from quernstone.llm.components import components

from .fixture import documents, empty, texts, words


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    arrays = [np.sort(rng.integers(0, 1 << 63, 1000).astype(np.uint64)), rng.integers(-9, 9, 77), np.empty(0, np.uint64), rng.random(5), np.array([2**64 - 1], np.uint64)]
    for a, b in zip(arrays, common.unpack(common.pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()


def test_words_are_those_of_the_pattern():
    values = [t for _, t in texts()] + ["\x00 a\x85b\x1c", " "]
    for low in (False, True):
        w = common.words_of(pa.array(values, pa.string()), low)
        assert [x.decode() for x in w.words.to_pylist()] == [x for t in values for x in words(t, low)]
        assert w.counts.tolist() == [len(words(t)) for t in values]


@pytest.mark.parametrize("block_bytes", [1 << 10, 8 << 20])
def test_op5(spark, block_bytes, monkeypatch):
    monkeypatch.setattr(blocks.blocks_of, "__defaults__", (block_bytes,))
    rows = texts()
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.dedup_substrings(documents(spark, rows)).collect())
    key = lambda i: math.inf if i is None else i
    least = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            s = tuple(w[k : k + 13])
            least[s] = min(least.get(s, math.inf), key(i))
    want = collections.Counter()
    for i, t in rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < key(i):
                gone.update(range(k, k + 13))
        want[i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    assert got == want


def test_op5_spans_are_maximal_and_empty_input(spark):
    for r in substring_dedup.dedup_substrings(documents(spark)).collect():
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:]))
    assert substring_dedup.dedup_substrings(empty(spark)).count() == 0


def test_op5_contract(spark, sf_dir):
    rows = substring_dedup.op5_substring_dedup(spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in common.table(spark, sf_dir, "documents").collect()}
    assert {r.doc_id for r in rows} == set(docs)
    clean = [r for r in rows if not r.n_removed]
    assert all(r.kept_sha256 == hashlib.sha256(" ".join(words(docs[r.doc_id])).encode()).hexdigest() for r in clean)


@pytest.mark.parametrize("hot", [1 / 512, 1 / 3])
def test_op1(spark, hot, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HOT_SHARE", hot)
    rows = texts()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c, pairs, after = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t in rows:
        if not held(i):
            s = ["<s> ", *words(t, True), "</s> "]
            c.update(s[1:])
            pairs.update(zip(s, s[1:]))
    for (a, _), n in pairs.items():
        after[a] += n
    kinds = collections.Counter(a for a, _ in pairs)
    total, v = sum(c.values()), len(c)
    p1 = lambda w: (c[w] + 0.1) / (total + 0.1 * (v + 1))
    want = collections.defaultdict(list)
    for i, t in rows:
        s = ["<s> ", *words(t, True), "</s> "]
        score = sum(math.log10(max(pairs[a, b] - 0.75, 0) / after[a] + 0.75 * kinds[a] / after[a] * p1(b) if after[a] else p1(b)) for a, b in zip(s, s[1:]))
        want[i].append((held(i), len(s) - 1, sum(c[w] > 0 for w in s[1:]), total, sum(math.log10(p1(w)) for w in s[1:]), score))
    got = collections.defaultdict(list)
    for r in lm_scoring.lm_scores(documents(spark, rows), blocks.held_out("doc_id", 10, 0)).collect():
        got[r.doc_id].append(tuple(r)[1:])
    assert got.keys() == want.keys()
    for i in want:
        for a, b in zip(sorted(got[i]), sorted(want[i]), strict=True):
            assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-9, abs=1e-9)


def test_op1_is_a_distribution():
    """What follows a context sums to one over all training words and one unknown."""
    docs = ["a b a c", "b b", "a"]
    c, pairs, after = collections.Counter(), collections.Counter(), collections.Counter()
    for t in docs:
        s = ["<s>", *t.split(), "</s>"]
        c.update(s[1:])
        pairs.update(zip(s, s[1:]))
        after.update(s[:-1])
    kinds = collections.Counter(a for a, _ in pairs)
    n, v = sum(c.values()), len(c)
    p1 = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))
    for h in after:
        assert sum(max(pairs[h, w] - 0.75, 0) / after[h] + 0.75 * kinds[h] / after[h] * p1(w) for w in [*c, "?"]) == pytest.approx(1)


def test_op1_empty_and_untrained(spark):
    assert lm_scoring.lm_scores(empty(spark), F.lit(False)).count() == 0
    rows = lm_scoring.lm_scores(documents(spark, [(1, "a b"), (2, None)]), F.lit(True)).collect()
    assert {(r.doc_id, r.score, r.train_tokens) for r in rows} == {(1, 0.0, 0), (2, 0.0, 0)}


def test_op1_held_out_texts_gain(spark, sf_dir):
    held = lm_scoring.op1_lm_scoring(spark, sf_dir).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def brute_fingerprint(text):
    w = words(text, True)
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op4(spark):
    rows = texts()
    prints = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    root[a] = min(root[a], root[b])
    least = collections.defaultdict(list)
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r].append(i)
    want = collections.Counter((i, p, min(least[r], default=None)) for (i, _), p, r in zip(rows, prints, root, strict=True))
    got = collections.Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash_dedup.near_duplicates(documents(spark, rows)).collect())
    assert got == want
    assert simhash_dedup.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3, 5, 7])
def test_links_connect_what_is_near(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, radius + 3), replace=False))) for b in base for _ in range(4)]
    cluster = [np.uint64(1 << 60) ^ np.uint64(k) for k in range(64)]  # a dense group
    fps = np.unique(np.array([*base, *near, *cluster], np.uint64))
    label = np.arange(len(fps))
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    for _ in fps:
        label = np.where(close, label[None, :], len(fps)).min(1)
    edges = simhash_dedup.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), radius)
    got = {r.node: r.root for r in components(edges).collect()}
    mine = [got.get(int(x), int(x)) for x in fps.view(np.int64)]
    assert len(set(zip(mine, label.tolist(), strict=True))) == len(set(mine)) == len(set(label.tolist()))


def test_forest_of_a_large_run():
    rng = np.random.default_rng(3)
    run = np.unique(np.concatenate([rng.integers(0, 1 << 31, 4500), np.arange(600)]).astype(np.uint64))
    a, b = simhash_dedup._links(run, np.array([0]), np.array([len(run)]), 3)
    assert (np.bitwise_count(a ^ b) <= 3).all()
    assert len(a) < 8 * len(run)


def test_components_of_a_path_a_star_and_odd_edges(spark):
    path = [(k, k + 1) for k in range(60)]
    star = [(1000, 1000 + k) for k in range(1, 300)]
    df = spark.createDataFrame([*path, *star, (5000, 5000), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{1000 + k: 1000 for k in range(300)}, 5000: 5000}
    assert components(df.limit(0)).count() == 0


@pytest.mark.parametrize("at_once", [100_000, 300])
def test_components_in_one_task_are_those_of_rounds(spark, at_once):
    """A path in mixed order, a star, and random edges; of graphs beyond at_once the rounds are used."""
    rng = np.random.default_rng(8)
    path = rng.permutation(np.arange(10_000, 10_400)).tolist()
    edges = [*zip(path, path[1:]), *((k, -7) for k in range(30)), *rng.integers(20_000, 20_300, (200, 2)).tolist(), (5, 5), (9000, 9000), (None, 3), (4, None)]
    df = spark.createDataFrame([tuple(e) for e in edges], "a long, b long")
    rows = lambda x: sorted((r.node, r.root) for r in x.collect())
    assert rows(components(df, at_once)) == rows(components(df))
    assert components(df.limit(0), at_once).count() == 0


def test_few_links_of_near_copies_take_few_jobs(spark):
    """The driver holds an account of every job and stage: rounds over a small graph filled it on tables of many partitions."""
    texts = documents(spark, [(k, " ".join(f"w{j}" for j in range(200) if j != k)) for k in range(40)])
    spark.sparkContext.setJobGroup("near-copies", "near copies")
    try:
        assert [r.doc_id for r in simhash_dedup.one_of_each(texts).collect()] == [0]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("near-copies")) <= 65


def test_one_of_each_keeps_one_near_copy(spark):
    kept = simhash_dedup.one_of_each(documents(spark))
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert kept.columns == documents(spark).columns
    assert 300 in ids and not {301, 302, 304, 303} & set(ids)
    assert {*range(100, 130), -5, 8, 9, 10} <= set(ids) and ids.count(12) == 1
    assert simhash_dedup.one_of_each(empty(spark)).count() == 0


def test_blocks_of_another_order_fail(spark):
    """Answers to a block that has changed since it asked are not used."""
    docs = documents(spark, [(1, "a b"), (2, "c d")]).coalesce(1).select("doc_id", "text")
    packed = blocks.blocks_of(docs)
    turned = packed.withColumn("payload", F.when(F.rand() < 2, F.col("payload")))
    ok = blocks.exchange(turned, lambda t: iter([(0, b"q")]), lambda q: q, lambda t, a: t.select(["doc_id"]), "doc_id long", 4)
    assert ok.count() == 2

    def other(batches):
        import os

        for b in batches:
            yield b.set_column(1, "payload", pa.array([blocks._freeze([pa.record_batch([pa.array([os.getpid()]), pa.array([os.urandom(4).hex()])], ["doc_id", "text"])]) for _ in range(b.num_rows)]))

    bad = blocks.exchange(packed.mapInArrow(other, "block long, payload binary"), lambda t: iter([(0, b"q")]), lambda q: q, lambda t, a: t.select(["doc_id"]), "doc_id long", 4)
    with pytest.raises(Exception, match="another order"):
        bad.count()


def test_a_pair_belongs_to_the_first_signature_that_it_shares(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    for radius in (2, 3, 4, 7):
        near = base ^ np.array([sum(1 << int(k) for k in rng.choice(64, rng.integers(0, radius + 1), replace=False)) for _ in base], np.uint64)
        rows = spark.createDataFrame([(int(x),) for x in np.concatenate((base, near)).view(np.int64)], "fp long")
        keys = [r.k for r in rows.select(simhash_dedup.variants(F.col("fp"), radius)[0].alias("k")).collect()]
        got = simhash_dedup.first_shared(base ^ near, radius)
        for a, b, place in zip(keys[: len(base)], keys[len(base) :], got, strict=True):
            shared = [k for k in a if k in b]
            assert place == min(k >> 56 & 255 for k in shared) and len({k >> 56 & 255 for k in shared}) == len(shared)


def test_sketches_never_part_similar_texts():
    rng = np.random.default_rng(13)
    texts = []
    for length in (3, 8, 40, 120, 600):
        base = [f"w{rng.integers(900)}" for _ in range(length)]
        for k in range(40):
            w = list(base)
            for at in rng.choice(length, min(length, int(rng.integers(0, 1 + length // 8))), replace=False):
                w[at] = f"x{rng.integers(900)}"
            texts.append(" ".join(w[: length - int(rng.integers(0, 1 + length // 9))]))
    n, low, high = simhash_dedup.sketches(pa.array(texts))
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    assert n.tolist() == list(map(len, sets))
    s = simhash_dedup.Sketches(n.astype(np.int64), low, high, 0.8)
    apart = s.apart(np.arange(len(n))[:, None], np.arange(len(n))[None, :])
    similar = np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    assert not (apart & similar).any()
    assert apart[~similar].mean() > 0.8 and similar.sum() > 500


@pytest.mark.parametrize("first", [8, 2])
def test_similar_links_of_a_group_of_near_copies_are_those_of_brute_force(spark, first, monkeypatch):
    """A link that fails must not cut off fingerprints that other links of a long run connect."""
    monkeypatch.setattr(simhash_dedup, "FIRST", first)
    rng = np.random.default_rng(12)
    rows = []
    for g, length in enumerate((100, 200, 300)):
        base = [f"w{rng.integers(5000)}" for _ in range(length)]
        for k in range(300):
            w = list(base)
            for at in rng.choice(length, rng.integers(1, 1 + length // 18), replace=False):
                w[at] = f"x{rng.integers(5000)}"
            rows.append((1000 * g + k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fp = {r.doc_id: r.fp % (1 << 64) for r in simhash_dedup.fingerprints(docs, 2, False).collect()}
    least = {}
    for i, t in sorted(rows):
        w = t.split()
        least.setdefault(fp[i], (i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)}))
    fps = list(least)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for n, a in enumerate(fps):
        for b in fps[:n]:
            x, y = least[a][1], least[b][1]
            if (a ^ b).bit_count() <= 7 and len(x & y) >= 0.8 * len(x | y):
                root[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for i, _ in rows:
        groups[find(fp[i])].append(i)
    want = {i: min(group) for group in groups.values() for i in group}
    assert len(groups) > 3 and max(map(len, groups.values())) > 8
    got = {r.doc_id: r.component_id for r in simhash_dedup.near_duplicates(docs, 2, 7, False, 0.8).collect()}
    assert got == want


def test_fingerprints_take_few_texts_at_once(monkeypatch):
    sizes, one = [], simhash_dedup.shingle_hashes
    monkeypatch.setattr(simhash_dedup, "shingle_hashes", lambda x, width: sizes.append(x.nbytes) or one(x, width))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(300)), "text": pa.array([f"{k} word " * 1500 for k in range(300)])})
    out = pa.Table.from_batches(simhash_dedup._printed(batch, 2, False, True))
    assert out["doc_id"].to_pylist() == list(range(300)) and len(sizes) > 1 and max(sizes) <= 2 << 20
    whole = simhash_dedup.fingerprint(*simhash_dedup._once(*one(batch.column("text"), 2)))
    assert (out["fp"].to_numpy().view(np.uint64) == whole).all()
