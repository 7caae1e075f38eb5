"""SimHash near-duplicates: deletion-variant signatures, equality join, verification, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from . import common
from .components import AT_ONCE, components

#: Seed of the shingles' XXH64.
SEED = 42
_CHUNK = 1 << 19
#: Bytes of texts that are fingerprinted at once.
_SLICE = 2 << 20
#: Links of a fingerprint in a run that are looked at once the first ones have failed; each further round takes so many times as many.
FIRST = 8


def shingle_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each text's shingles, one text after another, and the number of shingles of each text."""
    import xxhash

    words = common.words_of(texts, lower=True)
    n, total = words.counts, int(words.counts.sum())
    if not total:
        return np.empty(0, np.uint64), np.zeros(len(n), np.int64)
    _, bounds, data = words.words.buffers()
    bounds, data = np.frombuffer(bounds, np.int64)[: total + 1], np.frombuffer(data, np.uint8)[: np.frombuffer(bounds, np.int64)[total]]
    spaced = np.full(len(data) + total, 32, np.uint8)
    spaced[np.arange(len(data)) + np.repeat(np.arange(total), np.diff(bounds))] = data
    starts, ends = bounds[:-1] + np.arange(total), bounds[1:] + np.arange(total)
    per = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    first_word = np.repeat(words.starts, per) + np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    last_word = first_word + np.repeat(np.where(n >= width, width, n), per) - 1
    held, one = spaced.tobytes(), xxhash.xxh64_intdigest
    spans = zip(starts[first_word].tolist(), ends[last_word].tolist(), strict=True)
    return np.fromiter((one(held[a:b], SEED) for a, b in spans), np.uint64, len(first_word)), per


def fingerprint(hashes: np.ndarray, per: np.ndarray) -> np.ndarray:
    """A bit is 1 if it is set in over half of a text's hashes."""
    text = np.repeat(np.arange(len(per)), per)
    ones = np.zeros((len(per), 64), np.int64)
    for at in range(0, len(hashes), _CHUNK):
        h, t = hashes[at : at + _CHUNK], text[at : at + _CHUNK]
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts, _ = common.runs_of(t)
        ones[t[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > per[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)


def _once(hashes: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes without repeats."""
    text = np.repeat(np.arange(len(per)), per)
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    return h[new], np.bincount(t[new], minlength=len(per))


def fingerprints(docs: DataFrame, width: int = 3, repeats: bool = True, sketched: bool = False) -> DataFrame:
    """(doc_id, fp) of every row; fp is the 64-bit fingerprint as a signed long. No words: zero. repeats: whether repeated shingles count again. sketched: also
    n, low and high of Sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _printed(batch, width, repeats, sketched)

    docs = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    common.ship(docs.sparkSession)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long{', n long, low long, high long' if sketched else ''}")


def _printed(batch: pa.RecordBatch, width: int, repeats: bool, sketched: bool) -> Iterator[pa.RecordBatch]:
    """fingerprints() of a batch. A slice's words and hashes take many times its bytes, and each worker needs that much."""
    for part in common.slices(batch, _SLICE):
        hashes = shingle_hashes(part.column("text"), width)
        fp = fingerprint(*(hashes if repeats else _once(*hashes)))
        more = dict(zip(("n", "low", "high"), (pa.array(x.astype(np.int64) if x.dtype != np.uint64 else np.ascontiguousarray(x).view(np.int64)) for x in sketches(part.column("text"))))) if sketched else {}
        yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "fp": pa.array(fp.view(np.int64)), **more})


def variants(fp: Column, radius: int) -> tuple[Column, int]:
    """Signatures of a fingerprint. It is cut into radius // 2 + 1 segments, so that of radius differing bits some segment has one at
    most; each segment gives one signature for each of its bits, that bit masked. A signature holds its segment and bit in its top byte, or is a hash of
    them if a segment leaves no room; what meets by a collision is told apart as links are verified.
    """
    segments = radius // 2 + 1
    width = 64 // segments
    out = []
    for s in range(segments):
        low = s * width
        bits = width if s < segments - 1 else 64 - low
        value = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1))
        for b in range(bits):
            masked = value.bitwiseAND(F.lit(_signed(((1 << bits) - 1) & ~(1 << b))))
            out.append(masked.bitwiseOR(F.lit(_signed((s * width + b) << 56))) if bits <= 56 else F.xxhash64(masked, F.lit(b)))
    return F.array(*out), segments


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= radius


def first_shared(x: np.ndarray, radius: int) -> np.ndarray:
    """Of fingerprints that differ in the bits x, the place among variants() of the first signature that they share; 64 if they share none."""
    segments = radius // 2 + 1
    width, place = 64 // segments, np.full(len(x), 64, np.int64)
    for s in reversed(range(segments)):
        bits = width if s < segments - 1 else 64 - s * width
        part = x >> np.uint64(s * width) & np.uint64((1 << bits) - 1)
        ones = np.bitwise_count(part)
        place = np.where(ones == 0, s * width, np.where(ones == 1, s * width + np.bitwise_count(part - np.uint64(1)).astype(np.int64), place))
    return place


@dataclass
class Sketches:
    """Of each text the number of its different five-word shingles, and of each of 128 classes of them whether their number is odd. A shingle that one of two texts
    has alone changes one class, so these differ in no more classes than there are such shingles: texts that differ in too many are not similar."""

    n: np.ndarray
    low: np.ndarray
    high: np.ndarray
    similarity: float

    def __getitem__(self, at) -> Sketches:
        return Sketches(self.n[at], self.low[at], self.high[at], self.similarity)

    def apart(self, a, b) -> np.ndarray:
        """Whether a pair is less similar for certain. Of texts with x and y shingles and a similarity of s, (x + y)(1 - s) / (1 + s) are one text's alone at most."""
        alone = (self.n[a] + self.n[b]) * (1 - self.similarity) / (1 + self.similarity) + 1e-9
        odd = np.bitwise_count(self.low[a] ^ self.low[b]).astype(np.int64) + np.bitwise_count(self.high[a] ^ self.high[b])
        return (odd > alone) | (np.abs(self.n[a] - self.n[b]) > alone)


def sketches(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n, low and high of Sketches. Fewer words than width are one shingle, as in runs()."""
    words = common.words_of(texts, lower=True)
    codes, vocabulary = words.coded()
    hashes = common.hash_values(vocabulary, SEED)[codes] if len(codes) else np.empty(0, np.uint64)
    n, starts = words.counts, words.starts
    per = np.where(n >= width, n - width + 1, 1)
    first = np.repeat(starts, per) + np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    own, out = np.repeat(np.minimum(n, width), per), np.zeros(len(first), np.uint64)
    for k in range(width):
        held = k < own
        out[held] = common.mix(out[held] * np.uint64(0x9E3779B97F4A7C15) + hashes[first[held] + k] + np.uint64(1))
    h, count = _once(out, per)
    text = np.repeat(np.arange(len(count)), count)
    marks = np.zeros((len(count), 2), np.uint64)
    np.bitwise_xor.at(marks, (text, (h >> np.uint64(6) & np.uint64(1)).astype(np.int64)), np.uint64(1) << (h & np.uint64(63)))
    return count, marks[:, 0], marks[:, 1]


def _forest(fp: np.ndarray, radius: int, sketch: Sketches | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links that span the components of a run: each component takes its closest link outwards until there is none (Boruvka). Also the number of
    links that each member has in all. Memory is one strip of comparisons."""
    n = len(fp)
    label, a, b, degree = np.arange(n), [], [], None
    strip = max(1, (1 << 22) // n)
    while True:
        gap, to, met = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, np.int64)
        for at in range(0, n, strip):
            d = np.bitwise_count(fp[at : at + strip, None] ^ fp[None, :]).astype(np.int64)
            if sketch:
                d[sketch.apart(np.arange(at, min(n, at + strip))[:, None], np.arange(n)[None, :])] = 99
            if degree is None:
                met[at : at + strip] = (d <= radius).sum(1) - 1
            d[label[at : at + strip, None] == label[None, :]] = 99
            to[at : at + strip] = d.argmin(1)
            gap[at : at + strip] = d.min(1)
        degree = met if degree is None else degree
        # the least place breaks ties, so that chosen links make no circle but pairs that choose each other
        order = np.lexsort((np.maximum(np.arange(n), to), np.minimum(np.arange(n), to), gap, label))
        first = order[common.runs_of(label[order])[0]]
        first = first[gap[first] <= radius]
        if not len(first):
            break
        a.append(first)
        b.append(to[first])
        for x, y in zip(first.tolist(), to[first].tolist(), strict=True):
            label[label == max(label[x], label[y])] = min(label[x], label[y])
    none = np.empty(0, np.int64)
    return np.concatenate(a) if a else none, np.concatenate(b) if b else none, degree


def _between(fp: np.ndarray, root: np.ndarray, radius: int, most: int, sketch: Sketches | None = None, place: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each member of a run the closest links, most of them, to members with another root; and the members with links that this leaves out. place: of the
    run's signature, if known; pairs that share an earlier one are left to its run, so that no pair is given under all the signatures it shares."""
    n = len(fp)
    strip = max(1, (1 << 20) // n)
    a, b, more = [], [], []
    for at in range(0, n, strip):
        d = np.bitwise_count(fp[at : at + strip, None] ^ fp[None, :])
        x, y = np.nonzero((d <= radius) & (root[at : at + strip, None] != root[None, :]))
        if place is not None:
            own = first_shared(fp[at + x] ^ fp[y], radius) == place
            x, y = x[own], y[own]
        if sketch:
            able = ~sketch.apart(at + x, y)
            x, y = x[able], y[able]
        order = np.lexsort((d[x, y], x))
        x, y = x[order], y[order]
        starts, lengths = common.runs_of(x)
        rank = np.arange(len(x)) - np.repeat(starts, lengths)
        a.append(at + x[rank < most])
        b.append(y[rank < most])
        more.append(at + np.unique(x[rank >= most]))
    return np.concatenate(a), np.concatenate(b), np.concatenate(more)


def _parts(run: np.ndarray, radius: int) -> list[np.ndarray]:
    """Places of a run that are compared with each other; all pairs within the radius meet in one at least."""
    if len(run) <= 4096 or radius >= 8:
        return [np.arange(len(run))]
    octets = run.view(np.uint8).reshape(-1, 8)  # some byte of eight is then the same
    return [p for k in range(8) for o in [np.argsort(octets[:, k], kind="stable")] for p in np.split(o, np.flatnonzero(np.diff(octets[o, k])) + 1) if len(p) > 1]


def _links(fp: np.ndarray, starts: np.ndarray, lengths: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of each run: all of a short run's, a spanning forest of a long one's."""
    return _links_and_rest(fp, starts, lengths, radius)[:2]


def _links_and_rest(fp: np.ndarray, starts: np.ndarray, lengths: np.ndarray, radius: int, sketch: Sketches | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_links() and the numbers of those runs that have more links than these."""
    a, b, rest = [fp[:0]], [fp[:0]], [np.empty(0, np.int64)]
    short = lengths <= 8
    s, n = starts[short], lengths[short]
    for gap in range(1, int(n.max()) if len(n) else 0):
        for k in range(int(n.max()) - gap):
            has = n > k + gap
            x, y = fp[s[has] + k], fp[s[has] + k + gap]
            ok = _near(x, y, radius)
            if sketch:
                ok &= ~sketch.apart(s[has] + k, s[has] + k + gap)
            a.append(x[ok])
            b.append(y[ok])
    for number, start, length in zip(np.flatnonzero(~short), starts[~short], lengths[~short], strict=True):
        run = fp[start : start + length]
        left = False
        for p in _parts(run, radius):
            x, y, degree = _forest(run[p], radius, sketch[start + p] if sketch else None)
            a.append(run[p][x])
            b.append(run[p][y])
            left |= bool(degree.sum() > 2 * len(x))
        if left:
            rest.append(np.array([number]))
    return np.concatenate(a), np.concatenate(b), np.concatenate(rest)


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (a, b) that connect just those of the distinct fingerprints fp which chains of links connect.

    Rows with one signature lie together and are compared there; of a long run only a spanning forest leaves the task. Rows of a signature
    are distinct fingerprints, at most N / 2^31 of N random ones for radius 3.
    """
    return _compared(_signed_rows(distinct, radius), radius, rest=False).select("a", "b")


def _signed_rows(distinct: DataFrame, radius: int) -> DataFrame:
    keys, _ = variants(F.col("fp"), radius)
    return distinct.select("*", F.explode(keys).alias("key"))


def _compared(rows: DataFrame, radius: int, most: int = 0, rest: bool = True, similarity: float | None = None) -> DataFrame:
    """(a, b, more) from rows (key, fp), each key's rows compared with each other; with similarity, rows also have n, low and high, and pairs that
    their Sketches tell apart are no links. more is false: a link (a, b), as links() gives them; with rows (key, fp, root)
    and most, the closest links, most of them, of each row to rows with another root. more is true, only if rest: the run of key a has links that are not
    among those given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "fp", "root" if most else "key", *(("n", "low", "high") if similarity is not None else ())]
        held = [np.empty(0, np.int64) for _ in names]
        for batch in batches:
            held = [np.concatenate((x, batch.column(name).to_numpy(zero_copy_only=False))) for x, name in zip(held, names, strict=True)]
            last = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0  # the last run may go on
            if last:
                yield from linked(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        yield from linked(*held)

    def linked(key: np.ndarray, fp: np.ndarray, root: np.ndarray, *more_of: np.ndarray) -> Iterator[pa.RecordBatch]:
        fp = fp.view(np.uint64)
        sketch = Sketches(more_of[0], more_of[1].view(np.uint64), more_of[2].view(np.uint64), similarity) if more_of else None
        starts, lengths = common.runs_of(key)
        several = lengths > 1
        starts, lengths = starts[several], lengths[several]
        if not most:
            a, b, more = _links_and_rest(fp, starts, lengths, radius, sketch)
            yield from batch_of(a, b, key[starts[more]])
            return
        for start, length in zip(starts, lengths, strict=True):
            of_run, left, links = fp[start : start + length], False, []
            place = int(key[start]) >> 56 & 255 if radius >= 2 else None  # with one segment a signature is a hash
            for p in _parts(of_run, radius):
                mine = sketch[start + p] if sketch else None
                a, b, more = _between(of_run[p], root[start + p], radius, most, mine, place)
                left |= len(more) > 0
                links.append((of_run[p][a], of_run[p][b]))
            if links:
                yield from batch_of(*(np.concatenate(x) for x in zip(*links, strict=True)), key[start : start + left])

    def batch_of(a: np.ndarray, b: np.ndarray, more: np.ndarray) -> Iterator[pa.RecordBatch]:
        pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1).view(np.int64)
        more = more if rest else more[:0]
        if pairs.shape[1] + len(more):
            left, right = np.concatenate((pairs[0], more)), np.concatenate((pairs[1], more))
            yield pa.RecordBatch.from_pydict({"a": pa.array(left), "b": pa.array(right), "more": pa.array(np.arange(len(left)) >= pairs.shape[1])})

    common.ship(rows.sparkSession)
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, more boolean")


def similar_links(docs: DataFrame, nodes: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Edges (a, b) that connect just those fingerprints of nodes (fp, least) which chains of links connect that verified() holds for.

    First the links of links() are looked at. Where long runs have more, the closest of those that join two components of what was found are looked at,
    FIRST of each fingerprint and run, then FIRST times as many, until no link that joins two components is left. So a group whose links hold
    takes about as many looks as it has members; only links that fail make it look at more, at all of them if need be.
    """
    kept = nodes.where(F.col("least").isNotNull()).select("fp", "n", "low", "high")
    found = common.materialise(_compared(_signed_rows(kept, radius), radius, similarity=similarity), "candidate-links")
    good = tried = None
    most = FIRST
    while True:
        fresh = found.where(~F.col("more")).select("a", "b").distinct()
        fresh = common.materialise(fresh if tried is None else fresh.join(tried, ["a", "b"], "left_anti"), "fresh-links")
        common.let_go(docs.sparkSession)
        held = common.materialise(verified(fresh, docs, nodes, similarity), "similar-links")
        good, tried = (held, fresh) if good is None else (good.union(held), tried.union(fresh))
        rest = common.materialise(found.where("more").select(F.col("a").alias("key")).distinct(), "long-runs")  # of known size, as in verified()
        if rest.isEmpty():
            return good
        roots = components(good, AT_ONCE).select(F.col("node").alias("fp"), "root")
        common.let_go(docs.sparkSession)
        rooted = kept.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "n", "low", "high")
        rooted = _signed_rows(rooted, radius).join(rest, "key", "left_semi")
        found = common.materialise(_compared(rooted, radius, most, similarity=similarity), "candidate-links")
        most *= FIRST


def verified(edges: DataFrame, docs: DataFrame, nodes: DataFrame, similarity: float, width: int = 5) -> DataFrame:
    """Those edges of which the texts of the least doc_ids have that Jaccard similarity of their sets of width-word shingles, or a larger one."""
    ends = edges.select(F.col("a").alias("fp")).union(edges.select("b")).distinct()
    wanted = common.materialise(nodes.join(ends, "fp").select("fp", F.col("least").alias("doc_id")), "wanted")  # of known size: few are broadcast, and no text is shuffled
    words = common.word_array(common.lower_az(F.col("text").cast("string")))
    sets = docs.select("doc_id", "text").join(wanted, "doc_id").select("fp", F.array_distinct(runs(words, width)).alias("s"))
    sets = common.materialise(sets, "shingle-sets")
    both = edges.join(sets.select(F.col("fp").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("s").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b").distinct()


def runs(words: Column, width: int) -> Column:
    """Hashes of all runs of width words of an array; fewer words: of them all."""

    def hashed(w: Column) -> Column:
        n = F.greatest(F.lit(1), F.size(w) - (width - 1))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))

    return common.let(words, hashed)


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, repeats: bool = True, similarity: float | None = None) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, fp (signed long), component_id, the smallest doc_id that links lead to.

    Words are lower-cased (A-Z); shingles are width words joined by a space, repeats included unless repeats is false; fewer words give the
    whole sequence as one shingle, none the fingerprint zero, which is linked like any other. Two rows are linked if their fingerprints differ in radius
    bits or fewer. similarity: if given, different fingerprints are linked only if the texts' sets of five-word shingles are also so similar
    (Jaccard); every such pair is in one component, however long the runs of equal signatures are.

    Nulls: a null text has no words; a null doc_id is never a component_id unless a component holds nothing else, which gives null. Ties and
    repeated rows share a fingerprint and a component. An empty table gives an empty result. Other columns of docs are ignored.
    Equal fingerprints are one node, so groups of copies cost nothing; no pairs of documents are formed. A signature has 64 / (radius // 2 + 1) - 1
    bits: with radius 3 these tell billions of texts apart, with radius 7 thousands, so that the comparisons of a large corpus grow with its square.
    """
    sketched = similarity is not None
    prints = common.materialise(fingerprints(docs, width, repeats, sketched), "fingerprints")
    least = F.min("doc_id").alias("least")
    own = [F.min_by(F.struct("n", "low", "high"), F.col("doc_id")).alias("__s")] if sketched else []
    nodes = prints.groupBy("fp").agg(least, *own)
    nodes = common.materialise(nodes.select("fp", "least", "__s.*") if sketched else nodes, "nodes")
    edges = links(nodes.select("fp"), radius) if similarity is None else similar_links(docs, nodes, radius, similarity)
    found = components(edges, AT_ONCE if sketched else 0).select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, without near-duplicates: of each component of near_duplicates() the row with the smallest doc_id stays, and of
    equal doc_ids the one whose text, then whose hash of all columns that can be hashed, is smallest. Components are found with two-word shingles without repeats, seven bits, and that similarity of five-word shingles:
    few edits change few words and so few bits of such fingerprints. Rows with a null doc_id can't be told apart and all stay.
    """
    found = near_duplicates(docs, 2, 7, False, similarity)
    stay = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    first = F.struct(F.col("text"), F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (MapType, VariantType))]))
    known = docs.join(stay, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), first).alias("__row"))
    return known.select("__row.*").union(docs.where(F.col("doc_id").isNull()))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    out = near_duplicates(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash_dedup": op4_simhash_dedup}
SQL: dict[str, str] = {}
