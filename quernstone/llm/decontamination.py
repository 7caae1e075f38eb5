"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity. DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words a shingle, least similarity.
WIDTH, SIMILARITY = 5, 0.8
#: Of BLOCKS blocks of a fingerprint one at least differs in a BLOCKS-th of RADIUS bits or fewer, if all differ in RADIUS or fewer.
RADIUS, BLOCKS = 19, 5
#: Benchmark shingles are marked in a bitmap of at most this many longs; index rows are broadcast only up to this number, else shuffled.
BITMAP_LONGS, BROADCAST_ROWS = 1 << 18, 1 << 19
#: Starts of windows that one row holds at most.
STARTS = 2048


def shingles(words: Column, width: int) -> Column:
    """Hashes of all runs of width words of an array."""

    def hashed(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - width)
        every = F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return F.when(F.size(w) >= width, every).otherwise(F.array().cast("array<bigint>"))

    return common.let(words, hashed)


# ---- fingerprints ----------------------------------------------------------------------------------------------------


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long")


def _lanes(most: int) -> int:
    """Bits of a lane that counts up to most, with room for twice that below the sign of the topmost lane."""
    return 16 if most < 1 << 14 else 32


def _spread(lane: int) -> Column:
    return _long(sum(1 << (lane * q) for q in range(64 // lane)))


def _bits_at(h: Column, j: int, lane: int) -> Column:
    return F.shiftrightunsigned(h, j).bitwiseAND(_spread(lane))


def _tally(hashes: Column, lane: int) -> Column:
    """How often each bit is set among hashes: lane longs, each with 64 / lane counts; the first counts bits 0, lane, 2 * lane ..."""
    zero = F.struct(*[F.lit(0).cast("long").alias(f"c{j}") for j in range(lane)])
    return F.aggregate(hashes, zero, lambda t, h: F.struct(*[(t[f"c{j}"] + _bits_at(h, j, lane)).alias(f"c{j}") for j in range(lane)]))


def _half(n: Column, lane: int) -> Column:
    """What lifts just the counts of over half of n to the bit below the lane's topmost."""
    return ((F.lit((1 << (lane - 2)) - 1).cast("long") - F.floor(n / 2)) * _spread(lane)).cast("long")


def _majority(tally: Column, half: Column, lane: int) -> Column:
    """The bits set in over half of the hashes that were counted."""
    ones = [F.shiftrightunsigned(tally[f"c{j}"] + half, lane - 2).bitwiseAND(_spread(lane)) for j in range(lane)]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(one, j) for j, one in enumerate(ones)])


def fingerprint(hashes: Column, most: int = (1 << 30) - 1) -> Column:
    """SimHash of most hashes or fewer: a bit is 1 if it is set in over half of them, repeats included."""
    lane = _lanes(most)
    return common.let(hashes, lambda h: common.let(F.struct(_tally(h, lane).alias("t"), _half(F.size(h), lane).alias("half")), lambda x: _majority(x.t, x.half, lane)))


def slid(hashes: Column, span: Column, most: int) -> Column:
    """Fingerprints of all windows of span hashes, by start. Counts slide: what leaves a window is taken off and what enters it is added. They begin anew
    every so many windows, about the root of a long span, as arrays grow by copying. most: no span is longer."""
    lane = _lanes(most)

    def prepared(x: Column) -> Column:
        return F.struct(x.h.alias("h"), x.span.alias("span"), _half(x.span, lane).alias("half"), F.greatest(F.lit(64), F.ceil(2 * F.sqrt(x.span.cast("double")))).cast("int").alias("step"))

    def windows(x: Column) -> Column:
        def chunk(head: Column) -> Column:
            def one(s: Column, i: Column) -> Column:
                gone, come = F.get(x.h, i - 1), F.get(x.h, i + x.span - 1)
                tally = F.struct(*[(s.t[f"c{j}"] - _bits_at(gone, j, lane) + _bits_at(come, j, lane)).alias(f"c{j}") for j in range(lane)])
                return F.struct(tally.alias("t"), F.concat(s.out, F.array(_majority(s.t, x.half, lane))).alias("out"))

            # the state's counts are those of the window before i: one more step than windows writes the last of them
            start = F.struct(_tally(F.slice(x.h, head + 1, x.span), lane).alias("t"), F.array().cast("array<bigint>").alias("out"))
            last = F.least(head + x.step, F.size(x.h) - x.span + 1)
            return F.aggregate(F.sequence(head + 1, last), start, one, lambda s: s.out)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(x.h) - x.span, x.step), chunk))

    return common.let(common.let(F.struct(hashes.alias("h"), span.alias("span")), prepared), windows)


# ---- the index -------------------------------------------------------------------------------------------------------


def _masks(bits: int, most: int) -> list[int]:
    return [sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(bits), k)]


def _places() -> list[tuple[int, int, int]]:
    """Lowest bit, width and most differing bits of each block: with all of them exceeded, more than RADIUS bits differ."""
    ends = [64 * b // BLOCKS for b in range(BLOCKS + 1)]
    more = (RADIUS + 1) % BLOCKS
    return [(ends[b], ends[b + 1] - ends[b], (RADIUS + 1) // BLOCKS - 1 + (b < more)) for b in range(BLOCKS)]


def _block_key(fp: Column, size: Column, b: int) -> Column:
    low, width, _ = _places()[b]
    value = F.shiftrightunsigned(fp, low).bitwiseAND(_long((1 << width) - 1))
    return (size.cast("long") * 8 + b) * (1 << 16) + value  # blocks are up to eight, of sixteen bits at most


def window_keys(fp: Column, size: Column) -> Column:
    """One key for each block of a window's fingerprint."""
    return F.array(*[_block_key(fp, size, b) for b in range(BLOCKS)])


def index_rows(items: DataFrame) -> DataFrame:
    """(key, item_fp): of each fingerprint of items (fp, m) one row for each value near enough to one of its blocks: a lookup is an equality."""
    rows = []
    for b, (_, width, most) in enumerate(_places()):
        masks = common.literal(_masks(width, most), "array<bigint>")
        rows.append(items.select("fp", F.explode(masks).alias("x"), _block_key(F.col("fp"), F.col("m"), b).alias("k")))
    return reduce(DataFrame.unionByName, rows).select(F.col("k").bitwiseXOR(F.col("x")).alias("key"), F.col("fp").alias("item_fp"))


def _met_first(fp: Column, item_fp: Column, key: Column) -> Column:
    """Whether the block of key is the first of those in which two fingerprints are near enough: so a pair is met once."""
    differ = fp.bitwiseXOR(item_fp)
    near = [F.bit_count(F.shiftrightunsigned(differ, low).bitwiseAND(_long((1 << width) - 1))) <= most for low, width, most in _places()]
    first = reduce(lambda other, b: F.when(near[b], F.lit(b)).otherwise(other), reversed(range(BLOCKS)), F.lit(-1))
    return F.shiftrightunsigned(key, 16).bitwiseAND(F.lit(7).cast("long")) == first


# ---- exact similarity ------------------------------------------------------------------------------------------------


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays as multisets: the sum of the smaller counts over the sum of the larger. Sorted, the two are
    walked together."""

    def walk(x: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            u, v = F.get(x.a, s.i), F.get(x.b, s.j)
            left, right = F.coalesce(u <= v, v.isNull() & u.isNotNull()), F.coalesce(v <= u, u.isNull() & v.isNotNull())
            return F.struct((s.i + left.cast("int")).alias("i"), (s.j + right.cast("int")).alias("j"), (s.both + (left & right).cast("int")).alias("both"))

        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("both"))
        total = F.size(x.a) + F.size(x.b)
        return F.aggregate(F.sequence(F.lit(1), total), start, step, lambda s: s.both.cast("double") / (total - s.both))

    return common.let(F.struct(F.sort_array(a).alias("a"), F.sort_array(b).alias("b")), walk)


# ---- windows ---------------------------------------------------------------------------------------------------------


def _bitmap(items: DataFrame) -> tuple[Column, int]:
    """Marks of the benchmark's shingles by the upper bits of their hash, as an array of longs, and the shift that leaves a hash's place. Its size follows
    the benchmark up to BITMAP_LONGS; beyond that it marks more that is none, which costs time and loses nothing."""
    held = items.select(F.explode("item").alias("h"))
    number = held.count()
    bits = min(BITMAP_LONGS.bit_length() - 1 + 6, max(10, (64 * max(1, number) - 1).bit_length()))
    place = F.shiftrightunsigned("h", 64 - bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    marks = held.groupBy(F.shiftrightunsigned(place, 6).alias("w")).agg(F.bit_or(one).alias("b"))
    words = [0] * (1 << (bits - 6))
    for w, b in marks.collect():  # at most BITMAP_LONGS rows
        words[w] = b
    return common.literal(words, "array<bigint>"), 64 - bits


def _intervals(x: Column, sizes: Column) -> Column:
    """array<struct<m, span, lo, hi>>: for each item size m all starts of windows that hold enough of the rising places x.hits of x.size places, as
    intervals that don't overlap.

    A window of span places that is similar enough shares SIMILARITY / (1 + SIMILARITY) of its and the item's shingles together, so it holds so many
    marked places, in whatever order. need places in a row, the last one less than span after the first, are in the windows
    that start from last - span + 1 to first; both ends rise.
    """
    share = SIMILARITY / (1 + SIMILARITY)

    def of_size(m: Column) -> Column:
        span = F.least(m, x.size)
        given = F.struct(x.hits.alias("hits"), x.size.alias("size"), m.alias("m"), span.alias("span"), F.ceil(share * (m + span) - 1e-9).cast("int").alias("need"))
        return common.let(given, found)

    def found(y: Column) -> Column:
        first = lambda i: F.get(y.hits, i)
        last = lambda i: F.get(y.hits, i + y.need - 1)
        rows = F.filter(F.sequence(F.lit(0), F.size(y.hits) - y.need), lambda i: last(i) - first(i) < y.span)
        low = lambda i: F.greatest(F.lit(0), last(i) - y.span + 1)
        high = lambda i: F.least(first(i), y["size"] - y.span)
        one = lambda z, i, k: F.struct(
            y.m.alias("m"), y.span.alias("span"), F.greatest(low(i), F.when(k > 0, high(F.get(z.rows, k - 1)) + 1).otherwise(0)).alias("lo"), high(i).alias("hi")
        )
        apart = common.let(F.struct(rows.alias("rows")), lambda z: F.transform(z.rows, lambda i, k: one(z, i, k)))
        return F.when(F.size(y.hits) >= y.need, F.filter(apart, lambda r: r.lo <= r.hi)).otherwise(F.array().cast("array<struct<m:int,span:int,lo:int,hi:int>>"))

    return F.flatten(F.transform(sizes, of_size))


def _joined(intervals: Column) -> Column:
    """Intervals that touch as one, in time that grows with their number: only the first and the last of a chain are kept."""

    def chained(x: Column) -> Column:
        same = lambda a, b: F.coalesce((a.m == b.m) & (a.hi + 1 == b.lo), F.lit(False))
        heads = F.filter(x.all, lambda r, k: ~same(F.get(x.all, k - 1), r))
        tails = F.filter(x.all, lambda r, k: ~same(r, F.get(x.all, k + 1)))
        return F.zip_with(heads, tails, lambda a, b: F.struct(a.m.alias("m"), a.span.alias("span"), a.lo.alias("lo"), b.hi.alias("hi")))

    return common.let(F.struct(intervals.alias("all")), chained)


def regions(words: Column, width: int, bitmap: Column, shift: int, sizes: list[int]) -> Column:
    """array<struct<m, span, lo, hashes>>: the windows of a text to fingerprint, for each item size m: those of span hashes that start at the places of
    hashes, the first one at lo of the text. Null for a text without."""
    share = SIMILARITY / (1 + SIMILARITY)
    by_size = common.literal(sizes, "array<int>")

    def marked(h: Column) -> Column:
        place = F.shiftrightunsigned(h, shift)
        word = F.get(bitmap, F.shiftrightunsigned(place, 6).cast("int"))
        return F.bit_get(word, place.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1

    def hit(h: Column) -> Column:
        return F.struct(h.alias("h"), F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: marked(F.get(h, i))).alias("hits"), F.size(h).alias("size"))

    def cut(x: Column) -> Column:
        def pieces(r: Column) -> Column:
            heads = F.sequence(r.lo, r.hi, F.lit(STARTS))
            return F.transform(heads, lambda lo: F.struct(r.m.alias("m"), r.span.alias("span"), lo.alias("lo"), F.slice(x.h, lo + 1, F.least(lo + STARTS - 1, r.hi) - lo + r.span).alias("hashes")))

        found = F.flatten(F.transform(_joined(_intervals(x, by_size)), pieces))
        need = F.ceil(share * (min(sizes) + F.least(F.lit(min(sizes)), x["size"])) - 1e-9)
        return F.when(F.size(x.hits) >= need, F.nullif(found, F.array().cast("array<struct<m:int,span:int,lo:int,hashes:array<bigint>>>")))

    return common.let(shingles(words, width), lambda h: F.when(F.size(h) > 0, common.let(hit(h), cut)))


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, width, m, item, fp) of each distinct item with words."""
    words = common.word_array(common.lower_az(F.col("text").cast("string")))
    items = benchmark.select("item_id", words.alias("words")).where(F.size("words") > 0).distinct().withColumn("width", F.least(F.size("words"), F.lit(WIDTH)))
    hashed = reduce(lambda other, w: F.when(F.col("width") == w, shingles(F.col("words"), w)).otherwise(other), range(1, WIDTH), shingles(F.col("words"), WIDTH))
    items = items.select("item_id", "width", hashed.alias("item")).select("item_id", "width", F.size("item").alias("m"), "item", fingerprint(F.col("item")).alias("fp"))
    return common.materialise(items, "benchmark-items")


def _classes(items: DataFrame) -> list[tuple[int, list[int]]]:
    """Widths of shingles, WIDTH at most, and the item sizes of each: figures of the benchmark's lengths, no texts."""
    return [(w, sorted(m)) for w, m in sorted(map(tuple, items.groupBy("width").agg(F.collect_set("m")).collect()))]


def _keyed(docs: DataFrame) -> tuple[Column, Column]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return F.xxhash64(text), common.word_array(common.lower_az(text))


def _with_regions(docs: DataFrame, items: DataFrame, classes: list[tuple[int, list[int]]]) -> DataFrame:
    """docs __key, a hash of the text, and __r<width>: the regions of each class."""
    key, words = _keyed(docs)
    out = docs.withColumn("__key", key)
    made = []
    for w, sizes in classes:
        bitmap, shift = _bitmap(items.where(F.col("width") == w))
        made.append(regions(words, w, bitmap, shift, sizes).alias(f"__r{w}"))
    return out.select("*", *made)


def _matched(regional: DataFrame, items: DataFrame, width: int, sizes: list[int]) -> DataFrame:
    """(doc_id, key, item_id, start, similarity): the best window of each document and item of one class, from rows (doc_id, __key, __r<width>)."""
    own = items.where(F.col("width") == width).select("item_id", "m", "item", "fp")
    prints = own.select("fp", "m").distinct()  # many items of one fingerprint are one entry
    entries = prints.count() * sum(len(_masks(w, most)) for _, w, most in _places())
    hint = F.broadcast if entries <= BROADCAST_ROWS else lambda x: x

    rows = regional.select("doc_id", F.col("__key").alias("key"), F.explode(f"__r{width}").alias("r")).select("doc_id", "key", "r.*")
    # few bytes but much work: dealt out anew, and partitions by number are not merged
    parts = int(regional.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "key", "m", "lo")
    windows = rows.select("*", F.posexplode(slid(F.col("hashes"), F.col("span"), max(sizes))).alias("at", "wfp"))
    keyed = windows.select("*", F.explode(window_keys(F.col("wfp"), F.col("m"))).alias("wkey"))
    index = index_rows(prints)
    near = keyed.join(hint(index), keyed["wkey"] == index["key"]).where((F.bit_count(F.col("wfp").bitwiseXOR(F.col("item_fp"))) <= RADIUS) & _met_first(F.col("wfp"), F.col("item_fp"), F.col("wkey")))
    near = near.select("doc_id", keyed["key"], "m", "item_fp", (F.col("lo") + F.col("at")).alias("start"), F.slice("hashes", F.col("at") + 1, F.col("span")).alias("window"))
    small = own.count() <= BROADCAST_ROWS >> 6 and max(sizes) <= 1 << 10
    full = own.select("item_id", F.col("m").alias("m_"), F.col("fp").alias("fp_"), "item")
    pairs = near.join(F.broadcast(full) if small else full, (F.col("m") == F.col("m_")) & (F.col("item_fp") == F.col("fp_")))
    scored = pairs.withColumn("similarity", similarity(F.col("window"), F.col("item"))).where(F.col("similarity") >= SIMILARITY - 1e-12)
    best = scored.groupBy("doc_id", "key", "item_id").agg(F.max_by(F.struct("start", "similarity"), F.struct("similarity", -F.col("start"))).alias("x"))
    return best.select("doc_id", "key", "item_id", "x.start", "x.similarity")


def _found(regional: DataFrame, items: DataFrame, classes: list[tuple[int, list[int]]]) -> DataFrame:
    parts = [_matched(regional, items, w, sizes) for w, sizes in classes]
    if not parts:
        kind = items.schema["item_id"].dataType
        return regional.limit(0).select("doc_id", F.col("__key").alias("key"), F.lit(None).cast(kind).alias("item_id"), F.lit(0).alias("start"), F.lit(0.0).alias("similarity"))
    return reduce(DataFrame.unionByName, parts)


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, similarity) of docs (doc_id, text) and benchmark (item_id, text): each document and item of which some window of the document, as
    many words long as the item, has a weighted shingle similarity of SIMILARITY or more with it; start is the word at which the best such window begins, the first of equal ones.

    Words are lower-cased (A-Z); shingles are WIDTH words, or all words of a shorter item. A document shorter than an item is one window. One pass over the documents
    marks the shingles that any item has and keeps, for each item size, the windows with as many marks as that similarity needs; this loses none, and
    no other text leaves the pass. Every such window, in whatever order its words stand, is fingerprinted as it slides, and the multi-index finds all item
    fingerprints of its size within RADIUS bits: of BLOCKS blocks one then differs in few bits, and the index holds all such values, so that a lookup is
    an equality of a block. What it finds is compared exactly. A pair that is similar enough but differs in more bits is not found: at a similarity of 0.8 about ten
    bits of 64 are to be expected, with a standard deviation below three.

    Nulls: a null text has no words and no window; a null item text, or one without words, is no item; a null doc_id or item_id stays null.
    Repeated rows of docs give a row once for each doc_id and text. Empty tables give an empty result. Other columns are ignored. Very long
    texts and items: counts of bits don't overflow, a region is cut into rows of STARTS windows, and all steps but the sliding of a window
    (the root of its length, for windows of thousands of words) are linear.
    """
    items = _items(benchmark)
    classes = _classes(items)
    return _found(_with_regions(docs.select("doc_id", "text"), items, classes).drop("text"), items, classes).select("doc_id", "item_id", "start", "similarity")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, in which contaminations() finds no item. Rows without a marked window are written once and never shuffled."""
    items = _items(benchmark)
    classes = _classes(items)
    staged = common.materialise(_with_regions(docs, items, classes), "decontamination")
    marks = [F.col(f"__r{w}").isNotNull() for w, _ in classes]
    marked = reduce(lambda a, b: a | b, marks, F.lit(False))
    suspects = staged.where(marked)
    bad = _found(suspects, items, classes).select(F.col("doc_id").alias("__d"), F.col("key").alias("__k")).distinct()
    cleared = suspects.join(bad, (F.col("__key") == F.col("__k")) & F.col("doc_id").eqNullSafe(F.col("__d")), "left_anti")
    return staged.where(~marked).select(*docs.columns).union(cleared.select(*docs.columns))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


QUERIES = {"op6_decontamination": op6_decontamination}
SQL: dict[str, str] = {}
