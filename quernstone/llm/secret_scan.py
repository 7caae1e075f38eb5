"""Secret scan: patterns, and a battery of randomness tests under false-discovery control. DataFrame functions only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Patterns of the base kinds in the order in which they are listed (fixed values), and the least length of what they find.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the longest match of AKIA[A-Z0-9]+ has 20 characters or more just where this matches
HEX = r"[0-9a-f]{24,}"  # likewise, as a match takes a whole run
ASSIGN_LEAST = 6
#: What the battery looks at, and the bands of lengths that are controlled apart.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
BANDS = (20, 28, 40, 64, 128)
#: Share of ordinary strings among those reported that false-discovery control aims at; ordinary strings that are made at least (one a document, or
#: more of each in a small corpus), and the least of a cell that a tail is fitted to; steps of the battery's figure, and how many.
RATE, ORDINARY, FEW, STEP, STEPS = 0.01, 20000, 30, 0.1, 512

#: Encodings by the first pattern that fits (fixed values): name, pattern, alphabet in the order of its values.
_DIGITS, _UPPER, _LOWER = "0123456789", common.UPPER_AZ, common.LOWER_AZ
ENCODINGS = (
    ("hex", r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("HEX", r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("lower", r"^[a-z]+$", _LOWER),
    ("upper", r"^[A-Z]+$", _UPPER),
    ("base32", r"^[A-Z2-7]+=*$", _UPPER + "234567"),
    ("letters", r"^[A-Za-z]+$", _UPPER + _LOWER),
    ("base36", r"^[a-z0-9]+$", _DIGITS + _LOWER),
    ("base62", r"^[A-Za-z0-9]+$", _DIGITS + _UPPER + _LOWER),
    ("base64", r"^[A-Za-z0-9+/]+=*$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", r"^[A-Za-z0-9_-]+=*$", _UPPER + _LOWER + _DIGITS + "-_"),
)
#: Words of an ordinary string, and those that fill up a text of fewer than LEAST_WORDS (fixed values).
WORD, LEAST_WORDS = r"\b[A-Za-z]{2,15}\b", 12
FILLERS = "the quick order status user name report value index first number last update create remove config server client request response message account total count list item page line test data".split()


def _matches(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def spans(text: Column, pattern: str, least: int = 0, group: int = 0) -> Column:
    """array<struct<s, e, v>> of the leftmost non-overlapping matches, in code points, end exclusive; those whose group is shorter than least
    are left out. Places are running sums of the lengths of the matches and of the pieces between them."""
    empty = F.array().cast("array<struct<s:int,e:int,v:string>>")

    def placed(x: Column) -> Column:
        lengths = F.transform(x.found, lambda v, i: F.length(F.get(x.pieces, i)) + F.length(v))
        return F.struct(x.pieces.alias("pieces"), x.found.alias("found"), x.kept.alias("kept"), common.running(lengths).alias("before"))

    def listed(x: Column) -> Column:
        start = lambda i: (F.get(x.before, i) + F.length(F.get(x.pieces, i))).cast("int")
        every = F.transform(x.found, lambda v, i: F.struct(start(i).alias("s"), (start(i) + F.length(v)).alias("e"), v.alias("v")))
        return F.filter(every, lambda r, i: F.length(F.get(x.kept, i)) >= least)

    parts = F.struct(F.split(text, pattern, -1).alias("pieces"), _matches(text, pattern, 0).alias("found"), _matches(text, pattern, group).alias("kept"))
    return F.when(text.rlike(pattern), common.let(common.let(parts, placed), listed)).otherwise(empty)


# ---- the battery -----------------------------------------------------------------------------------------------------


def _upper_tail(z: Column) -> Column:
    """P(Z >= z) of a standard normal, to seven digits (Abramowitz and Stegun 26.2.17)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _chi_tail(chi: Column, free: Column) -> Column:
    """Upper tail of chi-squared (Wilson and Hilferty's normal form)."""
    return _upper_tail((F.pow(chi / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free)))


def _groups(alphabet: str) -> str:
    """Of each symbol its group: digits, marks, vowels, consonants, and capitals where small letters are there too."""
    small = any(c.islower() for c in alphabet)
    return "".join("0" if c.isdigit() else "1" if not c.isalpha() else "4" if small and c.isupper() else "2" if c.lower() in "aeiou" else "3" for c in alphabet)


def _shape(alphabet: str) -> Column:
    """What the tests need of an alphabet: itself, its groups and their shares, and of two and of three neighbouring draws the chance that groups change."""
    groups = _groups(alphabet)
    shares = {g: groups.count(g) / len(groups) for g in sorted(set(groups))}
    change = 1 - sum(q * q for q in shares.values())
    twice = sum(q * (1 - q) ** 2 for q in shares.values())
    listed = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(q).alias("q")) for g, q in shares.items()])
    return F.struct(F.lit(alphabet).alias("alphabet"), F.lit(groups).alias("groups"), listed.alias("shares"), F.lit(change).alias("change"), F.lit(twice - change * change).alias("tied"))


def battery(value: Column, encoding: Column) -> Column:
    """struct<symbols, parts, runs, serial>: p-values of value's symbols under uniform independent draws from the alphabet of an encoding.

    Chi-squared of the symbols' counts and of those of groups of symbols, as a short string has few of each symbol but enough of each group; runs of
    symbols of one group; serial correlation of neighbouring values. The last two are two-sided. They measure how far a string is from random; how far
    ordinary strings are is learned, see ordinary_strings(), so that no approximation for short strings decides anything.
    """

    def read(x: Column) -> Column:
        symbols = F.transform(F.sequence(F.lit(1), F.length(x.body)), lambda i: F.substring(x.body, i, F.lit(1)))
        values = F.transform(symbols, lambda c: F.call_function("locate", c, x.shape.alphabet).cast("double") - 1)
        return F.struct(x.body.alias("body"), x["shape"].alias("shape"), F.length(x.body).cast("double").alias("n"), F.length(x.shape.alphabet).cast("double").alias("k"), symbols.alias("symbols"), values.alias("values"))

    def total(x: Column) -> Column:
        mean = F.aggregate(x["values"], F.lit(0.0), lambda s, v: s + v) / x.n
        group = F.transform(x["values"], lambda v: F.substring(x.shape.groups, (v + 1).cast("int"), F.lit(1)))
        return F.struct(*(x[c].alias(c) for c in ("body", "shape", "n", "k", "symbols", "values")), mean.alias("mean"), group.alias("group"))

    def test(x: Column) -> Column:
        n, k, mean, shape = x.n, x.k, x["mean"], x["shape"]
        squares = F.aggregate(F.array_distinct(x.symbols), F.lit(0.0), lambda s, c: s + F.pow(n - F.length(F.replace(x.body, c, F.lit(""))), F.lit(2.0)))
        symbols = _chi_tail(k / n * squares - n, k - 1)
        apart = lambda y: F.pow(F.size(F.filter(x.group, lambda g: g == y.g)) - n * y.q, F.lit(2.0)) / (n * y.q)
        parts = _chi_tail(F.aggregate(shape.shares, F.lit(0.0), lambda s, y: s + apart(y)), F.size(shape.shares) - 1.0)
        changes = F.transform(x.group, lambda g, i: F.when(i > 0, (g != F.get(x.group, i - 1)).cast("int")).otherwise(0))
        turns = F.aggregate(changes, F.lit(0), lambda s, v: s + v)
        spread = (n - 1) * shape.change * (1 - shape.change) + 2 * (n - 2) * shape.tied
        runs = 2 * _upper_tail(F.abs(turns - (n - 1) * shape.change) / F.sqrt(spread))
        power = F.aggregate(x["values"], F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean))
        crossed = F.transform(x["values"], lambda v, i: F.when(i > 0, (v - mean) * (F.get(x["values"], i - 1) - mean)).otherwise(0.0))
        cross = F.aggregate(crossed, F.lit(0.0), lambda s, v: s + v)
        serial = F.when(power > 0, 2 * _upper_tail(F.abs(cross / power + 1 / n) * F.sqrt(n))).otherwise(F.lit(0.0))
        return F.struct(symbols.alias("symbols"), parts.alias("parts"), runs.alias("runs"), serial.alias("serial"))

    shape = F.get(F.array(*[_shape(x[2]) for x in ENCODINGS]), encoding)
    given = F.struct(F.regexp_replace(value, "=+$", "").alias("body"), shape.alias("shape"))
    return common.let(common.let(common.let(given, read), total), test)


def level(value: Column, encoding: Column) -> Column:
    """The battery's tests combined as Fisher does, the root of minus the sum of their logarithms, in steps: small for random strings."""
    log = lambda p: -F.log(F.least(F.lit(1.0), F.greatest(p, F.lit(1e-200))))
    figure = common.let(battery(value, encoding), lambda x: F.sqrt(log(x.symbols) + log(x.parts) + log(x.runs) + log(x.serial)))
    return F.least(F.lit(STEPS - 1), F.floor(figure / STEP)).cast("int")


def _encoding(value: Column) -> Column:
    """The number of the first encoding that fits; digits alone are a number and have none."""
    fits = reduce(lambda found, x: F.when(value.rlike(x[1][1]), F.lit(x[0])).otherwise(found), reversed(list(enumerate(ENCODINGS))), F.lit(None).cast("int"))
    return F.when(value.rlike("[A-Za-z]"), fits)


def _band(length: Column) -> Column:
    return reduce(lambda n, least: n + (length >= least).cast("int"), BANDS[1:], F.lit(0))


def candidates(text: Column) -> Column:
    """array<struct<s, e, cell, level>> of long unbroken strings in an encoding; cell: encoding and band of lengths."""
    coded = F.transform(spans(text, CANDIDATE), lambda c: F.struct(c.s.alias("s"), c.e.alias("e"), c.v.alias("v"), _encoding(c.v).alias("a")))
    coded = F.filter(coded, lambda c: c.a.isNotNull())
    cell = lambda c: c.a * len(BANDS) + _band(F.length(F.regexp_replace(c.v, "=+$", "")))
    return F.transform(coded, lambda c: F.struct(c.s.alias("s"), c.e.alias("e"), cell(c).alias("cell"), level(c.v, c.a).alias("level")))


# ---- ordinary strings ------------------------------------------------------------------------------------------------


def _unit(seed: Column, salt: int, n: Column | int) -> Column:
    """A whole number below n that hangs on seed."""
    return F.pmod(F.xxhash64(seed, F.lit(salt)), F.lit(n) if isinstance(n, int) else n).cast("int")


def ordinary_strings(text: Column, number: int) -> Column:
    """array<struct<a, v>>: number strings such as people write without a secret: words of the text that stand together, in the style that an
    encoding a allows (lower or upper case, capitalised, with / or + or - or _ between them, with a number at the end), cut to a length of some band. For hex
    the letters beyond f become the digit of the word's length. Which words, style and length hangs on the text by hashes."""
    words = _matches(text, WORD, 0)
    words = common.let(words, lambda w: F.when(F.size(w) >= LEAST_WORDS, w).otherwise(F.concat(w, F.array(*map(F.lit, FILLERS)))))
    ends = [*BANDS[1:], 2 * BANDS[-1]]

    def chosen(x: Column) -> Column:
        def one(seed: Column) -> Column:
            band = _unit(seed, 1, len(BANDS))
            least = F.get(F.array(*map(F.lit, BANDS)), band)
            length = least + _unit(seed, 2, F.get(F.array(*[F.lit(e - b) for b, e in zip(BANDS, ends, strict=True)]), band))
            return F.struct(seed.alias("seed"), _unit(seed, 3, len(ENCODINGS)).alias("a"), length.alias("n"), _unit(seed, 4, F.size(x.words)).alias("at"))

        def built(y: Column) -> Column:
            picked = F.transform(F.sequence(F.lit(0), F.ceil(y.n / 2).cast("int")), lambda i: F.get(x.words, F.pmod(y.at + i, F.size(x.words))))
            camel = F.transform(picked, lambda w: F.initcap(w))
            some = _unit(y.seed, 5, 2)
            cased = F.when(some == 0, F.array_join(picked, "\x00")).otherwise(F.array_join(camel, "\x00"))
            hexed = F.array_join(F.transform(picked, lambda w: F.regexp_replace(F.lower(w), F.lit("[^a-f]"), (F.length(w) % 10).cast("string"))), "")
            tail = F.substring(_unit(y.seed, 6, 10000).cast("string"), F.lit(1), 1 + _unit(y.seed, 7, 4))
            none = F.lit("")
            by = {
                "hex": (hexed, none),
                "HEX": (F.upper(hexed), none),
                "lower": (F.lower(F.array_join(picked, "")), none),
                "upper": (F.upper(F.array_join(picked, "")), none),
                "base32": (F.upper(F.array_join(picked, "")), F.translate(tail, "0189", "2345")),
                "letters": (F.array_join(camel, ""), none),
                "base36": (F.lower(F.array_join(picked, "")), tail),
                "base62": (F.array_join(camel, ""), tail),
                "base64": (F.replace(cased, F.lit("\x00"), F.when(_unit(y.seed, 8, 4) == 0, "+").otherwise("/")), F.when(some == 0, tail).otherwise("")),
                "base64url": (F.replace(cased, F.lit("\x00"), F.when(_unit(y.seed, 8, 2) == 0, "-").otherwise("_")), F.when(some == 0, tail).otherwise("")),
            }
            cut = lambda v, end: F.concat(F.substring(v, F.lit(1), y.n - F.length(end)), end)
            value = reduce(lambda other, k: F.when(y.a == k, cut(*by[ENCODINGS[k][0]])).otherwise(other), range(len(ENCODINGS)), F.lit(None).cast("string"))
            return F.struct(y.a.alias("a"), value.alias("v"))

        seeds = F.transform(F.sequence(F.lit(1), F.lit(number)), lambda i: F.xxhash64(x.text, i))
        return F.transform(seeds, lambda seed: common.let(one(seed), built))

    return common.let(F.struct(words.alias("words"), text.alias("text")), chosen)


def _ordinary_levels(text: Column, number: int) -> Column:
    cell = lambda x: x.a * len(BANDS) + _band(F.length(x.v))
    return F.transform(ordinary_strings(text, number), lambda x: F.struct(cell(x).alias("cell"), level(x.v, x.a).alias("level")))


def _tails(ordinary: dict[int, dict[int, int]]) -> dict[int, list[float]]:
    """For each cell the p-value of each level: the share of ordinary strings that look as random or more so. Below the least of them a normal
    tail goes on, if that is smaller. A cell of FEW ordinary strings or less takes those of its encoding's other bands too."""
    out = {}
    for cell in range(len(ENCODINGS) * len(BANDS)):
        own = ordinary.get(cell, {})
        if sum(own.values()) <= FEW:
            own = {}
            for c in range(cell // len(BANDS) * len(BANDS), (cell // len(BANDS) + 1) * len(BANDS)):
                for at, n in ordinary.get(c, {}).items():
                    own[at] = own.get(at, 0) + n
        total = sum(own.values())
        if total <= FEW:
            out[cell] = [1.0] * STEPS
            continue
        mean = sum((at + 0.5) * n for at, n in own.items()) / total
        spread = max(1.0, math.sqrt(sum((at + 0.5 - mean) ** 2 * n for at, n in own.items()) / total))
        seen, p = 0, []
        for at in range(STEPS):
            seen += own.get(at, 0)
            beyond = min(1 / (total + 1), 0.5 * math.erfc((mean - at - 1) / spread / math.sqrt(2)))
            p.append((seen + 1) / (total + 1) if seen else beyond)
        out[cell] = p
    return out


def random_below(ordinary: dict[int, dict[int, int]], tested: dict[int, dict[int, int]]) -> list[int]:
    """For each cell the level below which a string is called random: Benjamini and Hochberg's rule over the p-values of all strings of a band of
    lengths, whatever their encoding, under the hypothesis that a string is ordinary. ordinary, tested: counts by cell and level."""
    p = _tails(ordinary)
    out = [0] * (len(ENCODINGS) * len(BANDS))
    for band in range(len(BANDS)):
        cells = range(band, len(out), len(BANDS))
        found = sorted((p[c][at], n) for c in cells for at, n in tested.get(c, {}).items())
        total, seen, limit = sum(n for _, n in found), 0, -1.0
        for value, n in found:
            seen += n
            if value <= RATE * seen / total:
                limit = value
        for c in cells:
            out[c] = sum(value <= limit for value in p[c])  # p rises with the level
    return out


def _touches(found: Column, c: Column) -> Column:
    """Whether one of found, spans apart and in order, overlaps c: the last that begins before c ends is looked up by halving."""
    halved = lambda s, _: F.when(
        s.lo < s.hi, common.let(F.floor((s.lo + s.hi) / 2).cast("int"), lambda m: F.when(F.get(found, m).s < c.e, F.struct((m + 1).alias("lo"), s.hi.alias("hi"))).otherwise(F.struct(s.lo.alias("lo"), m.alias("hi"))))
    ).otherwise(s)
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(found) + 1.0)).cast("int"))
    before = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(found).alias("hi")), halved, lambda s: s.lo)
    return F.when(F.size(found) > 0, F.coalesce(F.get(found, before - 1).e > c.s, F.lit(False))).otherwise(False)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, assign, access, hex, random: arrays of struct<s, e> in code points, end exclusive.

    assign, access and hex are the matches of the patterns above. random holds long strings in an encoding that look more random than ordinary strings do: the
    hypothesis tested is that a string is ordinary, and Benjamini and Hochberg's rule, within each band of lengths, keeps the expected share of ordinary
    strings among those reported at RATE. What ordinary strings score in the battery is counted on strings made from the words of every document of docs. Strings that
    overlap a match of a pattern are neither tested nor reported.

    Nulls: a null text is empty; a null doc_id stays null. Repeated rows get equal results, and count as often as they are there. An empty table gives an
    empty result. Very long texts: time grows with the number of matches times its root at most (copies of references). Digits alone are no candidate. Other columns
    of docs are ignored.
    """
    number = max(1, math.ceil(ORDINARY / max(1, docs.count())))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        spans(F.col("text"), ASSIGN, ASSIGN_LEAST, 2).alias("assign"),
        spans(F.col("text"), ACCESS).alias("access"),
        spans(F.col("text"), HEX).alias("hex"),
        candidates(F.col("text")).alias("tested"),
        _ordinary_levels(F.col("text"), number).alias("ordinary"),
    )
    free = F.filter("tested", lambda c: ~(_touches(F.col("assign"), c) | _touches(F.col("access"), c) | _touches(F.col("hex"), c)))
    bare = lambda name: F.transform(name, lambda x: F.struct(x.s.alias("s"), x.e.alias("e"))).alias(name)
    found = common.materialise(found.select("doc_id", bare("assign"), bare("access"), bare("hex"), free.alias("tested"), "ordinary"), "secret-spans")
    counts: dict[bool, dict[int, dict[int, int]]] = {True: {}, False: {}}
    levels = lambda name, kind: found.select(F.explode(name).alias("x")).select(F.lit(kind).alias("k"), "x.cell", "x.level")
    for kind, cell, at, n in levels("ordinary", True).union(levels("tested", False)).groupBy("k", "cell", "level").count().collect():  # cells times STEPS at most
        counts[kind].setdefault(cell, {})[at] = n
    limit = common.literal(random_below(counts[True], counts[False]), "array<int>")
    suspect = F.filter("tested", lambda c: c.level < F.get(limit, c.cell))
    return found.select("doc_id", "assign", "access", "hex", F.transform(suspect, lambda c: F.struct(c.s.alias("s"), c.e.alias("e"))).alias("random"))


def _listed(*kinds: str) -> Column:
    """kind:start:end of all spans of these columns, by start and then by kind as given, comma-joined."""

    def marked(n: int, k: str) -> Column:
        return F.transform(k, lambda x: F.struct(x.s.alias("s"), F.lit(n).alias("n"), x.e.alias("e"), F.lit(k).alias("k")))

    every = [marked(n, k) for n, k in enumerate(kinds)]
    return F.array_join(F.transform(F.sort_array(F.concat(*every)), lambda x: F.concat_ws(":", x.k, x.s.cast("string"), x.e.cast("string"))), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(common.table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(_listed("assign", "access", "hex"), 256).alias("base_sha256"),
        _listed("assign", "access", "hex", "random").alias("spans"),
    )


QUERIES = {"op7_secret_scan": op7_secret_scan}
SQL: dict[str, str] = {}
