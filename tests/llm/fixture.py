"""Documents with everything that an operator must stand: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block long, payload string, key long, fp long, slot long, tokens string, keep boolean, words string, x int"


def lower_az(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def words(text: str | None, lower: bool = False) -> list[str]:
    return WORD.findall(lower_az(text or "") if lower else text or "")


def sentence(rng: random.Random, n: int, letters: str = "abcdefghij") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    passage = sentence(rng, 60)
    out: list[tuple[int | None, str | None]] = [(k, sentence(rng, rng.randint(14, 90))) for k in range(100, 130)]
    out += [(200 + k, f"{sentence(rng, 20)} {passage} {sentence(rng, 5)}") for k in range(5)]
    copy = sentence(rng, 80)
    edited = copy.split()
    edited[40] = "zzz"
    out += [(300, copy), (301, copy), (302, copy.upper()), (303, " ".join(edited)), (304, copy)]
    out += [(1, None), (2, ""), (3, " \t\n\x0b "), (4, "one"), (5, "one two"), (6, "One TWO three"), (None, copy), (None, None), (7, "ÀÉ ß x   y"), (8, "a " * 400), (9, "x" * 30000)]
    out += [(10, sentence(rng, 30000)), (11, sentence(rng, 50)), (11, sentence(rng, 50)), (12, "same row"), (12, "same row"), (-5, passage)]
    rng.shuffle(out)
    return out


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    full = [(i, t, ("en", "fr", None)[k % 3], "s", len(t or ""), k, "p", k, k, k, "t", True, "w", k) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
