"""Exact nearest neighbours of one query vector."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("l2", "cosine")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def distance(vector: Column, query: Sequence[float], metric: str) -> Column:
    """l2: the root of the summed squares of differences; cosine: 1 - cos."""
    q = F.array(*[F.lit(float(x)) for x in query])
    if metric == "l2":
        return F.sqrt(_sum(F.zip_with(vector, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))))
    norm = math.sqrt(sum(float(x) ** 2 for x in query))
    dot = _sum(F.zip_with(vector, q, lambda a, b: a.cast("double") * b))
    return 1 - dot / (F.sqrt(_sum(F.transform(vector, lambda a: a.cast("double") * a.cast("double")))) * F.lit(norm))


def knn(df: DataFrame, column: str, query: Sequence[float], k: int = 10, metric: str = "l2", output: Sequence[str] | None = None) -> DataFrame:
    """The k rows nearest to query, in order: output columns and distance. Null vectors are left out; k over the number of rows gives all."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    if not query or any(x is None for x in query):
        raise ValueError("the query must hold numbers only")
    output = df.columns if output is None else list(output)
    if not output:
        raise ValueError("no output columns")
    missing = [c for c in output if c not in df.columns]
    if missing:
        raise ValueError(f"no columns {missing}")
    sound = df.where(F.col(column).isNotNull())
    fits = F.when(F.size(column) == len(query), distance(F.col(column), query, metric)).otherwise(F.raise_error(F.lit(f"a vector has not {len(query)} components")))
    return sound.select(*output, fits.alias("distance")).orderBy("distance", *output[:1]).limit(k)
