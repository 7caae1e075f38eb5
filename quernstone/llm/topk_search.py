"""Exact top-k search by inner product: queries and candidates are indexed together in cover trees, and pairs of nodes are pruned."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Rows of a candidate block, of a query block and of a leaf, children of a node; cells of the top of the tree, and the sample that they are chosen from.
BLOCK, QUERIES_A_BLOCK, LEAF, CHILDREN, CELLS, SAMPLE = 4096, 512, 16, 8, 1024, 8192
#: Candidates that one product takes at a time.
BATCH = 1024
#: Products below this are exact in double arithmetic.
EXACT = 2.0**53


# ---- the tree of a block ---------------------------------------------------------------------------------------------


@dataclass
class Tree:
    """A cover tree over rows x. Node i has the rows points[start[i]:end[i]] and the children first[i] to first[i] + many[i] - 1, none of a leaf; no row is
    further from centre[i] than radius[i]. Node 0 is the root, and children come after their parent."""

    x: np.ndarray
    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    many: np.ndarray
    centre: np.ndarray
    radius: np.ndarray

    @property
    def norm(self) -> np.ndarray:
        return np.sqrt((self.centre**2).sum(1))

    def least(self, values: np.ndarray) -> np.ndarray:
        """The smallest of the rows' values in each node."""
        held = values[self.points]
        return np.array([held[a:b].min(initial=np.inf) for a, b in zip(self.start, self.end, strict=True)])


def farthest_first(x: np.ndarray, most: int, start: int = 0, within: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Centres, each the point farthest from those before, until none is further than within from one: any two are further apart than any point is from its
    nearest. Also the nearest centre of each point."""
    chosen, nearest = [start], np.zeros(len(x), np.int64)
    gap = ((x - x[start]) ** 2).sum(1)
    while len(chosen) < min(most, len(x)):
        far = int(gap.argmax())
        if gap[far] <= within * within:
            break
        d = ((x - x[far]) ** 2).sum(1)
        nearest[d < gap] = len(chosen)
        gap = np.minimum(gap, d)
        chosen.append(far)
    return np.array(chosen), nearest


def cover_tree(x: np.ndarray) -> Tree:
    """A node's rows go to the nearest of its children's centres, chosen farthest first until half the node's radius covers all or there are CHILDREN of them.
    Leaves have LEAF rows or fewer, or equal rows only. Balls are drawn about means, which are nearer to all rows than any row is."""
    parts, first, many, centre, radius = [np.arange(len(x))], [], [], [], []
    at = 0
    while at < len(parts):
        own = x[parts[at]]
        middle = own.mean(0) if len(own) else np.zeros(x.shape[1])
        gap = float(np.sqrt(((own - middle) ** 2).sum(1).max())) if len(own) else 0.0
        centre.append(middle)
        radius.append(gap * (1 + 1e-9) + 1e-6)
        chosen, nearest = farthest_first(own, CHILDREN, within=gap / 2) if len(own) > LEAF else ([0], None)
        if len(own) > LEAF and len(chosen) == 1:  # all within half the radius of one: two halves then
            chosen, nearest = farthest_first(own, 2)
        first.append(len(parts))
        many.append(len(chosen) if len(chosen) > 1 else 0)
        if len(chosen) > 1:
            parts += [parts[at][nearest == k] for k in range(len(chosen))]
        at += 1
    # rows in the order of the leaves, depth first
    order, start, end = [], np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)

    def lay(i: int) -> None:
        start[i] = len(order)
        if many[i]:
            for c in range(first[i], first[i] + many[i]):
                lay(c)
        else:
            order.extend(parts[i].tolist())
        end[i] = len(order)

    lay(0)
    return Tree(x, np.array(order, np.int64), start, end, np.array(first), np.array(many), np.array(centre).reshape(len(parts), x.shape[1]), np.array(radius))


def bounds(q: Tree, a: np.ndarray, c: Tree, b: np.ndarray) -> np.ndarray:
    """For pairs of nodes a and b: no query of a has a larger product with a candidate of b."""
    most = np.einsum("ij,ij->i", q.centre[a], c.centre[b]) + q.radius[a] * c.norm[b] + c.radius[b] * q.norm[a] + q.radius[a] * c.radius[b]
    return most + np.abs(most) * 1e-9 + 1e-6


@dataclass
class Best:
    """The k best candidates of each query so far: scores, ids (the largest id where there is none yet)."""

    score: np.ndarray
    ids: np.ndarray

    @classmethod
    def none(cls, queries: int, k: int) -> Best:
        return cls(np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max))

    def merge(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Ties go to smaller ids."""
        s, i = np.concatenate((self.score[rows], score), 1), np.concatenate((self.ids[rows], ids), 1)
        k = self.score.shape[1]
        if s.shape[1] > 4 * k:  # leave out what is below the k-th score for certain
            kth = np.partition(s, -k, axis=1)[:, -k, None]
            wide = int((s >= kth).sum(1).max())
            order = np.argpartition(-s, min(wide, s.shape[1]) - 1, axis=1)[:, :wide]
            s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        order = np.lexsort((i, -s), axis=1)[:, :k]
        self.score[rows], self.ids[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products, as doubles where these hold them, else as Python integers within the range of a long."""
    most = np.abs(q).max(initial=0.0) * np.abs(c).max(initial=0.0) * max(1, q.shape[1])
    if most < EXACT:
        return q @ c.T
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(q) @ whole(c).T, -(2**63), 2**63 - 1)


def search(q: Tree, q_ids: np.ndarray, c: Tree, c_ids: np.ndarray, best: Best, floor: np.ndarray) -> int:
    """Dual-tree search of all queries in all candidates; the number of products taken. floor: a score below which nothing counts for each query.

    Pairs of nodes are split, level by level, while the bound of their balls reaches the worst k-th score of the query node's queries. Pairs of leaves that are left are
    taken from the largest bound on, candidates in batches, and left out once each query's own k-th score is out of reach.
    """
    if not len(q.x) or not len(c.x):
        return 0
    exact = np.abs(q.x).max(initial=0.0) * np.abs(c.x).max(initial=0.0) * max(1, q.x.shape[1]) < EXACT
    if not exact:
        best.score = best.score.astype(object)
    worst = q.least(np.maximum(best.score[:, -1].astype(float), floor))
    a, b, leaves = np.zeros(1, np.int64), np.zeros(1, np.int64), []
    while len(a):
        if exact:  # an equal score may still win by its id
            near = bounds(q, a, c, b) >= worst[a]
            a, b = a[near], b[near]
        done = (q.many[a] == 0) & (c.many[b] == 0)
        leaves.append((a[done], b[done]))
        a, b = a[~done], b[~done]
        left = (q.many[a] > 0) & ((c.many[b] == 0) | (q.radius[a] > c.radius[b]))
        many = np.where(left, q.many[a], c.many[b])
        child = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        left, a, b = np.repeat(left, many), np.repeat(a, many), np.repeat(b, many)
        a, b = np.where(left, q.first[a] + child, a), np.where(left, b, c.first[b] + child)
    a, b = (np.concatenate(x) for x in zip(*leaves, strict=True))
    scored = 0
    order = np.argsort(a, kind="stable")
    for start, length in zip(*common.runs_of(a[order]), strict=True):
        node = a[order[start]]
        rows, others = q.points[q.start[node] : q.end[node]], b[order[start : start + length]]
        own = q.x[rows]
        # a query's own bound is closer than its node's
        most = own @ c.centre[others].T + np.sqrt((own**2).sum(1))[:, None] * c.radius[others]
        most += np.abs(most) * 1e-9 + 1e-6
        rank = np.argsort(-most.max(0), kind="stable")
        others, most = others[rank], most[:, rank]
        at = 0
        while at < len(others):
            if exact:
                kth = np.maximum(best.score[rows, -1].astype(float), floor[rows])
                live = (most[:, at:] >= kth[:, None]).any(0)
                others, most = np.concatenate((others[:at], others[at:][live])), np.concatenate((most[:, :at], most[:, at:][:, live]), 1)
            sizes = np.cumsum(c.end[others[at:]] - c.start[others[at:]])
            n = max(1, int(np.searchsorted(sizes, BATCH if at else 4 * best.score.shape[1], side="right")))
            taken = np.concatenate([c.points[c.start[o] : c.end[o]] for o in others[at : at + n]]) if at < len(others) else np.empty(0, np.int64)
            at += n
            if len(taken):
                score = products(own, c.x[taken])
                scored += score.size
                if exact:  # what no query wants is left out before anything is sorted
                    wanted = (score >= kth[:, None]).any(0)
                    score, taken = score[:, wanted], taken[wanted]
                same = q_ids[rows][:, None] == c_ids[taken][None, :]
                best.merge(rows, np.where(same, -np.inf, score), np.where(same, np.iinfo(np.int64).max, c_ids[taken][None, :]))
    return scored


# ---- blocks ----------------------------------------------------------------------------------------------------------


def _matrix(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)))
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _pack(ids: np.ndarray, t: Tree) -> bytes:
    return common.pack(np.array([*t.x.shape, len(t.radius)], np.int64), ids.astype(np.int64), t.x.reshape(-1), t.points, t.start, t.end, t.first, t.many, t.centre.reshape(-1), t.radius)


def _unpack(b: bytes) -> tuple[np.ndarray, Tree]:
    (rows, width, nodes), ids, x, points, start, end, first, many, centre, radius = common.unpack(b)
    return ids, Tree(x.reshape(rows, width), points, start, end, first, many, centre.reshape(nodes, width), radius)


def _narrowed(t: Tree, width: int) -> Tree:
    """Only the first components: all that matters where the other side's vectors end there. Balls of more components hold fewer as well."""
    return t if t.x.shape[1] == width else Tree(t.x[:, :width], t.points, t.start, t.end, t.first, t.many, t.centre[:, :width], t.radius)


def _floor(x: Column) -> Column:
    """Floor as a double: floor() would turn it into a long, which larger values don't fit."""
    return F.when(F.abs(x) >= EXACT, x).otherwise(F.floor(x).cast("double"))


def _cells(rows: DataFrame, number: int) -> np.ndarray:
    """Centres of the top of the tree, from at most SAMPLE rows chosen by a hash of vec_id."""
    unit = F.shiftrightunsigned(F.xxhash64("vec_id"), 11) / float(1 << 53)
    some = rows.where(unit < min(1.0, SAMPLE / max(1, number))).select("x").limit(SAMPLE).collect()
    if not some:
        return np.zeros((1, 1))
    x = _matrix([np.array(r[0]) for r in some])
    chosen, _ = farthest_first(x, max(1, min(CELLS, number // (BLOCK // 2))))
    return x[chosen]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, products_taken: list[int] | None = None) -> DataFrame:
    """For each query row of vectors (vec_id long, embedding array of a floating type) its k best rows: query_id, rank, vec_id, score.

    A component x counts as floor(scale * x), x as double; score is the integer inner product; ties go to the smaller vec_id. Candidates of a
    query are all rows but those with its vec_id; a query with fewer candidates than k gets all.

    Nulls: rows whose vec_id or vector is null, or whose vector holds null or non-finite components, take no part, neither does an empty vector's
    lack of components: its products are 0. A shorter vector counts as if it ended in zeros. Scores outside a long's range become its nearest end.
    Repeated rows are candidates each; a repeated query row is answered each time. An empty table gives an empty result. Other columns are ignored.

    The top of the tree is chosen from a bounded sample, see CELLS and SAMPLE; every row belongs to the cell of its nearest centre. Rows of a cell lie in
    blocks, each with a cover tree that is built once. Each query block first searches one block of its own cell; what its queries have then found
    prunes cells by their covering radii, each block for itself, and in the blocks of the cells that are left two cover trees are searched together. Figures of
    cells, CELLS at most, reach the driver; rows don't. products_taken: if given, gets the number of products, which needs the search to run at once.
    """
    spark = vectors.sparkSession
    common.ship(spark)
    x = F.transform("embedding", lambda e: _floor(scale * e.cast("double")))
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    number = rows.count()
    centres = _cells(rows, number)

    def widened(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = max(m.shape[1], centres.shape[1])
        return np.pad(m, ((0, 0), (0, width - m.shape[1]))), np.pad(centres, ((0, 0), (0, width - centres.shape[1])))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("x")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))))
            m, c = widened(_matrix([flat[ends[i] : ends[i + 1]] for i in range(batch.num_rows)]))
            with np.errstate(over="ignore", invalid="ignore"):
                far = np.nan_to_num((c**2).sum(1)[None, :] - 2 * (m @ c.T), nan=np.inf)
            cell = far.argmin(1)
            gap = np.sqrt(((m - c[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "is_query": batch.column("is_query"), "cell": pa.array(cell), "gap": gap, "x": lists})

    placed = common.materialise(rows.mapInArrow(assign, "vec_id long, is_query boolean, cell long, gap double, x array<double>"), "vectors")
    cells = placed.groupBy("cell").agg(F.count("*"), F.sum(F.col("is_query").cast("long")), F.max("gap")).collect()
    split = {r[0]: (-(-r[1] // BLOCK), -(-r[2] // QUERIES_A_BLOCK)) for r in cells}
    known = np.array(sorted(split), np.int64)
    radius = np.array([r[3] * (1 + 1e-9) + 1e-6 for r in sorted(cells)])

    def blocks(some: DataFrame, which: int, tag: str) -> DataFrame:
        parts = F.create_map(*[F.lit(v) for c, n in split.items() for v in (c, max(1, n[which]))]) if split else F.create_map(F.lit(0), F.lit(1))
        part = F.pmod(F.xxhash64("vec_id"), parts[F.col("cell")])
        return common.materialise(some.groupBy("cell", part.alias("part")).applyInArrow(pack, "cell long, part long, payload binary"), tag)

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        m = _matrix([np.array(v) for v in t.column("x").to_pylist()])
        ids = t.column("vec_id").to_numpy()
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([key[1].as_py()], pa.int64()), "payload": pa.array([_pack(ids, cover_tree(m))], pa.binary())})

    candidates = blocks(placed, 0, "candidate-blocks")
    queries = blocks(placed.where("is_query"), 1, "query-blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, c_ids, tree = None, None, None
        for batch in batches:
            for cell, part, candidate, query, floor in zip(*(batch.column(n) for n in ("q_cell", "q_part", "candidate", "query", "floor")), strict=True):
                candidate = candidate.as_buffer().to_pybytes() if candidate.is_valid else None
                if candidate is not None and candidate != held:
                    held, (c_ids, tree) = candidate, _unpack(candidate)
                q_ids, q = _unpack(query.as_buffer().to_pybytes())
                best, scored = Best.none(len(q_ids), k), 0
                least = common.unpack(floor.as_buffer().to_pybytes())[0] if floor.is_valid else np.full(len(q_ids), -np.inf)
                if candidate is not None:
                    width = min(q.x.shape[1], tree.x.shape[1])  # shorter vectors end in zeros
                    scored = search(_narrowed(q, width), q_ids, _narrowed(tree, width), c_ids, best, least)
                found = best.ids < np.iinfo(np.int64).max
                kept = np.array([int(s) for s in best.score[found]], np.int64)
                payload = common.pack(np.array([len(q_ids)], np.int64), q_ids, found.sum(1).astype(np.int64), best.ids[found], kept)
                kth = best.score[:, -1].astype(float)
                yield pa.RecordBatch.from_pydict(
                    {
                        "q_cell": pa.array([cell.as_py()], pa.int64()),
                        "q_part": pa.array([part.as_py()], pa.int64()),
                        "scored": pa.array([scored], pa.int64()),
                        "payload": pa.array([payload], pa.binary()),
                        "floor": pa.array([common.pack(kth)], pa.binary()),
                        "cells": pa.array([reached(q.x, kth)] if not floor.is_valid else [None], pa.list_(pa.int64())),
                    }
                )

    def reached(x: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Cells with a ball that some query's k-th score doesn't rule out."""
        m, c = widened(x)
        with np.errstate(over="ignore", invalid="ignore"):
            most = m @ c[known].T + np.sqrt((m**2).sum(1))[:, None] * radius
            most += np.abs(most) * 1e-9 + 1e-6
        return known[~(most < kth[:, None]).all(0)]

    ran = "q_cell long, q_part long, scored long, payload binary, floor binary, cells array<long>"
    asked = queries.select(F.col("cell").alias("q_cell"), F.col("part").alias("q_part"), F.col("payload").alias("query"))
    # one block of each query block's own cell, which of them differs, as all of a cell's queries may be in one
    held = candidates.groupBy("cell").agg(F.sort_array(F.collect_set("part")).alias("parts"))  # numbers of blocks
    start = asked.join(held, F.col("q_cell") == F.col("cell")).withColumn("home", F.get("parts", F.pmod(F.col("q_part"), F.size("parts")).cast("int"))).drop("cell", "parts")
    near = candidates.select(F.col("cell").alias("q_cell"), F.col("part").alias("home"), F.col("payload").alias("candidate"))
    first = start.join(near, ["q_cell", "home"]).withColumn("floor", F.lit(None).cast("binary"))
    home = common.materialise(first.select("q_cell", "q_part", "candidate", "query", "floor").mapInArrow(run, ran), "home-answers")

    wanted = home.select("q_cell", "q_part", "floor", F.explode("cells").alias("cell")).join(start, ["q_cell", "q_part"])
    both = wanted.join(candidates.select("cell", "part", F.col("payload").alias("candidate")), "cell").where((F.col("cell") != F.col("q_cell")) | (F.col("part") != F.col("home")))
    rest = both.select("q_cell", "q_part", "candidate", "query", "floor").mapInArrow(run, ran)

    def merge(t: pa.Table) -> pa.Table:
        best = q_ids = None
        for b in t.column("payload"):
            (n,), q_ids, per, ids, score = common.unpack(b.as_buffer().to_pybytes())
            best = best or (np.full((n, k), np.iinfo(np.int64).max), np.zeros((n, k), np.int64), np.zeros((n, k), bool))
            at = (np.repeat(np.arange(n), per), np.arange(len(ids)) - np.repeat(np.cumsum(per) - per, per))
            more = [np.full((n, k), np.iinfo(np.int64).max), np.zeros((n, k), np.int64), np.zeros((n, k), bool)]
            for m, v in zip(more, (ids, score, True), strict=True):
                m[at] = v
            i, s, has = (np.concatenate(p, 1) for p in zip(best, more, strict=True))
            order = np.lexsort((i, ~s, ~has), axis=1)[:, :k]  # ~s falls as s rises, for the least long too
            best = tuple(np.take_along_axis(p, order, 1) for p in (i, s, has))
        i, s, has = best
        q, rank = np.nonzero(has)
        return pa.table({"query_id": q_ids[q], "rank": pa.array(rank + 1, pa.int32()), "vec_id": i[has], "score": s[has]})

    every = home.select("q_cell", "q_part", "scored", "payload").union(rest.select("q_cell", "q_part", "scored", "payload"))
    if products_taken is not None:
        every = common.materialise(every, "answers")
        products_taken.append(every.agg(F.coalesce(F.sum("scored"), F.lit(0))).first()[0])
    return every.select("q_cell", "q_part", "payload").groupBy("q_cell", "q_part").applyInArrow(merge, "query_id long, rank int, vec_id long, score long")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op10_topk_search": op10_topk_search}
SQL = {
    "op10_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
}
