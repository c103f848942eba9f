"""Approximate nearest neighbours with a hierarchical k-means tree and best-bin-first traversal.

The tree is fitted on a bounded sample and every row is put into a leaf.  A query walks down the tree and
keeps the branches it did not take in a priority queue, by the distance to their centres; the next leaf is always
below the nearest branch left.  How many leaves a query visits is widened until the recall, measured
against exact neighbours of calibration queries over all rows, reaches its target.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidyloom.llm.common import written
from tidyloom.llm.embedding_join import usable


@dataclass(frozen=True)
class Tree:
    """``centres[node]``; node 0 is the root, ``children[node]`` its branches, ``leaf[node]`` its leaf or -1."""

    centres: np.ndarray
    children: tuple[tuple[int, ...], ...]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int((self.leaf >= 0).sum())


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        sizes = np.bincount(own, minlength=k)
        full = sizes > 0
        centres[full] = sums[full] / sizes[full, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None, :] - 2 * (x @ centres.T)).argmin(axis=1)


def fit_tree(x: np.ndarray, leaves: int, branches: int = 8, seed: int = 11) -> Tree:
    """Split the sample's largest part into ``branches`` until there are about ``leaves`` parts.

    A part whose rows are all equal is not split.
    """
    rng = np.random.default_rng(seed)
    centres, children, parts = [x.mean(axis=0)], [()], {0: np.arange(len(x))}
    queue = [(-len(x), 0)]
    while queue and len(parts) + branches - 1 <= max(leaves, 1):
        _, node = heapq.heappop(queue)
        rows = parts[node]
        distinct = np.unique(x[rows], axis=0)
        if len(distinct) < 2:
            continue
        middles = k_means(distinct.copy(), min(branches, len(distinct)), rng)
        own = nearest(x[rows], middles)
        if len(np.unique(own)) < 2:
            continue
        del parts[node]
        kids = []
        for k in np.unique(own):
            kids.append(len(centres))
            centres.append(middles[k])
            children.append(())
            parts[kids[-1]] = rows[own == k]
            heapq.heappush(queue, (-int((own == k).sum()), kids[-1]))
        children[node] = tuple(kids)
    leaf = np.full(len(centres), -1)
    leaf[sorted(parts)] = np.arange(len(parts))
    return Tree(np.array(centres), tuple(children), leaf)


def leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row: the nearest branch at every level."""
    out = np.zeros(len(x), np.int64)
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        kids = tree.children[node]
        if not kids:
            out[rows] = tree.leaf[node]
            continue
        own = nearest(x[rows], tree.centres[list(kids)])
        todo += [(kid, rows[own == k]) for k, kid in enumerate(kids) if (own == k).any()]
    return out


def best_bins(tree: Tree, query: np.ndarray, visits: int, rows: np.ndarray, least: int) -> list[int]:
    """The leaves of a best-bin-first traversal: ``visits`` of them, and more until they hold ``least`` of ``rows`` by leaf."""
    gaps = ((tree.centres - query) ** 2).sum(axis=1).tolist()
    queue, out, held = [(0.0, 0)], [], 0
    while queue and (len(out) < visits or held < least):
        node = heapq.heappop(queue)[1]
        while tree.children[node]:
            kids = sorted(tree.children[node], key=gaps.__getitem__)
            for kid in kids[1:]:
                heapq.heappush(queue, (gaps[kid], kid))
            node = kids[0]
        out.append(int(tree.leaf[node]))
        held += int(rows[out[-1]])
    return out


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` smallest scores, ties by the smaller id."""
    if len(ids) > 4 * k:
        some = np.flatnonzero(scores <= np.partition(scores, k - 1)[k - 1])
        return some[np.lexsort((ids[some], scores[some]))][:k]
    return np.lexsort((ids, scores))[:k]


def distances(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - query) ** 2).sum(axis=1))


def exact_leaves(rows: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> dict[int, list[int]]:
    """The leaves of the ``k`` exact nearest rows of a few queries, over all rows; each task sends ``k`` a query."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int, int]]] = {q: [] for q, _ in queries}
        for batch in batches:
            ids, leaf = np.asarray(batch.column("vec_id")), np.asarray(batch.column("leaf"))
            x = np.asarray(batch.column("vector").flatten()).reshape(batch.num_rows, -1)
            for q, vector in queries:
                scores = distances(x, np.asarray(vector))
                scores[ids == q] = np.inf
                for p in top(ids, scores, k):
                    if np.isfinite(scores[p]):
                        best[q].append((float(scores[p]), int(ids[p]), int(leaf[p])))
                best[q] = sorted(best[q])[:k]
        out = [(q, *x) for q, found in best.items() for x in found]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=["query_id", "score", "vec_id", "leaf"])

    found = rows.mapInArrow(scan, "query_id bigint, score double, vec_id bigint, leaf bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    out: dict[int, list[int]] = {q: [] for q, _ in queries}
    for r in found.withColumn("rank", rank).filter(F.col("rank") <= k).collect():
        out[r["query_id"]].append(r["leaf"])
    return out


def widened(tree: Tree, queries: list[tuple[int, list[float]]], truth: dict[int, list[int]], recall: float, rows: np.ndarray) -> int:
    """The fewest leaf visits, in steps of an eighth, with which the queries find ``recall`` of their neighbours."""
    places = []
    for q, vector in queries:
        order = {leaf: i for i, leaf in enumerate(best_bins(tree, np.asarray(vector), tree.leaves, rows, 0))}
        places += [order[leaf] for leaf in truth[q]]
    visits = 1
    while visits < tree.leaves and np.mean(np.asarray(places) < visits) < recall:
        visits = min(tree.leaves, visits + max(1, visits // 8))
    return visits


def nearest_vectors(
    vectors: DataFrame,
    is_query: Column | str,
    k: int = 10,
    recall: float = 0.97,
    leaf_rows: int = 200,
    max_leaves: int = 2048,
    sample: int = 20_000,
    calibration: int = 100,
    chunk: int = 20_000,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found, by Euclidean distance in double precision.

    Queries are the rows for which ``is_query`` holds; every other row, and every row but the query's
    own, is a candidate.  Ties go to the smaller id.  Vectors that are null, empty, zero, or hold null or non-finite components
    take no part, nor do rows with a null id or of another length than most rows (of the smaller, if two are as frequent).
    Rows that share an id are candidates each by itself, so an id may be found more than once; if they ask, the smallest of their vectors
    does, and none of them is its candidate.  Every query gets ``k`` rows, or all candidates if there are fewer: it goes on through
    the leaves until it has seen as many.  An empty table, or one without queries, gives no rows; other columns are not read.

    The tree is fitted on about ``sample`` rows drawn by hash, has about a leaf for ``leaf_rows`` rows and at most
    ``max_leaves``, and goes to every task.  ``calibration`` queries at most, drawn by hash, are searched exactly
    to widen the visits until their recall is ``recall``.  Leaves are cut into chunks of about ``chunk``
    candidates and ``chunk`` queries, so a full leaf is searched by many tasks.
    """
    condition = F.expr(is_query) if isinstance(is_query, str) else is_query
    base = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    ready = base.filter(usable("vector") & F.col("vec_id").isNotNull())
    common = ready.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if not common:
        return vectors.sparkSession.createDataFrame([], result)
    dims, n = common[0]["dims"], common[0]["count"]
    ready = ready.filter(F.size("vector") == dims)
    draw = F.xxhash64("vec_id", F.lit("tree"))
    parts = 1 << 30

    def drawn(df: DataFrame, amount: int, among: int) -> list:
        share = min(parts, int(parts * amount / max(among, 1)) + 1)
        return sorted((r["draw"], r["vec_id"], r["vector"]) for r in df.withColumn("draw", draw).filter(F.pmod("draw", F.lit(parts)) < share).limit(2 * amount).collect())

    tree = fit_tree(np.array([r[2] for r in drawn(ready, sample, n)] or [[0.0] * dims]), min(max_leaves, max(1, n // leaf_rows)))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("vector").flatten()).reshape(batch.num_rows, -1)
            leaf = leaf_of(tree, x) if len(x) else np.zeros(0, np.int64)
            yield batch.append_column("leaf", pa.array(leaf))

    marked = ready.withColumn("asked", F.coalesce(condition, F.lit(False)))
    index = written(marked.mapInArrow(put, "vec_id bigint, vector array<double>, asked boolean, leaf bigint"), "index")
    asked = index.filter("asked").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    shared = index.join(asked.select("vec_id"), "vec_id", "left_semi").groupBy("vec_id").agg(F.count("*").cast("int").alias("own"))
    asked = written(asked.join(shared, "vec_id"), "queries")
    held = np.zeros(tree.leaves, np.int64)
    for r in index.groupBy("leaf").count().collect():  # one row for each leaf
        held[r["leaf"]] = r["count"]
    amount = asked.count()
    chosen = [(r[1], r[2]) for r in drawn(asked, calibration, amount)]
    visits = widened(tree, chosen, exact_leaves(index.select("vec_id", "vector", "leaf"), chosen, k), recall, held) if chosen else 1

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("vector").flatten()).reshape(batch.num_rows, -1)
            bins = [best_bins(tree, q, visits, held, k + own) for q, own in zip(x, batch.column("own").to_pylist())]
            owner = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(owner)), pa.array([b for row in bins for b in row], pa.int64())], names=["vec_id", "leaf"])

    routes = written(asked.mapInArrow(route, "vec_id bigint, leaf bigint"), "routes")
    sizes = index.groupBy("leaf").agg(F.ceil(F.count("*") / chunk).cast("int").alias("cuts"))
    asks = routes.groupBy("leaf").agg(F.ceil(F.count("*") / chunk).cast("int").alias("turns"))
    # One row for each leaf, of which there are at most max_leaves.
    plan = F.broadcast(sizes.join(asks, "leaf"))
    keys = ["leaf", "cut", "turn"]
    candidates = index.join(plan, "leaf").select("vec_id", "vector", "leaf", F.pmod(F.xxhash64("vec_id"), F.col("cuts")).cast("int").alias("cut"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"))
    walkers = routes.join(plan, "leaf").join(asked.select("vec_id", "vector"), "vec_id").select("vec_id", "vector", "leaf", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), F.pmod(F.xxhash64("vec_id"), F.col("turns")).cast("int").alias("turn"))

    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if queries.num_rows and rows.num_rows:
            ids = np.asarray(rows.column("vec_id"))
            x = np.asarray(rows.column("vector").combine_chunks().flatten()).reshape(len(ids), -1)
            walk = np.asarray(queries.column("vector").combine_chunks().flatten()).reshape(queries.num_rows, -1)
            for q, vector in zip(queries.column("vec_id").to_pylist(), walk):
                scores = distances(x, vector)
                scores[ids == q] = np.inf
                best = top(ids, scores, k)
                best = best[np.isfinite(scores[best])]
                out.append((np.full(len(best), q), ids[best], scores[best]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"query_id": pa.array(columns[0]), "vec_id": pa.array(columns[1]), "score": pa.array(columns[2])})

    near = walkers.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(search, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
