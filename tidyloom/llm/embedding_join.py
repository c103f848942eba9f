"""Near-duplicate vectors by a subspace pigeonhole join.

A cosine of at least ``c`` is a squared distance of at most ``2 - 2c`` between unit vectors.  Unit vectors are
rotated (by the axes of the table's own covariance, which a join of equal lengths leaves unchanged) and split
into low-dimensional blocks.  Were every block's squared distance above its share of the budget, in proportion to its
dimensions, their sum would be above the budget: a linked pair is within the share in some block.  So each block is
range-joined by itself, on cells of its first dimensions, and the union of what the blocks find is verified on the
original vectors.  A pair that several blocks find counts in the first of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import components, mix64, roots, written

SLACK = 1e-9
KEYS = ["label", "dims", "block", "cell", "i", "j"]


def unit_vectors(flat: np.ndarray, n: int) -> np.ndarray:
    x = flat.reshape(n, -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vector: str) -> Column:
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def blocks_of(dims: int, width: int) -> list[tuple[int, int]]:
    return [(a, min(dims, a + width)) for a in range(0, dims, width)]


def axes(vectors: DataFrame, dims: int) -> np.ndarray:
    """Rotation to the principal axes, strongest first, so that the first dimensions tell most rows apart.

    Its input is one ``dims x dims`` sum for each task, added up by Spark.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            x = unit_vectors(np.asarray(batch.column("vector").flatten()), batch.num_rows)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims)), pa.array(total.ravel())], names=["at", "x"])

    sums = vectors.filter(F.size("vector") == dims).select("vector").mapInArrow(moments, "at bigint, x double")
    rows = sums.groupBy("at").agg(F.sum("x").alias("x")).collect()
    matrix = np.zeros(dims * dims)
    for r in rows:
        matrix[r["at"]] = r["x"]
    matrix = matrix.reshape(dims, dims)
    return np.linalg.eigh((matrix + matrix.T) / 2)[1][:, ::-1]


def cells(y: np.ndarray, radius: float, grid: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, cell, role`` of rotated block coordinates; role 0 is at home, 1 visits.

    A row visits those neighbouring cells that lie behind its own in the order of cells and hold
    places within ``radius`` of it; of two rows within ``radius`` in different cells one visits the other's.
    """
    width = 2 * radius
    home = np.floor(y[:, :grid] / width).astype(np.int64)
    low = y[:, :grid] - home * width <= radius * (1 + 1e-6)
    high = (home + 1) * width - y[:, :grid] <= radius * (1 + 1e-6)
    rows, names, roles = [], [], []

    def name(place: np.ndarray) -> np.ndarray:
        out = np.zeros(len(place), np.uint64)
        for k in range(grid):
            out = mix64(out * np.uint64(31) + place[:, k].astype(np.uint64) + np.uint64(1))
        return out.view(np.int64)

    for code in range(3**grid):
        step = np.array([code // 3**k % 3 - 1 for k in range(grid)])
        first = step[step != 0][:1]
        if len(first) and first[0] < 0:
            continue  # the other row of the pair visits
        near = np.ones(len(y), bool)
        for k in range(grid):
            near &= low[:, k] if step[k] < 0 else high[:, k] if step[k] > 0 else True
        at = np.flatnonzero(near)
        rows.append(at)
        names.append(name(home[at] + step))
        roles.append(np.full(len(at), int(bool(len(first)))))
    return np.concatenate(rows), np.concatenate(names), np.concatenate(roles)


def near_vectors(vectors: DataFrame, least: float = 0.93, block: int = 8, grid: int = 2, chunk: int = 3000) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors (vec_id, embedding, label, ...)``.

    Rows are linked when their labels are equal and their cosine, in double precision, is at least ``least``.
    Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null
    label, have no link; so have vectors of different lengths.  Equal vectors are one class, verified once
    and counted as often as they occur.  Rows that share an id are vectors of their own, linked like others; rows with a null
    ``vec_id`` have no link.  An empty table gives no rows, and other columns are not read.

    A cell with more than ``chunk`` rows is cut by hash, and pairs of cuts are verified by different tasks.
    """
    budget = 2 - 2 * least
    base = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    ready = base.filter(usable("vector") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    # A zero has one sign, so that equal vectors are equal keys.
    ready = ready.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    keys = ["label", "hash_a", "hash_b"]
    hashed = ready.withColumn("hash_a", F.xxhash64("vector")).withColumn("hash_b", F.xxhash64(F.lit(7), "vector"))
    # A class is named by one of its rows, as ids may repeat; numbers of rows hold in a written table.
    hashed = written(hashed.withColumn("row", F.monotonically_increasing_id()), "rows")
    ranked = hashed.groupBy(*keys).agg(F.min("row").alias("rep"), F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    members = hashed.join(ranked, keys).select("vec_id", "rep", "low", "copies", "label", F.when(F.col("row") == F.col("rep"), F.col("vector")).alias("vector"))
    members = written(members, "vectors")
    reps = members.filter("vector IS NOT NULL").select("rep", "low", "copies", "label", "vector")
    sizes = [r[0] for r in reps.select(F.size("vector")).distinct().orderBy(F.size("vector")).limit(17).collect()]
    if len(sizes) > 16:
        raise ValueError("vectors have more than 16 different lengths")
    turns = {d: axes(reps, d) for d in sizes}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column("vector").value_lengths())
            for d in np.unique(lengths):
                part = batch.filter(pa.array(lengths == d))
                y = unit_vectors(np.asarray(part.column("vector").flatten()), part.num_rows) @ turns[int(d)]
                for b, (start, stop) in enumerate(blocks_of(int(d), block)):
                    row, cell, role = cells(y[:, start:stop], np.sqrt(budget * (stop - start) / d), min(grid, stop - start))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("rep").take(pa.array(row)), part.column("label").take(pa.array(row))]
                        + [pa.array(np.full(len(row), x), pa.int32()) for x in (d, b)]
                        + [pa.array(cell), pa.array(role, pa.int32())],
                        names=["rep", "label", "dims", "block", "cell", "role"],
                    )

    dealt = written(reps.select("rep", "label", "vector").mapInArrow(deal, "rep bigint, label string, dims int, block int, cell bigint, role int"), "cells")
    place = ["label", "dims", "block", "cell"]
    counts = dealt.groupBy(*place).agg(F.sum(1 - F.col("role")).alias("home"), F.sum("role").alias("guests")).filter("home > 0 AND home + guests > 1")
    counts = counts.withColumn("cuts", F.ceil(F.greatest("home", "guests") / chunk).cast("int")).select(*place, "cuts")
    cut = F.pmod(F.xxhash64("rep"), F.col("cuts")).cast("int")
    all_cuts = F.sequence(F.lit(0), F.col("cuts") - 1)
    # At home: with each cut of the cell, the greater one second.  Visiting: with each cut at home.
    ways = F.when(
        F.col("role") == 0,
        F.concat(
            F.transform(all_cuts, lambda x: F.struct(F.least(cut, x).alias("i"), F.greatest(cut, x).alias("j"), F.when(cut == x, 0).when(cut < x, 1).otherwise(2).alias("side"))),
            F.transform(all_cuts, lambda x: F.struct(cut.alias("i"), (-1 - x).alias("j"), F.lit(1).alias("side"))),
        ),
    ).otherwise(F.transform(all_cuts, lambda x: F.struct(x.alias("i"), (-1 - cut).alias("j"), F.lit(2).alias("side"))))
    spread = dealt.join(counts, place).withColumn("way", F.explode(ways)).select("rep", *place, "way.i", "way.j", "way.side")
    # Vectors of single precision travel as such.
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    rows = spread.join(reps.select("rep", "copies", F.col("vector").cast("array<float>" if single else "array<double>").alias("vector")), "rep")

    def verify(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side, b, d = np.asarray(table.column("side")), table.column("block")[0].as_py(), table.column("dims")[0].as_py()
        left = np.flatnonzero(side <= 1)
        right = np.flatnonzero((side == 0) | (side == 2))
        n = table.num_rows
        counts, found = np.zeros(n, np.int64), []
        if len(left) and len(right):
            original = np.asarray(table.column("vector").combine_chunks().flatten()).astype(np.float64).reshape(n, -1)
            lengths = np.sqrt((original * original).sum(axis=1))
            y = unit_vectors(original, n) @ turns[d]
            copies = np.asarray(table.column("copies"))
            ranges = blocks_of(d, block)
            shares = [budget * (stop - start) / d + SLACK for start, stop in ranges]
            start, stop = ranges[b]
            squares = [(y[:, s:e] ** 2).sum(axis=1) for s, e in ranges]
            same = bool((side == 0).any())
            for at in range(0, len(left), 256):
                rows = left[at : at + 256]
                gap = squares[b][rows][:, None] + squares[b][right][None, :] - 2 * (y[rows, start:stop] @ y[right, start:stop].T)
                p, q = np.nonzero(gap <= shares[b] + SLACK)
                p, q = rows[p], right[q]
                if same:
                    p, q = p[p < q], q[p < q]
                for lo in range(0, len(p), 65536):
                    a, c = p[lo : lo + 65536], q[lo : lo + 65536]
                    cosine = (original[a] * original[c]).sum(axis=1) / (lengths[a] * lengths[c])
                    use = cosine >= least
                    a, c = a[use], c[use]
                    # Does this block find it, and no earlier one?  Each pair alone, so every task agrees.
                    gaps = (y[a] - y[c]) ** 2
                    first = np.full(len(a), -1)
                    for k in range(len(ranges) - 1, -1, -1):
                        first[gaps[:, ranges[k][0] : ranges[k][1]].sum(axis=1) <= shares[k]] = k
                    a, c = a[first == b], c[first == b]
                    np.add.at(counts, a, copies[c])
                    np.add.at(counts, c, copies[a])
                    found.append((a, c))
        ids = np.asarray(table.column("rep"))
        label = roots(n, *(np.concatenate(x) for x in zip(*found))) if found else np.arange(n)
        use = np.flatnonzero(counts)
        return pa.table({"rep": pa.array(ids[use]), "links": pa.array(counts[use]), "low": pa.array(ids[label[use]])})

    links = written(rows.groupBy(*KEYS).applyInArrow(verify, "rep bigint, links bigint, low bigint"), "links")
    groups = components(links.select(F.col("rep").alias("a"), F.col("low").alias("b")), "vector-groups")
    totals = links.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = groups.select(F.col("node").alias("rep"), "component")
    names = groups.join(reps.select("rep", "low"), "rep").groupBy("component").agg(F.min("low").alias("name"))
    found = totals.join(groups, "rep", "left").join(names, "component", "left").select("rep", "links", "name")
    linked = members.select("vec_id", "rep", "low", "copies").join(found, "rep", "left")
    out = linked.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("name", "low").alias("component_id"))
    alone = base.filter(~usable("vector") | F.col("label").isNull() | F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
