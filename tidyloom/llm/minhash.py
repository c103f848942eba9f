"""Near-duplicate documents by circulant MinHash: two permutations, banding, exact Jaccard verification.

Coordinate ``k`` of a signature is the minimum over a document's shingles of ``pi(sigma(shingle) + k mod 2^32)``:
``sigma`` and ``pi`` are two fixed permutations of 32-bit numbers, and ``pi`` is shifted circularly by
``k``.  Documents that agree in all rows of a band become candidates of each other.  Candidates are gathered
into clusters, and within a cluster every pair that shares a shingle is verified on the full sets.

Documents with equal sets are one class and are compared once.  Large clusters are cut into chunks by
set size and hash, and pairs of chunks are verified by different tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import components, mix64, roots, text_bytes, text_parts, word_hashes, written

SIGMA, PI = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)), (np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))


def permute32(x: np.ndarray, multipliers: tuple[np.uint32, np.uint32]) -> np.ndarray:
    """A permutation of 32-bit numbers: odd multipliers and shifted xors can be undone."""
    x = x ^ (x >> np.uint32(16))
    x *= multipliers[0]
    x ^= x >> np.uint32(15)
    x *= multipliers[1]
    x ^= x >> np.uint32(16)
    return x


def shingles_in_order(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts' words in their order, and the text of each.

    A shingle's hash covers all of its words; a text with fewer than ``width`` words has one shingle of all
    of them, a text without words none.
    """
    words = np.diff(first)
    counts = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    owner = np.repeat(np.arange(len(words)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[:-1][owner]
    shingles = np.zeros(len(at), np.uint64)
    for k in range(width if len(at) else 0):
        there = at + k < first[1:][owner]
        salt = np.uint64((k + 1) * 0xA24BAED4963EE407 % (1 << 64))
        shingles += np.where(there, mix64(hashes[np.minimum(at + k, len(hashes) - 1)] + salt), np.uint64(0))
    return mix64(shingles), owner


def shingle_sets(data: np.ndarray, starts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in one array, and where each text's begin and the last end."""
    n = len(starts) - 1
    shingles, owner = shingles_in_order(*word_hashes(data, starts), width)
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    return shingles[new], np.searchsorted(owner[new], np.arange(n + 1))


def circulant_signatures(shingles: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """``(texts, length)`` signatures; a text without shingles has the largest value everywhere."""
    out = np.full((len(starts) - 1, length), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(starts))
    begins = starts[:-1][full]
    if len(full):
        placed = permute32((shingles >> np.uint64(32)).astype(np.uint32), SIGMA)
        for k in range(length):
            out[full, k] = np.minimum.reduceat(permute32(placed + np.uint32(k), PI), begins)
    return out


def set_table(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, n, set_a, set_b, bands`` of every document; both set hashes do not depend on order."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, "text", 1 << 20):
                shingles, starts = shingle_sets(*text_bytes(part.column("text")), width)
                signatures = circulant_signatures(shingles, starts, bands * rows).astype(np.uint64)
                keys = np.zeros((part.num_rows, bands), np.uint64)
                for r in range(rows):
                    keys = mix64(keys * np.uint64(31) + signatures[:, r::rows] + np.uint64(1))
                keys = mix64(keys + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(shingles + salt)))) for salt in (np.uint64(1), np.uint64(0x7F4A7C15F39CC060))]
                set_a, set_b = (s[starts[1:]] - s[starts[:-1]] for s in sums)
                offsets = pa.array(np.arange(part.num_rows + 1) * bands, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(starts), pa.int64()),
                        pa.array(set_a.view(np.int64)),
                        pa.array(set_b.view(np.int64)),
                        pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel())),
                    ],
                    names=["doc_id", "n", "set_a", "set_b", "bands"],
                )

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return source.mapInArrow(describe, "doc_id bigint, n bigint, set_a bigint, set_b bigint, bands array<bigint>")


def linked(shingles: np.ndarray, starts: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(i, j)``, ``i < j``, of sets of which one is ``left`` and the other ``right``, with
    ``100 * intersection >= percent * union``.  Found through shared shingles alone.
    """
    sizes = np.diff(starts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, token = np.unique(shingles, return_inverse=True)
    often = np.bincount(token)
    # Of a set that is linked, at least percent % of the shingles are in another one.
    shared = np.bincount(owner, weights=often[token] > 1, minlength=len(sizes))
    alive = (100 * shared >= percent * sizes) & (sizes > 0)
    use = alive[owner] & (often[token] > 1)
    owner, token = owner[use], token[use]
    order = np.argsort(token, kind="stable")
    posts = owner[order]
    begin = np.searchsorted(token[order], np.arange(len(often) + 1))
    mine = np.searchsorted(owner, np.arange(len(sizes) + 1))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for i in np.flatnonzero(alive & left):
        own = token[mine[i] : mine[i + 1]]
        length = begin[own + 1] - begin[own]
        total = int(length.sum())
        if not total:
            continue
        place = np.arange(total) + np.repeat(begin[own] - (np.cumsum(length) - length), length)
        common = np.bincount(posts[place], minlength=len(sizes))
        near = np.flatnonzero((100 * common >= percent * (sizes + sizes[i] - common)) & right & (common > 0))
        near = near[near != i]
        found.append((np.full(len(near), i), near))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
    return np.minimum(a, b), np.maximum(a, b)


def verified_links(docs: DataFrame, clusters: DataFrame, width: int, percent: int, chunk: int) -> DataFrame:
    """``(a, b)``: links that join what the verified pairs of each group of candidates join.

    ``clusters``: ``doc_id, n, cluster``.  Small clusters share groups of about ``chunk`` shingles.  A
    larger cluster is cut by steps of set size, of which only equal and neighbouring ones can
    hold linked sets, and by hash; each pair of cuts is a group.
    """
    step = F.floor(F.log("n") / np.log(100 / percent)).cast("bigint")
    sized = clusters.withColumn("step", step)
    cells = sized.groupBy("cluster", "step").agg(F.sum("n").alias("cell"))
    cells = cells.groupBy("cluster").agg(F.sum("cell").alias("all"), F.ceil(F.max("cell") / chunk).cast("int").alias("cuts"))
    buckets = max(1, int((clusters.agg(F.sum("n")).head()[0] or 0) // chunk) + 1)
    sized = sized.join(cells, "cluster")
    cut = F.pmod(F.xxhash64("doc_id"), F.col("cuts")).cast("int")
    others = F.sequence(F.lit(0), F.col("cuts") - 1)

    def group(kind, key, level, i, j, side):
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), level.alias("level"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))

    zero, big = F.lit(0), F.lit(0).cast("bigint")
    small = F.array(group(0, F.pmod(F.xxhash64("cluster"), F.lit(buckets)), big, zero, zero, zero))
    within = F.transform(others, lambda x: group(1, F.col("cluster"), F.col("step"), F.least(cut, x), F.greatest(cut, x), F.when(cut == x, 0).when(cut < x, 1).otherwise(2)))
    upward = F.transform(others, lambda x: group(2, F.col("cluster"), F.col("step"), cut, x, F.lit(1)))
    downward = F.transform(others, lambda x: group(2, F.col("cluster"), F.col("step") - 1, x, cut, F.lit(2)))
    groups = F.when(F.col("all") <= chunk, small).otherwise(F.concat(within, upward, downward))
    wanted = sized.select("doc_id", groups.alias("groups"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    # Candidates grow with the documents, so their list is never sent to all executors.
    texts = texts.join(wanted.hint("merge"), "doc_id")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, "text", 1 << 20):
                shingles, starts = shingle_sets(*text_bytes(part.column("text")), width)
                sets = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(shingles.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), sets, part.column("groups")], names=["doc_id", "shingles", "groups"])

    schema = "doc_id bigint, shingles array<bigint>, groups array<struct<kind:int,key:bigint,level:bigint,i:int,j:int,side:int>>"
    sets = texts.mapInArrow(shingled, schema).select("doc_id", "shingles", F.explode("groups").alias("g"))

    def verify(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists = table.column("shingles").combine_chunks()
        ids = np.asarray(table.column("doc_id"))
        side = np.asarray(table.column("side"))
        starts = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        left, right = linked(np.asarray(lists.flatten()).view(np.uint64), starts, side <= 1, (side == 0) | (side == 2), percent)
        label = roots(len(ids), left, right)
        joined = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"a": pa.array(ids[joined], pa.int64()), "b": pa.array(ids[label[joined]], pa.int64())})

    keys = ["kind", "key", "level", "i", "j"]
    rows = sets.select("doc_id", "shingles", *[F.col(f"g.{k}").alias(k) for k in keys], "g.side")
    return rows.groupBy(*keys).applyInArrow(verify, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, bands: int = 24, rows: int = 4, chunk: int = 1_000_000) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs (doc_id, text, ...)``.

    Sets of ``width``-word shingles are linked when their Jaccard similarity is at least ``percent`` %.  A
    pair just at the threshold is missed with a chance of ``(1 - (percent / 100) ** rows) ** bands``: 4e-8 at
    85 %, 4e-6 at 80 %.  ``component_id`` is the smallest ``doc_id`` reachable over links.

    A null or blank text has no shingle and no link.  Rows with a null ``doc_id`` have a null component and
    are kept.  Rows that repeat a ``doc_id`` are one document.  Other columns are not read.
    """
    described = written(set_table(docs, width, bands, rows), "sets")
    full = described.filter("n > 0 AND doc_id IS NOT NULL")
    keys = ["n", "set_a", "set_b"]
    classes = full.groupBy(*keys).agg(F.min("doc_id").alias("rep"))
    members = written(full.join(classes, keys).select("doc_id", "n", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands")), "members")
    banded = members.filter("bands IS NOT NULL").select("rep", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).filter("first < last").select("band", "first")
    near = banded.join(buckets, "band").select(F.col("rep").alias("a"), F.col("first").alias("b"))
    clusters = components(near, "candidates").select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
    reps = members.filter("bands IS NOT NULL").select("doc_id", "n").distinct()
    links = verified_links(docs, written(reps.join(clusters, "doc_id"), "clusters"), width, percent, chunk)
    found = components(links, "verified").select(F.col("node").alias("rep"), F.col("component"))
    joined = members.select("doc_id", "n", "rep").join(found, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    alone = described.filter("n = 0 OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return joined.unionAll(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
