"""Repeated passages, byte for byte, from merged Burrows-Wheeler transforms of shards.

Which bytes are covered by a string of ``length`` bytes that also starts anywhere else?  Two steps find all of them:

1. Every window of ``length`` bytes has an anchor, its gram with the smallest hash, and equal windows have
   equal anchors at equal places.  Windows with one anchor are cut into those that hold a fixed stretch to its
   left and those that hold one to its right, and only windows with equal stretches can be equal.  Runs of
   windows are told apart by hashes of their stretch and of all their bytes: a run whose bytes occur twice is
   repeated as a whole, and a run whose stretch is its own has no equal window.
2. What is left are runs that share a stretch but not all bytes.  Their windows are sequences of blocks, and
   each shard of runs has its transform: for every place, the blocks that precede the suffixes there, in the
   order of the suffixes.  Transforms are merged by refining their interleave one block at a time: a stable
   partition of the interleaved preceding blocks gives the interleave for suffixes that are one block longer,
   and with it the intervals of equal suffixes.  No suffix is sorted anew.  Intervals of several windows of full
   length are repeated strings.

Strings are told apart by 64-bit hashes of their parts, together with the 64-bit hash of their stretch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import mix64, powers, text_bytes, text_parts, written

BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)
BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
GRAM = 32


class Spans:
    """Hashes of any stretch of ``data``, from sums over its beginning."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTES[data] * powers(BASE, len(data)), out=self.sums[1:])
        self.scale = powers(INVERSE, len(data) + 1)

    def hash(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        out = self.sums[start + size]
        out -= self.sums[start]
        out *= self.scale[start]
        return mix64(out + np.asarray(size).astype(np.uint64))


def anchors(spans: Spans, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``place, first, last``: the anchors of all windows within texts, and each one's run of window starts."""
    total = int(starts[-1])
    n = total - length + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    at = np.arange(total - GRAM + 1)
    low = spans.hash(at, GRAM)
    low &= np.uint64(0xFFFFFFFF00000000)
    low |= at.astype(np.uint64)  # of equal hashes the first
    width, reach = length - GRAM + 1, 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: reach - width], low[width - reach :])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(n, bool)
    turn = np.zeros(n, bool)
    for a, b in zip(starts[:-1].tolist(), (starts[1:] - length + 1).tolist()):
        if b > a:
            inside[a:b] = True
            turn[a] = True
    turn[1:] |= (place[1:] != place[:-1]) | (inside[1:] != inside[:-1])
    begin = np.flatnonzero(turn | np.concatenate(([True], np.zeros(n - 1, bool))))
    end = np.concatenate((begin[1:], [n])) - 1
    use = inside[begin]
    return place[begin][use], begin[use], end[use]


def runs(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """``text, first, windows, stretch, whole`` of the runs of windows of all texts; the last two are hashes."""
    spans = Spans(data)
    place, first, last = anchors(spans, starts, length)
    left = (length - GRAM) // 2
    sides = []
    for low, high, key_at, key_size in (
        (first, np.minimum(last, place - left), place - left, left + GRAM),
        (np.maximum(first, place - left + 1), last, place, length - left + 1),
    ):
        use = high >= low
        low, high = low[use], high[use]
        stretch = spans.hash(key_at[use], key_size) + np.uint64(len(sides))
        whole = spans.hash(low, high - low + length) + mix64((place[use] - low).astype(np.uint64))
        sides.append((low, high - low + 1, stretch, whole))
    low, windows, stretch, whole = (np.concatenate(x) for x in zip(*sides))
    return np.searchsorted(starts, low, side="right") - 1, low, windows, stretch, whole


def transform(blocks: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """A shard's transform, and its windows in their order: ``blocks[place, window]``.

    Entry ``i`` of the transform: the blocks that precede the suffixes of ``i`` blocks, in the suffixes' order.
    """
    order, out = np.arange(blocks.shape[1]), []
    for preceding in blocks[::-1]:
        column = preceding[order]
        out.append(column)
        order = order[np.argsort(column, kind="stable")]
    return out, order


def merged(transforms: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each window in the common order, and the interval of equal windows it is in."""
    sizes = [len(t[0]) for t in transforms]
    shard = np.repeat(np.arange(len(sizes), dtype=np.uint16 if len(sizes) < 1 << 16 else np.int64), sizes)
    interval = np.zeros(len(shard), np.int64)
    for step in range(len(transforms[0])):
        preceding = np.empty(len(shard), np.uint64)
        preceding[np.argsort(shard, kind="stable")] = np.concatenate([t[step] for t in transforms])
        order = np.argsort(preceding, kind="stable")
        shard, interval, preceding = shard[order], interval[order], preceding[order]
        new = np.zeros(len(shard), np.int64)
        new[1:] = (preceding[1:] != preceding[:-1]) | (interval[1:] != interval[:-1])
        interval = np.cumsum(new)
    return shard, interval


def repeated_windows(data: np.ndarray, window: np.ndarray, shard_of: np.ndarray, length: int, block: int) -> np.ndarray:
    """Whether the ``length`` bytes from each of ``window`` occur at another one of them; shards are in order."""
    spans = Spans(data)
    offsets = [min(a, length - block) for a in range(0, length, block)]
    blocks = np.stack([spans.hash(window + a, block) for a in offsets])
    edges = np.flatnonzero(np.diff(shard_of)) + 1
    bounds = [0, *edges.tolist(), len(window)]
    built = [transform(blocks[:, a:b]) for a, b in zip(bounds, bounds[1:])]
    shard, interval = merged([t for t, _ in built])
    several = np.bincount(interval)[interval] > 1
    out = np.zeros(len(window), bool)
    # The windows of a shard keep their order in the merged one.
    out[np.concatenate([order + a for (_, order), a in zip(built, bounds)])] = several[np.argsort(shard, kind="stable")]
    return out


def stretches(places: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the runs of consecutive ``places`` that are marked."""
    at = places[marked]
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1] + 1
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(at)])) - 1
    return at[first], at[last[: len(first)]]


DOC = ["doc_id", "twin"]


def identified(docs: DataFrame) -> DataFrame:
    """``doc_id``, a hash that tells rows with one ``doc_id`` apart (null ids too) by their texts, and ``text``."""
    doc_id = F.col("doc_id").cast("bigint")
    return docs.select(F.coalesce(doc_id, F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64("text").alias("twin"), "text", doc_id.isNull().alias("no_id"))


def run_table(docs: DataFrame, length: int) -> DataFrame:
    schema = "doc_id bigint, twin bigint, stretch bigint, whole bigint, times int, first array<int>, windows int"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, "text", 1 << 18):
                data, starts = text_bytes(part.column("text"))
                text, low, windows, stretch, whole = runs(data, starts, length)
                order = np.lexsort((low, whole, stretch, text))
                text, low, windows, stretch, whole = (x[order] for x in (text, low, windows, stretch, whole))
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (stretch[1:] != stretch[:-1]) | (whole[1:] != whole[:-1])
                at = np.flatnonzero(new)
                bounds = np.concatenate((at, [len(text)]))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(low - starts[text], pa.int32())) if len(at) else pa.array([], pa.list_(pa.int32()))
                owner = pa.array(text[at])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(owner),
                        part.column("twin").take(owner),
                        pa.array(stretch[at].view(np.int64)),
                        pa.array(whole[at].view(np.int64)),
                        pa.array(np.diff(bounds), pa.int32()),
                        lists,
                        pa.array(windows[at], pa.int32()),
                    ],
                    names=[c.split()[0] for c in schema.split(", ")],
                )

    return docs.filter(F.octet_length("text") >= length).select("doc_id", "twin", "text").mapInArrow(find, schema)


SPAN = "doc_id bigint, twin bigint, start int, stop int"


def contested_spans(docs: DataFrame, asked: DataFrame, length: int, block: int, task_windows: int, shard_windows: int) -> DataFrame:
    """Spans of the repeated windows of runs that share their stretch with other runs.

    ``asked``: a row for each distinct run with ``doc_id, twin, stretch, windows, at, single, crowd``.  Stretches are
    dealt out to tasks of about ``task_windows`` windows.  Where one stretch has more, its windows become
    rows and are counted by Spark instead.
    """
    total = asked.agg(F.sum("windows")).head()[0] or 0
    buckets = max(1, int(total // task_windows) + 1)
    wanted = asked.groupBy(*DOC).agg(F.collect_list(F.struct("stretch", "windows", "at", "single", (F.col("crowd") > task_windows).alias("crowded"))).alias("runs"))
    texts = docs.select(*DOC, "text").dropDuplicates(DOC).join(wanted, DOC)
    schema = "doc_id bigint, twin bigint, stretch bigint, windows int, at int, single boolean, crowded boolean, bytes binary"
    names = [c.split()[0] for c in schema.split(", ")]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary())

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, "text"):
                rows = []
                for doc, twin, text, found in zip(*(part.column(c) for c in (*DOC, "text", "runs"))):
                    data, key = text.as_buffer().to_pybytes(), (doc.as_py(), twin.as_py())
                    rows += [(*key, r["stretch"], r["windows"], r["at"], r["single"], r["crowded"], data[r["at"] : r["at"] + r["windows"] - 1 + length]) for r in found.as_py()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    cut = texts.mapInArrow(take, schema)
    crowded = bool(asked.filter(F.col("crowd") > task_windows).head(1))
    cut = written(cut, "runs") if crowded else cut

    def merge(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        windows, at = np.asarray(table.column("windows")).astype(np.int64), np.asarray(table.column("at")).astype(np.int64)
        data, starts = text_bytes(table.column("bytes").combine_chunks())
        owner = np.repeat(np.arange(len(windows)), windows)
        inner = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        shard = np.cumsum(windows)[owner] // shard_windows
        marked = repeated_windows(data, starts[owner] + inner, shard, length, block)
        marked &= np.asarray(table.column("single"))[owner]
        # Places of one run are consecutive, and a gap separates runs.
        first, last = stretches(inner + owner * np.int64(1 << 32), marked)
        run = first >> 32
        start = at[run] + (first & 0xFFFFFFFF)
        stop = at[run] + (last & 0xFFFFFFFF) + length
        return pa.table({c: table.column(c).take(pa.array(run)) for c in DOC} | {"start": pa.array(start, pa.int32()), "stop": pa.array(stop, pa.int32())})

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                windows = np.asarray(part.column("windows")).astype(np.int64)
                data, starts = text_bytes(part.column("bytes"))
                owner = np.repeat(np.arange(len(windows)), windows)
                inner = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
                hashes = Spans(data).hash(starts[owner] + inner, length)
                place = np.asarray(part.column("at"))[owner] + inner
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in (*DOC, "stretch", "single")), pa.array(hashes.view(np.int64)), pa.array(place, pa.int32())], names=[*DOC, "stretch", "single", "window", "start"])

    calm = cut.filter("NOT crowded").withColumn("bucket", F.pmod(F.xxhash64("stretch"), F.lit(buckets)))
    spans = calm.groupBy("bucket").applyInArrow(merge, SPAN)
    if not crowded:
        return spans
    each = cut.filter("crowded").mapInArrow(windows_of, "doc_id bigint, twin bigint, stretch bigint, single boolean, window bigint, start int")
    twice = each.groupBy("stretch", "window").count().filter("count > 1").select("stretch", "window")
    return spans.unionAll(each.filter("single").join(twice, ["stretch", "window"]).select(*DOC, "start", (F.col("start") + length).cast("int").alias("stop")))


def repeated_spans(docs: DataFrame, length: int, block: int, task_windows: int, shard_windows: int) -> DataFrame:
    """``doc_id, twin, start, stop`` in bytes: spans that together cover all repeated strings of ``docs``."""
    table = written(run_table(docs, length), "all-runs", compression="zstd")
    shared = table.groupBy("stretch").agg(F.sum("times").alias("all")).filter("all > 1").select("stretch")
    near = written(table.join(shared, "stretch"), "shared-runs")
    kinds = near.groupBy("stretch", "whole").agg(F.sum("times").alias("times"), F.min(F.struct("doc_id", "twin", F.col("first")[0].alias("at"))).alias("one"), F.max("windows").alias("windows"))
    kinds = written(kinds, "kinds")
    crowds = kinds.groupBy("stretch").agg(F.count("*").alias("kinds"), F.min("times").alias("least"), F.sum("windows").alias("crowd"))
    crowds = crowds.filter("kinds > 1 AND least = 1").select("stretch", "crowd")
    asked = kinds.join(crowds, "stretch").select("one.doc_id", "one.twin", "stretch", "windows", "one.at", (F.col("times") == 1).alias("single"), "crowd")
    whole = near.join(kinds.filter("times > 1").select("stretch", "whole"), ["stretch", "whole"]).select(*DOC, F.explode("first").alias("start"), (F.col("windows") - 1 + length).alias("size"))
    whole = whole.select(*DOC, "start", (F.col("start") + F.col("size")).cast("int").alias("stop"))
    return whole.unionAll(contested_spans(docs, written(asked, "asked"), length, block, task_windows, shard_windows))


def remove_repeats(docs: DataFrame, length: int = 400, block: int = 50, task_windows: int = 400_000, shard_windows: int = 50_000) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of every row of ``docs (doc_id, text, ...)``.

    Removed is each byte covered by a string of ``length`` bytes that also starts elsewhere, in the same or
    another row; strings never cross rows and are judged on the input.  ``kept``: the other bytes.  A null text is
    empty; a null ``doc_id`` stays null.  Rows that repeat an id and a text repeat each other.  ``block`` must not exceed ``length``.
    """
    source = identified(docs)
    spans = written(repeated_spans(source, length, block, task_windows, shard_windows), "spans")
    packed = spans.groupBy(*DOC).agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, "text"):
                rows = []
                for doc, text, spans, no_id in zip(*(part.column(c) for c in ("doc_id", "text", "spans", "no_id"))):
                    data = text.as_buffer().to_pybytes() if text.is_valid else b""
                    pieces, done, count = [], 0, 0
                    for s in spans.as_py() or ():
                        if s["start"] > done or not count:
                            pieces.append(data[done : s["start"]])
                            count += 1
                        done = max(done, s["stop"])
                    kept = b"".join([*pieces, data[done:]])
                    rows.append((None if no_id.as_py() else doc.as_py(), len(data), len(data) - len(kept), count, hashlib.sha256(kept).hexdigest(), kept))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[c.split()[0] for c in schema.split(", ")])

    return source.join(packed, DOC, "left").mapInArrow(cut, schema)
