"""JSON arrays and csv files with quoted line breaks, cut by tasks.

Neither can be cut without knowing whether a place lies within quotes.  So every byte range of a file is read for what it
does to the state: whether it leaves quotes as it found them, and by how much it changes the depth of brackets, for both
states it may begin in.  These summaries are composed along each file, one short row a range, and then each range knows its
first state and hands out the records that begin in it, reading on behind its end for the last one.  Spark parses the
records.  A file of a single range needs no summary and is read once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import OPEN_COST_BYTES, open_filesystem

RANGE_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20
#: What is read first behind a range, for its last record.
AHEAD_BYTES = 16 << 10

QUOTE, BACKSLASH, NEWLINE, RETURN, COMMA, APOSTROPHE = b'"\\\n\r,\''
#: What a bracket does to the depth; 2 marks bytes that matter in other ways.
_DEPTH = np.zeros(256, np.int8)
_DEPTH[list(b"[{")] = 1
_DEPTH[list(b"]}")] = -1
_STRUCTURE = _DEPTH != 0
_STRUCTURE[[COMMA, APOSTROPHE]] = True
_BLANK = b" \t\r\n"
_STATE = ("inside", "depth", "kind", "over")

_LAYOUT = ("pathGlobFilter", "recursiveFileLookup", "modifiedBefore", "modifiedAfter", "basePath", "ignoreMissingFiles")
_COMPRESSED = (".gz", ".bz2", ".zst", ".zstd", ".lz4", ".snappy", ".deflate", ".xz")


class Bytes:
    """A file's bytes, with blanks in place of a byte order mark."""

    def __init__(self, stream: pa.NativeFile, blank: bytes):
        self.stream, self.blank = stream, blank
        self.marked = stream.read_at(3, 0) == b"\xef\xbb\xbf"

    def read_at(self, count: int, at: int) -> bytes:
        data = self.stream.read_at(count, at)
        if self.marked and at < 3:
            mark = min(3 - at, len(data))
            data = self.blank * mark + data[mark:]
        return data


class Json:
    """State along a JSON text: within a string or not, behind a backslash or not, and the depth of brackets."""

    def __init__(self, inside: bool, escaped: bool, depth: int):
        self.inside, self.escaped, self.depth = inside, escaped, depth

    def quotes(self, data: np.ndarray) -> np.ndarray:
        """Places of the quotes that no backslash escapes."""
        found = np.flatnonzero(data == QUOTE)
        slashes = np.flatnonzero(data == BACKSLASH)
        escaped, self.escaped = self.escaped, False
        if not len(slashes):
            return found[found > 0] if escaped else found
        first = np.concatenate(([True], np.diff(slashes) != 1))
        begin, end = slashes[first], slashes[np.concatenate((first[1:], [True]))] + 1
        odd = (end - begin) % 2 == 1
        if escaped and begin[0] == 0:
            odd[0] = not odd[0]
        elif escaped:
            found = found[found > 0]
        self.escaped = bool(odd[-1] and end[-1] == len(data))
        return found[~np.isin(found, end[odd])]

    def structure(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Brackets, commas and apostrophes: their places, whether they lie in strings, and what they do to the depth."""
        quotes = self.quotes(data)
        at = np.flatnonzero(_STRUCTURE[data])
        within = (np.searchsorted(quotes, at) + self.inside) % 2 == 1
        self.inside ^= bool(len(quotes) % 2)
        return at, within, _DEPTH[data[at]].astype(np.int64)


def _blocks(stream: Bytes, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    for at in range(start, stop, BLOCK_BYTES):
        yield at, stream.read_at(min(BLOCK_BYTES, stop - at), at)


def _piece(stream: Bytes, at: int, stop: int, size: int) -> bytes:
    """What is read next: nothing behind the range together with it, then pieces that double, as the last record mostly ends soon."""
    count = stop - at if at < stop else AHEAD_BYTES + at - stop
    return stream.read_at(min(BLOCK_BYTES, count, size - at), at)


def _is_escaped(stream: Bytes, start: int) -> bool:
    """Whether an odd number of backslashes lies before ``start``."""
    count, at = 0, start
    while at:
        low = max(0, at - 1024)
        data = stream.read_at(at - low, low)
        run = len(data) - len(data.rstrip(b"\\"))
        count += run
        if run < len(data):
            break
        at = low
    return count % 2 == 1


def json_summary(stream: Bytes, start: int, stop: int) -> tuple[bool, int, int, int]:
    """Does the range end on the other side of a quote; its change of depth if it begins outside, or inside a string; its first byte that is no blank."""
    state, sums, kind = Json(False, _is_escaped(stream, start), 0), [0, 0], 0
    for _, block in _blocks(stream, start, stop):
        _, within, depth = state.structure(np.frombuffer(block, np.uint8))
        sums[0] += int(depth[~within].sum())
        sums[1] += int(depth[within].sum())
        if not kind:
            kind = (block.lstrip(_BLANK) or b"\0")[0]
    return state.inside, sums[0], sums[1], kind


def json_records(stream: Bytes, path: str, start: int, stop: int, size: int, inside: bool, depth: int, kind: int, over: bool) -> Iterator[list[bytes]]:
    """The elements of the array that begin in the range; of another document its first range gives the whole.  ``over``: the document's end is behind."""
    array = kind == ord("[")
    if not array and start:
        return
    state = Json(inside, _is_escaped(stream, start), depth)
    kept: list[bytes] | None = None if array or not kind else []  # parts of the open record
    at = start
    while at < size and (at < stop or kept is not None):
        block = _piece(stream, at, stop, size)
        if over:
            _refuse_rest(path, block[: max(0, stop - at)])
            at += len(block)
            continue
        places, within, steps = state.structure(np.frombuffer(block, np.uint8))
        places, steps = places[~within], steps[~within]
        kinds = np.frombuffer(block, np.uint8)[places]
        if array and (kinds == APOSTROPHE).any():
            raise ValueError(f"{path}: an apostrophe outside of strings; set splittable to false to read other than strict JSON")
        depths = state.depth + np.cumsum(steps)
        state.depth = int(depths[-1]) if len(depths) else state.depth
        if array:
            # The array's own bracket, the commas between elements, and the bracket that closes it.
            cuts = np.flatnonzero(((kinds == COMMA) & (depths == 1)) | ((steps == 1) & (depths == 1)) | ((steps == -1) & (depths == 0)))
        else:
            cuts = np.flatnonzero((steps == -1) & (depths == 0))[:1]
        out, begin = [], 0
        for cut in cuts.tolist():
            place, closes = int(places[cut]), depths[cut] == 0
            if kept is not None:
                out.append(b"".join([*kept, block[begin : place if array else place + 1]]))
            kept, begin = ([], place + 1) if not closes and at + place < stop else (None, place + 1)
            if closes:
                over = True
                _refuse_rest(path, block[begin : max(begin, (stop if array else size) - at)])
                break
            if kept is None:
                break
        if kept is not None:
            kept.append(block[begin:])
        yield [x for x in out if x.strip(_BLANK)]
        if not array and over:
            stop = size  # nothing may follow the only record
        elif kept is None and at + len(block) >= stop:
            break
        at += len(block)
    if kept and b"".join(kept).strip(_BLANK):
        yield [b"".join(kept)]  # cut short: the parser decides


def _refuse_rest(path: str, rest: bytes) -> None:
    if rest.strip(_BLANK):
        raise ValueError(f"{path}: something follows the document; for a document a line set multiLine to false")


def csv_summary(stream: Bytes, start: int, stop: int) -> tuple[bool, int, int, int]:
    count = sum(block.count(b'"') for _, block in _blocks(stream, start, stop))
    return count % 2 == 1, 0, 0, 0


def csv_records(stream: Bytes, path: str, start: int, stop: int, size: int, inside: bool, separator: int) -> Iterator[list[bytes]]:
    """The records that begin in the range, without their line breaks."""
    before = stream.read_at(1, start - 1)[0] if start else NEWLINE
    kept: list[bytes] | None = [] if before == NEWLINE and not inside else None  # parts of the open record
    at = start
    while at < size and (at < stop or kept is not None):
        block = _piece(stream, at, stop, size)
        data = np.frombuffer(block, np.uint8)
        quotes = np.flatnonzero(data == QUOTE)
        opens = quotes[int(inside) :: 2]
        ahead = np.where(opens > 0, data[np.maximum(opens - 1, 0)], before)
        if not np.isin(ahead, (separator, NEWLINE, RETURN, QUOTE)).all():
            raise ValueError(f"{path}: a quote within an unquoted field; set splittable to false to read such files")
        breaks = np.flatnonzero(data == NEWLINE)
        breaks = breaks[(np.searchsorted(quotes, breaks) + inside) % 2 == 0]
        out, begin = [], 0
        for place in breaks.tolist():
            if kept is not None:
                out.append(b"".join([*kept, block[begin:place]]))
            begin = place + 1
            kept = [] if at + begin < stop else None
            if kept is None and at + begin >= stop:
                break
        if kept is not None:
            kept.append(block[begin:])
        inside ^= bool(len(quotes) % 2)
        before = block[-1] if block else before
        yield [x for x in (r.removesuffix(b"\r") for r in out) if x]
        at += max(1, len(block))
    if kept and (rest := b"".join(kept).removesuffix(b"\r")):
        yield [rest]


def can_split(spark: SparkSession, path: str, options: dict) -> bool:
    """Whether the files can be cut: not told otherwise, in UTF-8, and not compressed."""
    if str(options.get("splittable", True)).lower() == "false":
        return False
    encoding = str(options.get("encoding") or options.get("charset") or "utf-8").lower()
    return encoding in ("utf-8", "utf8") and not path.rstrip("/*").lower().endswith(_COMPRESSED) and "compression" not in options


def records(spark: SparkSession, path: str, options: dict, summary: Callable, cut: Callable, blank: bytes, range_bytes: int) -> DataFrame | None:
    """``value`` and the columns of partition folders: a row per record; None if a file is compressed.

    ``summary(stream, start, stop)`` and ``cut(stream, path, start, stop, size, first, *state)``.  Files are listed
    as by Spark's readers.  The rows of a file are in no order.
    """
    layout = {k: v for k, v in options.items() if k in _LAYOUT}
    files = spark.read.options(**layout).format("binaryFile").load(path)
    folders = [c for c in files.columns if c not in ("path", "modificationTime", "length", "content")]
    files = files.select("path", "length", *[F.col(f"`{c}`") for c in folders])
    # What Spark listed: names and the sum of sizes, without a job.
    listed = files._jdf.queryExecution().analyzed().collectLeaves().apply(0).relation().location()
    names, total = list(listed.inputFiles()), listed.sizeInBytes()
    if any(name.lower().endswith(_COMPRESSED) for name in names):
        return None
    # Ranges smaller than what opening a file costs share a task, once every core has a few.
    several = min(-(-total // range_bytes), 4 * spark.sparkContext.defaultParallelism)
    tasks = max(1, -(-(total + len(names) * OPEN_COST_BYTES) // max(range_bytes, OPEN_COST_BYTES)), several)
    each = F.greatest(F.ceil(F.col("length") / range_bytes), F.lit(1))
    ranges = files.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), each - 1)).alias("part"))

    def spans(batch: pa.RecordBatch) -> Iterator[tuple]:
        for row, (name, size, part) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "length", "part")))):
            fs, inner = open_filesystem(name)
            with fs.open_input_file(inner) as stream:
                yield row, name, Bytes(stream, blank), part * range_bytes, min(size, (part + 1) * range_bytes), size, part

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(name, part, *summary(stream, start, stop)) for _, name, stream, start, stop, _, part in spans(batch)]
            types = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["path", "part", "flips", "outside", "within", "kind"])

    def compose(table: pa.Table) -> pa.Table:
        inside, depth, begun, out = False, 0, False, []
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        kind = next((r["kind"] for r in rows if r["kind"]), 0)
        for r in rows:
            over = begun and depth == 0 and not inside
            begun |= r["kind"] != 0
            out.append((r["path"], r["part"], inside, depth, kind, over))
            depth += r["within"] if inside else r["outside"]
            inside ^= r["flips"]
        types = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.bool_())
        return pa.Table.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["path", "part", *_STATE])

    state = dict(zip(_STATE, (F.lit(False), F.lit(0).cast("bigint"), F.lit(0), F.lit(False))))
    if total > range_bytes:
        long = ranges.filter(F.col("length") > range_bytes).select("path", "length", "part").repartition(tasks)
        states = long.mapInArrow(summarize, "path string, part bigint, flips boolean, outside bigint, within bigint, kind int")
        states = states.groupBy("path").applyInArrow(compose, "path string, part bigint, inside boolean, depth bigint, kind int, over boolean")
        ranges = ranges.join(states, ["path", "part"], "left").select(*ranges.columns, *[F.coalesce(c, v).alias(c) for c, v in state.items()])
    else:
        ranges = ranges.select("*", *[v.alias(c) for c, v in state.items()])

    def hand_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, name, stream, start, stop, size, part in spans(batch):
                begun = [batch.column(c)[row].as_py() for c in _STATE]
                for texts in cut(stream, name, start, stop, size, part == 0, *begun):
                    if texts:
                        where = pa.array([row] * len(texts))
                        columns = [pa.array(texts, pa.binary()).cast(pa.string()), *(batch.column(c).take(where) for c in folders)]
                        yield pa.RecordBatch.from_arrays(columns, names=["value", *folders])

    schema = ", ".join(["value string", *(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema if f.name in folders)])
    return ranges.repartition(tasks).mapInArrow(hand_out, schema)


def split_json(spark: SparkSession, path: str, options: dict, range_bytes: int = RANGE_BYTES) -> DataFrame | None:
    """A row per document, or per element of a document that is an array."""

    def cut(stream, name, start, stop, size, first, inside, depth, kind, over) -> Iterator[list[bytes]]:
        if first and not kind:
            kind = json_summary(stream, 0, min(size, BLOCK_BYTES))[3] if size else 0
        return json_records(stream, name, start, stop, size, inside, depth, kind, over)

    return records(spark, path, options, json_summary, cut, b" ", range_bytes)


def split_csv(spark: SparkSession, path: str, options: dict, header: bool, separator: str, range_bytes: int = RANGE_BYTES) -> DataFrame | None:
    """A row per record, without each file's first one if it is a header."""

    def cut(stream, name, start, stop, size, first, inside, depth, kind, over) -> Iterator[list[bytes]]:
        skip = header and first
        for texts in csv_records(stream, name, start, stop, size, inside, ord(separator)):
            if skip and texts:
                texts, skip = texts[1:], False
            yield texts

    return records(spark, path, options, csv_summary, cut, b"\n", range_bytes)
