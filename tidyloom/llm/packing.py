"""Mixture-controlled packing: deficit round-robin over source queues fills windows of tokens.

Every source is a queue of documents.  In each round a queue earns credit in proportion to its target, sends the
documents (long ones in units) that its credit covers, and carries the rest, its deficit, into the next round.  What is
sent forms one stream, cut every ``size`` tokens into sequences.  The credit after any number of rounds is known, so the
round that sends a unit follows from its place in its queue, and a unit's place in the stream from sums over the rounds
before: rounds are dealt out to tasks in bins, each with the sum of the bins before it.

Where targets differ from what the queues hold, a queue that runs dry ends a phase, and the others share
its credit in the next one.
"""

from __future__ import annotations

import json
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidyloom.llm.common import span_hashes, text_parts, written

# The word pattern of vocabularies with word ends, for characters below 256.
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
WORD_END = "</w>"
SPACE, LETTER, DIGIT, MARK = range(4)
ONE_LETTER, TWO_LETTERS = b"stmd", (b"re", b"ve", b"ll")

KNOWN_WORDS = 1_500_000


def character_kinds() -> np.ndarray:
    kinds = np.full(256, MARK, np.uint8)
    for i in range(256):
        c = chr(i)
        if c.isalpha():
            kinds[i] = LETTER
        elif c.isnumeric():
            kinds[i] = DIGIT
        elif c in "\t\n\x0b\x0c\r \x85\xa0":
            kinds[i] = SPACE
    return kinds


KIND = character_kinds()
LOWER = np.array([ord(chr(i).lower()) for i in range(256)], np.uint8)


class WordTokenizer:
    """Ids of whole texts by a tokenizer that treats words separately; a word's ids are kept for the next one.

    Texts of characters below 256 without special tokens are cut into words in numpy, and the tokenizer sees
    only words that are not known yet; all other texts, and all texts of other tokenizers, go through it
    as a whole.  Words are told apart by 64-bit hashes.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends_word = np.zeros(size, bool)
        self.ends_word[[i for word, i in vocabulary.items() if word.endswith(WORD_END)]] = True
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        self.by_word = json.dumps(WORD_PATTERN)[1:-1] in json.dumps(stated.get("pre_tokenizer")) and stated["model"].get("end_of_word_suffix") == WORD_END
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes of words, in order
        self.slot = np.zeros(0, np.int64)  # and where their places are
        self.place = np.zeros(1, np.int64)  # of words' ids in the bank, and its end
        self.bank = np.zeros(0, self.dtype)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Encode new words (``hashes`` in order), many at a time: each ends with an id that ends a word."""
        sizes, ids = [], [self.bank]
        for i in range(0, len(words), 1000):
            group = words[i : i + 1000]
            got = self.whole([" ".join(group)])[0]
            ends = np.flatnonzero(self.ends_word[got]) + 1
            if len(ends) == len(group) and ends[-1] == len(got):
                sizes.append(np.diff(ends, prepend=0))
                ids.append(got)
            else:
                each = self.whole(group)
                sizes.append(np.array([len(x) for x in each]))
                ids.extend(each)
        at = np.searchsorted(self.known, hashes)
        self.slot = np.insert(self.slot, at, np.arange(len(self.known), len(self.known) + len(hashes)))
        self.known = np.insert(self.known, at, hashes)
        self.place = np.concatenate((self.place, self.place[-1] + np.cumsum(np.concatenate(sizes))))
        self.bank = np.concatenate(ids)

    def cut(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of lower-case ``data`` open and close."""
        kind = KIND[data]
        opens = kind != SPACE
        opens[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        for at in np.flatnonzero(data == 39):
            if opens[at]:
                follow = data[at + 1 : at + 3].tobytes()
                size = 1 if follow[:1] and follow[:1] in ONE_LETTER else 2 if follow in TWO_LETTERS else 0
                if size:
                    opens[at + 1] = False
                    if at + 1 + size < len(data) and kind[at + 1 + size] == LETTER:
                        opens[at + 1 + size] = True
        after = np.ones(len(data) + 1, bool)
        after[:-1] = opens | (kind == SPACE)
        after[1:] &= kind != SPACE
        after[0] = False
        return np.flatnonzero(opens), np.flatnonzero(after)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        plain: list[bytes | None] = []
        for text in texts:
            try:
                plain.append(text.encode("latin-1") if self.by_word and "<|" not in text else None)
            except UnicodeEncodeError:
                plain.append(None)
        data = LOWER[np.frombuffer(b"\n".join(x for x in plain if x is not None), np.uint8)]
        opens, closes = self.cut(data)
        out = np.zeros(0, self.dtype)
        ends = np.zeros(0, np.int64)
        if len(opens):
            hashes = span_hashes(data, opens, closes)
            distinct, first, where = np.unique(hashes, return_index=True, return_inverse=True)
            if len(self.known) > KNOWN_WORDS:
                self.forget()
            at = np.searchsorted(self.known, distinct)
            new = np.ones(len(distinct), bool)
            inside = at < len(self.known)
            new[inside] = self.known[at[inside]] != distinct[inside]
            if new.any():
                raw = data.tobytes()
                self.learn(distinct[new], [raw[opens[f] : closes[f]].decode("latin-1") for f in first[new]])
                at = np.searchsorted(self.known, distinct)
            word = self.slot[at][where]
            begin, count = self.place[word], self.place[word + 1] - self.place[word]
            ends = np.cumsum(count)
            out = self.bank[np.arange(ends[-1]) + np.repeat(begin - (ends - count), count)]
        edges = np.cumsum([0] + [len(x) + 1 for x in plain if x is not None])
        upto = np.concatenate(([0], ends))[np.searchsorted(opens, edges)]
        rest = iter(self.whole([t for t, x in zip(texts, plain) if x is None]))
        part = iter(range(len(edges) - 1))
        return [next(rest) if x is None else out[upto[i := next(part)] : upto[i + 1]] for x in plain]


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int, queue: str = "source") -> DataFrame:
    """``doc_id, queue, tokens, ids, wide, task, inner``: the ids of every whole text and ``end_id``.

    ``ids``: little-endian numbers of 16 bits, or 32 where ``wide``.  ``inner``: the ids of the same queue before
    this row in its task.  Only a written table of these rows is used: a task that is run again replaces all
    of its rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(tokenizer_path)
        task = TaskContext.get().partitionId()
        end = np.asarray([end_id], tokenizer.dtype).tobytes()
        done: dict[str | None, int] = {}
        for batch in batches:
            for part in text_parts(batch, "text", 2 << 20):
                ids = [x.tobytes() + end for x in tokenizer.ids([t or "" for t in part.column("text").to_pylist()])]
                sizes = [len(x) // tokenizer.dtype.itemsize for x in ids]
                inner = []
                for name, size in zip(part.column("queue").to_pylist(), sizes):
                    inner.append(done.get(name, 0))
                    done[name] = inner[-1] + size
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("queue"),
                        pa.array(sizes, pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array([tokenizer.dtype.itemsize == 4] * n),
                        pa.array([task] * n, pa.int32()),
                        pa.array(inner, pa.int64()),
                    ],
                    names=["doc_id", "queue", "tokens", "ids", "wide", "task", "inner"],
                )

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(queue).cast("string").alias("queue"), "text")
    return source.mapInArrow(encode, "doc_id bigint, queue string, tokens bigint, ids binary, wide boolean, task int, inner bigint")


def tokenizer_of(path: str) -> WordTokenizer:
    """One for all tasks of a Python worker, so that they share its known words."""
    shared = sys.modules.setdefault("tidyloom_worker", types.ModuleType("tidyloom_worker"))
    if getattr(shared, "tokenizer", (None,))[0] != path:
        shared.tokenizer = (path, WordTokenizer(path))
    return shared.tokenizer[1]


def phases(totals: dict[str | None, int], weights: dict[str, float]) -> list[tuple[str | None, int, int, int, int]]:
    """``queue, begin, end, offset, width``: while the stream goes from ``offset`` on for ``width`` tokens, the queue sends
    its tokens from ``begin`` to ``end``.

    Queues with a weight send in proportion to it; one that runs dry ends a phase, and the others share its credit in the
    next one.
    """
    left = {q: n for q, n in totals.items() if n > 0}
    begin, offset, out = dict.fromkeys(left, 0), 0, []
    while left:
        length = min(n / weights[q] for q, n in left.items())
        sends = {q: n if n / weights[q] <= length * (1 + 1e-12) else min(n, int(length * weights[q])) for q, n in left.items()}
        width = sum(sends.values())
        out += [(q, begin[q], begin[q] + n, offset, width) for q, n in sends.items() if n]
        offset += width
        begin = {q: begin[q] + n for q, n in sends.items()}
        left = {q: n - sends[q] for q, n in left.items() if n > sends[q]}
    return out


def timed_units(tokens: DataFrame, unit: int, size: int, weights: dict[str, float] | None, bin_tokens: int) -> DataFrame:
    """The units of all documents with the round that sends them.

    A unit is a document, or ``unit`` tokens of a longer one.  Its queue sends it in the round in which the credit has
    earned a share of it that a hash of the queue fixes, the same for all its units: so the queue is never further than a unit
    from its credit, and queues of few documents do not all send them in the same round.
    """
    spark = tokens.sparkSession
    # Places in the queues: sums by task, then the rows' own places within their tasks.
    sums = tokens.groupBy("queue", "task").agg(F.sum("tokens").alias("all"))
    ahead = Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("all").over(Window.partitionBy("queue"))
    sums = written(sums.select("queue", "task", "all", F.coalesce(F.sum("all").over(ahead), F.lit(0)).alias("ahead"), total.alias("total")), "queues")
    same = (F.col("t.task") == F.col("s.task")) & F.col("t.queue").eqNullSafe(F.col("s.queue"))
    placed = tokens.alias("t").join(sums.select("queue", "task", "ahead", "total").alias("s"), same)
    placed = placed.select("t.doc_id", "t.queue", "t.ids", "t.wide", F.col("t.tokens").alias("doc_tokens"), "s.total", (F.col("s.ahead") + F.col("t.inner")).alias("place"))
    number = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(doc_tokens - 1) div {unit}")))
    units = placed.select("*", number.alias("k")).withColumn("start", F.col("k") * unit)
    units = units.withColumn("length", F.least(F.lit(unit).cast("bigint"), F.col("doc_tokens") - F.col("start"))).withColumn("place", F.col("place") + F.col("start"))
    share = F.pmod(F.xxhash64("queue"), F.lit(1 << 30)) / (1 << 30)
    units = units.withColumn("earned", F.col("place") + share * F.col("length"))
    if weights is None:
        stream = sums.agg(F.sum("all")).head()[0] or 0
        units = units.withColumn("time", F.col("earned") / F.col("total") * stream)
    else:
        named = {q: float(w) for q, w in weights.items() if w > 0}
        rows = sums.filter(F.col("queue").isin(list(named))).groupBy("queue").agg(F.sum("all").alias("all")).collect()
        plan = phases({r["queue"]: r["all"] for r in rows}, named)
        weighed = sum(r["all"] for r in rows)
        rest = (sums.agg(F.sum("all")).head()[0] or 0) - weighed
        plan = spark.createDataFrame(plan, "queue string, first bigint, stop bigint, offset bigint, width bigint").alias("p")
        here = (F.col("u.queue") == F.col("p.queue")) & (F.col("u.earned") >= F.col("p.first")) & (F.col("u.earned") < F.col("p.stop"))
        units = units.alias("u").join(plan, here, "left")
        inside = F.col("p.offset") + (F.col("u.earned") - F.col("p.first")) / (F.col("p.stop") - F.col("p.first")) * F.col("p.width")
        behind = F.lit(weighed) + F.col("u.earned") / F.col("u.total") * rest
        units = units.select("u.*", F.coalesce(inside, behind).alias("time"))
    round_of = F.floor(F.col("time") / size).cast("bigint")
    return units.withColumn("round", round_of).withColumn("bin", F.expr(f"round div {max(1, bin_tokens // size)}"))


def offsets(units: DataFrame) -> DataFrame:
    """``bin, first``: the tokens of the bins before it; two levels, so that no task reads all bins of a long stream."""
    bins = units.groupBy("bin").agg(F.sum("length").alias("all")).withColumn("high", F.expr("bin div 10000"))
    before = Window.orderBy("high").rowsBetween(Window.unboundedPreceding, -1)
    highs = bins.groupBy("high").agg(F.sum("all").alias("all")).select("high", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("high").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return bins.join(highs, "high").select("bin", (F.col("base") + F.coalesce(F.sum("all").over(within), F.lit(0))).alias("first"))


PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, queue string, padded_length bigint"


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 2,
    size: int = 4096,
    queue: str = "source",
    weights: dict[str, float] | None = None,
    unit: int = 1024,
    bin_tokens: int = 1 << 20,
) -> DataFrame:
    """Pack every document of ``docs (doc_id, text, <queue>, ...)``; a row per piece.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue, padded_length``.  Each id, and
    ``end_id`` after each text, lies in exactly one piece, and all sequences but the last are full; the last is
    padded to the next power of two.  In each round of ``size`` tokens a queue earns credit by its weight (tokens by queue,
    relative; by default what the queues hold, so that all run dry together) and sends the documents, or units of ``unit`` tokens of
    longer ones, that its credit covers; the rest is carried on, over windows and partitions.  What a queue has sent
    after any round differs from its credit by less than ``unit`` tokens.  Queues without a weight follow the others, in the
    proportions of what they hold.  There may be any number of queues.

    A null text is empty and gives its ``end_id``.  A null queue is a queue of its own.  A queue holds its
    documents in the order of the tasks that encoded them.  Repeated rows are packed as often as they occur, and ids
    need not differ.  An empty table gives no rows.  Units of about ``bin_tokens`` tokens of the stream are ordered together.
    """
    tokens = written(token_table(docs, tokenizer_path, end_id, queue), "tokens", compression="zstd")
    units = timed_units(tokens, unit, size, weights, bin_tokens)
    first = offsets(units)
    stream = tokens.agg(F.sum("tokens")).head()[0] or 0
    tail = stream % size
    last, padded = stream // size, 1 << max(0, int(tail - 1).bit_length()) if tail else size

    wide = F.when(F.col("wide"), 4).otherwise(2)
    ids = F.expr("substring(ids, CAST(start * bytes + 1 AS INT), CAST(length * bytes AS INT))")
    slim = units.withColumn("bytes", wide).select("bin", "round", "queue", "place", "doc_id", "start", "length", ids.alias("ids"), "bytes", "doc_tokens")
    ordered = Window.partitionBy("bin").orderBy("round", "queue", "place").rowsBetween(Window.unboundedPreceding, -1)
    slim = slim.withColumn("inside", F.coalesce(F.sum("length").over(ordered), F.lit(0)))
    sent = slim.join(first, "bin").withColumn("at", F.col("first") + F.col("inside"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, "ids"):
                at, length, start = (np.asarray(part.column(c)) for c in ("at", "length", "start"))
                # A piece ends where its sequence ends.
                parts = (at % size + length + size - 1) // size
                owner = np.repeat(np.arange(len(at)), parts)
                k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                lead = np.where(k == 0, 0, k * size - (at % size)[owner])
                amount = np.minimum(length[owner] - lead, size - (at[owner] + lead) % size)
                place = at[owner] + lead
                kinds = np.asarray(part.column("bytes"))
                views = [memoryview(np.frombuffer(x.as_buffer(), "<u4" if b == 4 else "<u2").astype("<u4")).cast("B") for x, b in zip(part.column("ids"), kinds)]
                crc = [zlib.crc32(views[d][4 * s : 4 * (s + n)]) for d, s, n in zip(owner.tolist(), lead.tolist(), amount.tolist())]
                rows = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(rows),
                        pa.array(start[owner] + lead),
                        pa.array(amount),
                        pa.array(crc, pa.int64()),
                        part.column("doc_tokens").take(rows),
                        pa.array(place // size),
                        pa.array(place % size),
                        part.column("queue").take(rows),
                        pa.array(np.where(place // size == last, padded, size)),
                    ],
                    names=[c.split()[0] for c in PIECE.split(", ")],
                )

    return sent.select("doc_id", "start", "length", "ids", "bytes", "doc_tokens", "queue", "at").mapInArrow(cut, PIECE)
