"""Collocations by top-order marginalisation: only the longest windows are counted, Spark's ROLLUP gives all shorter ones.

A window is a word and the ``order - 1`` words that lead on from it within its piece, padded behind the piece's end.  Equal
windows are counted, and one ROLLUP over language and window columns sums their counts: the sums at the
first ``k`` columns are the occurrences of phrases of ``k`` words, those at the language all its words.

A phrase that is asked for is frequent, and so is every shorter one in it.  So hashes of words, of pairs and of triples are
counted first, each only where the shorter ones are frequent, and the frequent ones become a Bloom filter of a fixed size;
windows are padded behind the first of them that it does not hold.  What it holds by mistake costs rows, never results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidyloom.llm.common import mix64, span_hashes, text_bytes, text_parts, written
from tidyloom.llm.words import byte_set, word_array, word_edges

BETWEEN = byte_set(b" \t.,;:!?\n\x0b\x0c\r")
BREAKS = byte_set(b".,;:!?\n\x0b\x0c\r")
SALTS = 64
GROUP_BYTES = 4 << 20


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places in a filter of ``bits`` for the first 56 bits of each hash."""
    hashes = hashes >> np.uint64(8) << np.uint64(8)
    hashes = mix64(hashes + np.uint64(1))
    return hashes % np.uint64(bits), mix64(hashes) % np.uint64(bits)


def in_filter(held: np.ndarray, hashes: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which of the ``hashes`` that are ``asked`` the filter holds."""
    at = np.flatnonzero(asked)
    out = np.ones(len(at), bool)
    for place in places(hashes[at], len(held) * 64):
        out &= (held[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    found = np.zeros(len(hashes), bool)
    found[at[out]] = True
    return found


class Pieces:
    """The words of texts of one language, numbered, and which words are followed by another one of their piece."""

    def __init__(self, texts: pa.Array, lang: str):
        data, starts = text_bytes(texts)
        opens, closes = word_edges(data, starts, BETWEEN)
        coded = word_array(data, opens, closes).dictionary_encode()
        self.words, self.ids = coded.dictionary, np.asarray(coded.indices)
        # A word and its successor are in one piece if no break and no text's end lies between them.
        broken = np.concatenate(([0], np.cumsum(BREAKS[data] if len(data) else np.zeros(0, bool), dtype=np.int32)))
        text = np.searchsorted(starts, opens, side="right")
        self.joined = (broken[closes[:-1]] == broken[opens[1:]]) & (text[1:] == text[:-1])
        first = np.zeros(len(self.words), np.int64)
        first[self.ids[::-1]] = np.arange(len(self.ids))[::-1]
        name = np.frombuffer(lang.encode() or b"\0", np.uint8)
        salt = span_hashes(name, np.array([0]), np.array([len(name)]))
        self.hashes = mix64(span_hashes(data, opens[first], closes[first]) + salt)

    def grams(self, held: np.ndarray, size: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Hashes of ``size`` words from each word on, and for 1 up to ``size`` words whether they are one that is asked for.

        The words have to lie in one piece, and all shorter grams in them have to be ``held``; the last array is before
        the filter is asked for grams of that size.
        """
        hashes, asked = self.hashes[self.ids], [np.ones(len(self.ids), bool)]
        for k in range(2, size + 1):
            here = asked[-1] & in_filter(held, hashes, asked[-1])
            asked[-1] = here
            hashes = mix64(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[self.ids[k - 1 :]])
            asked.append(here[:-1] & here[1:] & (self.joined if k == 2 else True))
        return hashes, asked


def pieces_of(batches: Iterator[pa.RecordBatch], part_bytes: int) -> Iterator[tuple[str, Pieces]]:
    for batch in batches:
        for part in text_parts(batch, "text", part_bytes):
            langs = part.column("lang").dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                yield lang, Pieces(part.column("text").filter(pc.equal(langs.indices, code)), lang)


def counted_windows(docs: DataFrame, order: int, held: np.ndarray, part_bytes: int) -> DataFrame:
    """``lang, w1, ..., n``: equal windows of a part of a task's texts as one row.

    Pads are nulls.  ``held``: a Bloom filter of grams of up to ``order - 1`` words; behind the first gram that it lacks all is padding.
    """
    names = [f"w{k}" for k in range(1, order + 1)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, pieces in pieces_of(batches, part_bytes):
            # Windows are numbered column by column: equal numbers so far and equal next words are equal windows.
            columns = []
            for k, alive in enumerate(pieces.grams(held, order)[1][: len(pieces.ids)]):
                lead = np.full(len(pieces.ids), -1, pieces.ids.dtype)
                lead[: len(alive)] = np.where(alive, pieces.ids[k:], -1)
                columns.append(lead)
            columns += [np.full(len(pieces.ids), -1, pieces.ids.dtype)] * (order - len(columns))
            number, wide = columns[0].astype(np.int64) + 1, len(pieces.words) + 1
            for lead in columns[1:]:
                number = np.unique(number, return_inverse=True)[1] * wide + lead + 1
            _, at, times = np.unique(number, return_index=True, return_counts=True)
            del number
            for low in range(0, len(at), 100_000):
                some = at[low : low + 100_000]
                out = [pieces.words.take(pa.array(c[some], mask=c[some] < 0)) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), *out, pa.array(times[low : low + 100_000])], names=["lang", *names, "n"])

    schema = ", ".join(["lang string", *(f"{c} string" for c in names), "n bigint"])
    return docs.mapInArrow(count, schema)


def frequent(docs: DataFrame, size: int, least: int, bits: int, part_bytes: int, held: np.ndarray, bucket_bits: int) -> np.ndarray:
    """The Bloom filter ``held`` of shorter grams with all grams of ``size`` words that occur ``least`` times.

    Counted are grams whose shorter grams are all held.  At most ``bits / 32`` sums reach the driver.  Grams are counted by 56-bit
    hashes: where two share one, the filter may hold one too many, never one too few.  Their first ``bucket_bits`` say which
    group counts them; a row holds all that a part of a task's texts has for a group.
    """
    low_bits = np.uint64(56 - bucket_bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pieces in pieces_of(batches, part_bytes):
            if len(pieces.ids) < size:
                continue
            hashes, asked = pieces.grams(held, size)
            hashes, times = np.unique(hashes[asked[-1]] >> np.uint64(8), return_counts=True)
            bucket = (hashes >> low_bits).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))[: len(bucket)])
            rests = (hashes & ((np.uint64(1) << low_bits) - np.uint64(1))).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
            counts = times.astype("<u4").tobytes()
            edges = [*first.tolist(), len(bucket)]
            blobs = [(rests[6 * a : 6 * b], counts[4 * a : 4 * b]) for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), *(pa.array([x[k] for x in blobs], pa.binary()) for k in range(2))], names=["bucket", "rests", "counts"])

    def mark(table: pa.Table) -> pa.Table:
        rests = np.frombuffer(b"".join(table.column("rests").to_pylist()), np.uint8).reshape(-1, 6)
        wide = np.zeros((len(rests), 8), np.uint8)
        wide[:, :6] = rests
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<u4").astype(np.int64)
        rest, which = np.unique(wide.view("<u8").ravel(), return_inverse=True)
        often = rest[np.bincount(which, weights=counts, minlength=len(rest)) >= least].astype(np.uint64)
        hashes = (np.uint64(table.column("bucket")[0].as_py()) << low_bits | often) << np.uint64(8)
        place = np.unique(np.concatenate(places(hashes, bits)))
        return pa.table({"slot": pa.array((place // 32).astype(np.int64)), "bit": pa.array(np.uint64(1) << place % np.uint64(32)).cast(pa.int64())})

    counted = docs.mapInArrow(count, "bucket bigint, rests binary, counts binary")
    marked = counted.groupBy("bucket").applyInArrow(mark, "slot bigint, bit bigint").groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    halves = np.zeros(bits // 32, np.uint32)
    halves[np.asarray(marked.column("slot").combine_chunks())] = np.asarray(marked.column("bits").combine_chunks())
    found = halves.view("<u8").astype(np.uint64)
    return found | held


def phrase_counts(docs: DataFrame, order: int, least: int, filter_bits: int, part_bytes: int) -> tuple[DataFrame, DataFrame]:
    """``lang, words, phrase, f`` of all phrases of 1 to ``order`` words with ``f >= least``, and ``lang, n`` of all words."""
    held = np.zeros(filter_bits // 64, np.uint64)
    # A group of counts for every few MB of text.
    text = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    bucket_bits = max(8, min(40, int(text // GROUP_BYTES).bit_length()))
    for size in range(1, order):
        held = frequent(docs, size, least, filter_bits, part_bytes, held, bucket_bits)
    names = [f"w{k}" for k in range(1, order + 1)]
    windows = counted_windows(docs, order, held, part_bytes).groupBy("lang", *names).agg(F.sum("n").alias("n"))
    sums = windows.rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    # At the level of k words the last 'order - k' columns are summed over; a pad in the first k is a shorter phrase.
    size = F.expr("CASE " + " ".join(f"WHEN level = {(1 << (order - k)) - 1} THEN {k}" for k in range(order + 1)) + " END")
    whole = F.expr("CASE " + " ".join(f"WHEN words = {k} THEN w{k} IS NOT NULL" for k in range(1, order + 1)) + " ELSE true END")
    kept = sums.withColumn("words", size).filter(F.col("words").isNotNull() & whole & ((F.col("words") == 0) | (F.col("f") >= least)))
    kept = written(kept.select("lang", "words", F.concat_ws(" ", *names).alias("phrase"), "f"), "phrases")
    return kept.filter("words > 0"), kept.filter("words = 0").select("lang", F.col("f").alias("n"))


def collocations(
    docs: DataFrame,
    least: int = 30,
    order: int = 4,
    top: int = 2000,
    cover_percent: int = 80,
    filter_bits: int = 1 << 25,
    part_bytes: int = 8 << 20,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best ``top`` phrases of 2 to ``order`` words of each language.

    Texts of ``docs (text, lang, ...)``, A-Z as a-z, are cut at ``. , ; : ! ?`` and 0x0A-0x0D into pieces and at blanks and tabs into words.
    Candidates occur ``least`` times; ``a`` counts them, ``n`` all words of the language.  A cut leaves a first part that
    occurs ``l`` times and a rest that occurs ``r`` times; a phrase has the score of its lowest cut, of equal ones the first:
    the whole part of ``2000000 * a / (l + r)``.  A candidate is left out if it lies within a longer one that occurs
    ``cover_percent`` of a hundred times as often or more.  Ranks are by score, then ``a``, then the phrase's bytes.

    A null text is empty, a null language is ``und``.  Repeated rows count as often as they occur, and ids are not read.  A
    language without candidates, and an empty table, give no rows.
    """
    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    counts, words = phrase_counts(source, order, least, filter_bits, part_bytes)
    candidates = counts.filter("words > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    # Every cut with the occurrences of its two parts; these are frequent, as the whole phrase is.
    known = counts.select("lang", "phrase", "f")
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("w", F.lit(1), k), " ").alias("head"), F.array_join(F.slice("w", k + 1, F.size("w")), " ").alias("rest"))))
    cuts = candidates.select("lang", "phrase", "a", cut.alias("c")).select("lang", "phrase", "a", "c.*")
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("CAST(2000000 AS DECIMAL(8,0)) * CAST(a AS DECIMAL(19,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("low"))

    # The most frequent longer candidate that holds each shorter phrase.
    sizes = F.sequence(F.lit(2), F.size("w") - 1)
    inner = F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))))
    longer = candidates.filter(F.size("w") > 2).select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("around"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    covered = F.expr(f"CAST(100 AS DECIMAL(3,0)) * CAST(around AS DECIMAL(19,0)) >= CAST({int(cover_percent)} AS DECIMAL(3,0)) * CAST(a AS DECIMAL(19,0))")
    left = scored.join(longer, ["lang", "phrase"], "left").filter(F.col("around").isNull() | ~covered)

    # Each of several parts of a language keeps its best before the language is ranked.
    best = [F.col("low.score").desc(), F.col("a").desc(), F.col("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*best)
    left = left.withColumn("place", F.row_number().over(part)).filter(F.col("place") <= top)
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "low.l", "low.r", "n", "low.score")
