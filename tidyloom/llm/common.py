"""What several operators share: written tables, components of links, batches of texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder name on the storage that ``spark.checkpoint.dir`` names, which all machines share.

    Only where it is unset and Spark runs on one machine, the folder is a temporary one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """The same rows from a table on shared storage: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = work_folder(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it, so that no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def components(edges: DataFrame, name: str = "links", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` of every node of ``edges (a, b)``; a component is named by its smallest node.

    Alternating large-star and small-star rounds: each is one aggregation and one join on the
    nodes, and each round's edges are a written table.  Rounds grow with the logarithm of the longest
    chain.  Loops and repeated edges do no harm; nulls must not occur.  No edges give no rows.
    """

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()

    def both_ways(df: DataFrame) -> DataFrame:
        return df.unionAll(df.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def stars(df: DataFrame) -> DataFrame:
        low = df.groupBy("a").agg(F.min("b").alias("low"))
        return df.join(low, "a").withColumn("low", F.least("a", "low"))

    here = edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint"))
    here = written(here.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = state(here)
    for _ in range(max_rounds):
        if not before[0]:
            break
        large = stars(both_ways(here)).filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = large.distinct()
        small = stars(small).select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        here = written(small.select("e.a", "e.b").filter("a <> b").distinct(), name)
        after = state(here)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = here.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return here.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)


def text_parts(batch: pa.RecordBatch, column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into parts of about ``max_bytes`` of text, so that working arrays stay small."""
    ends = np.cumsum(text_lengths(batch.column(column)))
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + max_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_lengths(texts: pa.Array) -> np.ndarray:
    """Bytes of each text; a null has none."""
    return np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes in one array, and the ``n + 1`` places where texts start and the last ends."""
    lengths = text_lengths(texts)
    joined = b"".join(x.as_buffer().to_pybytes() if x.is_valid else b"" for x in texts)
    return np.frombuffer(joined, dtype=np.uint8), np.concatenate(([0], np.cumsum(lengths)))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``0..n-1`` over the links ``left[i] - right[i]``."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


#: Blank and 0x09-0x0D end a word.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True


def byte_codes() -> np.ndarray:
    codes = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    codes[65:91] = codes[97:123]  # A-Z as a-z
    return codes


CODES = byte_codes()


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0, 1, ..., n - 1`` modulo 2^64."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        out[done : 2 * done] = out[: min(done, n - done)] * step
        done *= 2
    return out


def span_hashes(data: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
    """A hash of the length and every byte, A-Z as a-z, of each ``data[opens[i]:closes[i]]``."""
    base, inverse = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(CODES[data] * powers(base, len(data)), out=sums[1:])
    hashes = (sums[closes] - sums[opens]) * powers(inverse, len(data) + 1)[opens]
    return mix64(hashes + (closes - opens).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, A-Z as a-z, and where each text's begin and the last end.

    Words are runs of bytes other than blank and 0x09-0x0D; texts never share a word.  A hash covers the
    length and every byte of its word.
    """
    word = ~SPACES[data] if len(data) else np.zeros(0, bool)
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    before = np.concatenate(([False], word))
    after = np.concatenate((word, [False]))
    opens = np.flatnonzero(after & (~before | edge))
    closes = np.flatnonzero(before & (~after | edge))
    hashes = span_hashes(data, opens, closes)
    first = np.searchsorted(opens, starts)  # of each text, among the words
    return hashes, first
