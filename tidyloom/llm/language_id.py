"""Language ID with a byte convolutional network: multi-width filters, max pooling, softmax.

The network is trained in numpy on a bounded sample of labelled rows and applied to every whole text, cut
into fixed-length byte windows that are scored in batches; a text's posteriors are the averages of its
windows', weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyloom.llm.common import free_name, text_bytes, text_parts

UNDETERMINED = "und"


@dataclass(frozen=True)
class ByteNetwork:
    """``filters[j, byte, f]``: what ``byte`` at place ``j`` adds to filter ``f``; byte 0 is padding.

    A filter of width ``w`` has zeros at the places from ``w`` on.
    """

    languages: tuple[str, ...]
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray
    window: int

    def pair_tables(self) -> list[np.ndarray]:
        """By two bytes at once: places 0 and 1, places 2 and 3 of the filters."""
        f = self.filters
        return [(f[j][:, None, :] + f[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, len(f), 2)]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(
    texts: list[bytes],
    labels: list[str],
    window: int = 512,
    widths: tuple[int, ...] = (2, 3, 4),
    filters_per_width: int = 10,
    steps: int = 1500,
    batch: int = 64,
    crop: int = 256,
    seed: int = 7,
) -> ByteNetwork:
    """Fit the network with Adam on random crops of 12 to ``crop`` bytes, classes drawn evenly."""
    rng = np.random.default_rng(seed)
    languages = tuple(sorted(set(labels)))
    by_class = [[t for t, y in zip(texts, labels) if y == name] for name in languages]
    depth = 4
    if max(widths) > depth:
        raise ValueError(f"widths go up to {depth}")
    n = len(widths) * filters_per_width
    reach = np.repeat(widths, filters_per_width)
    mask = (np.arange(depth)[:, None, None] < reach[None, None, :]).astype(np.float32) * np.ones((1, 256, 1), np.float32)
    mask[:, 0, :] = 0
    p = {
        "filters": rng.normal(0, 0.2, (depth, 256, n)).astype(np.float32) * mask,
        "bias": np.zeros(n, np.float32),
        "dense": rng.normal(0, 0.3, (n, len(languages))).astype(np.float32),
        "offset": np.zeros(len(languages), np.float32),
    }
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1 if len(languages) > 1 else 1):
        y = rng.integers(0, len(languages), batch)
        x = np.zeros((batch, crop + depth), np.uint8)
        for i, c in enumerate(y):
            text = by_class[c][rng.integers(0, len(by_class[c]))]
            size = min(len(text), int(12 * (crop / 12) ** rng.random()))
            at = rng.integers(0, len(text) - size + 1)
            x[i, :size] = np.frombuffer(text, np.uint8, size, at)
        maps = sum(p["filters"][j][x[:, j : crop + j]] for j in range(depth))
        top = maps.argmax(axis=1)
        pooled = np.take_along_axis(maps, top[:, None, :], axis=1)[:, 0, :] + p["bias"]
        hidden = np.maximum(pooled, 0)
        error = softmax(hidden @ p["dense"] + p["offset"])
        error[np.arange(batch), y] -= 1
        error /= batch
        back = (error @ p["dense"].T) * (pooled > 0)
        g = {"dense": hidden.T @ error, "offset": error.sum(0), "bias": back.sum(0), "filters": np.zeros_like(p["filters"])}
        for j in range(depth):
            seen = np.take_along_axis(x, top + j, axis=1)
            np.add.at(g["filters"][j], (seen, np.broadcast_to(np.arange(n), seen.shape)), back)
        g["filters"] = g["filters"] * mask + 1e-5 * p["filters"]
        rate = 0.02 * (1 - step / (steps + 1))
        for k in p:
            first[k] += 0.1 * (g[k] - first[k])
            second[k] += 0.01 * (g[k] ** 2 - second[k])
            p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return ByteNetwork(languages, p["filters"] * mask, p["bias"], p["dense"], p["offset"], window)


def posteriors(network: ByteNetwork, data: np.ndarray, starts: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
    """Class posteriors of each text ``data[starts[i]:starts[i + 1]]``, over all of its windows."""
    tables = tables or network.pair_tables()
    size, sizes = network.window, np.diff(starts)
    # At least three padding bytes end a text, so that no filter sees the next one.
    windows = (sizes + 3 + size - 1) // size
    first = np.concatenate(([0], np.cumsum(windows)))
    padded = np.zeros(first[-1] * size + 4, np.uint8)
    for i in range(len(sizes)):
        padded[first[i] * size : first[i] * size + sizes[i]] = data[starts[i] : starts[i + 1]]
    pairs = padded[:-1].astype(np.uint16) << 8 | padded[1:]
    by_window = np.empty((first[-1], len(network.languages)), np.float32)
    step = 256
    for w in range(0, first[-1], step):
        end = min(first[-1], w + step)
        maps = tables[0].take(pairs[w * size : end * size], axis=0)
        maps += tables[1].take(pairs[w * size + 2 : end * size + 2], axis=0)
        pooled = maps.reshape(end - w, size, -1).max(axis=1)
        by_window[w:end] = softmax(np.maximum(pooled + network.bias, 0) @ network.dense + network.offset)
    owner = np.repeat(np.arange(len(sizes)), windows)
    weight = np.clip(np.repeat(sizes, windows) - (np.arange(first[-1]) - first[owner]) * size, 0, size).astype(np.float64)
    out = np.zeros((len(sizes), len(network.languages)))
    np.add.at(out, owner, by_window * weight[:, None])
    return out / np.maximum(sizes, 1)[:, None]


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a document is kept from learning: a quarter of all, by its id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_on(docs: DataFrame, per_language: int = 1200, max_languages: int = 200, sample_chars: int = 600, **settings) -> ByteNetwork | None:
    """Train on a bounded sample: at most about ``per_language`` rows of each ``lang``, drawn by hash.

    Each row gives ``sample_chars`` characters from a place drawn by hash.  Only ``text`` and ``lang`` of
    documents that are not held out are read.  More than ``max_languages`` different values are refused, none is left
    out.  No labelled row: None.  Rows that share an id are drawn together or not at all; every one that is drawn counts.
    """
    known = docs.select("doc_id", "lang", "text").filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out())
    counts = known.groupBy("lang").count().limit(max_languages + 1).collect()
    if not counts:
        return None
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} different languages")
    counts.sort(key=lambda r: r["lang"])
    parts = 1 << 30
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(parts, int(parts * per_language / r["count"]) + 1))])
    draw = F.xxhash64("doc_id", F.lit("language"))
    start = F.pmod(F.shiftright(draw, 32), F.greatest(F.length("text") - sample_chars, F.lit(1))) + 1
    sample = (
        known.filter(F.pmod(draw, F.lit(parts)) < share[F.col("lang")])
        .filter(F.col("text").rlike(r"\p{L}"))
        .select("lang", F.substring(F.col("text"), start, F.lit(sample_chars)).alias("text"), draw.alias("draw"))
    )
    rows = sorted((r["lang"], r["draw"], r["text"].replace("\0", " ").encode()) for r in sample.collect())
    rows = [r for r in rows if r[2]]
    return train([r[2] for r in rows], [r[0] for r in rows], **settings) if rows else None


def with_language(docs: DataFrame, network: ByteNetwork | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language and score of each whole text in columns ``names`` (replacing such columns).

    ``und`` and 0.0 for a null text, one without a letter, or without a network.  Of equally likely languages the first by name.
    Row-wise: no shuffle; repeated rows are told each by itself, and an empty table gives no rows.
    """
    kept = [f for f in docs.schema if f.name.lower() not in names]
    schema = T.StructType([*kept, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    told = free_name(docs, "__letters")
    rows = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(told))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = network.pair_tables() if network else []
        for batch in batches:
            for part in text_parts(batch, "text"):
                letters = np.asarray(part.column(told).to_pylist(), dtype=bool)
                if network and letters.any():
                    data, starts = text_bytes(part.column("text"))
                    chances = posteriors(network, data, starts, tables)
                    best = chances.argmax(axis=1)
                    label = [network.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letters)]
                    score = np.where(letters, np.clip(chances.max(axis=1), 0, 1), 0.0)
                else:
                    label, score = [UNDETERMINED] * part.num_rows, np.zeros(part.num_rows)
                columns = [part.column(f.name) for f in kept] + [pa.array(label, pa.string()), pa.array(score, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return rows.mapInArrow(predict, schema)


def identify_language(docs: DataFrame, **settings) -> DataFrame:
    """Learn from the labelled rows of ``docs`` and predict every row: ``doc_id, held_out, lang_pred, score``."""
    network = train_on(docs, **settings)
    return with_language(docs.select("doc_id", "text"), network).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
