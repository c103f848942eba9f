"""A hidden Markov model of words, trained by Baum-Welch over all partitions, and exact likelihoods of whole texts.

Words are numbered in blocks of texts, block by block; the counts of all words of all blocks are one distributed
table, and each block gets back what it needs of it.  A state emits symbols: the ``own`` most frequent words are
symbols of their own, the others share ``tied`` symbols by their last characters, and a word's share of its
symbol follows from the corpus counts.  So the model has a bounded size while every word has its own probability:

    P(text) = sum over state paths of  start * moves * P(symbol | state)  times  product of P(word | symbol)

Each step of Baum-Welch is one pass: tasks run the scaled forward and backward recursions over their blocks and
emit expected counts, Spark sums them, and the driver normalizes them.  Texts longer than ``SEGMENT`` are cut: the
transfer matrix of each segment carries the recursion over it, so that segments of one text run side by side and
the likelihood stays exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidyloom.llm.common import SPACES, text_bytes, text_parts, written
from tidyloom.llm.words import word_array, word_edges

SEGMENT = 1024
PART_TOKENS = 1_000_000
END = ""  # no word is empty


@dataclass
class Model:
    """``start[z]``, ``move[z, y]``, ``ratio[s, z]``: P(symbol s | state z) / ``usual[s]``."""

    start: np.ndarray
    move: np.ndarray
    ratio: np.ndarray
    usual: np.ndarray


def first_model(amount: np.ndarray, states: int, seed: int) -> Model:
    """States that tend to last and prefer symbols at random; ``amount``: how often each symbol occurs."""
    draw = np.random.default_rng(seed)
    usual = (amount + 1.0) / (amount.sum() + len(amount))
    lean = np.exp(draw.normal(0.0, 0.5, (len(amount), states)))
    lean /= (lean * usual[:, None]).sum(axis=0)
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1.0 / states), move, lean, usual)


def next_model(model: Model, emitted: np.ndarray, moved: np.ndarray, started: np.ndarray, prior: float) -> Model:
    """From expected counts; every state also holds ``prior`` occurrences at the corpus frequencies."""
    states = len(started)
    ratio = (emitted / model.usual[:, None] + prior) / (emitted.sum(axis=0) + prior)
    move = (moved + prior / states) / (moved.sum(axis=1, keepdims=True) + prior)
    return Model((started + prior / states) / (started.sum() + prior), move, ratio, model.usual)


class Chains:
    """The segments of a block's texts, side by side: step ``t`` works on all segments longer than ``t``."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray):
        parts = -(-sizes // SEGMENT)
        self.text = np.repeat(np.arange(len(sizes)), parts)
        self.part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        length = np.minimum(sizes[self.text] - self.part * SEGMENT, SEGMENT)
        self.last = self.part == parts[self.text] - 1
        order = np.argsort(-length, kind="stable")
        self.text, self.part, self.last, self.length = (x[order] for x in (self.text, self.part, self.last, length))
        first = (np.cumsum(length) - length)[order]
        steps = int(self.length[0]) if len(order) else 0
        #: How many segments are longer than t.
        self.wide = np.searchsorted(-self.length, -np.arange(steps), side="left")
        self.at = np.concatenate(([0], np.cumsum(self.wide)))
        where = np.concatenate([first[:n] + t for t, n in enumerate(self.wide.tolist())]) if steps else np.zeros(0, np.int64)
        self.symbols = symbols[where]
        #: The segment of each text's part, to walk along a text.
        self.of = np.full((int(parts.max(initial=0)), len(sizes)), -1, np.int64)
        self.of[self.part, self.text] = np.arange(len(order))

    def rows(self, t: int) -> slice:
        return slice(self.at[t], self.at[t + 1])


def transfers(model: Model, chains: Chains) -> np.ndarray:
    """Of each segment that follows another one, the matrix from the states before it to its last one, scaled."""
    states = len(model.start)
    out = np.tile(np.eye(states), (len(chains.text), 1, 1))
    inner = chains.part > 0
    if not inner.any():
        return out
    # Segments stay ordered by length when some are left out.
    chosen = np.flatnonzero(inner)
    upto = np.concatenate(([0], np.cumsum(inner)))
    work = out[chosen]
    for t, n in enumerate(chains.wide.tolist()):
        k = int(upto[n])
        if not k:
            break
        ratio = model.ratio[chains.symbols[chains.rows(t)][chosen[:k]]]
        step = (work[:k].reshape(k * states, states) @ model.move).reshape(k, states, states) * ratio[:, None, :]
        step /= step.sum(axis=(1, 2), keepdims=True)
        work[:k] = step
    out[chosen] = work
    return out


def borders(model: Model, chains: Chains, jump: np.ndarray, backward: bool) -> tuple[np.ndarray, np.ndarray]:
    """The state before each segment (of a first one: unused) and, if asked for, the weights behind it."""
    states = len(model.start)
    ahead = np.zeros((len(chains.text), states))
    behind = np.ones((len(chains.text), states))
    if len(chains.of) < 2:
        return ahead, behind
    many = np.flatnonzero(chains.of[1] >= 0)
    first = chains.of[0][many]
    here = model.start * model.ratio[chains.symbols[chains.at[0] + first]]
    here /= here.sum(axis=1, keepdims=True)
    for t in range(1, SEGMENT):  # texts of several segments fill the first one
        here = here @ model.move * model.ratio[chains.symbols[chains.at[t] + first]]
        here /= here.sum(axis=1, keepdims=True)
    for k in range(1, len(chains.of)):
        use = chains.of[k][many] >= 0
        many, here = many[use], here[use]
        now = chains.of[k][many]
        ahead[now] = here
        here = np.einsum("nk,nkj->nj", here, jump[now])
        here /= here.sum(axis=1, keepdims=True)
    if backward:
        for k in range(len(chains.of) - 1, 0, -1):
            texts = np.flatnonzero(chains.of[k] >= 0)
            now, before = chains.of[k][texts], chains.of[k - 1][texts]
            there = np.einsum("nkj,nj->nk", jump[now], behind[now])
            behind[before] = there / there.sum(axis=1, keepdims=True)
    return ahead, behind


def forward(model: Model, chains: Chains, ahead: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Log of the scales of each segment, the scaled states of all tokens if kept, and all scales."""
    tokens, states = len(chains.symbols), len(model.start)
    scales = np.empty(tokens)
    kept = np.empty((tokens, states)) if keep else None
    here = np.where((chains.part == 0)[:, None], model.start, ahead @ model.move)
    logs = np.zeros(len(chains.text))
    for t, n in enumerate(chains.wide.tolist()):
        rows = chains.rows(t)
        here = (here if t == 0 else here[:n] @ model.move) * model.ratio[chains.symbols[rows]]
        scale = here.sum(axis=1)
        here /= scale[:, None]
        scales[rows] = scale
        if keep:
            kept[rows] = here
    if tokens:
        segment = np.arange(tokens) - np.repeat(chains.at[:-1], chains.wide)
        logs = np.bincount(segment, np.log10(scales), minlength=len(logs))
    return logs, kept, scales


def likelihoods(model: Model, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 of the exact probability of each text's symbols; ``sizes``: how many each has, 1 at least."""
    if not len(sizes):
        return np.zeros(0)
    chains = Chains(symbols, sizes)
    ahead, _ = borders(model, chains, transfers(model, chains), False)
    logs, _, _ = forward(model, chains, ahead, False)
    usual = np.add.reduceat(np.log10(model.usual)[symbols], np.cumsum(sizes) - sizes)
    return np.bincount(chains.text, logs, minlength=len(sizes)) + usual


def expected_counts(model: Model, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts of a block: emissions by symbol and state, moves between states, first states."""
    states = len(model.start)
    emitted, moved, started = np.zeros((len(model.usual), states)), np.zeros((states, states)), np.zeros(states)
    if not len(sizes):
        return emitted, moved, started
    chains = Chains(symbols, sizes)
    ahead, behind = borders(model, chains, transfers(model, chains), True)
    _, kept, scales = forward(model, chains, ahead, True)
    later = None
    for t in range(len(chains.wide) - 1, -1, -1):
        rows, n = chains.rows(t), int(chains.wide[t])
        back = behind[:n].copy()
        if later is not None:
            m = len(later)
            back[:m] = later @ model.move.T
            moved += kept[chains.at[t] : chains.at[t] + m].T @ later
        here = kept[rows]
        ends = slice(0 if later is None else len(later), n)  # segments that end here
        back[ends] /= (here[ends] * back[ends]).sum(axis=1, keepdims=True)
        later = model.ratio[chains.symbols[rows]] * back / scales[rows][:, None]
        here *= back  # now the chance of each state
    entered = later  # at t = 0 all segments
    inner = chains.part > 0
    moved += ahead[inner].T @ entered[inner]
    started += kept[: len(chains.text)][~inner].sum(axis=0)
    for z in range(states):
        emitted[:, z] = np.bincount(chains.symbols, kept[:, z], minlength=len(emitted))
    return emitted, moved * model.move, started


BLOCK = "block bigint, doc_ids array<bigint>, held array<boolean>, sizes array<bigint>, ids binary, words array<string>, counts array<bigint>"
CODED = "doc_ids array<bigint>, held array<boolean>, sizes array<bigint>, known array<bigint>, base array<double>, inside array<double>, symbols binary"


def names_of(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def in_lists(values: np.ndarray | pa.Array) -> pa.ListArray:
    """One list that holds all values."""
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def word_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """A row per block of texts: its words, each text's words by number with ``END`` behind them, training counts."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in text_parts(batch, "text", block_bytes):
                found, sizes = [], []
                for piece in text_parts(part, "text"):
                    data, starts = text_bytes(piece.column("text"))
                    opens, closes = word_edges(data, starts, SPACES)
                    found.append(word_array(data, opens, closes))
                    sizes.append(np.diff(np.searchsorted(opens, starts)))
                coded = pa.concat_arrays([*found, pa.array([END])]).dictionary_encode()
                ids, sizes = np.asarray(coded.indices), np.concatenate(sizes)
                ids = np.insert(ids[:-1], np.cumsum(sizes), ids[-1])
                sizes += 1
                held = np.asarray(part.column("held").to_pylist(), bool)
                counts = np.bincount(ids[~np.repeat(held, sizes)], minlength=len(coded.dictionary))
                columns = [pa.array([block]), *(in_lists(part.column(c)) for c in ("doc_id", "held")), in_lists(sizes), pa.array([ids.astype("<i4").tobytes()]), in_lists(coded.dictionary), in_lists(counts)]
                yield pa.RecordBatch.from_arrays(columns, names=names_of(BLOCK))
                block += 1

    return docs.mapInArrow(split, BLOCK)


def word_table(blocks: DataFrame, own: int, tied: int) -> DataFrame:
    """``word, c, symbol``: how often each word occurs in training texts, and its symbol (0 to ``own + tied - 1``)."""
    each = blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select(F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    words = written(each.groupBy("word").agg(F.sum("n").alias("c")), "words")
    top = words.filter("c > 0").orderBy(F.desc("c"), "word").limit(own)  # at most `own` rows are numbered
    top = top.select("word", (F.row_number().over(Window.orderBy(F.desc("c"), "word")) - 1).alias("symbol"))
    tail = F.lit(own) + F.pmod(F.crc32(F.encode(F.right("word", F.lit(3)), "UTF-8")), F.lit(tied))
    return written(words.join(top, "word", "left").select("word", "c", F.coalesce("symbol", tail).cast("int").alias("symbol")), "symbols")


def coded_blocks(blocks: DataFrame, words: DataFrame, own: int, tied: int) -> tuple[DataFrame, np.ndarray, int]:
    """The blocks as symbols, with each text's base score and its words' shares of their symbols; symbol counts; N."""
    sums = words.groupBy("symbol").agg(F.sum("c").alias("c"), F.count_if(F.col("c") > 0).alias("kinds")).collect()  # own + tied at most
    amount, kinds = np.zeros(own + tied), np.zeros(own + tied)
    for row in sums:
        amount[row["symbol"]], kinds[row["symbol"]] = row["c"], row["kinds"]
    total, distinct = int(amount.sum()), int(kinds.sum())
    asked = blocks.select(F.col("block").alias("asker"), F.posexplode("words").alias("place", "word"))
    asked = asked.join(words, "word").select("asker", "place", "c", "symbol")

    def code(left: pa.Table, right: pa.Table) -> pa.Table:
        place = np.asarray(right.column("place").combine_chunks())
        c, symbol = np.zeros(len(place), np.int64), np.zeros(len(place), np.int32)
        c[place], symbol[place] = np.asarray(right.column("c").combine_chunks()), np.asarray(right.column("symbol").combine_chunks())
        base = np.log10((c + 1) / (total + distinct + 1))
        inside = np.where(symbol < own, 0.0, np.log10((c + 1) / (amount[symbol] + kinds[symbol] + 1)))
        ids = np.frombuffer(left.column("ids")[0].as_py(), "<i4")
        sizes = np.asarray(left.column("sizes").combine_chunks().values)
        first = np.cumsum(sizes) - sizes
        sums = [np.add.reduceat(x[ids], first) if len(first) else x[:0] for x in ((c > 0).astype(np.int64), base, inside)]
        columns = [np.asarray(left.column("doc_ids").combine_chunks().values.to_pylist(), object), np.asarray(left.column("held").combine_chunks().values.to_pylist(), bool), sizes, *sums]
        # The recursions work on about a million tokens at a time.
        part = first // PART_TOKENS
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        out = []
        for a, b in zip(edges, edges[1:]):
            low, high = int(first[a]), int(first[b - 1] + sizes[b - 1])
            row = [*(in_lists(pa.array(x[a:b], t)) for x, t in zip(columns, types)), pa.array([symbol[ids[low:high]].astype("<i4").tobytes()])]
            out.append(pa.Table.from_arrays(row, names=names_of(CODED)))
        return pa.concat_tables(out)

    texts = blocks.select("block", "doc_ids", "held", "sizes", "ids")
    return texts.groupBy("block").cogroup(asked.groupBy("asker")).applyInArrow(code, CODED), amount, total


def training_pass(coded: DataFrame, model: Model, prior: float) -> Model:
    """One step of Baum-Welch over all training texts; ``(symbols + states + 1) x states`` sums reach the driver."""
    states, symbols = len(model.start), len(model.usual)
    names = [f"e{z}" for z in range(states)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((symbols + states + 1, states))
        for batch in batches:
            for row in range(batch.num_rows):
                sizes = np.asarray(batch.column("sizes")[row].values)
                use = ~np.asarray(batch.column("held")[row].values.to_pylist(), bool)
                chosen = np.frombuffer(batch.column("symbols")[row].as_buffer(), "<i4")[np.repeat(use, sizes)]
                emitted, moved, started = expected_counts(model, chosen, sizes[use])
                table[:symbols] += emitted
                table[symbols:-1] += moved
                table[-1] += started
        at = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(table[at, z].astype(np.float32)) for z in range(states))], names=["symbol", *names])

    sums = coded.select("held", "sizes", "symbols").mapInArrow(count, ", ".join(["symbol int", *(f"{n} float" for n in names)]))
    sums = sums.groupBy("symbol").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    table = np.zeros((symbols + states + 1, states))
    table[np.asarray(sums.column("symbol").combine_chunks())] = np.stack([np.asarray(sums.column(n).combine_chunks()) for n in names], axis=1)
    if not np.isfinite(table).all():
        raise ArithmeticError("expected counts are not finite")
    return next_model(model, table[:symbols], table[symbols:-1], table[-1], prior)


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def hidden_markov_scores(
    docs: DataFrame,
    held_out: Column,
    states: int = 8,
    steps: int = 4,
    own: int = 32_768,
    tied: int = 4_096,
    prior: float = 50.0,
    seed: int = 1,
    block_bytes: int = 32 << 20,
) -> DataFrame:
    """Score every whole text of ``docs (doc_id, text, ...)`` by a model of those that are not ``held_out``.

    Tokens: words, A-Z as a-z, between blanks and 0x09-0x0D, then one end.  ``n_known``: tokens that training texts
    hold; ``train_tokens``: all tokens of training texts (N).  ``base_score``: log10 of the product of ``(c + 1) / (N + V + 1)``;
    ``score``: log10 of the text's probability, summed over all state paths.  ``own`` and ``tied`` bound the model, not the
    corpus counts, which cover every word.

    A null text is empty and has its end only; a null id, or a null ``held_out``, belongs to training.  Every row counts and is scored, repeated
    ones too.  Of words that are equally frequent the smaller is first among ``own``.  An empty table gives no rows; without
    training texts every word is unknown.  Other columns are not read.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), "text")
    blocks = written(word_blocks(source, block_bytes), "blocks", compression="zstd")
    coded, amount, total = coded_blocks(blocks, word_table(blocks, own, tied), own, tied)
    coded = written(coded, "coded", compression="zstd")
    model = first_model(amount, states, seed)
    for _ in range(steps if total else 0):
        model = training_pass(coded, model, prior)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                values = {c: batch.column(c)[row].values for c in names_of(CODED)[:-1]}
                symbols = np.frombuffer(batch.column("symbols")[row].as_buffer(), "<i4")
                scores = likelihoods(model, symbols, np.asarray(values["sizes"])) + np.asarray(values["inside"])
                columns = [values["doc_ids"], values["held"], values["sizes"], values["known"], pa.array(np.full(len(scores), total)), values["base"], pa.array(scores)]
                yield pa.RecordBatch.from_arrays(columns, names=names_of(SCORES))

    return coded.mapInArrow(score, SCORES)
