"""Mixing sources to target weights by soft membership and projected gradients.

A classifier learned from a labelled table gives each document a posterior over domains.  Nonnegative
document rates are then fitted by least squares, so that the expected tokens of each domain,
``sum(rate * tokens * posterior)``, match their targets.  The rates after any number of steps follow from the
residuals of these steps, a few numbers each: tasks compute them afresh, and only sums reach the driver.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import free_name, text_bytes, text_parts, word_hashes, written

BITS = 15
SHAPES = 5


@dataclass(frozen=True)
class DomainModel:
    """Logistic regression on hashed words and a few shapes of the text; a row of ``weights`` per feature."""

    domains: tuple[str, ...]
    weights: np.ndarray


def features(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of all texts' distinct words, each text's number of words, the features' owners, and the texts' shapes.

    A text has at most ``2 ** BITS`` features of words, however long it is.  Shapes: a constant, shares of
    capitals, of marks and of digits, and how much words repeat.
    """
    hashes, first = word_hashes(data, starts)
    sizes = np.diff(starts)
    shapes = np.ones((len(sizes), SHAPES))
    for k, (low, high) in enumerate(((65, 91), (33, 48), (48, 58)), start=1):
        sums = np.concatenate(([0], np.cumsum((data >= low) & (data < high))))
        shapes[:, k] = 3 * (sums[starts[1:]] - sums[starts[:-1]]) / np.maximum(sizes, 1)
    owner = np.repeat(np.arange(len(sizes)), np.diff(first))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(order), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    words, owner = (hashes[new] >> np.uint64(64 - BITS)).astype(np.int64), owner[new]
    shapes[:, 4] = np.bincount(owner, minlength=len(sizes)) / np.maximum(np.diff(first), 1)
    once = np.ones(len(words), bool)
    once[1:] = (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])
    return words[once], np.diff(first), owner[once], shapes


def chances_of(weights: np.ndarray, words: np.ndarray, owner: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    scores = shapes @ weights[-SHAPES:]
    for k in range(weights.shape[1]):
        scores[:, k] += np.bincount(owner, weights=weights[words, k], minlength=len(shapes))
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def telling(words: np.ndarray, owner: np.ndarray, y: np.ndarray, classes: int, least: float) -> np.ndarray:
    """Words whose share of a domain's texts differs from the others' by ``least`` standard errors."""
    out = np.zeros(1 << BITS, bool)
    n = len(y)
    seen = np.bincount(words, minlength=1 << BITS)
    for k in range(classes):
        inside = int((y == k).sum())
        if 0 < inside < n:
            hits = np.bincount(words[y[owner] == k], minlength=1 << BITS)
            p = seen / n
            error = np.sqrt(p * (1 - p) * (1 / inside + 1 / (n - inside))) + 1e-12
            out |= (np.abs(hits / inside - (seen - hits) / (n - inside)) >= least * error) & (seen >= 4)
    return out


def fit_domains(words: np.ndarray, owner: np.ndarray, shapes: np.ndarray, labels: list[str], counts: dict[str, int], steps: int = 300, least: float = 5.0) -> DomainModel:
    """Full-batch Adam on the cross entropy over telling words and shapes.

    A domain weighs as much as it has labelled documents (``counts``), however many were drawn.
    """
    domains = tuple(sorted(set(labels)))
    y = np.searchsorted(domains, labels)
    use = telling(words, owner, y, len(domains), least)[words]
    words, owner = words[use], owner[use]
    weight = np.array([counts[d] for d in domains]) / np.bincount(y, minlength=len(domains))
    weight = (weight / (weight[y].sum()))[y]
    weights = np.zeros(((1 << BITS) + SHAPES, len(domains)))
    first_moment, second_moment = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        error = chances_of(weights, words, owner, shapes)
        error[np.arange(len(y)), y] -= 1
        error *= weight[:, None]
        gradient = 1e-5 * weights
        gradient[-SHAPES:] += shapes.T @ error
        for k in range(len(domains)):
            gradient[: 1 << BITS, k] += np.bincount(words, weights=error[owner, k], minlength=1 << BITS)
        first_moment += 0.1 * (gradient - first_moment)
        second_moment += 0.01 * (gradient**2 - second_moment)
        weights -= 0.1 * (first_moment / (1 - 0.9**step)) / (np.sqrt(second_moment / (1 - 0.99**step)) + 1e-8)
    return DomainModel(domains, np.where(np.abs(weights) < 1e-9, 0, weights))


def quality_domain() -> Column:
    """The domain that a row of the labelled table names: toxic, low or high quality; null if unlabelled."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "high")


def learn_domains(docs: DataFrame, labels: DataFrame, domain: Column | None = None, per_domain: int = 2000, max_domains: int = 1000) -> DomainModel | None:
    """Learn from at most about ``per_domain`` labelled documents of each domain, drawn by hash of their ids.

    A document with several labels takes the greatest; ids and labels that are null are not used.  None if
    no document is labelled; more than ``max_domains`` different domains are refused.  Tasks read the drawn whole texts and send
    their features, at most ``2 * 2 ** BITS`` bytes a text.
    """
    domain = quality_domain() if domain is None else domain
    named = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), domain.alias("domain")).dropna().groupBy("doc_id").agg(F.max("domain").alias("domain"))
    counts = {r["domain"]: r["count"] for r in named.groupBy("domain").count().limit(max_domains + 1).collect()}
    if not counts:
        return None
    if len(counts) > max_domains:
        raise ValueError(f"more than {max_domains} different domains")
    parts = 1 << 30
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(parts, int(parts * per_domain / n) + 1))])
    drawn = named.filter(F.pmod(F.xxhash64("doc_id", F.lit("domain")), F.lit(parts)) < share[F.col("domain")])
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("text <> ''")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, "text", 2 << 20):
                words, _, owner, shapes = features(*text_bytes(part.column("text")))
                own = np.split(words.astype("<u2"), np.searchsorted(owner, np.arange(1, part.num_rows)))
                packed = [pa.array([x.tobytes() for x in rows], pa.binary()) for rows in (own, shapes)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("domain"), *packed], names=["doc_id", "domain", "words", "shapes"])

    # The draw is bounded, so it may go to every executor.
    sample = texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "domain", "text")
    described = sample.mapInArrow(describe, "doc_id bigint, domain string, words binary, shapes binary")
    rows = sorted((r["doc_id"], r["domain"], bytes(r["words"]), bytes(r["shapes"])) for r in described.collect())
    if not rows:
        return None
    words = np.frombuffer(b"".join(r[2] for r in rows), "<u2").astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r[2]) // 2 for r in rows])
    shapes = np.frombuffer(b"".join(r[3] for r in rows)).reshape(len(rows), SHAPES)
    return fit_domains(words, owner, shapes, [r[1] for r in rows], counts)


def domain_table(docs: DataFrame, model: DomainModel | None) -> DataFrame:
    """``doc_id, tokens, chances``: words and domain posteriors of every whole text; one domain without a model."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, "text", 2 << 20):
                words, tokens, owner, shapes = features(*text_bytes(part.column("text")))
                chances = chances_of(model.weights, words, owner, shapes) if model else np.ones((part.num_rows, 1))
                offsets = pa.array(np.arange(part.num_rows + 1) * chances.shape[1], pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.round(chances, 9).ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(tokens, pa.int64()), lists], names=["doc_id", "tokens", "chances"])

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return source.mapInArrow(describe, "doc_id bigint, tokens bigint, chances array<double>")


def rates_after(chances: np.ndarray, steps: list[list[float]], floor: float = 0.0) -> np.ndarray:
    """All rates start at 1; each step moves them against the gradient and projects them onto ``floor`` and more."""
    rates = np.ones(len(chances))
    for step in steps:
        rates = np.maximum(floor, rates - chances @ np.asarray(step))
    return rates


def summed(table: DataFrame, columns: list[str], sums, size: int) -> np.ndarray:
    """The sums over all rows of the ``size`` numbers that ``sums(batch)`` gives; one row reaches the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            out += sums(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(out)], names=["place", "value"])

    rows = table.select(*columns).mapInArrow(partial, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(size)
    for row in rows:
        out[row["place"]] = row["value"]
    if not np.isfinite(out).all():
        raise ArithmeticError("sums over the documents are not finite")
    return out


def weighed(batch: pa.RecordBatch, weights: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Each row's chances among the domains with a weight, and its tokens that count."""
    chances, other = wanted_chances(np.asarray(batch.column("chances").flatten()).reshape(-1, len(weights)), weights)
    return chances, np.where(other, 0, np.asarray(batch.column("tokens")))


def fit_rates(table: DataFrame, weights: list[float], max_steps: int = 40, tolerance: float = 1e-4, keep: bool = False) -> list[list[float]]:
    """The steps that lead to rates whose expected domain tokens are in the proportions of ``weights``.

    Projected gradient on the least squares of the domains' errors relative to their tokens at rate 1, for which a step of 1
    cannot overshoot.  The total is the smallest that thins no domain with a positive weight; with ``keep`` every rate stays
    at least 1 and the total is in each step the one that fits the masses best.  Stops when every domain
    is within ``tolerance`` of the total.  Where ``max_steps`` do not get there, a last step is the projection of the rates onto
    those that meet the targets; targets that no rates meet are refused.  Domains without a weight are not fitted: the steps
    are for ``wanted_chances``, and rows most probably of such a domain have no tokens.
    """
    weights = [float(w) for w in weights]
    asked = [w for w in weights if w > 0]
    k, floor = len(asked), float(keep)

    def totals(steps: list[list[float]]) -> np.ndarray:
        def mass(batch: pa.RecordBatch) -> np.ndarray:
            chances, tokens = weighed(batch, weights)
            return (rates_after(chances, steps, floor) * tokens) @ chances

        return summed(table, ["tokens", "chances"], mass, k)

    share = np.asarray(asked) / sum(asked)
    start = totals([])
    if not start.sum():
        return []
    scale = np.maximum(start, 1e-9 * start.sum())

    def targets(now: np.ndarray) -> np.ndarray:
        if not keep:
            return share * (start / share).max()
        fit = share / scale**2
        return share * max((fit @ now) / (fit @ share), start.sum())

    steps: list[list[float]] = []
    now = start
    while len(steps) < max_steps and np.abs(now - targets(now)).max() > tolerance * now.sum():
        steps.append([round(float(x), 12) for x in (now - targets(now)) / scale])
        now = totals(steps)
    wanted = targets(now)
    if np.abs(now - wanted).max() > tolerance * wanted.sum():
        # With `keep` the total stays free: along the basis the masses are in proportion, across it lies their total.
        basis = np.linalg.svd(share[None, :])[2][1:].T if keep else np.eye(k)
        last = closing_step(table, weights, steps, wanted - floor * start, basis, 1e-2 * tolerance * wanted.sum(), floor)
        if last is None:
            raise ValueError(f"no rates give the shares {share.tolist()}: {len(steps)} steps end at {(now / now.sum()).tolist()}")
        steps.append([round(float(-x), 12) for x in last])
    return steps


def wanted_chances(chances: np.ndarray, weights: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors among the domains with a positive weight, and which rows are most probably of another domain."""
    asked = np.asarray(weights, float) > 0
    if asked.all():
        return chances, np.zeros(len(chances), bool)
    other = ~asked[chances.argmax(axis=1)]
    own = chances[:, asked]
    return own / np.where(other, np.maximum(own.sum(axis=1), 1e-9), own.sum(axis=1))[:, None], other


def closing_step(table: DataFrame, weights: list[float], steps: list[list[float]], wanted: np.ndarray, basis: np.ndarray, error: float, floor: float = 0.0, max_passes: int = 60) -> np.ndarray | None:
    """The ``m`` in the span of ``basis`` for which ``max(0, rates + chances @ m)`` moves the masses to ``wanted`` along ``basis``.

    ``rates`` are those after ``steps`` above ``floor``.  Newton's method on the dual of the projection, convex and quadratic in
    pieces: a pass gives its value, gradient and Hessian.  None where the masses are out of reach: the dual has no least value then.
    """
    k = len(wanted)

    def sums(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def parts(batch: pa.RecordBatch) -> np.ndarray:
            chances, tokens = weighed(batch, weights)
            rates = rates_after(chances, steps, floor) - floor + chances @ at
            moved = np.maximum(0, rates) * tokens
            hessian = chances.T @ (chances * (tokens * (rates >= 0))[:, None])
            return np.concatenate(([(moved * rates).sum() / 2], moved @ chances, hessian.ravel()))

        out = summed(table, ["tokens", "chances"], parts, 1 + k + k * k)
        return out[0] - wanted @ at, basis.T @ (out[1 : k + 1] - wanted), basis.T @ out[k + 1 :].reshape(k, k) @ basis

    now = np.zeros(k)
    value, gradient, curve = sums(now)
    for _ in range(max_passes):
        if not len(gradient) or np.abs(gradient).max() <= error:
            return now
        ridge = 1e-12 * max(np.trace(curve), 1e-300) * np.eye(len(gradient))
        move = basis @ np.linalg.lstsq(curve + ridge, -gradient, rcond=None)[0]
        slope = gradient @ (basis.T @ move)
        length = 1.0
        if not np.isfinite(move).all() or np.abs(now + move).max() > 1e9:
            return None  # the dual falls for ever
        while slope < 0 and length > 1e-6:
            next_ = now + length * move
            found = sums(next_)
            if found[0] <= value + 1e-4 * length * slope + 1e-12 * abs(value):
                break
            length /= 2
        else:
            return None
        now, (value, gradient, curve) = next_, found
    return None


def mixing_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float], domain: Column | None = None, keep: bool = False, most: float = 100.0, **settings) -> DataFrame:
    """``doc_id, tokens, domain, chances, rate, copies`` of every row of ``docs (doc_id, text, ...)``.

    ``weights``: the wanted share of tokens by domain, among the domains with a weight; documents most probably of
    another domain have the rate 0.  ``domain`` is the most
    probable one, ``chances`` the posteriors in the order of the domains' names.  ``copies`` is ``rate`` rounded up or
    down at random by a hash of the id, so that its mean is the rate.  Null and empty texts have no tokens and
    their rate follows from their posterior; a null id is rounded as an id of its own.  Rows that share an id are rated each by
    itself and rounded alike.  Of equally probable domains the first by name is ``domain``.  Without labels all
    documents form the domain ``all`` and have the rate 1.

    With ``keep``, every document whose ``domain`` has a weight has a rate of at least 1; where no such rates meet the
    weights, as when the posteriors tell nothing apart, all of these rates are 1 and a warning says so.  Targets that need a
    document more than ``most`` times are refused.
    """
    model = learn_domains(docs, labels, domain)
    table = written(domain_table(docs, model), "domains")
    domains = model.domains if model else ("all",)
    asked = [float(weights.get(name, 0)) for name in domains]
    fitted = model is not None and sum(asked) > 0
    steps: list[list[float]] = []
    if fitted:
        try:
            steps = fit_rates(table, asked, keep=keep, **settings)
        except ValueError as error:
            if not keep:
                raise
            warnings.warn(f"all rates stay 1: {error}", stacklevel=2)

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chances = np.asarray(batch.column("chances").flatten()).reshape(-1, len(domains))
            best = pa.array([domains[i] for i in chances.argmax(axis=1)], pa.string())
            own, other = wanted_chances(chances, asked if fitted else [1.0] * len(domains))
            rates = np.where(other, 0, rates_after(own, steps, float(keep)))
            columns = [batch.column("doc_id"), batch.column("tokens"), best, batch.column("chances"), pa.array(rates)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tokens", "domain", "chances", "rate"])

    rates = table.mapInArrow(rated, "doc_id bigint, tokens bigint, domain string, chances array<double>, rate double")
    highest = rates.agg(F.max("rate")).head()[0] if steps else None
    if highest is not None and highest > most:
        raise ValueError(f"the weights need a document {highest:.1f} times, more than {most}")
    draw = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 30)) / (1 << 30)
    return rates.withColumn("copies", (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("int"))


def mixed(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """``docs`` with each row as often as ``rates`` says for its ``doc_id``; a row without a rate once."""
    names = [F.col(f"d.`{c}`") for c in docs.columns]
    known = rates.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("copies").alias("copies"))
    joined = docs.alias("d").join(known.alias("r"), F.col("d.doc_id") == F.col("r.doc_id"), "left")
    return joined.withColumn(free_name(docs, "__times"), F.expr("explode(array_repeat(0, coalesce(r.copies, 1)))")).select(*names)
