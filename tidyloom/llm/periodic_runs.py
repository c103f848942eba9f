"""Periodic runs of words, from a suffix automaton whose suffix links are a link-cut forest.

Words are appended one by one.  The suffixes of what has been read are the path from the newest state to the root, and
each state knows where its strings last ended.  Paths of states with one last end are kept as one splay tree, ordered
by length.  Appending a word *accesses* its state: the path to the root takes the new end as its colour, and every
old segment it crosses gives the last end ``p`` of its longest string of ``k`` words.  With the new end ``i``, the words
repeat at the distance ``i - p`` over ``k`` words, so ``k >= i - p`` is a square, and its run begins ``k - 1`` words before ``p``
and goes on as long as words repeat at that distance.  A square of a primitive word is always found so, as the word's
last end cannot lie nearer; so every run is found, with its smallest period.

Only stretches that may hold a run are read: in a run of ``least`` words or more, each word lies in a gram of ``least / 2`` words
that the text holds at least twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import mix64, text_bytes, text_parts, word_hashes

GRAM_BASE = np.uint64(0x9E3779B97F4A7C15)


class LastEnds:
    """Suffix automaton of the words appended so far, with the last end of every state's strings.

    State 1 is the root, 0 stands for none.  ``above`` and ``below`` are the children in the splay trees (shorter and
    longer strings), ``parent`` the parent there or, from a tree's root, the state its path hangs on.  ``end`` is kept
    at the roots of the trees only, for all states of a tree.
    """

    def __init__(self) -> None:
        self.length, self.link, self.edges = [0, 0], [0, 0], [{}, {}]
        self.above, self.below, self.parent, self.end = [0, 0], [0, 0], [0, 0], [-1, -1]
        self.newest = 1

    def new_state(self, length: int, edges: dict[int, int], link: int, end: int) -> int:
        self.length.append(length)
        self.edges.append(edges)
        self.link.append(link)
        self.above.append(0)
        self.below.append(0)
        self.parent.append(link)
        self.end.append(end)
        return len(self.length) - 1

    def splay(self, x: int) -> None:
        """Make ``x`` the root of its tree."""
        above, below, parent = self.above, self.below, self.parent
        top = 0
        while True:
            p = parent[x]
            if not p:
                break
            if above[p] == x:
                left = True
            elif below[p] == x:
                left = False
            else:
                break
            g = parent[p]
            inner = g and (above[g] == p or below[g] == p)
            if not inner:
                top = p
            elif (above[g] == p) == left:  # the same side twice: the parent goes up first
                top = g
                if left:
                    c = above[g] = below[p]
                    below[p] = g
                else:
                    c = below[g] = above[p]
                    above[p] = g
                if c:
                    parent[c] = g
                gg = parent[p] = parent[g]
                parent[g] = p
                if gg:
                    if above[gg] == g:
                        above[gg] = p
                    elif below[gg] == g:
                        below[gg] = p
                g = gg
            else:
                top = g
                if left:
                    c = above[p] = below[x]
                    below[x] = p
                    if c:
                        parent[c] = p
                    c = below[g] = above[x]
                    above[x] = g
                else:
                    c = below[p] = above[x]
                    above[x] = p
                    if c:
                        parent[c] = p
                    c = above[g] = below[x]
                    below[x] = g
                if c:
                    parent[c] = g
                gg = parent[x] = parent[g]
                parent[p] = parent[g] = x
                if gg:
                    if above[gg] == g:
                        above[gg] = x
                    elif below[gg] == g:
                        below[gg] = x
                continue
            # One turn of x over p.
            if left:
                c = above[p] = below[x]
                below[x] = p
            else:
                c = below[p] = above[x]
                above[x] = p
            if c:
                parent[c] = p
            parent[x] = g
            parent[p] = x
            if g:
                if above[g] == p:
                    above[g] = x
                elif below[g] == p:
                    below[g] = x
        if top:
            self.end[x] = self.end[top]

    def split(self, q: int, length: int) -> int:
        """A new state for the strings of ``q`` of up to ``length`` words, just above ``q`` on its path."""
        self.splay(q)
        clone = self.new_state(length, dict(self.edges[q]), self.link[q], self.end[q])
        short = self.above[q]
        self.parent[clone] = self.parent[q]
        self.above[clone], self.below[clone] = short, q
        if short:
            self.parent[short] = clone
        self.above[q] = 0
        self.parent[q] = clone
        self.link[q] = clone
        return clone

    def append(self, word: int) -> None:
        length, link, edges = self.length, self.link, self.edges
        p = self.newest
        new = self.newest = self.new_state(length[p] + 1, {}, 0, -1)
        while p and word not in edges[p]:
            edges[p][word] = new
            p = link[p]
        parent = edges[p][word] if p else 1
        if p and length[parent] != length[p] + 1:
            q, parent = parent, self.split(parent, length[p] + 1)
            while p and edges[p].get(word) == q:
                edges[p][word] = parent
                p = link[p]
        link[new] = self.parent[new] = parent

    def access(self, end: int) -> list[tuple[int, int]]:
        """Colour the newest state's path with ``end``; the last ends and longest strings of what it was, longest first."""
        x, last, out = self.newest, 0, []
        while x:
            self.splay(x)
            old, rest = self.end[x], self.below[x]
            if rest:
                self.end[rest] = old
            if old >= 0:
                out.append((old, self.length[x]))
            self.below[x] = last
            last, x = x, self.parent[x]
        self.end[last] = end
        return out


def runs_of(words: list[int], least: int = 12) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of ``words``, by start, then period."""
    ends, until, out = LastEnds(), {}, []
    n = len(words)
    for i, word in enumerate(words):
        ends.append(word)
        for p, longest in ends.access(i):
            period = i - p
            if longest >= period and until.get(period, -1) < i:
                stop = i + 1
                while stop < n and words[stop] == words[stop - period]:
                    stop += 1
                until[period] = stop - 1
                start = p - longest + 1
                if stop - start >= least:
                    out.append((start, stop - start, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def candidate_stretches(hashes: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Where stretches of words that may hold runs begin and end; ``first``: where the texts do, and the last one's end."""
    gram = (least + 1) // 2
    n = len(hashes) - gram + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = np.zeros(n, np.uint64)
    for k in range(gram):
        sums = sums * GRAM_BASE + hashes[k : k + n]
    text = np.searchsorted(first, np.arange(n), side="right") - 1
    keys = mix64(sums) ^ mix64(text.astype(np.uint64) + np.uint64(1))
    inside = np.flatnonzero(np.arange(n) + gram <= first[text + 1])
    order = inside[np.argsort(keys[inside])]
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    steps = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + gram, -1)
    covered = np.cumsum(steps[:-1]) > 0
    turn = np.zeros(len(hashes) + 1, bool)
    turn[first] = True
    before, after = np.concatenate(([False], covered)), np.concatenate((covered, [False]))
    begin, end = np.flatnonzero(after & (~before | turn)), np.flatnonzero(before & (~after | turn))
    use = end - begin >= least
    return begin[use], end[use]


SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, least: int = 12, part_bytes: int = 4 << 20) -> DataFrame:
    """The periodic runs of every whole text of ``docs (doc_id, text, ...)``; a row per row.

    Words are what lies between blanks and 0x09-0x0D, compared byte by byte and numbered from 0.  ``runs``, by start, then period:
    every longest stretch of words with smallest period ``period`` that holds ``least`` words and two periods at least.
    ``collapsed``: the words that no run contains after its first period, joined by blanks.

    A null text is empty: no words, no runs and an empty ``collapsed``.  A null or repeated id is kept as it is, and each
    row is read by itself.  A text is read by one task, in memory that grows with its longest stretch of repeated grams.
    An empty table gives no rows; other columns are not read.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_parts(batch, "text", part_bytes):
                data, starts = text_bytes(part.column("text"))
                hashes, first = word_hashes(data, starts)
                begin, end = candidate_stretches(hashes, first, least)
                owner = np.searchsorted(first, begin, side="right") - 1
                found: dict[int, list[tuple[int, int]]] = {}
                for d, a, b in zip(owner.tolist(), (begin - first[owner]).tolist(), (end - first[owner]).tolist()):
                    found.setdefault(d, []).append((a, b))
                raw, runs, collapsed = data.tobytes(), [], []
                for d, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
                    words, mine = raw[a:b].split(), []
                    for low, high in found.get(d, ()):
                        number: dict[bytes, int] = {}
                        coded = [number.setdefault(w, len(number)) for w in words[low:high]]
                        mine += [(low + s, n, q) for s, n, q in runs_of(coded, least)]
                    if mine:
                        steps = np.zeros(len(words) + 1, np.int64)
                        for s, n, q in mine:
                            steps[s + q] += 1
                            steps[s + n] -= 1
                        words = [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()]
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in mine])
                    collapsed.append(b" ".join(words))
                texts = pa.array(collapsed, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(first)), pa.array(runs, RUN), texts], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(find, SCHEMA)
