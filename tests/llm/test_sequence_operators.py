"""Hidden Markov scores, collocations and periodic runs against plain restatements."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidyloom.llm import collocations, hidden_markov, periodic_runs, queries

#: Clashes with columns of results and of inner tables.
DOCS = "doc_id bigint, text string, lang string, n long, score string, words string, block int, `Text ` string"


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(d, t, g, 1, "s", "w", 2, "x") for d, t, g in rows], DOCS).repartition(parts)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# Hidden Markov model


def small_model(states, symbols, seed=0):
    rng = np.random.default_rng(seed)
    usual = rng.dirichlet(np.ones(symbols))
    chance = rng.dirichlet(np.ones(symbols), states).T
    return hidden_markov.Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), chance / usual[:, None], usual), chance


@pytest.mark.parametrize("segment", [1, 2, 4, 1024])
def test_likelihoods_sum_over_all_paths_and_counts_are_expectations(monkeypatch, segment):
    monkeypatch.setattr(hidden_markov, "SEGMENT", segment)
    model, chance = small_model(3, 5)
    sizes = np.array([1, 3, 9, 4, 8, 5, 13, 1])
    symbols = np.random.default_rng(1).integers(0, 5, sizes.sum()).astype(np.int32)
    texts = np.split(symbols, np.cumsum(sizes)[:-1])

    def paths(text):
        """Probability and states of every path of a short text."""
        for code in range(3 ** len(text)):
            states = [code // 3**k % 3 for k in range(len(text))]
            p = model.start[states[0]]
            for k, (z, s) in enumerate(zip(states, text)):
                p *= chance[s, z] * (model.move[states[k - 1], z] if k else 1)
            yield p, states

    found = hidden_markov.likelihoods(model, symbols, sizes)
    emitted, moved, started = np.zeros((5, 3)), np.zeros((3, 3)), np.zeros(3)
    for text, score in zip(texts, found):
        every = list(paths(text)) if len(text) < 10 else []
        if every:
            total = sum(p for p, _ in every)
            assert score == pytest.approx(math.log10(total))
        here = model.start * chance[text[0]]
        ahead = [here]
        for s in text[1:]:
            ahead.append(ahead[-1] @ model.move * chance[s])
        behind = [np.ones(3)]
        for s in text[:0:-1]:
            behind.insert(0, model.move @ (chance[s] * behind[0]))
        total = ahead[-1].sum()
        assert score == pytest.approx(math.log10(total))
        started += ahead[0] * behind[0] / total
        for k, s in enumerate(text):
            emitted[s] += ahead[k] * behind[k] / total
            if k:
                moved += ahead[k - 1][:, None] * model.move * (chance[s] * behind[k]) / total
    for a, b in zip(hidden_markov.expected_counts(model, symbols, sizes), (emitted, moved, started)):
        np.testing.assert_allclose(a, b, atol=1e-9)


def test_steps_never_lower_the_likelihood_without_a_prior():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 30, 60)
    symbols = rng.integers(0, 12, sizes.sum()).astype(np.int32)
    model = hidden_markov.first_model(np.bincount(symbols, minlength=12).astype(float), 4, 1)
    scores = []
    for _ in range(8):
        scores.append(hidden_markov.likelihoods(model, symbols, sizes).sum())
        model = hidden_markov.next_model(model, *hidden_markov.expected_counts(model, symbols, sizes), 1e-9)
        np.testing.assert_allclose((model.ratio * model.usual[:, None]).sum(axis=0), 1)
    assert all(b >= a - 1e-9 for a, b in zip(scores, scores[1:])) and scores[-1] > scores[0] + 1


def base_scores(rows, held):
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", lowered(t)) + [""] for i, (_, t, _) in enumerate(rows)}
    count = Counter(w for i, words in tokens.items() if not held(rows[i][0]) for w in words)
    total, kinds = sum(count.values()), len(count)
    return [
        (d, held(d), len(tokens[i]), sum(count[w] > 0 for w in tokens[i]), total, round(sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in tokens[i]), 6))
        for i, (d, _, _) in enumerate(rows)
    ]


@pytest.fixture(scope="module")
def two_tongues():
    rng = random.Random(2)
    rows = []
    for d in range(160):
        kind = "ab"[d % 2]
        rows.append((d, " ".join(f"{kind}{int(rng.paretovariate(0.6)) % 60}" for _ in range(rng.randrange(1, 80))), "en"))
    rows[5] = (5, " ".join(["Long", "text"] * 3000), "en")
    return rows + [(None, "No id", "en"), (900, None, "en"), (901, "", None), (902, "\t \n", "en"), (903, "É é x", "en"), (7, "again", "en"), (7, "again", "en")]


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


@pytest.mark.parametrize("own, tied, block", [(32_768, 64, 32 << 20), (10, 4, 300)])
def test_scores_of_a_table(spark, two_tongues, own, tied, block):
    rule = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    out = hidden_markov.hidden_markov_scores(docs(spark, two_tongues), rule, states=2, steps=6, own=own, tied=tied, block_bytes=block).collect()
    key = repr
    assert sorted((tuple(r[:5]) + (round(r["base_score"], 6),) for r in out), key=key) == sorted(base_scores(two_tongues, held), key=key)
    assert all(r["score"] < 0 for r in out)
    unseen = [r for r in out if r["held_out"] and r["n_tokens"] > 20]
    assert unseen and sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_one_state_is_the_unigram_model(spark, two_tongues):
    """With one state and no prior a text's probability is the product of its symbols' shares."""
    rows = [r for r in two_tongues if r[0] not in (5, 7)]
    out = hidden_markov.hidden_markov_scores(docs(spark, rows), F.lit(False), states=1, steps=1, own=1000, tied=4, prior=1e-12).collect()
    tokens = {d: re.findall(r"[^\x20\x09-\x0D]+", lowered(t)) + [""] for d, t, _ in rows}
    count = Counter(w for words in tokens.values() for w in words)
    for r in out:
        assert r["score"] == pytest.approx(sum(math.log10(count[w] / r["train_tokens"]) for w in tokens[r["doc_id"]]))


def test_scores_without_training_or_rows(spark):
    out = hidden_markov.hidden_markov_scores(docs(spark, [(1, "a b", "en"), (2, None, "en")]), F.lit(True), states=2, own=4, tied=4).collect()
    assert sorted(tuple(r)[:6] for r in out) == [(1, True, 3, 0, 0, 0.0), (2, True, 1, 0, 0, 0.0)]
    assert hidden_markov.hidden_markov_scores(docs(spark, [], 1), F.lit(False), states=2, own=4, tied=4).collect() == []


# Collocations


def best_phrases(rows, least, order, top, cover):
    found, words = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, order + 1):
                found.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in found.items():
        asked = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in asked.items():
            holds = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
            if any(len(q) > len(p) and 100 * b >= cover * a and holds(q) for q, b in asked.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, rest) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, rest, words[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(8)
    fixed = ["new york city hall", "at the end of the day", "Ünder dem Dach", "a a a a a"]
    rows = []
    for d in range(220):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else f"w{int(rng.paretovariate(1)) % 40}" for _ in range(rng.randrange(0, 40))]
        text = "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "; "]) for p in parts)
        rows.append((d, text, rng.choice(["en", "de", None, "", "und"])))
    return rows + [(1, None, "en"), (None, "New York, City Hall", "en"), (2, "x y " * 3000, "en"), (3, "z z", "zz")] + [(4, "at the end of the day", "en")] * 40


@pytest.mark.parametrize("least, top, cover, bits, part", [(30, 2000, 80, 1 << 16, 1 << 25), (3, 2000, 80, 64, 500), (2, 7, 50, 1 << 16, 4000), (1, 5, 80, 1 << 16, 1 << 25)])
def test_collocations_equal_all_ngrams(spark, talk, least, top, cover, bits, part):
    out = collocations.collocations(docs(spark, talk), least, 4, top, cover, bits, part)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in out.collect()) == best_phrases(talk, least, 4, top, cover)
    assert {t for c, t in out.dtypes if c not in ("lang", "phrase")} == {"bigint"}


def test_collocations_of_other_orders_and_nothing(spark, talk):
    out = collocations.collocations(docs(spark, talk), 5, 3, 50, 80, 1 << 16)
    assert sorted(tuple(r) for r in out.collect()) == best_phrases(talk, 5, 3, 50, 80)
    assert collocations.collocations(docs(spark, [], 1)).collect() == []
    assert collocations.collocations(docs(spark, [(1, None, None), (2, "a b", "en")])).collect() == []


def test_windows_are_summed_by_one_rollup(spark, talk):
    held = np.full(4, np.iinfo(np.uint64).max, np.uint64)  # a filter that holds everything
    windows = collocations.counted_windows(docs(spark, talk).select("lang", "text").na.fill("und", ["lang"]), 4, held, 1 << 20)
    plan = windows.rollup("lang", "w1", "w2", "w3", "w4").agg(F.sum("n"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("hashpartitioning") == 1


# Periodic runs


def all_runs(words, least):
    out = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                part = words[i : j + q]
                if not any(part[r:] == part[:-r] for r in range(1, q)):
                    out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_all_periods(seed):
    rng = random.Random(seed)
    for _ in range(250):
        words = [rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randrange(45))]
        if words and rng.random() < 0.4:
            p, a = rng.randrange(1, 8), rng.randrange(len(words))
            words = [words[i] if i < a else words[a + (i - a) % p if a + (i - a) % p < len(words) else a] for i in range(len(words))]
        least = rng.choice([1, 2, 5, 6, 12])
        expected = all_runs(words, least)
        assert periodic_runs.runs_of(words, least) == expected
        hashes = np.array(words, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(5)
        begin, end = periodic_runs.candidate_stretches(hashes, np.array([0, len(words)]), least)
        found = [(a + s, n, q) for a, b in zip(begin.tolist(), end.tolist()) for s, n, q in periodic_runs.runs_of(words[a:b], least)]
        assert sorted(found, key=lambda r: (r[0], r[2])) == expected


def test_last_ends_of_all_suffixes():
    rng = random.Random(4)
    words = [rng.randrange(2) for _ in range(70)]
    ends = periodic_runs.LastEnds()
    for i, word in enumerate(words):
        ends.append(word)
        found = {}
        for p, longest in ends.access(i):
            found[p] = max(longest, found.get(p, 0))
        for size in range(1, i + 2):
            last = max((j for j in range(size - 1, i) if words[j - size + 1 : j + 1] == words[i - size + 1 : i + 1]), default=None)
            segments = [p for p, longest in found.items() if longest >= size]
            assert (max(segments) if segments else None) == last


def test_long_words_do_not_slow_it_down():
    words = [i % 7 for i in range(60_000)]
    assert periodic_runs.runs_of(words) == [(0, 60_000, 7)]


def expected_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = all_runs(words, 12)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *figures, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def test_query_of_runs_equals_brute_force(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for d in range(260):
        words = [rng.choice(["a", "A", "é", "b c", "d."]) if rng.random() < 0.3 else f"w{rng.randrange(30)}" for _ in range(rng.randrange(0, 120))]
        if rng.random() < 0.3:
            line = words[:9]
            words = words[9:40] + line * rng.randrange(2, 6) + words[40:] + line * 2
        rows.append((d, "".join(w + rng.choice([" ", "  ", "\n", "\t ", "\x0b"]) for w in words)))
    rows += [(300, None), (301, ""), (302, " \n"), (None, "x " * 40), (303, "ab " * 5000), (303, "ab " * 5000), (304, "one"), (305, "1 2 3 4 5 6 " * 2)]
    table = docs(spark, [(d, t, None) for d, t in rows])
    table.write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op13_suffix_automaton_runs(spark, str(tmp_path))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted((expected_row(d, t) for d, t in rows), key=repr)
    assert sum(1 for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 10 == 0 and t) > 10


def test_runs_of_nothing(spark):
    assert periodic_runs.periodic_runs(docs(spark, [], 1)).collect() == []
    out = periodic_runs.periodic_runs(docs(spark, [(1, "a b " * 6, "en")]), least=6).collect()
    assert [tuple(r) for r in out] == [(1, 12, [(0, 12, 2)], "a b")]
