import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import base_spans, near_copies, repeats
from pyspark.sql import functions as F

from tidyloom.llm import language_id, license_scan, minhash, packing, pii, suffix_dedup

DOCS = "doc_id bigint, text string, `Text ` string, score string"
WORDS = [f"w{i}" for i in range(400)]


def docs(spark, rows, parts=3):
    """With columns whose names clash with those of results and parameters."""
    return spark.createDataFrame([(d, t, "x", "y") for d, t in rows], DOCS).repartition(parts)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, text, changes):
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(20, 120)) for _ in range(6)]
    rows = [(i, edited(rng, rng.choice(base), rng.randrange(0, 4))) for i in range(150)]
    rows += [(200 + i, rows[7][1]) for i in range(40)] + [(300 + i, prose(rng, 40)) for i in range(30)]
    return rows + [(400, None), (401, ""), (402, " \t\n"), (403, "a b c"), (404, "A B\tc"), (405, "É é"), (406, "é é"), (407, "x " * 30_000)]


@pytest.mark.parametrize("percent, chunk", [(85, 1_000_000), (80, 300), (85, 100)])
def test_near_duplicates_equal_all_pairs(spark, copies, percent, chunk):
    found = minhash.near_duplicates(docs(spark, copies), percent, chunk=chunk).collect()
    assert {r[0]: tuple(r)[1:] for r in found} == near_copies(copies, percent)


def test_near_duplicates_of_nulls_repeats_and_nothing(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (0, "q")]
    found = sorted(map(repr, (tuple(r) for r in minhash.near_duplicates(docs(spark, rows)).collect())))
    assert found == sorted(map(repr, [(None, 2, None, True)] * 2 + [(1, 2, 1, True)] * 2 + [(0, 1, 0, True)]))
    assert minhash.near_duplicates(docs(spark, []).limit(0)).collect() == []


def test_one_coordinate_is_a_shifted_permutation():
    x = np.arange(1 << 16, dtype=np.uint32)
    assert len(np.unique(minhash.permute32(x, minhash.PI))) == len(x)
    sets = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 50).astype(np.uint64))
    signature = minhash.circulant_signatures(sets, np.array([0, 50, 50]), 8)
    placed = minhash.permute32((sets >> np.uint64(32)).astype(np.uint32), minhash.SIGMA)
    assert signature[0].tolist() == [int(minhash.permute32(placed + np.uint32(k), minhash.PI).min()) for k in range(8)]
    assert set(signature[1].tolist()) == {0xFFFFFFFF}


@pytest.mark.parametrize("limits", [{}, {"task_windows": 300, "shard_windows": 50}])
def test_repeated_strings_equal_brute_force(spark, limits):
    rng = random.Random(3)
    passages = ["".join(rng.choice("abcé \n") for _ in range(rng.randrange(30, 200))) for _ in range(20)]
    rows = [(i, "".join(rng.choice(passages)[rng.randrange(20) : rng.randrange(25, 300)] if rng.random() < 0.6 else prose(rng, 9) for _ in range(rng.randrange(8)))) for i in range(120)]
    rows += [(1000, None), (1001, ""), (1002, "a" * 500), (1003, "ab" * 300), (1004, "x" * 39), (1005, "y" * 40), (1006, "z" * 41), (1007, rows[5][1])]
    found = suffix_dedup.remove_repeats(docs(spark, rows), 40, 10, **limits).collect()
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found}
    assert got == set(repeats(rows, 40)) and len(found) == len(rows)
    assert all(r["kept_sha256"] == hashlib.sha256(r["kept"]).hexdigest() for r in found)


def test_repeats_of_null_ids_and_nothing(spark):
    rows = [(None, "p" * 30 + "q" * 20), (None, "p" * 30 + "q" * 20), (1, "r" * 10), (2, "s" * 10), (2, "t" * 45)]
    found = suffix_dedup.remove_repeats(docs(spark, rows), 40, 10).collect()
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in found)
    assert got == [(0, 50, 50), (0, 50, 50), (1, 10, 0), (2, 10, 0), (2, 45, 45)]
    assert suffix_dedup.remove_repeats(docs(spark, []).limit(0)).collect() == []


def test_merged_transforms_sort_like_one():
    rng = np.random.default_rng(2)
    blocks = rng.integers(0, 3, (4, 60)).astype(np.uint64)
    built = [suffix_dedup.transform(blocks[:, a:b]) for a, b in ((0, 25), (25, 26), (26, 60))]
    shard, interval = suffix_dedup.merged([t for t, _ in built])
    queues = [iter((order + a).tolist()) for (_, order), a in zip(built, (0, 25, 26))]
    order = [next(queues[s]) for s in shard]
    columns = [tuple(blocks[:, i]) for i in order]
    assert columns == sorted(columns)
    assert [a == b for a, b in zip(interval, interval[1:])] == [a == b for a, b in zip(columns, columns[1:])]


def test_anchors_find_what_the_patterns_find():
    rng, found = random.Random(1), pii.automaton()
    for _ in range(5000):
        text = "".join(rng.choice("0123 459-.()+@ab. %é\n12") for _ in range(rng.randrange(60)))
        assert [s for s in pii.spans(text, found) if s[2] in pii.BASE] == base_spans(text), text


def test_pii_report_and_redaction(spark):
    text = "é a.b@c.org, 1.2.3.256 1.2.3.4.5, 4111 1111-1111 1111 +1 (743) 555-3824 acct: 12345678 at 12 Old Mill Road, IBAN GB82 WEST 1234 5698 7654 32 https://u.x/y."
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, "7" * 100_000 + "@"), (None, "x@y.z")]
    found = {(r["doc_id"], r["spans"]): r for r in pii.pii_report(docs(spark, rows)).collect()}
    kinds = ",".join(f"{k}:{s}:{e}" for s, e, k in pii.spans(text, pii.automaton()))
    row = found[(1, kinds)]
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == (1, 1, 1, 1)
    base = ",".join(f"{k}:{s}:{e}" for s, e, k in base_spans(text))
    assert row["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert {"account", "address", "url"} <= {part.split(":")[0] for part in kinds.split(",")}
    assert found[(2, "")]["base_sha256"] == hashlib.sha256(b"").hexdigest() and (None, "email:0:5") in found
    redacted = {r["doc_id"]: r["text"] for r in pii.redact_pii(docs(spark, rows)).collect()}
    assert redacted[1].startswith("é <email>, 1.2.3.256 <ip>.5, <card> <phone> acct: <account> at <address>")
    assert redacted[2] is None and redacted[3] == "" and redacted[None] == "<email>"
    assert pii.pii_report(docs(spark, []).limit(0)).collect() == []


@pytest.mark.parametrize("cue", [*pii.STREET_KINDS, *(c.capitalize() for c in pii.STREET_CUES), *pii.STREET_CUES, "ST"])
def test_every_kind_of_street_is_a_cue(cue):
    found = pii.automaton()
    assert pii.redact(f"lives at 12 Old Oak {cue}. Then", found) == "lives at <address>. Then"
    for other in (f"12 old oak {cue}", f"Old Oak {cue}", f"12 Old Oak {cue}x", f"12 {cue}"):
        assert pii.redact(other, found) == other


def test_small_words_are_no_cues():
    assert pii.redact("in 2019 Apple way ahead, 3 Months drive", pii.automaton()) == "in 2019 Apple way ahead, 3 Months drive"


LANGUAGES = {"aa": "kolu tami resa", "bb": "strü wölk gläß", "cc": "ñandú caño peña"}


def test_network_on_held_out_rows(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(LANGUAGES[k].split()) for _ in range(rng.randrange(5, 60))), k, "z") for i, k in enumerate(rng.choices(list(LANGUAGES), k=400))]
    rows += [(1000, None, "aa", "z"), (1001, "", "bb", "z"), (1002, "12 - 34 !", "cc", "z"), (None, "kolu tami", None, "z"), (1003, "strü " * 30_000, None, "z"), (1004, "kolu\0tami resa", None, "z")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, Score string").repartition(3)
    found = language_id.identify_language(table, steps=300).collect()
    got = {r["doc_id"]: r for r in found}
    tested = [i for i in range(400) if got[i]["held_out"]]
    assert 60 < len(tested) < 140
    assert np.mean([got[i]["lang_pred"] == rows[i][2] for i in tested]) > 0.97
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert got[1003]["lang_pred"] == "bb" and got[None]["lang_pred"] == "aa" and not got[None]["held_out"]
    assert all(0 <= r["score"] <= 1 for r in found) and len(found) == len(rows)
    blind = language_id.identify_language(table.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in blind} == {"und"}
    assert language_id.identify_language(table.limit(0)).collect() == []


def test_posteriors_equal_a_plain_convolution():
    """Windows, filters at every place, the greatest answers, a dense layer, and means weighted by bytes."""
    rng = np.random.default_rng(3)
    network = language_id.train([b"abca", b"cddc", "éa".encode()] * 9, ["x", "y", "z"] * 9, steps=30, window=16, crop=16)
    for size in (0, 1, 2, 13, 14, 15, 16, 17, 40):
        text = bytes(rng.integers(1, 256, size).astype(np.uint8))
        padded = text + bytes(64)
        out, used = np.zeros(3), 0
        for at in range(0, size + 3, 16):
            maps = [[sum(network.filters[j][padded[at + i + j]][f] for j in range(4)) for f in range(network.filters.shape[2])] for i in range(16)]
            hidden = np.maximum(np.max(maps, axis=0) + network.bias, 0)
            scores = hidden @ network.dense + network.offset
            chance = np.exp(scores - scores.max())
            weight = min(max(size - at, 0), 16)
            out += chance / chance.sum() * weight
            used += weight
        found = language_id.posteriors(network, np.frombuffer(text, np.uint8), np.array([0, size]))[0]
        np.testing.assert_allclose(found, out / max(used, 1), atol=1e-5)


def test_too_many_languages_are_refused_and_repeated_rows_are_told_alike(spark):
    rows = [(i, f"kolu{i % 5} tami", f"l{i % 5}") for i in range(60)] * 2
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    with pytest.raises(ValueError, match="more than 4 different languages"):
        language_id.identify_language(table, max_languages=4)
    told = {}
    for r in language_id.identify_language(table, steps=20).collect():
        told.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert all(len(x) == 2 and x[0] == x[1] for x in told.values())


def test_posteriors_do_not_depend_on_neighbours():
    network = language_id.train([b"abab", b"cdcd"] * 20, ["x", "y"] * 20, steps=50, window=16, crop=16)
    texts = [b"ab" * 20, b"", b"cd" * 8, b"a" * 16, b"d"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum([0] + [len(t) for t in texts])
    together = language_id.posteriors(network, data, starts)
    for i, text in enumerate(texts):
        alone = language_id.posteriors(network, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        np.testing.assert_allclose(together[i], alone[0], atol=1e-6)


def test_licenses_in_windows(spark):
    rng = random.Random(6)
    texts = license_scan.TEMPLATES
    rows = [(i, prose(rng, rng.randrange(80)) + " " + text.upper().replace(",", " ,") + "\n" + prose(rng, rng.randrange(80))) for i, text in enumerate(texts.values())]
    rows += [(50, " ".join(texts["GPL-3.0"].split()[:5])), (51, edited(rng, texts["MIT-text"], 1)), (52, None), (53, ""), (54, prose(rng, 60_000) + " " + texts["MIT"])]
    rows += [(55, f"{texts['MIT']} {prose(rng, 30)} {texts['MIT']}"), (None, texts["MIT"])]
    found = license_scan.scan_licenses(docs(spark, rows)).collect()
    got = {(r["doc_id"], r["license"]): r for r in found}
    words = lambda t: license_scan.ordered_shingles(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), 5)[0].tolist()
    expected = set()
    for d, text in rows:
        own = words(text or "")
        for name, template in texts.items():
            wanted = set(words(template))
            n = len(wanted)
            if any(len(set(own[i : i + n]) & wanted) >= 0.8 * n for i in range(len(own)) if own[i] in wanted):
                expected.add((d, name))
    assert set(got) == expected and len(found) == len(got)
    assert got[(55, "MIT")]["matches"] == 2 and got[(55, "MIT")]["containment"] == 1.0
    assert license_scan.scan_licenses(docs(spark, []).limit(0)).collect() == []


def test_public_licenses_are_told_apart(spark):
    rng = random.Random(9)
    texts = license_scan.public_licenses()
    gnu = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    rows = [(i, f"{prose(rng, 20)} {text} {prose(rng, 20)}") for i, text in enumerate(texts.values())]
    rows += [(200, gnu.format("General", 2)), (201, gnu.format("Lesser General", "2.1")), (202, gnu.format("Lesser General", 3)), (203, gnu.format("Affero General", 3))]
    rows += [(204, f"This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. {prose(rng, 20)}"), (205, texts["GPL-3.0"])]
    found = {}
    for r in license_scan.scan_licenses(docs(spark, rows)).collect():
        found.setdefault(r["doc_id"], {})[r["license"]] = r["containment"]
    for i, name in enumerate(texts):
        assert found[i][name] == 1.0, name
    assert [list(found[i]) for i in range(200, 206)] == [["GPL-2.0-header"], ["LGPL-2.1-header"], ["LGPL-3.0-header"], ["AGPL-3.0-header"], ["CC-BY-SA-4.0-notice"], ["GPL-3.0"]]


def test_license_templates_from_a_table(spark):
    table = spark.createDataFrame([("own", "you may read this text but never sell it"), ("none", None)], "license string, text string")
    rows = [(1, "x y You may read this text, but never sell it. z"), (2, "Released under the MIT License")]
    assert [(r["doc_id"], r["license"]) for r in license_scan.scan_licenses(docs(spark, rows), table).collect()] == [(1, "own")]
    with pytest.raises(ValueError, match="different names"):
        license_scan.scan_licenses(docs(spark, rows), table.unionAll(table))


public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_word_cutting_equals_the_tokenizer():
    rng, own = random.Random(2), packing.WordTokenizer(TOKENIZER)
    alphabet = "aAzéÉß'st re ve'm0 9²½\x85\xa0\x1c\n!?…µªÿ×÷İΣ<|>«»́-_"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(25))) for _ in range(3000)] + ["<|endoftext|> a", ""]
    for i in range(0, len(texts), 100):
        part = texts[i : i + 100]
        assert [x.tolist() for x in own.ids(part)] == [x.tolist() for x in own.whole(part)]


def assert_packed(rows, pieces, size):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for d, t, *_ in rows}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(ids)
    for d, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[d])
            piece = np.asarray(ids[d][at : at + p["length"]], "<u4").tobytes()
            assert p["ids_crc32"] == packing.zlib.crc32(piece)
            at += p["length"]
        assert at == len(ids[d])
    lengths = []
    for s in range(len(by_sequence)):
        at = 0
        for p in sorted(by_sequence[s], key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        lengths.append(at)
    assert all(n == size for n in lengths[:-1]) and 0 < lengths[-1] <= size
    return by_sequence


def carried(pieces, size, share):
    """The most that a queue's tokens up to the end of any sequence differ from ``share(queue, position)``."""
    sent, worst = {}, 0
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        sent[p["queue"]] = sent.get(p["queue"], 0) + p["length"]
        if p["offset"] + p["length"] == size:
            worst = max([worst, *(abs(n - share(q, (p["sequence_id"] + 1) * size)) for q, n in sent.items())])
    return worst


@pytest.mark.parametrize("weights, unit, bins", [(None, 16, 1 << 20), ({"a": 3.0, "b": 1.0}, 16, 512), (None, 1024, 256)])
def test_packing_places_each_id_once(spark, weights, unit, bins):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(80)), rng.choice(["a", "a", "a", "b", None])) for i in range(200)]
    rows += [(500, None, "b"), (501, "", "c"), (502, prose(rng, 5000), "a")]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, source string, queue int, bin int").repartition(4)
    pieces = packing.pack(table, TOKENIZER, size=256, weights=weights, unit=unit, bin_tokens=bins).collect()
    assert_packed(rows, pieces, 256)
    total = Counter()
    for p in pieces:
        total[p["queue"]] += p["length"]
    whole = sum(total.values())
    if weights is None:
        # Each queue is within a unit of its credit, so the stream is within as many units as there are queues.
        assert carried(pieces, 256, lambda q, at: at * total[q] / whole) <= 2 * unit * len(total)
    else:
        first = [p for p in pieces if (p["sequence_id"] + 1) * 256 <= total["b"] * 4 - 1024]
        assert first and {p["queue"] for p in first} == {"a", "b"}
        assert carried(first, 256, lambda q, at: at * (0.75 if q == "a" else 0.25)) <= 4 * unit


def test_packing_of_nothing_long_units_and_repeated_rows(spark):
    table = spark.createDataFrame([(i, f"w{i} x", f"s{i % 7}") for i in range(60)], "doc_id bigint, text string, source string")
    assert packing.pack(table.limit(0), TOKENIZER).collect() == []
    assert_packed([tuple(r) for r in table.collect()], packing.pack(table, TOKENIZER, size=16, unit=1).collect(), 16)
    twice = packing.pack(table.unionAll(table), TOKENIZER, size=16).collect()
    once = packing.pack(table, TOKENIZER, size=16).collect()
    assert sum(p["length"] for p in twice) == 2 * sum(p["length"] for p in once)
    whole = packing.pack(table.withColumn("doc_id", F.lit(None).cast("bigint")), TOKENIZER, size=1 << 20).collect()
    assert {p["doc_id"] for p in whole} == {None} and {p["length"] for p in whole} == {p["doc_tokens"] for p in whole}


@pytest.mark.parametrize("sources", [1000, 5000])
def test_packing_of_many_sources(spark, sources):
    """Documents stay in long pieces, and every id has one place, with one source that holds a third of all rows."""
    rng = random.Random(3)
    words = [rng.choice(WORDS) for _ in range(20_000)]
    rows = []
    for i in range(10_000):
        at, n = rng.randrange(10_000), 9000 if i == 77 else rng.randrange(150, 450)
        rows.append((i, " ".join(words[at : at + n]), "hot" if i % 3 == 0 else f"s{i % sources}"))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(8)
    pieces = packing.pack(table, TOKENIZER).toPandas()
    by_doc = pieces.sort_values(["doc_id", "start"]).groupby("doc_id")
    assert len(by_doc) == 10_000 and (by_doc["length"].sum() == by_doc["doc_tokens"].first()).all()
    assert (pieces.sort_values(["doc_id", "start"]).groupby("doc_id")["length"].cumsum() - pieces["length"]).eq(pieces["start"]).all()
    by_sequence = pieces.sort_values(["sequence_id", "offset"]).groupby("sequence_id")["length"]
    assert (by_sequence.cumsum() - pieces["length"]).eq(pieces["offset"]).all()
    assert (by_sequence.sum().iloc[:-1] == 4096).all()
    assert pieces["length"].mean() > 100
    hot = pieces[pieces["queue"] == "hot"].groupby("sequence_id")["length"].sum()
    share = pieces[pieces["queue"] == "hot"]["length"].sum() / pieces["length"].sum()
    quarters = np.array_split(hot.reindex(range(pieces["sequence_id"].max())).fillna(0).to_numpy(), 4)
    assert all(abs(q.mean() / 4096 - share) < 0.05 for q in quarters)


def test_phases_hand_a_dry_queues_credit_on():
    plan = packing.phases({"a": 10**14, "b": 3 * 10**14 + 7, "none": 0}, {"a": 1.0, "b": 1.0})
    assert plan == [("a", 0, 10**14, 0, 2 * 10**14), ("b", 0, 10**14, 0, 2 * 10**14), ("b", 10**14, 3 * 10**14 + 7, 2 * 10**14, 2 * 10**14 + 7)]
    assert packing.phases({}, {"a": 1.0}) == []
