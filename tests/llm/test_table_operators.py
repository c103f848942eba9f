import gzip
import hashlib
import io
import random

import numpy as np
import pytest
from helpers import component_names, near_copies
from pyspark.sql import functions as F

from tidyloom.llm import archives, common, embedding_join, kmeans_tree, mixing


@pytest.mark.parametrize("links", [[], [(1, 1)], [(i, i + 1) for i in range(60)] + [(99, 98), (98, 99)], [(0, i) for i in range(1, 50)]])
def test_components_of_chains_and_stars(spark, links):
    edges = spark.createDataFrame(links, "a bigint, b bigint")
    nodes = {n for a, b in links for n in (a, b) if a != b}
    expected = component_names(nodes, [x for x in links if x[0] != x[1]])
    assert {r[0]: r[1] for r in common.components(edges).collect()} == expected


VECTORS = "vec_id bigint, embedding array<float>, label int, rep string"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(9)
    middles = rng.normal(size=(12, 24))
    rows = []
    for i in range(260):
        v = middles[rng.integers(12)] + rng.normal(size=24) * rng.choice([0.05, 0.2, 0.4, 2])
        rows.append((i, [float(np.float32(x)) for x in v * rng.choice([1, 3])], int(rng.integers(3)), "r"))
    rows += [(500 + i, rows[3][1], 1, "r") for i in range(30)]
    odd = [None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, [1.0, 2.0], [-0.0, 1.0]]
    rows += [(600 + i, v, 1, "r") for i, v in enumerate(odd)]
    return rows + [(700, rows[3][1], None, "r"), (701, [1.0, 2.0], 1, "r"), (702, [0.0, 1.0], 1, "r")]


def good(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("chunk", [3000, 7])
def test_vector_links_equal_all_pairs(spark, vectors, chunk):
    table = spark.createDataFrame(vectors, VECTORS).repartition(4)
    use = [(i, np.array(v), l) for i, v, l, _ in vectors if good(v) and l is not None]
    links = [
        (i, j)
        for a, (i, v, l) in enumerate(use)
        for j, w, m in use[:a]
        if l == m and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93
    ]
    degree = dict.fromkeys((r[0] for r in vectors), 0)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    name = component_names(degree, links)
    found = embedding_join.near_vectors(table, 0.93, chunk=chunk).collect()
    assert {tuple(r) for r in found} == {(i, degree[i], name[i], name[i] == i) for i in degree} and len(found) == len(vectors)


def test_vector_join_of_nothing(spark):
    assert embedding_join.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []
    assert kmeans_tree.nearest_vectors(spark.createDataFrame([], VECTORS), "vec_id % 2 = 0").collect() == []


def test_tree_search_recall_ties_and_scores(spark, vectors):
    rng = np.random.default_rng(3)
    rows = [r for r in vectors if r[1] is None or len(r[1]) != 2] + [(1000 + i, [float(np.float32(x)) for x in rng.normal(size=24)], 0, "r") for i in range(900)]
    table = spark.createDataFrame(rows, VECTORS).repartition(4)
    found = kmeans_tree.nearest_vectors(table, "vec_id % 10 = 0", recall=0.97, leaf_rows=20, chunk=50).collect()
    use = {i: np.array(v) for i, v, *_ in rows if good(v)}
    hits = total = 0
    for q in [i for i in use if i % 10 == 0]:
        own = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11))
        exact = {i: float(np.sqrt(((use[i] - use[q]) ** 2).sum())) for i in use if i != q}
        assert all(r["score"] == pytest.approx(exact[r["vec_id"]], abs=1e-12) for r in own)
        assert [(r["score"], r["vec_id"]) for r in own] == sorted((r["score"], r["vec_id"]) for r in own)
        best = sorted(exact, key=lambda i: (exact[i], i))[:10]
        hits, total = hits + len(set(best) & {r["vec_id"] for r in own}), total + 10
    assert hits >= 0.9 * total and {r["query_id"] for r in found} == {i for i in use if i % 10 == 0}


def test_best_bins_visit_every_leaf_once():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 6))
    tree = kmeans_tree.fit_tree(x, 40)
    assert sorted(kmeans_tree.best_bins(tree, x[0], 10**6, np.ones(tree.leaves), 0)) == list(range(tree.leaves)) and tree.leaves > 20
    assert kmeans_tree.best_bins(tree, x[0], 1, np.ones(tree.leaves), 0) == [kmeans_tree.leaf_of(tree, x[:1])[0]]
    assert len(kmeans_tree.best_bins(tree, x[0], 1, np.ones(tree.leaves), 5)) == 5


def test_vector_links_of_repeated_ids(spark):
    rows = [(5, [1.0, 0.0], 1, "r"), (5, [1.0, 0.0], 1, "r"), (5, [0.0, 1.0], 1, "r"), (9, [0.01, 1.0], 1, "r"), (9, [0.02, 1.0], 2, "r"), (7, [1.0, 0.01], 1, "r")]
    found = embedding_join.near_vectors(spark.createDataFrame(rows, VECTORS).repartition(3), 0.93).collect()
    assert sorted(tuple(r) for r in found) == [(5, 1, 5, True), (5, 2, 5, True), (5, 2, 5, True), (7, 2, 5, False), (9, 0, 9, True), (9, 1, 5, False)]


def test_lone_vectors_get_as_many_neighbours_as_all(spark):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(100, 16)) * 10
    rows = [(1 + i, (middles[i // 60] + rng.normal(size=16) * 1e-3).tolist(), 0, "r") for i in range(6000)]
    rows = [(100_000 + i, v, g, r) if i % 100 == 0 else (i, v, g, r) for i, v, g, r in rows]
    rows += [(200_000 + 100 * i, (rng.normal(size=16) * 200).tolist(), 0, "r") for i in range(12)]
    found = kmeans_tree.nearest_vectors(spark.createDataFrame(rows, VECTORS).repartition(4), "vec_id % 100 = 0").groupBy("query_id").count().collect()
    assert {r["query_id"] for r in found} == {r[0] for r in rows if r[0] % 100 == 0}
    assert {r["count"] for r in found} == {10}


def test_neighbours_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0], 0, "r"), (0, [1.0, 0.0], 0, "r"), (0, [9.0, 9.0], 0, "r"), (5, [1.0, 1.0], 0, "r"), (5, [1.0, 2.0], 0, "r"), (None, [1.0, 0.0], 0, "r")]
    found = kmeans_tree.nearest_vectors(spark.createDataFrame(rows, VECTORS), "vec_id = 0").collect()
    assert [tuple(r) for r in sorted(found)] == [(0, 1, 5, 1.0), (0, 2, 5, 2.0)]
    assert kmeans_tree.fit_tree(np.ones((50, 3)), 10).leaves == 1


def test_few_candidates(spark):
    rows = [(i, [float(i), 1.0], 0, "r") for i in range(4)]
    found = kmeans_tree.nearest_vectors(spark.createDataFrame(rows, VECTORS), "vec_id = 1").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(found)] == [(1, 0, 1.0), (2, 2, 1.0), (3, 3, 2.0)]


def test_pages_through_both_archive_formats(spark):
    rng = random.Random(2)
    big = "é" * 600
    rows = [(i, f"http://x/{i} é", "".join(rng.choice("ab \r\n\0é") for _ in range(rng.randrange(2000)))) for i in range(40)]
    rows += [(100 + i, "u", big) for i in range(20)] + [(200, None, None), (201, "a\nb", ""), (202, "", "x"), (203, "", "x"), (204, "u", "y" * 1000), (None, "u", big), (119, "u", big)]
    table = spark.createDataFrame([(*r, 0) for r in rows], "page_id bigint, url string, html string, path int").repartition(4)
    found = archives.archived_pages(table, file_bytes=3000).collect()
    payloads = [(i, (h or "").encode()) for i, _, h in rows]
    latest = {}
    for i, b in payloads:
        latest[b] = max(latest.get(b, -1), -1 if i is None else i)
    expected, spent = [], set()
    for i, b in payloads:
        first = i == latest[b] and b not in spent
        if first:
            spent.add(b)
        again = len(b) >= 1000 and not first
        expected.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", latest[b] if again else None))
    assert sorted(map(repr, (tuple(r) for r in found))) == sorted(map(repr, expected))
    assert archives.archived_pages(table.limit(0)).collect() == []


@pytest.mark.parametrize("version", [1, 2])
def test_arc_headers_by_version(version):
    body = b"HTTP/1.0 404 Not Found\r\n\r\nline\n\nline"
    values = {"URL": "http://a/b c", "IP-address": "1.2.3.4", "Archive-date": "199612312359", "Content-type": "text/html", "Archive-length": str(len(body))}
    data = archives.arc_head(version, "f.arc", "1996") + b"\n" + archives.arc_line(version, values) + body + b"\n"
    (record,) = archives.arc_records(io.BytesIO(data))
    assert record.fields["URL"] == "http://a/b c" and record.block == body
    assert list(record.fields) == list(archives.ARC_FIELDS[version])
    headers, block = next(archives.warc_records(io.BytesIO(archives.converted("f.arc", record, None))))
    assert headers["warc-date"] == "1996-12-31T23:59:00Z" and headers["warc-type"] == "response" and block == body
    assert headers["warc-ip-address"] == "1.2.3.4" and headers["warc-record-id"].startswith("<urn:uuid:")
    with pytest.raises(ValueError, match="declared length"):
        list(archives.arc_records(io.BytesIO(data[:-9])))
    with pytest.raises(ValueError, match="does not match"):
        list(archives.warc_records(io.BytesIO(archives.converted("f.arc", record, None).replace(b"Not", b"not"))))


def test_records_without_http_are_resources():
    record = archives.ArcRecord(0, {"URL": "dns:x", "IP-address": "-", "Archive-date": "20010203", "Content-type": "text/dns"}, b"x")
    headers, block = next(archives.warc_records(io.BytesIO(archives.converted("f", record, None))))
    assert headers["warc-type"] == "resource" and headers["content-type"] == "text/dns" and block == b"x"
    assert gzip.decompress(gzip.compress(block)) == block


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(12)
    common_words = [f"c{i}" for i in range(60)]
    marks = {"high": "fine", "low": "$$$", "toxic": "vile"}
    rows, labels = [], []
    for i in range(600):
        kind = rng.choices(list(marks), [6, 3, 1])[0]
        words = [rng.choice(common_words) for _ in range(rng.randrange(10, 60))]
        for _ in range(3):
            words[rng.randrange(len(words))] = marks[kind]
        rows.append((i, " ".join(words), kind))
        if i % 2:
            labels.append((i, int(kind != "low"), int(kind == "toxic")))
    rows += [(900, None, "high"), (901, "", "high"), (None, "c1 c2 fine", "high")]
    labels += [(None, 1, 0), (5000, 0, 1), (1, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, copies string").repartition(3)
    return rows, docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_rates_meet_the_targets(labelled):
    rows, docs, labels = labelled
    found = mixing.mixing_rates(docs, labels, {"high": 0.5, "low": 0.5}).collect()
    assert len(found) == len(rows)
    total = sum(r["rate"] * r["tokens"] * np.array(r["chances"]) for r in found)
    np.testing.assert_allclose(total / total.sum(), [0.5, 0.5, 0], atol=0.01)
    kinds = {r[0]: r[2] for r in rows}
    own = [r for r in found if r["doc_id"] is not None and r["tokens"]]
    assert np.mean([r["domain"] == kinds[r["doc_id"]] for r in own]) > 0.95
    assert all(r["rate"] >= 0 and abs(r["copies"] - r["rate"]) < 1 for r in found)
    assert np.mean([r["copies"] == 0 for r in own if kinds[r["doc_id"]] == "toxic"]) > 0.9


def test_rates_equal_projected_gradients_in_numpy(spark):
    rng = np.random.default_rng(4)
    chances = np.round(rng.dirichlet([0.4, 0.4, 0.4], 300), 9)
    tokens = rng.integers(0, 100, 300)
    table = spark.createDataFrame([(i, int(t), [float(x) for x in p]) for i, (t, p) in enumerate(zip(tokens, chances))], "doc_id bigint, tokens bigint, chances array<double>").repartition(5)
    steps = mixing.fit_rates(table, [2, 1, 1])
    mass = tokens @ chances
    wanted = np.array([0.5, 0.25, 0.25]) * max(mass / [0.5, 0.25, 0.25])
    rates = np.ones(300)
    for step in steps:
        gradient = ((rates * tokens) @ chances - wanted) / mass
        np.testing.assert_allclose(step, gradient, atol=1e-9)
        rates = np.maximum(0, rates - chances @ gradient)
    np.testing.assert_allclose(mixing.rates_after(chances, steps), rates, atol=1e-6)
    np.testing.assert_allclose((rates * tokens) @ chances, wanted, rtol=2e-3)


def test_mixing_without_labels_and_of_nothing(labelled):
    rows, docs, labels = labelled
    found = mixing.mixing_rates(docs, labels.limit(0), {"high": 1.0}).collect()
    assert {(r["domain"], r["rate"], r["copies"]) for r in found} == {("all", 1.0, 1)}
    assert mixing.mixing_rates(docs.limit(0), labels, {"high": 1.0}).collect() == []


def test_copies_become_rows(spark):
    docs = spark.createDataFrame([(1, "a", 7), (2, "b", 8), (3, "c", 9), (None, "d", 1)], "doc_id bigint, text string, copies int")
    rates = spark.createDataFrame([(1, 0), (2, 3), (None, 5)], "doc_id bigint, copies int")
    found = mixing.mixed(docs, rates)
    assert found.columns == docs.columns
    assert sorted(r["text"] for r in found.collect()) == ["b", "b", "b", "c", "d"]


def test_pipeline_stages_take_effect(spark, labelled):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    from tidyloom.llm import queries

    smoke = "/root/testdata/sf0.001"
    documents = queries.table(spark, smoke, "documents")
    odd = [(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "12 34", "en", "s", 5), (10**6 + 3, "+1 (743) 555-3824 and a.b@c.org in the text that follows here", None, None, 61)]
    docs = documents.unionAll(spark.createDataFrame(odd, documents.schema))
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.written(stage(spark, docs, smoke), name)
        rows[name] = docs
        if name != "packing":
            assert docs.columns == documents.columns and dict(docs.dtypes) == dict(before.dtypes)
    language = {r["doc_id"] for r in rows["language"].collect()}
    assert not language & {10**6, 10**6 + 1, 10**6 + 2} and language >= {r["doc_id"] for r in documents.filter(F.length("text") > 200).collect()}
    groups = near_copies([(r["doc_id"], r["text"]) for r in rows["language"].collect()], 80)
    assert {r["doc_id"] for r in rows["near_duplicates"].collect()} == {d for d, (_, _, kept) in groups.items() if kept}
    cleaned = {r["doc_id"]: r for r in rows["personal_data"].collect()}
    assert set(cleaned) == {d for d, (_, _, kept) in groups.items() if kept}
    assert cleaned[10**6 + 3]["text"] == "<phone> and <email> in the text that follows here" and cleaned[10**6 + 3]["n_chars"] == 49
    mixture = [r["doc_id"] for r in rows["mixture"].collect()]
    assert set(mixture) <= set(cleaned) and len(mixture) > 0.5 * len(cleaned)
    assert sum(r["length"] for r in rows["packing"].collect()) == sum(r["doc_tokens"] for r in rows["packing"].filter("start = 0").collect())
    assert {r["doc_id"] for r in rows["packing"].collect()} == set(mixture)


def posterior_table(spark, chances, tokens):
    return spark.createDataFrame([(int(t), [float(x) for x in p]) for t, p in zip(tokens, chances)], "tokens bigint, chances array<double>").repartition(5)


@pytest.mark.parametrize("weights", [[0.3, 0.5, 0.2], [0.8, 0.2, 0.0], [0.3, 0.2, 0.5]])
def test_overlapping_domains_meet_the_targets(spark, weights):
    rng = np.random.default_rng(5)
    kind = rng.choice(3, 800, p=[0.76, 0.13, 0.11])
    scores = np.log([0.76, 0.13, 0.11]) + rng.normal(0, 1, (800, 3)) + 1.2 * np.eye(3)[kind]
    chances = np.round(np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True), 9)
    tokens = rng.integers(1, 100, 800)
    steps = mixing.fit_rates(posterior_table(spark, chances, tokens), weights)
    own, other = mixing.wanted_chances(chances, weights)
    mass = (np.where(other, 0, mixing.rates_after(own, steps)) * tokens) @ own
    np.testing.assert_allclose(mass / mass.sum(), [w for w in weights if w], atol=2e-4)


def test_targets_out_of_reach_are_refused(spark):
    with pytest.raises(ValueError, match="no rates give the shares"):
        mixing.fit_rates(posterior_table(spark, [[0.9, 0.1], [0.7, 0.3]] * 5, [10] * 10), [0.5, 0.5])


def test_the_mixture_stage_drops_only_toxic_documents(spark, labelled, monkeypatch):
    import corpus_pipeline

    _, docs, labels = labelled
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, sf_dir, name: labels)
    told = {r["doc_id"]: r["domain"] for r in mixing.mixing_rates(docs, labels, {"high": 1.0}).collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.mix_to_weights(spark, docs, "").collect()}
    assert "toxic" in told.values() and {d for d in told if d is not None} - kept == {d for d, k in told.items() if k == "toxic" and d is not None}


@pytest.mark.parametrize("weights", [[0.8, 0.2, 0.0], [0.2, 0.5, 0.3], [0.1, 0.9, 0.0]])
def test_keeping_rates_meet_the_targets_from_above(spark, weights):
    rng = np.random.default_rng(7)
    chances = np.round(rng.dirichlet([0.9, 0.3, 0.2], 400), 9)
    tokens = rng.integers(0, 100, 400)
    table = spark.createDataFrame([(int(t), [float(x) for x in p]) for t, p in zip(tokens, chances)], "tokens bigint, chances array<double>").repartition(5)
    own, other = mixing.wanted_chances(chances, weights)
    steps = mixing.fit_rates(table, weights, keep=True)
    assert steps
    rates = np.where(other, 0, mixing.rates_after(own, steps, 1.0))
    mass = (rates * tokens) @ own
    np.testing.assert_allclose(mass / mass.sum(), [w for w in weights if w], atol=2e-4)
    assert (other == (np.array(weights)[chances.argmax(axis=1)] == 0)).all() and rates[~other].min() >= 1


def test_keeping_steps_are_projected_gradients(spark):
    """Each step moves the rates against the gradient of the relative errors and projects them onto 1 and more."""
    rng = np.random.default_rng(2)
    chances, tokens = np.round(rng.dirichlet([2, 1], 60), 9), rng.integers(1, 50, 60)
    steps = mixing.fit_rates(posterior_table(spark, chances, tokens), [0.6, 0.4], keep=True, max_steps=300)
    rates, start, share = np.ones(60), tokens @ chances, np.array([0.6, 0.4])
    for step in steps:
        mass = (rates * tokens) @ chances
        total = max((share / start**2) @ mass / ((share / start**2) @ share), start.sum())
        np.testing.assert_allclose(step, (mass - share * total) / start, atol=1e-9)
        rates = np.maximum(1, rates - chances @ step)
    mass = (rates * tokens) @ chances
    np.testing.assert_allclose(mass / mass.sum(), share, atol=2e-4)


def test_posteriors_that_tell_nothing_keep_the_rates(spark, labelled, monkeypatch):
    flat = posterior_table(spark, [[0.75, 0.25]] * 4, [5] * 4)
    with pytest.raises(ValueError, match="no rates"):
        mixing.fit_rates(flat, [0.5, 0.5], keep=True)
    _, docs, labels = labelled
    fit = mixing.fit_rates
    monkeypatch.setattr(mixing, "fit_rates", lambda table, weights, keep: fit(flat, [0.5, 0.5], keep=keep))
    with pytest.warns(UserWarning, match="no rates"):
        found = mixing.mixing_rates(docs, labels, {"high": 0.5, "low": 0.5}, keep=True).collect()
    assert {r["rate"] for r in found if r["domain"] != "toxic"} == {1.0}


def test_more_repeats_than_allowed_are_refused(spark, labelled):
    _, docs, labels = labelled
    with pytest.raises(ValueError, match="more than 1.5"):
        mixing.mixing_rates(docs, labels, {"high": 0.02, "low": 0.98}, keep=True, most=1.5)


def test_sums_that_are_not_finite_are_refused(spark):
    with pytest.raises(ArithmeticError, match="finite"):
        mixing.fit_rates(posterior_table(spark, [[float("nan"), 0.5]] * 3, [1] * 3), [0.5, 0.5])


def test_domain_table_equals_a_plain_restatement(spark, labelled):
    """Words and posteriors of every text from sets of its words and shares of its characters."""
    rows, docs, labels = labelled
    model = mixing.learn_domains(docs, labels)
    for r in mixing.domain_table(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        data = (r["text"] or "").encode()
        words = data.split()
        assert r["tokens"] == len(words)
        lowered = {bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words}
        hashes = {int(common.word_hashes(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[0][0]) >> (64 - mixing.BITS) for w in lowered}
        n = max(len(data), 1)
        shares = [3 * sum(low <= b < high for b in data) / n for low, high in ((65, 91), (33, 48), (48, 58))]
        scores = np.array([1, *shares, len(lowered) / max(len(words), 1)]) @ model.weights[-mixing.SHAPES :] + sum((model.weights[h] for h in hashes), np.zeros(len(model.domains)))
        chances = np.exp(scores - scores.max())
        np.testing.assert_allclose(r["chances"], chances / chances.sum(), atol=1e-6)


def test_stages_of_nothing_of_repeated_ids_and_of_clashing_names(spark):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    from tidyloom.llm import queries

    smoke = "/root/testdata/sf0.001"
    documents = queries.table(spark, smoke, "documents")
    extra = [F.lit("x").alias(c) for c in ("__language", "__chance", "__times", "__letters", "copies", "rate", "lang_pred", "tokens", "bin", "round", "queue", "kept")]
    docs = documents.unionAll(documents.filter("doc_id < 20")).unionAll(documents.filter("doc_id < 5").withColumn("doc_id", F.lit(None).cast("bigint")))
    docs = docs.select("*", *extra)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), smoke)
        assert empty.collect() == []
        before, docs = docs, common.written(stage(spark, docs, smoke), name)
        if name != "packing":
            assert docs.columns == before.columns == empty.columns and docs.count() > 0
            assert {r["__times"] for r in docs.select("__times").distinct().collect()} == {"x"}
        if name == "near_duplicates":
            # Rows that share an id stand or fall together, and those without one stay.
            assert docs.filter("doc_id IS NULL").count() == before.filter("doc_id IS NULL").count()
            times = {r["doc_id"]: r["count"] for r in docs.groupBy("doc_id").count().collect()}
            assert all(n == 2 for d, n in times.items() if d is not None and d < 20)


def test_features_of_a_text_are_bounded():
    texts = [" ".join(f"w{i}" for i in range(100_000)).encode(), b"", b"a b a"]
    data, starts = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    words, tokens, owner, shapes = mixing.features(data, starts)
    assert tokens.tolist() == [100_000, 0, 3] and shapes[2, 4] == pytest.approx(2 / 3)
    assert len(np.unique(words[owner == 0])) == (owner == 0).sum() <= 1 << mixing.BITS and (owner == 2).sum() == 2


def test_too_many_domains_are_refused(labelled):
    _, docs, labels = labelled
    with pytest.raises(ValueError, match="more than 1 different"):
        mixing.learn_domains(docs, labels, max_domains=1)
