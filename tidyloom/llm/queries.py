"""The subpackage's registered queries: thin applications of the operators to whole tables.

Where SQL gives the same rows it is in ``ORACLES``.  The others are learned, approximate, or too slow in SQL on whole
tables; ``tests/llm`` holds them against brute force, round trips and held-out rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyloom.llm.archives import archived_pages
from tidyloom.llm.collocations import collocations
from tidyloom.llm.embedding_join import near_vectors
from tidyloom.llm.hidden_markov import hidden_markov_scores
from tidyloom.llm.kmeans_tree import nearest_vectors
from tidyloom.llm.language_id import identify_language
from tidyloom.llm.license_scan import scan_licenses
from tidyloom.llm.minhash import near_duplicates
from tidyloom.llm.mixing import mixing_rates
from tidyloom.llm.packing import pack
from tidyloom.llm.periodic_runs import periodic_runs
from tidyloom.llm.pii import pii_report
from tidyloom.llm.suffix_dedup import remove_repeats

#: Wanted shares of tokens by domain; toxic text has none.
DOMAIN_WEIGHTS = {"high": 0.8, "low": 0.2, "toxic": 0.0}
TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_subspace_pigeonhole_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def op2_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op4_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"))


def op6_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op7_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))


def op8_merged_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), DOMAIN_WEIGHTS)


def op10_byte_network_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def op11_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov_scores(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def op12_rollup_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def echoed(docs: DataFrame) -> DataFrame:
    """``docs`` with the words of every tenth text (by a hash of its id) from some word on repeating with a period."""
    docs = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string"))).withColumn("g", F.expr("h div 10"))
    chosen = docs.withColumn("w", F.when(F.col("h") % 10 == 0, F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x <> '')")))
    chosen = chosen.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    chosen = chosen.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[CAST(a + (i - a) % p AS INT)])), ' ')")
    return chosen.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


def op13_suffix_automaton_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(echoed(table(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    found = found.withColumn("best", longest)
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        "best.length",
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_subspace_pigeonhole_join,
        op2_license_windows,
        op3_kmeans_tree_search,
        op4_mixture_packing,
        op5_arc_to_warc,
        op6_circulant_minhash,
        op7_pii_anchors,
        op8_merged_transforms,
        op9_soft_membership_mixing,
        op10_byte_network_language,
        op11_hidden_markov,
        op12_rollup_collocations,
        op13_suffix_automaton_runs,
        pipeline,
    )
}

#: Everything that links reach, from pairs ``links (a, b)`` in both directions.
REACHED = "reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)"

ORACLES = {
    "op1_subspace_pigeonhole_join": f"""
        WITH RECURSIVE vectors AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        links AS (
            SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x
            JOIN vectors y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
            WHERE list_cosine_similarity(x.v, y.v) >= 0.93
        ),
        {REACHED},
        lowest AS (SELECT a, min(b) AS low FROM reached GROUP BY a),
        degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
        SELECT e.vec_id, coalesce(d.n, 0) AS n_links, least(e.vec_id, coalesce(l.low, e.vec_id)) AS component_id,
            e.vec_id = least(e.vec_id, coalesce(l.low, e.vec_id)) AS kept
        FROM embeddings e LEFT JOIN lowest l ON l.a = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id""",
    "op5_arc_to_warc": """
        WITH payloads AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages
        ),
        latest AS (SELECT *, max(page_id) OVER (PARTITION BY digest, n) AS last_id FROM payloads)
        SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
            CASE WHEN n >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN n >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
        FROM latest""",
    "op6_circulant_minhash": f"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
            FROM words
        ),
        sizes AS (SELECT doc_id, len(s) AS n FROM sets),
        shingles AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
        common AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x
            JOIN shingles y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL
        ),
        links AS (
            SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
            WHERE 100 * c >= 85 * (x.n + y.n - c)
        ),
        {REACHED},
        lowest AS (SELECT a, min(b) AS low FROM reached GROUP BY a)
        SELECT d.doc_id, d.n AS n_shingles, least(d.doc_id, coalesce(l.low, d.doc_id)) AS component_id,
            d.doc_id = least(d.doc_id, coalesce(l.low, d.doc_id)) AS kept
        FROM sizes d LEFT JOIN lowest l ON l.a = d.doc_id""",
    "op12_rollup_collocations": """
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ),
        lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        windows AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
        grams AS (
            SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
            FROM windows, (VALUES (1), (2), (3), (4)) AS sizes(k) WHERE i + k - 1 <= len(w) GROUP BY ALL
        ),
        totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
        candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k >= 2 AND f >= 30),
        cuts AS (
            SELECT lang, phrase, w, a, cut, array_to_string(w[:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS rest
            FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates)
        ),
        scored AS (
            SELECT c.lang, c.phrase, c.w, c.a, c.cut, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score
            FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = c.head JOIN grams y ON y.lang = c.lang AND y.phrase = c.rest
        ),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        inner_phrases AS (
            SELECT lang, a AS around, array_to_string(w[i:i + m - 1], ' ') AS phrase
            FROM (SELECT lang, a, w, k, m, unnest(range(1, k - m + 2)) AS i FROM candidates, (VALUES (2), (3)) AS sizes(m) WHERE m < k)
        ),
        around AS (SELECT lang, phrase, max(around) AS around FROM inner_phrases GROUP BY ALL),
        ranked AS (
            SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
            FROM lowest s LEFT JOIN around o ON o.lang = s.lang AND o.phrase = s.phrase
            WHERE o.around IS NULL OR 100::HUGEINT * o.around < 80::HUGEINT * s.a
        )
        SELECT r.lang, rank, phrase, a, l, r.r, n, score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000""",
}
