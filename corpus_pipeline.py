"""A training corpus from ``documents``: language, near-duplicates, personal data, mixture, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept.  ``run`` writes each
stage's rows as Parquet on shared storage and gives the reread table to the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyloom.llm.common import free_name, written
from tidyloom.llm.language_id import UNDETERMINED, train_on, with_language
from tidyloom.llm.minhash import near_duplicates
from tidyloom.llm.mixing import mixed, mixing_rates
from tidyloom.llm.packing import pack
from tidyloom.llm.pii import redact_pii
from tidyloom.llm.queries import DOMAIN_WEIGHTS, table, tokenizer_path

#: A document whose best language has a lower posterior is in none of the learned ones.
LEAST_LANGUAGE_SCORE = 0.3


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network, learned from the labelled rows, can tell.

    Null texts and texts without a letter go, and all texts if no row is labelled.  Each row is judged by itself, whatever its id; of
    equally likely languages the first by name counts.  Columns keep their names and types, also those called like inner ones.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    language, chance = free_name(docs, "__language"), free_name(docs, "__chance")
    told = with_language(docs, train_on(docs), (language, chance))
    return told.filter((F.col(language) != UNDETERMINED) & (F.col(chance) >= LEAST_LANGUAGE_SCORE)).select(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Texts without words are near nothing and stay, as do rows without an id, which no row can name.  Rows that share an id stand or
    fall together.
    """
    copies = near_duplicates(docs).filter("NOT kept").select("doc_id").distinct()
    return docs.join(copies.hint("merge"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in each text replaced by its kind; ``n_chars`` follows.  Null texts stay null, every row stays."""
    changed = redact_pii(docs)
    return changed.withColumn("n_chars", F.length("text").cast(changed.schema["n_chars"].dataType)) if "n_chars" in docs.columns else changed


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of quality domains asks for, at least once; only toxic ones go.

    Null and empty texts have no tokens and stay; rows without an id stay once; rows that share an id are repeated alike.  Without
    labelled documents every row stays once.
    """
    return mixed(docs, mixing_rates(docs, table(spark, sf_dir, "labels"), DOMAIN_WEIGHTS, keep=True))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences whose tokens follow the sources' proportions.

    A null text is empty and gives its end alone, a null source is a source of its own, and every row is packed, repeated ones too.
    """
    return pack(docs, tokenizer_path())


STAGES = [
    ("language", keep_known_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", hide_personal_data),
    ("mixture", mix_to_weights),
    ("packing", pack_sequences),
]

#: The stages learn, link and cut text: no SQL gives these rows, the tests have brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
