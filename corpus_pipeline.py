"""The corpus pipeline: documents in, training order out.

Every stage takes the session, the documents its predecessor kept, and the folder of the tables. It is
written to the shared folder as Parquet and read again by the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayledger.functions.pseudonym import PlateHasher
from wayledger.llm import decontaminate, language, minhash, mixing, pii, simhash
from wayledger.llm.catalog import TEST_KEY
from wayledger.llm.common import table
from wayledger.session import materialise


def decided_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression cannot tell go. Dictionaries are learned from the labelled ones."""
    return language.accepted_only(docs, language.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id. Texts whose SimHash
    fingerprints of five-word runs are linked, and those that share a MinHash band, are candidates; near are
    sets of runs that share 0.8 of what they have together."""
    return minhash.representatives(docs, also=simhash.linked(docs, minhash.SHINGLE))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words or more inside benchmark windows go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced; ``n_chars`` is counted anew."""
    return pii.pseudonymised(docs, PlateHasher(TEST_KEY))


def training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents in training order, mixed to the sources' weights over time."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", decided_language),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("pii_surrogates", surrogates),
    ("mixing", training_order),
]

#: Language identification and fingerprints have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
