"""From raw documents to token ids: a pipeline of five stages, each one operator of the library.

Every stage takes the session, the documents its predecessor kept and the folder of the tables,
and returns a DataFrame, which is written as Parquet and read again for the next stage. All stages but
the last return the columns of ``documents``; other columns are dropped. Null and empty texts pass
through as documents of no words, rows that occur twice stay one, and empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgwarden.llm import crf_secrets, mixing, simhash, toxicity
from pkgwarden.llm.queries import bpe_tree, table
from pkgwarden.sources.tables import settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: None: no stage but the last can be expressed in SQL (a trained classifier, XXH64, Viterbi).
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, takes as toxic go.

    A document without a text is kept unless most labelled ones are toxic.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels")).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates stays: fingerprints of shingles
    of three words that differ in at most three bits, and what these connect. Texts without words
    are one group."""
    return simhash.keep_one_of_each(docs, words=3, radius=3).select(COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; all documents stay. ``n_chars`` follows the new text."""
    text = crf_secrets.redact(docs, crf_secrets.train(docs))
    covered = docs.select("doc_id", text.alias("text"), "lang", "source")
    return covered.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their target words."""
    return mixing.mixed_documents(docs).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; ``round_trip`` tells that they decode to its bytes."""
    whole = F.coalesce("text", F.lit("")).cast("binary")
    return bpe_tree(spark).round_trip(docs.select("doc_id", "source", "text")).select(
        "doc_id",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        (F.col("decoded") == whole).alias("round_trip"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_to_targets),
    ("encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
