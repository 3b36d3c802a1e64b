"""The corpus pipeline: quality rules, exact dedup, near-duplicate dedup, secret redaction, packing.

Every stage takes and, but for the last, returns the columns of ``documents``, and any further ones whatever they are called.
Null text counts as empty, so the first stage rejects it. Rows with the same id, or a null one, are documents of their own.
An empty table goes through all stages and gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import exact_dedup, simhash
from tidemill.llm.packing import pack_documents
from tidemill.llm.quality import keep_good
from tidemill.llm.secrets import redact
from tidemill.llm.shared import removed_after, scratch, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counts or the compression bands reject go, whole texts counted. Repeated rows get the same verdict each."""
    return keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space one stays: the longest, of those of a length the smallest id, of those one row; null ids come last."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that similarities of 0.8 of five-word shingles connect, the row with the smallest id stays, null ids last; ties leave one row.

    All pairs at 0.8 or more are found exactly. Fingerprints, which estimate the similarity, connect some somewhat below too: of 293
    rows that went by them 245 had another at 0.8 or more, all but one of the rest one at 0.7 or more.
    """
    return simhash.drop_near_copies(docs, width=5, similarity=0.8)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and linked parts of credentials are replaced by a mark, in a null text nothing; n_chars follows the text. All rows stay."""
    return redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places in sequences of 2048 tokens, a row for each piece; an empty or null text is a piece with the end id alone."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_rules),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack),
]
#: SQL can't express compression, fingerprints and token ids; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again; what a stage wrote on the way is deleted after it."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = scratch(spark)
    for name, stage in STAGES[:-1]:
        with removed_after(spark):
            docs = written(stage(spark, docs, sf_dir), name, folder)
    return STAGES[-1][1](spark, docs, sf_dir)
