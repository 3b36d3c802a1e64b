"""The operators' registered queries: each applies one to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.alignment import cross_align
from tidemill.llm.exact_dedup import exact_dedup
from tidemill.llm.language import identify, train
from tidemill.llm.maxent import score
from tidemill.llm.packing import pack_documents
from tidemill.llm.pieces import encode
from tidemill.llm.pseudonyms import pseudonymize
from tidemill.llm.quality import quality
from tidemill.llm.secrets import scan
from tidemill.llm.simhash import near_dedup
from tidemill.llm.token_files import token_files
from tidemill.llm.toxicity import toxicity
from tidemill.llm.whitening import whiten

#: Stands for the key that a user gives; whoever knows it can undo the pseudonyms.
PSEUDONYM_KEY = b"example key, not secret"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    return encode(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, compression ratios and the verdict on every document."""
    return quality(_table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, from the files they were written to."""
    return token_files(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op4_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and model scores of all documents."""
    return score(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of whole texts."""
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return scan(_table(spark, sf_dir, "documents")).drop("found")


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms for personal data."""
    return pseudonymize(_table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page, and of every document, whose source stands for its host; likelihoods from all labelled documents but the row itself."""
    docs, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    none = F.lit(None)
    langs, counts = train(docs)
    address = F.concat(F.lit("source://"), F.col("source"))
    rows = docs.select("doc_id", none.cast("long").alias("page_id"), "text", address.alias("url"), "lang", F.lit(False).alias("markup")).unionByName(
        pages.select(none.cast("long").alias("doc_id"), "page_id", F.col("html").alias("text"), "url", none.cast("string").alias("lang"), F.lit(True).alias("markup"))
    )
    rows = rows.withColumn("declared", none.cast("string"))
    return identify(rows, langs, counts, keep=("doc_id", "page_id"), markup_col="markup", label_col="lang")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    return near_dedup(_table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from labelled ones that aren't held out, with the nearest example."""
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings whitened by 32 components of the covariance of all."""
    return whiten(_table(spark, sf_dir, "embeddings"))


def op13_cross_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level and sentence pieces of all documents aligned, with corpus-wide counts of linked ids."""
    return cross_align(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_quality_rules": op3_quality_rules,
    "op4_maxent_scores": op4_maxent_scores,
    "op8_token_files": op8_token_files,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_secret_scan": op6_secret_scan,
    "op7_pseudonyms": op7_pseudonyms,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_language_id": op10_language_id,
    "op11_toxicity": op11_toxicity,
    "op12_whitening": op12_whitening,
    "op13_cross_alignment": op13_cross_alignment,
}

ORACLE_SQL = {
    "op5_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        r AS (SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, CAST(count(*) OVER (PARTITION BY norm) AS BIGINT) AS group_size
              FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id ASC NULLS LAST))
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r""",
}
