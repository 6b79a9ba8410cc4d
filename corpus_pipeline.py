"""The curation pipeline: quality filter, near-duplicate removal, decontamination, secrets, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; run() writes each stage's rows
as Parquet in the shared folder and reads them again. All stages but the last return the columns of documents, with any
further columns as they came, whatever their names; an empty table stays empty. Texts are taken whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import bagminhash, bpe, common, decontaminate, quality, secret_scan


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier scores under 0.3; it learns from the documents here and their labels.

    Null and empty texts score what the model's bias gives, all alike; a row without an id is scored and never learnt
    from; repeated rows fare alike. Without labels nothing goes.
    """
    return quality.kept(docs, quality.fit(docs, common.table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each near-duplicate class.

    Documents without a word (null and empty texts) resemble nothing and all stay. A null id is smaller than any other.
    Repeated rows (same id and text) become one, whose other columns are those of any of them.
    """
    return bagminhash.kept(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item or a re-parameterised copy of one.

    Null and empty texts hold nothing and stay, as do all documents if the benchmark is empty; repeated rows fare alike.
    """
    return decontaminate.kept(docs, common.table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; all documents stay, and n_chars follows the text. Null texts stay null."""
    out = secret_scan.redacted(docs, secret_scan.fit(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the texts that are left; null and empty ones have no tokens.

    A row for each row, with its id as it is; other columns aren't read.
    """
    import public_tokenizers

    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicate removal", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret redaction", redact_secrets),
    ("byte-level BPE", encode_tokens),
]
#: No SQL expresses the stages (a trained model, signatures, merges); tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
