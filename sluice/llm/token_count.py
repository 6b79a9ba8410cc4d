"""Token counts behind a digest cache.

A text's digest (SHA-256 of its UTF-8 bytes; null counts as empty, nothing else is changed, as counts depend on every
byte) is joined to the stored counts of the same tokenizer version, which is a digest of the vocabulary file, the
library's version and the options. Only distinct texts without a stored count are encoded, and their counts are
appended to the cache, a Parquet folder in storage that all executors share.

Empty texts have no tokens. Repeated rows share one encoding and come back each by itself. Texts are encoded whole. An
empty table gives no rows and leaves an empty cache. Only the id and the text are read, so no other column can clash.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CACHE = "digest binary, version string, n_tokens long"


def version(path: str) -> str:
    import sentencepiece
    import tokenizers

    with open(path, "rb") as f:
        content = hashlib.sha256(f.read()).hexdigest()
    library = tokenizers.__version__ if path.endswith(".json") else sentencepiece.__version__
    return hashlib.sha256(f"{content} {library} no-special no-truncation no-padding".encode()).hexdigest()


@lru_cache(4)
def counter(path: str):
    """A function from texts to their numbers of tokens."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return lambda texts: [len(x.ids) for x in own.encode_batch_fast(texts, add_special_tokens=False)]


def _stored(spark: SparkSession, cache: str, tag: str) -> DataFrame | None:
    try:
        rows = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    # runs that overlapped may have stored a digest twice
    return rows.where(F.col("version") == tag).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def counted(docs: DataFrame, path: str, cache: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row. `cache` is the cache's folder; by default a new one."""
    spark, tag = docs.sparkSession, version(path)
    cache = cache or f"{common.scratch(spark)}/token-counts-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for part in common.pieces(batch):
                n = count(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([tag] * len(n)), pa.array(n, pa.int64())], ["digest", "version", "n_tokens"])

    rows = common.id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    missing, stored = rows.select("digest", "text"), _stored(spark, cache, tag)
    if stored is not None:
        missing = missing.join(stored, "digest", "left_anti")
    distinct = missing.groupBy("digest").agg(F.first("text").alias("text"))  # copies meet within tasks before the shuffle
    distinct.mapInArrow(run, CACHE).write.mode("append").parquet(cache)
    # a table of its own, so that the rows of a text with very many copies can be split in the join
    known = common.checkpointed(_stored(spark, cache, tag))
    own = rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return own.join(known, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
