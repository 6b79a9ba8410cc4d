"""Token streams: positions, chunks, fixed-length rows, permutations, order fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.text import byte_ids, labels_with_mask, let
from sluice.sources.storage import checkpointed

from .prefix import accumulated


def byte_tokens(text: Column) -> Column:
    """Ids 0 to 255: the text's UTF-8 bytes."""
    return byte_ids(text)


def tokenizer_ids(path: str, pattern: str | None = None) -> Callable[[Column], Column]:
    """A tokenizer for `tokenised` out of a vocabulary file: .json by `tokenizers`, .model by `sentencepiece`, ranks by
    `tiktoken` with the pattern that splits texts. No special tokens; null counts as empty."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(text: pd.Series) -> pd.Series:
        encode = _encoder(path, pattern)
        return pd.Series([np.asarray(x, np.int32) for x in encode([s or "" for s in text])])

    return ids


@lru_cache(4)
def _encoder(path: str, pattern: str | None):
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        return lambda texts: [x.ids for x in own.encode_batch(texts, add_special_tokens=False)]
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: model.encode(texts, num_threads=1)
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [own.encode_ordinary(t) for t in texts]


def training_rows(rows: DataFrame, ignore: int = -100) -> DataFrame:
    """Packed rows (input_ids, loss_mask) with `labels`: the ids, but `ignore` where the mask is set."""
    return rows.withColumn("labels", labels_with_mask(F.col("input_ids"), F.col("loss_mask"), ignore))


def tokenised(df: DataFrame, text: str = "text", tokenizer: Callable[[Column], Column] = byte_tokens, eos: int | None = None, skip_empty: bool = False) -> DataFrame:
    """ids and n_tokens; with an end token, which a document without tokens has alone unless it's skipped."""
    ids = tokenizer(F.col(text))
    out = df.withColumn("ids", ids)
    out = out.where(F.size("ids") > 0) if skip_empty else out
    out = out if eos is None else out.withColumn("ids", F.concat("ids", F.array(F.lit(eos))))
    return out.withColumn("n_tokens", F.size("ids"))


def n_chunks(tokens: Column, seq_len: int = 2048) -> Column:
    """Sequences of seq_len inputs with their targets that so many tokens hold."""
    return F.greatest(F.lit(0), F.floor((tokens - 1) / seq_len)).cast("long")


def chunks(shards: DataFrame, by: str, order: list[str], tokens: str = "n_tokens", seq_len: int = 2048) -> DataFrame:
    """A row for each chunk: shard, chunk in the shard, global index, offset in the source's stream."""
    run = accumulated(shards, order, tokens, [by]).withColumn("_start", F.col("excl")).drop("rn", "incl", "excl", "total")
    run = accumulated(run.withColumn("_n", n_chunks(F.col(tokens), seq_len)), [by, *order], "_n").withColumn("_first", F.col("excl")).drop("rn", "incl", "excl", "total")
    out = run.where("_n > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("chunk"))
    return out.withColumn("global_chunk", F.col("_first") + F.col("chunk")).withColumn("offset", F.col("_start") + F.col("chunk") * seq_len).drop("_n", "_first", "_start")


def packed(docs: DataFrame, ids: str, mask: str | None, seq_len: int, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows of seq_len tokens (and mask) over the stream of documents; the incomplete last row of a stream is dropped.

    Documents are cut into their parts of rows first, so that the shuffle carries arrays, not tokens.
    """
    n = F.size(ids)
    run = accumulated(docs.where(n > 0), order, n, by)
    first, last = F.floor(F.col("excl") / seq_len), F.floor((F.col("incl") - 1) / seq_len)
    cut = run.select(*(by or []), "excl", "total", ids, *([mask] if mask else []), F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("row"))
    low = F.greatest(F.lit(0), F.col("row") * seq_len - F.col("excl"))
    take = lambda c: F.slice(c, (low + 1).cast("int"), (F.least(F.size(c), (F.col("row") + 1) * seq_len - F.col("excl")) - low).cast("int"))
    part = F.struct(F.col("excl").alias("at"), take(ids).alias("ids"), *([take(mask).alias("mask")] if mask else []))
    rows = cut.where((F.col("row") + 1) * seq_len <= F.col("total")).groupBy(*(by or []), "row").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    flat = lambda f: F.flatten(F.transform("parts", lambda p: p[f])).alias({"ids": "input_ids", "mask": "loss_mask"}[f])
    return rows.select(*(by or []), "row", flat("ids"), *([flat("mask")] if mask else []))


def packed_raw(docs: DataFrame, ids: str, seq_len: int, order: list[str], by: list[str] | None = None, dtype: str = "<u4") -> DataFrame:
    """([by,] row, content): the rows of `packed` without a mask, as raw arrays of `dtype`, which has to hold every id.

    Bytes of that width are sorted and shuffled instead of arrays of ids, and no row's ids are numbers of the JVM.
    """
    from sluice.sources.sinks import token_shards

    whole = token_shards(docs, ids, order, seq_len, None, by, dtype).where(F.col("n_tokens") == seq_len)
    return whole.select(*(by or []), F.col("shard").alias("row"), "content")


def dropped_tail(docs: DataFrame, tokens: str, seq_len: int, by: list[str]) -> DataFrame:
    return docs.groupBy(*by).agg((F.sum(tokens) % seq_len).alias("n_dropped"), F.floor(F.sum(tokens) / seq_len).alias("n_rows"))


def permuted(chunk_rows: DataFrame, rank: str = "rank", index: str = "global_chunk") -> DataFrame:
    """position: place of each chunk in the order of its owner's rank, then of the chunks."""
    return accumulated(chunk_rows, [rank, index]).withColumn("position", F.col("rn") - 1).drop("rn", "incl", "excl", "total")


def is_permutation(df: DataFrame, index: str) -> DataFrame:
    """One row: whether the values are 0 to n - 1, each once."""
    return df.agg(((F.count("*") == F.count_distinct(index)) & (F.coalesce(F.min(index), F.lit(0)) == 0) & (F.count("*") == F.coalesce(F.max(index) + 1, F.lit(0)))).alias("ok"))


def rebuilt_lengths(docs: DataFrame, packed_counts: DataFrame, by: str = "domain", tokens: str = "n_tokens", count: str = "packed") -> DataFrame:
    """By domain: tokens plus an end token for each document against the packed count."""
    own = docs.groupBy(by).agg((F.sum(tokens) + F.count("*")).alias("expected"))
    return packed_counts.join(own, by, "full").withColumn("ok", F.coalesce(F.col("expected") == F.col(count), F.lit(False)))


def byte_stream(docs: DataFrame, by: str, order: list[str], text: str = "text", shard_tokens: int = 1 << 30) -> DataFrame:
    """The documents with n_bytes (with their newline), shard, and n_separators: the newlines between them and the one before.

    Shards are closed before a document that would overflow them; one longer than a shard has a shard of its own.
    """
    from sluice.sources.sinks import rotated

    place = rotated(docs, order, by, text, shard_tokens).withColumnRenamed("n", "n_bytes")
    return docs.join(place, [by, *order]).withColumn("n_separators", F.when(F.col("nth") > 0, 2).otherwise(0)).drop("nth")


def one_epoch(shards: DataFrame, seq_len: int, needed: int | None = None, tokens: str = "n_tokens") -> DataFrame:
    """Sequences of one pass; an error if more are needed."""
    out = shards.agg(F.sum(F.floor(F.col(tokens) / seq_len)).alias("n_sequences"))
    if needed is None:
        return out
    return out.withColumn("n_sequences", F.when(F.col("n_sequences") < needed, F.raise_error(F.lit("more than one epoch")).cast("long")).otherwise(F.col("n_sequences")))


def fingerprint(df: DataFrame, order: list[str], fields: list[str], fan: int = 4096, levels: int | None = None) -> DataFrame:
    """SHA-256 over the ordered rows' canonical JSON (fields by name), as a tree.

    Each `fan` neighbouring digests are joined by newlines and hashed again, until one is left; no task gets more. Of no
    rows it is the hash of nothing. With `levels`, the tree has as many whatever the number of rows: the last one hashes
    all that are left, which a task reads in order as a stream.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(fields))), 256)
    level = accumulated(df.select(*order, row.alias("h")), list(order)).select((F.col("rn") - 1).alias("i"), "h")
    n, done = level.count(), 1
    while True:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]), "\n")
        if levels is None and n <= fan:
            return level.agg(F.sha2(joined, 256).alias("fingerprint"))
        if levels is not None and done >= levels:
            one = level.repartition(1).sortWithinPartitions("i").select("h").mapInArrow(_streamed_sha256, "h string")
            return one.agg(F.coalesce(F.max("h"), F.sha2(F.lit(""), 256)).alias("fingerprint"))
        level = checkpointed(level.groupBy(F.floor(F.col("i") / fan).alias("g")).agg(F.sha2(joined, 256).alias("h")).select(F.col("g").alias("i"), "h"))
        n, done = -(-n // fan), done + 1


def _streamed_sha256(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of a task's digests, joined by newlines; nothing for a task without any."""
    own, between = hashlib.sha256(), b""
    for batch in batches:
        if batch.num_rows:
            own.update(between + "\n".join(batch.column(0).to_pylist()).encode())
            between = b"\n"
    if between:
        yield pa.RecordBatch.from_arrays([pa.array([own.hexdigest()])], ["h"])


def segments(ids: Column, seq_len: int) -> Column:
    """Overlapping parts of an id array: seq_len long, each beginning with the last token of the one before."""
    parts = _overlapping(ids, F.size(ids), seq_len, lambda x, i: F.slice(x, i + 1, seq_len))
    return F.coalesce(parts, F.array().cast("array<array<int>>"))


def byte_segments(text: Column, seq_len: int) -> Column:
    """The `segments` of a text's byte tokens as raw bytes, one for each id; the bytes go neither to Python nor into numbers."""
    raw = text.cast("binary")
    parts = _overlapping(raw, F.octet_length(raw), seq_len, lambda x, i: F.substring(x, i + 1, F.lit(seq_len)))
    return F.coalesce(parts, F.array().cast("array<binary>"))


def _overlapping(ids: Column, n: Column, seq_len: int, part: Callable[[Column, Column], Column]) -> Column:
    """part(ids, i) for the first place i of each of the segments of n tokens."""
    at = F.when(n >= 2, F.sequence(F.lit(0), n - 2, F.lit(seq_len - 1)))
    return let(F.struct(ids.alias("ids"), at.alias("at")), lambda x: F.transform(x["at"], lambda i: part(x["ids"], i)))


def shard_of(position: Column, shard_tokens: int) -> Column:
    return F.floor(position / shard_tokens).cast("long")


def usable_prefix(shards: DataFrame, by: list[str], order: list[str], seq_len: int, tokens: str = "n_tokens") -> DataFrame:
    """How many tokens of each shard a concatenation keeps that is cut to whole sequences."""
    run = accumulated(shards, order, tokens, by)
    usable = F.floor(F.col("total") / seq_len) * seq_len
    return run.withColumn("kept", F.greatest(F.lit(0), F.least(F.col(tokens), usable - F.col("excl"))).cast("long")).drop("rn", "incl", "excl", "total")


def usable_content(shards: DataFrame, by: list[str], order: list[str], seq_len: int, content: str = "content", item_bytes: int = 4) -> DataFrame:
    """Shards' raw content, cut so that their concatenation is whole sequences; shards without any left go."""
    own = shards.withColumn("_n", F.floor(F.octet_length(content) / item_bytes))
    own = usable_prefix(own, by, order, seq_len, "_n").where("kept > 0")
    return own.withColumn(content, F.substring(content, F.lit(1), (F.col("kept") * item_bytes).cast("int"))).drop("_n", "kept")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def attention_of_rows(q: pd.Series, k: pd.Series) -> pd.Series:
    """attention_received of each row's arrays (positions x dimensions)."""
    return pd.Series([attention_received([list(x) for x in a], [list(x) for x in b]) if a is not None and len(a) else [] for a, b in zip(q, k, strict=True)])


def attention_received(q: list[list[float]], k: list[list[float]]) -> list[float]:
    """Causal softmax attention that each position gets, summed over later queries; for one small sequence."""
    a = np.asarray(q, float) @ np.asarray(k, float).T / np.sqrt(len(q[0]))
    a[np.triu_indices(len(a), 1)] = -np.inf
    p = np.exp(a - a.max(1, keepdims=True))
    return (p / p.sum(1, keepdims=True)).sum(0).tolist()
