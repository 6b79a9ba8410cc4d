"""What the operators of this package share: input selection, Arrow text batches, storage."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into numpy arrays at once. A longer text is taken alone.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), so that no further column can clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it; where that is unset, a local one, on one machine only."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not re.match(r"local(\[|$)", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            sc.setCheckpointDir("/tmp/checkpoints")
        folder = sc._jsc.sc().getCheckpointDir().get()
    elif sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, in the shared folder."""
    return f"{shared_dir(spark)}/sluice-{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Deletes the application's intermediate tables; no result that still reads them may be used afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage with files in the shared folder; a lost executor costs nothing that is done."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder, in a folder for each value of `by`."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(id_col: Column | str) -> Column:
    """crc32 of the id as text, modulo 5: 0 marks held-out rows."""
    return F.pmod(F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")), F.lit(5))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, held_out: bool = False, lang: bool = False) -> DataFrame:
    """At most `limit` labelled ids outside the held-out fold, lowest hash of the id first: (doc_id, text, label[, lang]).

    The hash order makes the sample the same at every partitioning. The bound is a parameter of every fit. A doc_id that
    stands in several rows has them all here; `bounded` leaves one.
    """
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    part = fold("doc_id") == 0
    chosen = (
        known.where(F.col("doc_id").isNotNull() & (part if held_out else ~part))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    # the sample is bounded by `limit` rows, so its ids may be broadcast
    extra = [F.col("lang").cast("string").alias("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")] if lang else []
    own = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *extra)
    return own.join(F.broadcast(chosen), "doc_id")


def bounded(features: DataFrame, sizes: list[str], limit_bytes: int) -> DataFrame:
    """The rows of a labelled sample's features, one for each doc_id, of at most `limit_bytes` together.

    Rows are taken by the hash of their ids as long as they fit; one that doesn't is left out. Only the sizes of the
    sample's rows come to the driver.
    """
    rest = [c for c in features.columns if c != "doc_id"]
    one = checkpointed(features.groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("r")).select("doc_id", "r.*"))
    size = sum((F.octet_length(c) for c in sizes), F.lit(0)).cast("long")
    at = one.select(size.alias("n"), F.xxhash64("doc_id").alias("h"), "doc_id").toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending")]).to_pydict()
    have, chosen = 0, []
    for n, i in zip(at["n"], at["doc_id"], strict=True):
        if have + n <= limit_bytes:
            have += n
            chosen.append(i)
    if len(chosen) < len(at["n"]):
        one = one.join(F.broadcast(features.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long")), "doc_id")
    return one


#: Changes of a model's numbers are summed as integers of this fraction, so that the order of tasks doesn't matter.
FRACTION = 1 << 30


def labelled(docs: DataFrame, labels: DataFrame, label: str, shard_rows: int, lang: bool = False) -> DataFrame:
    """All labelled documents outside the held-out fold: (doc_id, label, lang, z), the text compressed; each id once.

    They are dealt by id to partitions of about `shard_rows` rows, in the order of the id's hash. Of several rows of one
    doc_id the least counts, whatever the partitioning.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id") != 0)).groupBy("doc_id").agg(F.max("label").alias("label"))
    shards = max(1, -(-known.count() // shard_rows))
    spoken = F.col("lang").cast("string") if lang and "lang" in docs.columns else F.lit(None).cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), spoken.alias("lang"))
    own = packed(own.where(F.col("doc_id").isNotNull() & (fold("doc_id") != 0)), ["doc_id", "lang"])
    rows = own.join(known, "doc_id").groupBy("doc_id").agg(F.min(F.struct("label", "lang", "z")).alias("r")).select("doc_id", "r.*")
    return rows.repartition(shards, "doc_id").sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")


def changes(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """A task's changes of a model, a row of numbers for each key, for `mean_changes`."""
    whole = np.rint(values * float(FRACTION)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *[pa.array(np.ascontiguousarray(whole[:, j])) for j in range(whole.shape[1])]], ["key", *[f"v{j}" for j in range(whole.shape[1])]])


def mean_changes(shards: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, the mean change of each over the tasks that changed it); the driver gets no more rows than the model has keys."""
    names = [f"v{j}" for j in range(width)]
    got = shards.mapInArrow(run, "key long, " + ", ".join(f"{v} long" for v in names)).groupBy("key").agg(F.count("*").alias("n"), *[F.sum(v).alias(v) for v in names]).toArrow()
    n = got["n"].to_numpy()
    return got["key"].to_numpy(), np.stack([got[v].to_numpy() / n / FRACTION for v in names], 1)


def slices(col: pa.ChunkedArray, dtype) -> list[np.ndarray]:
    """Each binary value as an array of `dtype`; views of the column's buffer, no copies."""
    if not len(col):
        return []
    raw, offsets = buffers(as_array(col))
    whole, cut = raw.view(dtype), (offsets // np.dtype(dtype).itemsize).tolist()
    return [whole[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def as_array(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    return col


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array without nulls; offsets start at 0."""
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about `size` bytes together; at least one row each."""
    _, offsets = buffers(as_array(batch.column(batch.schema.get_field_index(text))))
    for at, to in _runs(np.diff(offsets), size):
        yield batch.slice(at, to - at)


def packed(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, z): each text compressed for the shuffle, behind its length; rows and tasks as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = (x.as_buffer().to_pybytes() if x.as_buffer() else b"" for x in batch.column(len(keys)))
            z = [len(b).to_bytes(8, "little") + pa.compress(b, codec="zstd", asbytes=True) for b in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(z, pa.binary())], [*keys, "z"])

    kinds = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, text).mapInArrow(run, f"{kinds}, z binary")


def unpacked_one(z: bytes) -> bytes:
    return pa.decompress(z[8:], int.from_bytes(z[:8], "little"), codec="zstd", asbytes=True)


def _sizes(col: pa.Array) -> np.ndarray:
    """Bytes of each compressed text when unpacked."""
    raw, offsets = buffers(col)
    if not len(col):
        return np.empty(0, np.int64)
    return raw[offsets[:-1, None] + np.arange(8)].copy().view(np.int64)[:, 0]


def _runs(sizes: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    offsets, at = np.append(0, np.cumsum(sizes)), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to
        at = to


def packed_pieces(batch: pa.RecordBatch, *texts: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """As `pieces`, by the unpacked bytes of all the columns named."""
    sizes = sum(_sizes(batch.column(batch.schema.get_field_index(t))) for t in texts)
    for at, to in _runs(sizes, size):
        yield batch.slice(at, to - at)


def unpacked(col: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of runs of compressed texts with about `size` bytes each; at least one text each."""
    sizes = _sizes(col)
    for at, to in _runs(sizes, size):
        texts = [pa.decompress(x.as_py()[8:], n, codec="zstd", asbytes=True) for x, n in zip(col.slice(at, to - at), sizes[at:to].tolist(), strict=True)]
        yield np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum(sizes[at:to]))


def crc_fold(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(str(i).encode()) % 5 for i in ids])
