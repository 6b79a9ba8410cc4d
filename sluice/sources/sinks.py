"""Writers: sharded JSON lines and Parquet, token streams, manifests. Commits are Spark's, so readers see whole outputs."""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.prefix import SINGLE_TASK_ROWS, accumulated, is_small

from . import files, ranges


def jsonl(df: DataFrame, path: str, docs_per_shard: int = 50_000, compression: str = "gzip") -> None:
    df.write.option("maxRecordsPerFile", docs_per_shard).option("compression", compression).json(path)


def jsonl_by_domain(df: DataFrame, path: str, by: str = "domain", docs_per_shard: int = 10_000, key: str | None = None, parts: int = 16) -> DataFrame:
    """Writes shards by domain; gives the counts (by, n_docs) of the domains, read from what was written.

    A domain's rows are dealt to `parts` tasks by a hash of the key (of the whole row without one), which a task that is
    run again repeats.
    """
    salt = F.pmod(F.xxhash64(key or F.to_json(F.struct(*df.columns))), F.lit(parts))
    df.repartition(by, salt).write.option("maxRecordsPerFile", docs_per_shard).option("compression", "gzip").partitionBy(by).json(path)
    return df.sparkSession.read.schema(df.select(by).schema).json(path).groupBy(by).agg(F.count("*").alias("n_docs"))


def size_capped(df: DataFrame, order: list[str], cap: int = 1 << 30, by: list[str] | None = None) -> DataFrame:
    """shard: number of the JSON-lines shard of at most about `cap` uncompressed bytes that each record goes to."""
    n = F.octet_length(F.to_json(F.struct(*df.columns))) + 1
    return accumulated(df, order, n, by).withColumn("shard", F.floor(F.col("excl") / cap).cast("int")).drop("rn", "incl", "excl", "total")


def jsonl_capped(df: DataFrame, path: str, order: list[str], cap: int = 1 << 30) -> None:
    size_capped(df, order, cap).repartition("shard").write.partitionBy("shard").option("compression", "none").json(path)


def jsonl_zstd(df: DataFrame, path: str, text: str = "text", docs_per_shard: int = 50_000, prefix: str = "part", frame_docs: int = 1024) -> dict:
    """Zstandard JSON lines, at most `docs_per_shard` records a file and `frame_docs` a frame; gives n_docs and n_chars, counted while writing."""
    from pyspark.sql import Observation

    seen = Observation()
    counted = df.observe(seen, F.count("*").alias("n_docs"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("n_chars"))
    rows = counted.select(F.spark_partition_id().alias("task"), F.to_json(F.struct(*df.columns)).alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        def piece(content: bytes, more: bool) -> pa.RecordBatch:
            name = f"{prefix}-{task:05d}-{number:05d}.jsonl.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary()), pa.array([more])], ["name", "content", "more"])

        # frames one after another are a Zstandard file like any other; the table at its end says where they begin
        number, have, task, sizes = 0, 0, 0, []
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                to = min(batch.num_rows, at + docs_per_shard - have, at + frame_docs)
                task = batch.column(0)[at].as_py()
                plain = "".join(x + "\n" for x in batch.column(1).slice(at, to - at).to_pylist()).encode()
                frame = zstandard.ZstdCompressor().compress(plain)
                sizes.append((len(frame), len(plain)))
                yield piece(frame, True)
                have, at = have + to - at, to
                if have == docs_per_shard:
                    yield piece(ranges.frame_table(sizes), False)
                    number, have, sizes = number + 1, 0, []
        if have:
            yield piece(ranges.frame_table(sizes), False)

    files.write(rows.mapInArrow(run, "name string, content binary, more boolean"), path)
    return seen.get


def parquet_by(df: DataFrame, path: str, by: str = "dump", unknown: str = "unknown") -> None:
    """Hive-partitioned Parquet; a null partition is `unknown`."""
    df.withColumn(by, F.coalesce(F.col(by).cast("string"), F.lit(unknown))).write.partitionBy(by).option("compression", "zstd").parquet(path)


def parquet(df: DataFrame, path: str, compression: str = "zstd") -> None:
    df.write.option("compression", compression).parquet(path)


#: Bytes of tokens that a task of token_shards joins at once; wider shards than the second are joined on the JVM.
BLOCK_BYTES, WIDE_SHARD_BYTES = 1 << 22, 1 << 26


def token_shards(df: DataFrame, ids: str, order: list[str], shard_tokens: int, eos: int | None = None, by: list[str] | None = None, dtype: str = "<u4", single_task_rows: int = SINGLE_TASK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """([by,] shard, n_tokens, content): the stream of ids (with an end token each) in aligned shards of raw tokens.

    Documents become bytes first and are cut at shard borders, so that bytes are shuffled; a shard's parts meet in one task.
    Where the plan isn't small, only keys and lengths are written and summed up, and the bytes go, compressed, through one
    shuffle into blocks of whole shards.
    """
    own = df if eos is None else df.withColumn(ids, F.concat(ids, F.array(F.lit(eos))))
    item = np.dtype(dtype).itemsize
    own = own.where(F.size(ids) > 0)
    if shard_tokens * item <= WIDE_SHARD_BYTES and not is_small(own, single_task_rows):
        return _shards_by_blocks(own, ids, order, shard_tokens, by or [], dtype, block_bytes)
    n = (F.octet_length("raw") / item).cast("long")
    raw = own.select(*(by or []), *order, _raw_tokens(dtype)(F.col(ids)).alias("raw")).withColumn("n", n)
    run = accumulated(raw, order, "n", by)
    first, last = F.floor(F.col("excl") / shard_tokens), F.floor((F.col("incl") - 1) / shard_tokens)
    cut = run.select(*(by or []), "excl", "n", "raw", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("shard"))
    low = F.greatest(F.lit(0), F.col("shard") * shard_tokens - F.col("excl"))
    high = F.least(F.col("n"), (F.col("shard") + 1) * shard_tokens - F.col("excl"))
    part = F.substring("raw", (low * item + 1).cast("int"), ((high - low) * item).cast("int"))
    cut = cut.select(*(by or []), "shard", F.col("excl").alias("at"), part.alias("raw"))
    joined = cut.groupBy(*(by or []), "shard").agg(F.expr("listagg(raw) WITHIN GROUP (ORDER BY at)").alias("content"))
    return joined.select(*(by or []), "shard", (F.octet_length("content") / item).cast("long").alias("n_tokens"), "content")


def _ordered(values: Iterable) -> tuple:
    """Values as a key that Python orders as Spark does: nulls first, NaN last."""
    return tuple((0,) if v is None else (2,) if v != v else (1, v) for v in values)


def _shards_by_blocks(own: DataFrame, ids: str, order: list[str], shard_tokens: int, by: list[str], dtype: str, block_bytes: int) -> DataFrame:
    """token_shards by blocks of whole shards.

    The lengths tell which key each block begins with and where; a row for each block goes to all tasks. A document goes
    to its block, in parts where it ends in another. Of several documents with one key each goes whole to all blocks of
    the key, and they stand by length and content.
    """
    item, kept = np.dtype(dtype).itemsize, list(dict.fromkeys([*by, *order]))
    size = shard_tokens * max(1, block_bytes // (shard_tokens * item))
    keys = own.groupBy(*kept).agg(F.sum(F.size(ids)).alias("_n"), F.count("*").alias("_rows"))
    run = accumulated(keys, order, "_n", by)
    first, last = F.ceil(F.col("excl") / size).cast("long"), F.floor((F.col("incl") - 1) / size).cast("long")
    begun = run.where(first <= last).select(*kept, "excl", "_rows", F.explode(F.sequence(first, last)).alias("_block")).toArrow()
    starts: dict[tuple, tuple[list, list, list]] = {}  # by group: the blocks' first keys, where these begin, their rows
    for r in sorted(begun.to_pylist(), key=lambda r: r["_block"]):
        for had, x in zip(starts.setdefault(_ordered(r[c] for c in by), ([], [], [])), (_ordered(r[c] for c in order), r["excl"], r["_rows"]), strict=True):
            had.append(x)
    by_at, order_at = [kept.index(c) for c in by], [kept.index(c) for c in order]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            *columns, own_ids = batch.columns
            flat = own_ids.flatten().to_numpy(zero_copy_only=False)
            ends = np.append(0, np.cumsum(pc.list_value_length(own_ids).to_numpy(zero_copy_only=False))).tolist()
            values, rows, parts = [c.to_pylist() for c in columns], [], []
            for i in range(batch.num_rows):
                firsts, begins, docs = starts[_ordered(values[c][i] for c in by_at)]
                key, n = _ordered(values[c][i] for c in order_at), ends[i + 1] - ends[i]
                low, high = bisect_left(firsts, key), bisect_right(firsts, key)  # the blocks that begin with the key
                at, alone = (begins[low], docs[low] == 1) if low < high else (None, False)
                for block in range(low - (at is None or at < low * size), high):
                    since, to = (max(0, block * size - at), min(n, (block + 1) * size - at)) if alone else (0, n)
                    rows.append(i)
                    parts.append((block, n, since, to - since, codec.compress(flat[ends[i] + since : ends[i] + to].astype(dtype), asbytes=True)))
            cut = zip(*parts, strict=True) if parts else [()] * 5
            kinds = (*[pa.int64()] * 4, pa.binary())
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int64())) for c in columns), *map(pa.array, cut, kinds)], [*kept, *PART])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, group, block, at, content, own = pa.Codec("zstd"), None, 0, 0, bytearray(), []

        def shards() -> pa.RecordBatch:
            if block < len(starts[group][0]) - 1 and len(content) != size * item:
                raise ValueError(f"block {block} of {group} has {len(content)} bytes")
            edges = np.append(np.arange(0, len(content), shard_tokens * item), len(content)).astype(np.int32)
            k = len(edges) - 1
            whole = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(edges), pa.py_buffer(content)])
            numbers = [pa.array(block * (size // shard_tokens) + np.arange(k)), pa.array(np.diff(edges).astype(np.int64) // item)]
            return pa.RecordBatch.from_arrays([*(c.take(pa.array([0] * k, pa.int64())) for c in own), *numbers, whole], [*by, "shard", "n_tokens", "content"])

        for batch in batches:
            keys = [_ordered(x) for x in zip(*(batch.column(c).to_pylist() for c in by_at), strict=True)] or [()] * batch.num_rows
            numbers = [c.to_pylist() for c in batch.columns[len(kept) : -1]]
            for i, (key, b, n, since, m) in enumerate(zip(keys, *numbers, strict=True)):
                if (key, b) != (group, block) or group is None:
                    if group is not None:
                        yield shards()
                    group, block, at, content = key, b, starts[key][1][b], bytearray()
                    own = [batch.column(c).slice(i, 1) for c in by_at]
                raw = codec.decompress(batch.column(len(kept) + 4)[i].as_buffer(), m * item)
                low, high = max(at + since, block * size), min(at + since + m, (block + 1) * size)
                if low < high:
                    if low != block * size + len(content) // item:
                        raise ValueError(f"parts of block {block} of {key} don't follow each other")
                    content += memoryview(raw)[(low - at - since) * item : (high - at - since) * item]
                at += n
        if group is not None:
            yield shards()

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in own.select(*kept).schema.fields]
    numbers = ", ".join(f"{c} long" for c in PART[:-1])
    parts = own.select(*kept, ids).mapInArrow(dealt, f"{', '.join(kinds)}, {numbers}, {PART[-1]} binary")
    placed = parts.repartition(*by, "_block").sortWithinPartitions(*by, "_block", *order, "_n", "_raw")
    return placed.mapInArrow(joined, ", ".join([*(kinds[c] for c in by_at), "shard long", "n_tokens long", "content binary"]))


#: Columns of a document's part of a block: its tokens in all, the part's first one and number, and the part compressed.
PART = ["_block", "_n", "_since", "_m", "_raw"]


def _raw_tokens(dtype: str):
    """Ids as the bytes of their raw array."""

    @F.arrow_udf("binary")
    def raw(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in ids:
            own = part.flatten().to_numpy(zero_copy_only=False).astype(dtype)
            ends = np.append(0, np.cumsum(pc.list_value_length(part).to_numpy(zero_copy_only=False))).astype(np.int32) * np.int32(own.itemsize)
            yield pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends), pa.py_buffer(own)])

    return raw


def token_files(shards: DataFrame, path: str, by: list[str] | None = None, suffix: str = ".u32le.bin") -> None:
    """Writes the content of token_shards as raw files [by/]shard-00000.u32le.bin."""
    number = F.format_string("shard-%05d" + suffix, F.col("shard").cast("int"))
    files.write(shards.select(F.concat_ws("/", *[F.col(b).cast("string") for b in by or []], number).alias("name"), "content"), path)


def rotated(docs: DataFrame, order: list[str], by: str, text: str = "text", shard_tokens: int = 1 << 30) -> DataFrame:
    """(by, order, n, shard, nth): which shard each document goes to, as its nth, if a shard is closed before a document
    that would overflow it.

    Documents end in one newline, two newlines stand between documents of a shard. Where a shard ends depends on all
    before it, so a group's lengths (and nothing else) are read in order by one task, a step for each shard.
    """
    n = F.octet_length(F.regexp_replace(text, r"\n*\z", "")) + 1
    own = docs.select(by, *order, n.cast("long").alias("n")).repartition(by).sortWithinPartitions(by, *order)
    by_at, n_at = own.columns.index(by), len(own.columns) - 1

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, shard, size, count = object(), 0, 0, 0  # of the open shard
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(n_at).to_numpy()
            key = batch.column(by_at).to_pylist()
            number, nth = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            edges = [i for i in range(len(n)) if i == 0 or key[i] != key[i - 1]] + [len(n)]
            total = np.append(0, np.cumsum(n + 2))
            for a, b in zip(edges, edges[1:], strict=False):
                if key[a] != group:
                    group, shard, size, count = key[a], 0, 0, 0
                at = a
                while at < b:
                    # with its separators, all but the last, the shard may hold so much more
                    to = min(b, int(np.searchsorted(total, total[at] + shard_tokens + 2 - size, "right")) - 1)
                    if to <= at and not count:
                        to = at + 1  # a document of its own, however long
                    if to > at:
                        number[at:to], nth[at:to] = shard, count + np.arange(to - at)
                        size, count, at = size + int(total[to] - total[at]), count + to - at, to
                    if at < b:
                        shard, size, count = shard + 1, 0, 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number), pa.array(nth)], [*batch.schema.names, "shard", "nth"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields)
    return own.mapInArrow(fold, f"{kinds}, shard long, nth long")


def byte_shards(docs: DataFrame, order: list[str], by: str, text: str = "text", shard_tokens: int = 1 << 30) -> DataFrame:
    """(by, shard, n_docs, n_bytes) of the shards that `rotated` makes, in order."""
    out = rotated(docs, order, by, text, shard_tokens).groupBy(by, "shard")
    return out.agg(F.count("*").alias("n_docs"), (F.sum("n") + 2 * F.count("*") - 2).alias("n_bytes")).orderBy(by, "shard")


def byte_shard_contents(docs: DataFrame, order: list[str], by: str, text: str = "text", shard_tokens: int = 1 << 30) -> DataFrame:
    """(by, shard, content): the bytes of each shard. The order names each document once; a shard's documents meet in one task."""
    place = rotated(docs, order, by, text, shard_tokens).drop("n")
    body = F.encode(F.concat(F.regexp_replace(text, r"\n*\z", ""), F.lit("\n")), "utf-8")
    rows = docs.select(by, *order, body.alias("body")).join(place, [by, *order]).select(by, "shard", "nth", "body")

    def joined(t: pa.Table) -> pa.Table:
        t = t.sort_by("nth")
        content = b"\n\n".join(t["body"].to_pylist())
        return pa.table({by: t[by].slice(0, 1), "shard": t["shard"].slice(0, 1), "content": pa.array([content], pa.binary())})

    return rows.groupBy(by, "shard").applyInArrow(joined, f"{by} {docs.schema[by].dataType.simpleString()}, shard long, content binary")


def merged_parts(parts: DataFrame, order: str = "part", content: str = "content", item_bytes: int = 4) -> DataFrame:
    """(part, start, n_tokens): layout of the concatenation of part files; an error if one isn't whole tokens."""
    n = F.octet_length(content)
    fits = F.when(n % item_bytes == 0, (n / item_bytes).cast("long")).otherwise(F.raise_error(F.lit("a part is not whole tokens")).cast("long"))
    return accumulated(parts.withColumn("n_tokens", fits).drop(content), [order], "n_tokens").withColumn("start", F.col("excl")).drop("rn", "incl", "excl", "total")


def manifest(df: DataFrame, order: list[str]) -> DataFrame:
    """(json): one row with the canonical JSON (names sorted, rows sorted) of a small table."""
    row = F.struct(*sorted(df.columns))
    return df.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), row.alias("r")))), lambda x: x["r"])).alias("json"))


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.option("header", "true").csv(path)  # a report of few rows


def publish(df: DataFrame, path: str, done: DataFrame | None = None, key: str | None = None, ready: bool = False) -> None:
    """Adds the rows whose key isn't done yet; Spark's committer makes them visible at once, so a rerun is harmless.

    With a key, a marker `<key>.done` for each key follows below path/_done; with `ready`, the file path/_state/READY.
    """
    new = df if done is None else df.join(done.select(key), key, "left_anti")
    new.write.mode("append").parquet(path)
    if key is not None:
        files.mark_done(df.select(key).distinct(), f"{path}/_done", key)
    if ready:
        files.mark_ready(df.sparkSession, f"{path}/_state")


def annotations(df: DataFrame, path: str, docs_per_shard: int = 50_000) -> dict | None:
    """Annotation records (id, source, text?, annotations) as Zstandard JSON lines; nothing is written for an empty table."""
    if df.isEmpty():
        return None
    return jsonl_zstd(df, path, next((c for c in ("text", "id") if c in df.columns), df.columns[0]), docs_per_shard, "annotations")


def u32le(values: list[int]) -> bytes:
    return np.asarray(values, "<u4").tobytes()
