"""Exact top-k inner products by MaxScore, over shards of vectors.

Terms are the dimensions; a query's contribution from one is bounded by the shard's extremes. With the k-th best score
known so far as threshold, the terms of smallest bounds whose bounds sum to less are non-essential: a row that only they
reach can't compete. Essential postings are traversed: the list (row, component) of a dimension that few rows have, or
its column where most rows have one, and all queries of a block go through the columns together. Rows whose essential
scores and the other terms' bounds reach the threshold are probed for the non-essential terms, in descending order of
bounds, and only rows that can still reach it stay. Dense vectors are in nearly every list; there the partial scores
prune, not the lists. A shard whose bounds sum to less than the threshold is skipped.

Shards are runs of rows of one task, packed and written once without a shuffle. Queries are broadcast in blocks of at
most about `block_rows` rows and BLOCK_BYTES. A first sixteenth of the shards gives each query of a block its threshold, which the other shards start
from, and a task carries it from shard to shard; each task gives its k best rows a query, and these are merged.

Vectors that are null or hold null or non-finite components take no part. Shorter vectors, the empty one too, count as
padded with zeros. Ties go to the smaller vec_id, rows without an id last; such a row is a candidate, but never a query.
Repeated rows are rows of their own; a query's own row is never its candidate. Scores are exact whatever the size of
components; those beyond a long are cut to its range, and are ties there. Empty tables give no rows. Further columns
aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, wordhash

#: Probing looks at the rows again after so many terms.
STEP = 8
#: Queries that go through a shard together.
TOGETHER = 256
#: A dimension that at most this share of a shard's rows have is kept as a list, else as a column.
SPARSE = 0.125
#: Bounds of a shard's components and of a block of queries, which is broadcast.
SHARD_BYTES, BLOCK_BYTES = 1 << 21, 1 << 26
LOW, HIGH = -(1 << 63), (1 << 63) - 1
SHARD = "wave int, n int, ids binary, nulls binary, rows binary, x binary"
FOUND = "qrow long, query_id long, vec_id long, row long, score long"


def _valid(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of valid vectors, their lengths, components one after another)."""
    off = col.offsets.to_numpy().astype(np.int64)
    x = col.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    bad = np.append(0, np.cumsum(~np.isfinite(x)))
    ok = np.flatnonzero(col.is_valid().to_numpy(zero_copy_only=False) & (bad[off[1:]] == bad[off[:-1]]))
    size = off[ok + 1] - off[ok]
    return ok, size, x[wordhash.ranges(off[ok], size)]


def _padded(size: np.ndarray, x: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(size), width))
    out[np.repeat(np.arange(len(size)), size), wordhash.ranges(np.zeros(len(size), np.int64), size)] = x
    return out


def packed(vectors: DataFrame, shard_rows: int, id_col: str, vec_col: str) -> DataFrame:
    """A row for each shard: ids, marks of missing ids, row numbers and components of at most `shard_rows` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, size, x = _valid(common.as_array(batch.column(2)))
            if not len(ok):
                continue
            width = max(1, int(size.max()))
            step = max(1, min(shard_rows, SHARD_BYTES // (8 * width)))
            cut = np.append(0, np.cumsum(size))
            rows = batch.column(0).to_numpy()[ok]
            none = batch.column(1).is_null().to_numpy(zero_copy_only=False)[ok]
            ids = batch.column(1).fill_null(0).to_numpy()[ok]
            for a in range(0, len(ok), step):
                b = min(len(ok), a + step)
                m = _padded(size[a:b], x[cut[a] : cut[b]], width)
                wave = int(wordhash.mix(rows[a : a + 1].astype(np.uint64))[0] % np.uint64(16) > 0)
                cols = [[wave], [b - a], [ids[a:b].tobytes()], [none[a:b].tobytes()], [rows[a:b].tobytes()], [m.tobytes()]]
                kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["wave", "n", "ids", "nulls", "rows", "x"])

    source = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("x"))
    return source.mapInArrow(run, SHARD)


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, whether each is missing, row numbers, components) of the batch's shards."""
    for i in range(batch.num_rows):
        n, ids, none, rows, x = (batch.column(c)[i].as_py() for c in range(1, 6))
        yield np.frombuffer(ids, np.int64), np.frombuffer(none, bool), np.frombuffer(rows, np.int64), np.frombuffer(x, np.float64).reshape(n, -1)


def _queries(shards: DataFrame, every: int) -> DataFrame:
    """(qrow, query_id, v) of the rows whose id is divisible by `every`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, none, rows, x in _unpacked(batch):
                own = np.flatnonzero(~none & (ids % every == 0))
                cols = [pa.array(rows[own]), pa.array(ids[own]), pa.array([r.tobytes() for r in x[own]], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["qrow", "query_id", "v"])

    return shards.select("wave", "n", "ids", "nulls", "rows", "x").mapInArrow(run, "qrow long, query_id long, v binary")


def quantised(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): doubles that are whole numbers, or Python integers where doubles don't reach."""
    if np.abs(x).max(initial=0) < 2.0**52 / scale:
        return np.floor(scale * x)
    whole = np.frompyfunc(lambda v: int(v) * scale if abs(v) >= 2.0**52 else int(np.floor(scale * v)), 1, 1)
    return whole(x)


class Shard:
    """Postings of a shard by dimension, with the extremes that bound contributions."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, none: np.ndarray, rows: np.ndarray):
        order = np.lexsort((rows, ids, none))  # the order of ties
        self.x, self.ids, self.none, self.rows = x[order], ids[order], none[order], rows[order]
        self.high, self.low = self.x.max(0, initial=0), self.x.min(0, initial=0)
        there = self.x != 0
        listed = there.sum(0) <= SPARSE * len(x)
        self.columns = np.flatnonzero(~listed)
        self.dense = np.ascontiguousarray(self.x[:, self.columns].T)
        self.lists = {int(d): (at := np.flatnonzero(there[:, d]), self.x[at, d]) for d in np.flatnonzero(listed & there.any(0))}

    def top(self, q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, position, score) of rows that reach their query's threshold; at most k of each query."""
        bound = np.maximum(q * self.high, q * self.low)  # at least 0: the extremes take in 0
        terms = np.argsort(-bound, axis=1, kind="stable")
        falling = np.take_along_axis(bound, terms, 1)
        # bounds of all terms from each place on
        rest = np.concatenate([np.cumsum(falling[:, ::-1], axis=1)[:, ::-1], np.zeros((len(q), 1), q.dtype)], axis=1)
        go = np.flatnonzero(rest[:, 0] >= floor)
        if not len(go):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, self.x.dtype)
        q, terms, rest, least = q[go], terms[go], rest[go], floor[go]
        essential = (rest[:, :-1] >= least[:, None]).sum(1)  # the terms from there on can't reach the threshold alone
        place = np.argsort(terms, axis=1)
        walked = np.where(place < essential[:, None], q, 0)
        score = walked[:, self.columns] @ self.dense if len(self.columns) else np.zeros((len(q), len(self.rows)), q.dtype)
        for d, (at, value) in self.lists.items():
            who = np.flatnonzero(walked[:, d] != 0)
            if len(who):
                score[np.ix_(who, at)] += walked[who, d][:, None] * value[None, :]
        live = score + np.take_along_axis(rest, essential[:, None], 1) >= least[:, None]
        live &= self.rows[None, :] != own[go][:, None]
        i, at = np.nonzero(live)
        score, depth = score[i, at], essential[i]
        for start in range(int(essential.min()), q.shape[1], STEP):  # probing
            for step in range(start, min(start + STEP, q.shape[1])):
                due = np.flatnonzero(depth <= step)
                d = terms[i[due], step]
                score[due] += q[i[due], d] * self.x[at[due], d]
            done = np.minimum(np.maximum(depth, start + STEP), q.shape[1])
            stay = score + rest[i, done] >= least[i]
            i, at, score, depth = i[stay], at[stay], score[stay], depth[stay]
        if score.dtype == object:
            score = np.maximum(np.minimum(score, HIGH), LOW)
        return best(go[i], at, score, k)


def best(query: np.ndarray, order: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, by score, then by `order`."""
    by = np.argsort(order, kind="stable")
    by = by[np.argsort(~score[by] if score.dtype == np.int64 else -score[by], kind="stable")]  # a long's complement can't overflow
    by = by[np.argsort(query[by], kind="stable")]
    query = query[by]
    nth = np.arange(len(by)) - np.searchsorted(query, query, "left")
    by = by[nth < k]
    return query[nth < k], order[by], score[by]


def _search(shards: DataFrame, qrow: np.ndarray, qid: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, scale: int) -> DataFrame:
    """The k best rows of each task for each query of the block, if they reach the query's threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = floor.astype(object)
        # what was found so far: query, (missing id, id, row), score
        who, none, ids, rows, score = (np.empty(0, t) for t in (np.int64, bool, np.int64, np.int64, object))
        whole = quantised(q, scale)
        for batch in batches:
            for own_ids, own_none, own_rows, x in _unpacked(batch):
                width = max(x.shape[1], q.shape[1])
                grown = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m
                own, wide = grown(quantised(x, scale)), grown(whole)
                if own.dtype == object or wide.dtype == object or float(np.abs(own).max(initial=0)) * float(np.abs(wide).max(initial=0)) * width >= 2.0**53:
                    own, wide = (np.frompyfunc(int, 1, 1)(m) for m in (own, wide))
                shard, fresh = Shard(own, own_ids, own_none, own_rows), []
                for a in range(0, len(qrow), TOGETHER):
                    b = slice(a, a + TOGETHER)
                    need = least[b] if own.dtype == object else np.maximum(least[b].astype(np.float64), -(2.0**62))
                    i, at, s = shard.top(wide[b], qrow[b], need, k)
                    fresh.append((i + a, at, s.astype(np.int64).astype(object)))
                i, at, s = (np.concatenate(c) for c in zip(*fresh, strict=True))
                if not len(i):
                    continue
                who, score = np.append(who, i), np.append(score, s)
                none, ids, rows = np.append(none, shard.none[at]), np.append(ids, shard.ids[at]), np.append(rows, shard.rows[at])
                order = np.empty(len(who), np.int64)
                order[np.lexsort((rows, ids, none))] = np.arange(len(who))
                back = np.argsort(order)
                who, order, score = best(who, order, score.astype(np.int64), k)
                none, ids, rows, score = none[back][order], ids[back][order], rows[back][order], score.astype(object)
                full = np.flatnonzero(np.bincount(who, minlength=len(qrow)) >= k)
                last = np.searchsorted(who, full, "right") - 1
                least[full] = np.maximum(least[full], score[last])
        if len(who):
            cols = [pa.array(qrow[who]), pa.array(qid[who]), pa.array(ids, mask=none), pa.array(rows), pa.array(score.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["qrow", "query_id", "vec_id", "row", "score"])

    return shards.select("wave", "n", "ids", "nulls", "rows", "x").mapInArrow(run, FOUND)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, shard_rows: int = 4096, block_rows: int = 1 << 17, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    shards = common.written(packed(vectors, shard_rows, id_col, vec_col), "vectors", "wave")
    queries = common.written(_queries(shards, every), "vector-queries")
    rows, size = queries.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("v") + 16), F.lit(0))).first()
    blocks = max(-(-rows // block_rows), -(-size // BLOCK_BYTES))
    order = Window.partitionBy("qrow").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    found = spark.createDataFrame([], FOUND)
    for block in range(blocks):
        # rows are dealt by hash, so that blocks are of about one size
        q = queries.where(F.pmod(F.xxhash64("qrow"), F.lit(blocks)) == block).toArrow()
        if not q.num_rows:
            continue
        qrow, qid = q["qrow"].to_numpy(), q["query_id"].to_numpy()
        sizes = np.array([len(v.as_buffer()) // 8 for v in q["v"]], np.int64)
        x = _padded(sizes, np.concatenate([np.frombuffer(v.as_buffer(), np.float64) for v in q["v"]]), int(sizes.max()))
        floor = np.full(len(qrow), LOW, object)
        first = common.checkpointed(_search(shards.where("wave = 0"), qrow, qid, x, floor, k, scale))
        # a number for each query of the block
        kth = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("qrow", "score").toArrow()
        place = {r: i for i, r in enumerate(qrow.tolist())}
        for r, s in zip(kth["qrow"].to_pylist(), kth["score"].to_pylist(), strict=True):
            floor[place[r]] = s
        found = found.union(first).union(_search(shards.where("wave = 1"), qrow, qid, x, floor, k, scale))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
