"""Hard negatives by blocked dense matrix products, in two passes over shards of labelled vectors.

The first pass multiplies blocks of anchors by blocks of candidates and keeps each anchor's best rows of the same label;
each task keeps the best of its shards, and these are merged. The second pass multiplies again and keeps, for each anchor
and each of its positives, the best rows of another label whose score lies in the positive's window. Products are in
float64, which is exact as long as sums stay below 2^53; larger components are multiplied as Python integers.

Anchors are broadcast in blocks of at most BLOCK_BYTES with their positives. Shards are runs of rows of one task, written
once without a shuffle. Rows with a null label, a null vector or a null or non-finite component take no part. Shorter
vectors, the empty one too, count as padded with zeros. Ties go to the smaller vec_id, rows without an id last; such a
row is a candidate, but never an anchor. Repeated rows are rows of their own: each can be the other's positive. Scores
beyond a long are cut to its range, windows included. Anchors without positives, and positives without a row in their
window, give nothing, as do empty tables. Further columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, maxscore

#: Anchors that are multiplied together, bounds of a shard's components and of a block of anchors, which is broadcast.
TOGETHER, SHARD_BYTES, BLOCK_BYTES = 256, 1 << 21, 1 << 25
SHARD = "n int, ids binary, nulls binary, rows binary, labels binary, x binary"
FOUND = "qrow long, anchor_id long, slot int, vec_id long, row long, score long"


def packed(vectors: DataFrame, flip: int, classes: int, id_col: str, vec_col: str, label_col: str, shard_rows: int) -> DataFrame:
    """A row for each shard: ids, marks of missing ids, row numbers, labels and components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, size, x = maxscore._valid(common.as_array(batch.column(3)))
            if not len(ok):
                continue
            width, cut = max(1, int(size.max())), np.append(0, np.cumsum(size))
            step = max(1, min(shard_rows, SHARD_BYTES // (8 * width)))
            rows, labels = batch.column(0).to_numpy()[ok], batch.column(2).to_numpy()[ok]
            none, ids = batch.column(1).is_null().to_numpy(zero_copy_only=False)[ok], batch.column(1).fill_null(0).to_numpy()[ok]
            for a in range(0, len(ok), step):
                b = min(len(ok), a + step)
                order = np.lexsort((rows[a:b], ids[a:b], none[a:b])) + a  # rows stand in the order of ties
                m = maxscore._padded(size[a:b], x[cut[a] : cut[b]], width)[order - a]
                cols = [[b - a], *[[y.tobytes()] for y in (ids[order], none[order], rows[order], labels[order], m)]]
                kinds = [pa.int32(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["n", "ids", "nulls", "rows", "labels", "x"])

    label = F.col(label_col).cast("long")
    label = F.when(F.coalesce(F.col(id_col) % flip == 0, F.lit(False)), F.pmod(label + 1, F.lit(classes))).otherwise(label) if flip else label
    own = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vec_col).alias("x"))
    return own.where("label IS NOT NULL AND x IS NOT NULL").mapInArrow(run, SHARD)


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, whether each is missing, row numbers, labels, components) of the batch's shards."""
    for i in range(batch.num_rows):
        ids, none, rows, labels, x = (batch.column(c)[i].as_buffer() for c in range(1, 6))
        n = batch.column(0)[i].as_py()
        yield np.frombuffer(ids, np.int64), np.frombuffer(none, bool), np.frombuffer(rows, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(x, np.float64).reshape(n, -1)


def _anchors(shards: DataFrame, every: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, none, rows, labels, x in _unpacked(batch):
                own = np.flatnonzero(~none & (ids % every == 0))
                cols = [pa.array(rows[own]), pa.array(ids[own]), pa.array(labels[own]), pa.array([r.tobytes() for r in x[own]], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["qrow", "anchor_id", "label", "v"])

    return shards.mapInArrow(run, "qrow long, anchor_id long, label long, v binary")


def products(anchors: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: exact doubles, or Python integers cut to a long's range."""
    width = max(anchors.shape[1], x.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m for m in (anchors, x))
    if a.dtype != object and b.dtype != object and float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width < 2.0**53:
        return a @ b.T
    whole = np.frompyfunc(int, 1, 1)
    return np.maximum(np.minimum(whole(a) @ whole(b).T, maxscore.HIGH), maxscore.LOW)


def highest(score: np.ndarray, ok: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of what is ok, reaches its row's `least`, and isn't behind k better ones; ties of the last all stay."""
    ok = ok & (score >= least[:, None])
    full = np.flatnonzero(ok.sum(1) > k)
    if len(full):
        masked = np.where(ok[full], score[full], -np.inf)
        kth = np.sort(masked, axis=1)[:, -k] if score.dtype == object else np.partition(masked, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        ok[full] &= score[full] >= kth[:, None]
    return np.nonzero(ok)


class Kept:
    """The k best rows so far of each of `n` lists; `least` is the score that another one has to reach."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, maxscore.LOW, object)
        self.list, self.none, self.ids, self.rows, self.score = (np.empty(0, t) for t in (np.int64, bool, np.int64, np.int64, np.int64))

    def add(self, number: np.ndarray, none: np.ndarray, ids: np.ndarray, rows: np.ndarray, score: np.ndarray) -> None:
        number, score = np.append(self.list, number), np.append(self.score, score.astype(np.int64))
        none, ids, rows = np.append(self.none, none), np.append(self.ids, ids), np.append(self.rows, rows)
        order = np.empty(len(number), np.int64)
        order[by := np.lexsort((rows, ids, none))] = np.arange(len(number))
        self.list, order, self.score = maxscore.best(number, order, score, self.k)
        self.none, self.ids, self.rows = none[by][order], ids[by][order], rows[by][order]
        full = np.flatnonzero(np.bincount(self.list, minlength=len(self.least)) >= self.k)
        self.least[full] = self.score[np.searchsorted(self.list, full, "right") - 1]


def _search(shards: DataFrame, qrow: np.ndarray, qid: np.ndarray, qlabel: np.ndarray, q: np.ndarray, windows: list[tuple[np.ndarray, np.ndarray]] | None, k: int, scale: int) -> DataFrame:
    """Each task's k best rows: of the anchors' own label without windows, else of other labels in each slot's window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, whole = len(windows) if windows else 1, maxscore.quantised(q, scale)
        kept = Kept(len(qrow) * slots, k)
        for batch in batches:
            for ids, none, rows, labels, x in _unpacked(batch):
                own = maxscore.quantised(x, scale)
                for a in range(0, len(qrow), TOGETHER):
                    part = slice(a, a + TOGETHER)
                    score = products(whole[part], own)
                    like = labels[None, :] == qlabel[part][:, None]
                    for slot in range(slots):
                        number = np.arange(a, a + len(score)) * slots + slot
                        least = kept.least[number]
                        least = least if score.dtype == object else np.maximum(least.astype(np.float64), -(2.0**62))
                        if windows:
                            low, high = (w[part] for w in windows[slot])
                            ok = ~like & (score >= low[:, None]) & (score <= high[:, None])
                        else:
                            ok = like & (rows[None, :] != qrow[part][:, None])
                        i, at = highest(score, ok, least, k)
                        if len(i):
                            kept.add(number[i], none[at], ids[at], rows[at], score[i, at])
        if len(kept.list):
            who = kept.list // slots
            cols = [pa.array(qrow[who]), pa.array(qid[who]), pa.array((kept.list % slots).astype(np.int32)), pa.array(kept.ids, mask=kept.none), pa.array(kept.rows), pa.array(kept.score)]
            yield pa.RecordBatch.from_arrays(cols, ["qrow", "anchor_id", "slot", "vec_id", "row", "score"])

    return shards.mapInArrow(run, FOUND)


def ranked(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(
    vectors: DataFrame, positives: int = 5, negatives: int = 3, every: int = 50, low: int = 50, high: int = 95, scale: int = 256, flip: int = 7, classes: int = 10,
    shard_rows: int = 4096, block_bytes: int = BLOCK_BYTES, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors whose id is divisible by `every`.

    Negatives score from `low` to `high` hundredths of the positive. Where the id is divisible by `flip`, the label first
    becomes the next of `classes` (0: no label changes).
    """
    spark = vectors.sparkSession
    shards = common.written(packed(vectors, flip, classes, id_col, vec_col, label_col, shard_rows), "labelled-vectors")
    anchors = common.written(_anchors(shards, every), "anchors")
    rows, size = anchors.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("v") + 128), F.lit(0))).first()
    blocks = -(-size // block_bytes)
    best = spark.createDataFrame([], f"{FOUND}, rank int")
    worst = best
    for block in range(blocks):
        a = anchors.where(F.pmod(F.xxhash64("qrow"), F.lit(blocks)) == block).toArrow()
        if not a.num_rows:
            continue
        qrow, qid, qlabel = (a[c].to_numpy() for c in ("qrow", "anchor_id", "label"))
        sizes = np.array([len(v.as_buffer()) // 8 for v in a["v"]], np.int64)
        q = maxscore._padded(sizes, np.concatenate([np.frombuffer(v.as_buffer(), np.float64) for v in a["v"]]), int(sizes.max()))
        found = common.checkpointed(ranked(_search(shards, qrow, qid, qlabel, q, None, positives, scale), positives, "qrow"))
        own = found.select("qrow", "rank", "score").toArrow()  # at most `positives` numbers for each anchor of the block
        place = {r: i for i, r in enumerate(qrow.tolist())}
        # a slot that no positive fills has an empty window
        bounds = [(np.ones(len(qrow), np.int64), np.zeros(len(qrow), np.int64)) for _ in range(positives)]
        for r, nth, s in zip(*(own[c].to_pylist() for c in ("qrow", "rank", "score")), strict=True):
            bounds[nth - 1][0][place[r]], bounds[nth - 1][1][place[r]] = -((-low * s) // 100), (high * s) // 100
        best = best.union(found)
        worst = worst.union(ranked(_search(shards, qrow, qid, qlabel, q, bounds, negatives, scale), negatives, "qrow", "slot").withColumn("rank", F.col("rank").cast("int")))
    p = best.select("qrow", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    n = worst.select("qrow", "anchor_id", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return n.join(p, ["qrow", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
