"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Features of a text are its words (runs of letters, of digits, or of one sign), the shape of each word's case, and pairs
of neighbours, hashed to buckets; a bucket's value is its share of the text's features. Scores are sparse dot products
through the logistic function. The fit reads all labelled rows outside the held-out fold, in shards.

Null and empty texts have no features and score what the bias gives. Repeated rows are scored each by itself. Texts are
taken whole, however long. With no labelled rows at all every score is 0.5; an empty table gives no rows. Further
columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordhash
from .wordhash import U

#: Kinds of bytes: 0 white space, 1 small letters, 2 capitals, 3 digits, others by the sign itself.
_KIND = np.array([0 if b in (32, 9, 10, 11, 12, 13) else 1 if 97 <= b <= 122 or b > 127 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else b + 4 for b in range(256)], np.int16)
#: A word is one kind, capitals counting as letters.
_WORD = np.where(_KIND == 2, 1, _KIND)


def features(buf: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each feature, index of its text)."""
    kind = _WORD[buf]
    new = np.ones(len(buf), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offsets[offsets < len(buf)]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(buf))
    keep = kind[start] != 0
    start, end = start[keep], end[keep]
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    text = np.searchsorted(offsets, start, "right") - 1
    word = wordhash.span_hashes(wordhash.LOWER[buf], start, end)
    capital = _KIND[buf] == 2
    capitals = np.add.reduceat(capital, start) if len(start) else np.empty(0)
    upper = np.where(capitals == 0, 0, np.where(capitals >= np.minimum(end - start, 2), 2, 1))
    shape = wordhash.mix((kind[start].astype(np.int64) * 4 + upper).astype(np.uint64) + U(77))
    pair = wordhash.grams(word, 2)
    same = text[1:] == text[:-1]
    pair = np.where(word[1:] == word[:-1], U(0x1F3D5B79A2C4E680), pair) if len(pair) else pair  # a word said twice is one feature
    hashed = np.concatenate([word, shape, pair[same]])
    return (hashed >> U(64 - bits)).astype(np.int64), np.concatenate([text, text, text[1:][same]])


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    bits: int

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        bucket, text = features(buf, offsets, self.bits)
        n = len(offsets) - 1
        total = np.bincount(text, self.weights[bucket], n) if len(bucket) else np.zeros(n)
        z = self.bias + total / np.maximum(1, np.bincount(text, minlength=n)) * SCALE
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: Values are shares of a text's features times this, so that weights stay near 1.
SCALE = 20.0


def weights(z: np.ndarray, n: np.ndarray, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01) -> np.ndarray:
    w = -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)
    return np.where(np.abs(z) <= l1, 0.0, w)


def pass_over(z: np.ndarray, n: np.ndarray, rows: list[tuple[int, np.ndarray, np.ndarray]], rng: np.random.Generator, alpha: float = 0.3, **rest: float) -> None:
    """One pass of proximal FTRL over (label, buckets, values), one row at a time, in an order that `rng` draws."""
    last = len(z) - 1  # the bias
    for k in rng.permutation(len(rows)):
        y, i, x = rows[k]
        i, x = np.append(i, last), np.append(x, 1.0)
        w = weights(z[i], n[i], alpha, **rest)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
        z[i] += g - s * w
        n[i] += g * g


def model_of(z: np.ndarray, n: np.ndarray, bits: int, **rest: float) -> Model:
    w = weights(z, n, **rest)
    return Model(w[:-1].astype(np.float32), float(w[-1]), bits)


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int, epochs: int = 4, **rest: float) -> Model:
    """The model of rows that are all at hand; `rest` may have alpha, beta, l1 and l2."""
    z, n, rng = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1), np.random.default_rng(7)
    for _ in range(epochs):
        pass_over(z, n, rows, rng, **rest)
    return model_of(z, n, bits, **rest)


def fit(docs: DataFrame, labels: DataFrame, shard_rows: int = 6000, bits: int = 18, epochs: int = 4) -> Model:
    """Learns from all labelled rows outside the held-out fold.

    Each pass is a job: a task goes over its shard of about `shard_rows` rows, batch by batch, from the model so far, and
    the shards' changes are averaged by bucket; the driver gets only these means. A repeated doc_id counts once. Shards
    are dealt by id and sums are exact, so that a repeated run gives the same model.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for buf, offsets in common.unpacked(batch.column(1)):
                bucket, text = features(buf, offsets, bits)
                order = np.argsort(text, kind="stable")
                bucket, cut = bucket[order], np.searchsorted(text[order], np.arange(len(offsets)))
                for a, b in zip(cut, cut[1:], strict=False):
                    i, c = np.unique(bucket[a:b], return_counts=True)
                    own = i.astype(np.int32).tobytes() + (c * (SCALE / max(1, b - a))).astype(np.float32).tobytes()
                    out.append(len(own).to_bytes(8, "little") + pa.compress(own, codec="zstd", asbytes=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["label", "f"])

    shards = common.checkpointed(common.labelled(docs, labels, "quality", shard_rows).select("label", "z").mapInArrow(run, "label int, f binary"))
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    for number in range(epochs):

        def passed(batches: Iterator[pa.RecordBatch], z: np.ndarray = z, n: np.ndarray = n, number: int = number) -> Iterator[pa.RecordBatch]:
            own, rng = (z.copy(), n.copy()), np.random.default_rng([7, number])
            for batch in batches:
                raw = [common.unpacked_one(f.as_py()) for f in batch.column(1)]
                parts = [(np.frombuffer(f[: len(f) // 2], np.int32), np.frombuffer(f[len(f) // 2 :], np.float32)) for f in raw]
                pass_over(*own, [(y, i, x) for y, (i, x) in zip(batch.column(0).to_pylist(), parts, strict=True)], rng)
            at = np.flatnonzero((own[0] != z) | (own[1] != n))
            if len(at):
                yield common.changes(at, np.stack([own[0][at] - z[at], own[1][at] - n[at]], 1))

        keys, values = common.mean_changes(shards, passed, 2)
        z[keys] += values[:, 0]
        n[keys] += values[:, 1]
    return model_of(z, n, bits)


def scored(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.pieces(batch):
                score = model.score(*common.buffers(common.as_array(part.column(1))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    got = common.id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, score double")
    return got.select("doc_id", F.coalesce(common.fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows, all columns, whose text scores at least the threshold; texts go through Arrow once, with their rows."""
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = common.as_array(batch.column(at)).fill_null("")
            for part in common.pieces(pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), text], ["row", "text"])):
                score = model.score(*common.buffers(common.as_array(part.column(1))))
                rows = part.column(0).filter(pa.array(score >= threshold))
                if len(rows):
                    yield pa.RecordBatch.from_arrays(batch.take(rows).columns, names)

    return docs.mapInArrow(run, docs.schema)
