"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of a bucket's for the word and one's for its beginning. Filters of widths 1 to 3 run over
the words, the maximum of each over the text goes to a logistic unit. As everything before the maximum is linear, the
scorer multiplies the embeddings by all filters once and only adds rows. The score is calibrated so that 0.5 is the
best cut over all languages; thresholds by language, from all calibration rows, are given beside it.
The language is no input of the score. The fit reads all labelled rows outside the held-out fold, in shards.

Null and empty texts: all maxima are 0. Repeated rows are scored each by itself. Texts are taken whole, however long.
With no labelled rows all rows score alike; an empty table gives no rows. Further columns aren't read, whatever their names.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.prefix import accumulated

from . import common, wordhash
from .wordhash import U

WIDTHS, FILTERS, DIM, BITS, HEAD = (1, 2, 3), 8, 12, 17, 6
_WIDE = sum(WIDTHS) * FILTERS
#: Different scores of a language that one task may sum up; more are summed up by ranges.
SINGLE_TASK_VALUES = 4000


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each word, bucket of its beginning, each text's first word's index (n + 1 long))."""
    low = wordhash.LOWER[buf]
    start, end, first = wordhash.spans(low, offsets, wordhash.NOT_ALNUM)
    whole = wordhash.span_hashes(low, start, end)
    head = wordhash.span_hashes(low, start, np.minimum(end, start + HEAD)) ^ U(0x5BD1E995)
    return (whole >> U(64 - BITS)).astype(np.int32), (wordhash.mix(head) >> U(64 - BITS)).astype(np.int32), first


@dataclass
class Model:
    table: np.ndarray  # embeddings times all filters
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    shift: float = 0.0
    by_lang: dict[str, float] = field(default_factory=dict)

    def raw(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        whole, head, first = words(buf, offsets)
        n = len(offsets) - 1
        peak = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        pad = max(WIDTHS) - 1
        count = np.diff(first)
        at = wordhash.ranges(first[:-1] + pad * np.arange(n), count)  # `pad` empty words after each text
        z = np.zeros((len(whole) + pad * n + pad, _WIDE), np.float32)
        z[at] = self.table[whole] + self.table[head]
        start = first[:-1] + pad * np.arange(n)
        used, col = len(whole) + pad * n, 0
        between = np.ones(used, bool)
        between[at] = False
        for k, width in enumerate(WIDTHS):
            c = z[:used, col : col + FILTERS].copy()
            for j in range(1, width):
                c += z[j : used + j, col + j * FILTERS : col + (j + 1) * FILTERS]
            c[between] = 0  # what begins behind a text must not reach into the next one
            col += width * FILTERS
            peak[:, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(c, start)
        return np.maximum(peak + self.bias, 0) @ self.out + self.out_bias

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = self.slope * self.raw(buf, offsets).astype(float) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class State:
    """What training changes, and AdaGrad's sums of squares for each."""

    emb: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    sums: list[np.ndarray]
    out_sum: float = 1e-2

    @property
    def parts(self) -> tuple:
        return self.emb, self.filters, self.bias, self.out, self.out_bias

    def dense(self) -> np.ndarray:
        """Everything but the embeddings, in rows as wide as an embedding and its sums."""
        flat = np.concatenate([np.ravel(x).astype(float) for x in (*self.filters, self.bias, self.out, self.out_bias, *self.sums[1:], self.out_sum)])
        return np.append(flat, np.zeros(-len(flat) % (2 * DIM))).reshape(-1, 2 * DIM)

    def since(self, before: State) -> pa.RecordBatch:
        """The changes: of an embedding by its bucket, of the rows of `dense` by negative keys."""
        bucket = np.flatnonzero((self.sums[0] != before.sums[0]).any(1))
        emb = np.concatenate([self.emb[bucket] - before.emb[bucket], self.sums[0][bucket] - before.sums[0][bucket]], 1)
        dense = self.dense() - before.dense()
        return common.changes(np.append(bucket, -1 - np.arange(len(dense))), np.concatenate([emb.astype(float), dense]))

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        at = keys >= 0
        self.emb[keys[at]] += values[at, :DIM].astype(np.float32)
        self.sums[0][keys[at]] += values[at, DIM:].astype(np.float32)
        dense = self.dense()
        dense[-1 - keys[~at]] += values[~at]
        flat = dense.ravel()
        for x in (*self.filters, self.bias, self.out):
            x[:], flat = flat[: x.size].reshape(x.shape), flat[x.size :]
        self.out_bias, flat = float(flat[0]), flat[1:]
        for x in self.sums[1:]:
            x[:], flat = flat[: x.size].reshape(x.shape), flat[x.size :]
        self.out_sum = float(flat[0])


def begun(seen: np.ndarray, total: np.ndarray) -> State:
    """The state before training, of the rows of either label that have a bucket, and of all.

    Embeddings begin at random but for their first coordinate, the damped log-odds of the bucket in the rows; with
    maxima over long texts the gradient reaches only winners, so winners have to be worth looking at from the start.
    """
    rng = np.random.default_rng(11)
    size = 1 << BITS
    emb = rng.normal(0, 0.05, (size, DIM)).astype(np.float32)
    total = np.maximum(1, total)
    ratio = (seen[1] + 0.5) / (total[1] + 1) / ((seen[0] + 1) / (total[0] + 2))
    emb[:, 0] = np.clip(np.log(ratio), -3, 3) * np.minimum(1, seen.sum(0) / 8) * (np.log(ratio) > 0)
    filters = [rng.normal(0, 0.1, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0, : FILTERS // 2] = 1.0
    bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
    bias[:] = -0.5
    out = rng.normal(0, 0.05, len(WIDTHS) * FILTERS).astype(np.float32)
    out[: FILTERS // 2] = 0.4
    sums = [np.full((size, DIM), 1e-2, np.float32), *[np.full_like(f, 1e-2) for f in filters], np.full_like(bias, 1e-2), np.full_like(out, 1e-2)]
    return State(emb, filters, bias, out, -2.0, sums)


def count(seen: np.ndarray, total: np.ndarray, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
    for y, w, h in rows:
        seen[y, np.unique(np.concatenate([w, h]))] += 1
        total[y] += 1


def pass_over(s: State, rows: list[tuple[int, np.ndarray, np.ndarray]], rng: np.random.Generator, rate: float = 0.08) -> None:
    """One pass of gradient steps over (label, words, heads), in an order that `rng` draws."""
    emb, filters, bias, out, sums, pad = s.emb, s.filters, s.bias, s.out, s.sums, max(WIDTHS) - 1
    for k in rng.permutation(len(rows)):
        y, w, h = rows[k]
        n = len(w)
        x = np.zeros((n + 2 * pad, DIM), np.float32)
        x[:n] = emb[w] + emb[h]
        peak = np.empty(len(WIDTHS) * FILTERS, np.float32)
        where = []
        for i, width in enumerate(WIDTHS):
            c = x[: n + pad] @ filters[i][:DIM]
            for j in range(1, width):
                c += x[j : n + pad + j] @ filters[i][j * DIM : (j + 1) * DIM]
            top = c.argmax(0)
            where.append(top)
            peak[i * FILTERS : (i + 1) * FILTERS] = c[top, np.arange(FILTERS)]
        act = np.maximum(peak + bias, 0)
        g = 1 / (1 + np.exp(-np.clip(act @ out + s.out_bias, -30, 30))) - y
        if abs(g) < 0.02:
            continue
        g_out, g_act = g * act, g * out * (act > 0)
        sums[-1] += g_out**2
        out -= rate * g_out / np.sqrt(sums[-1])
        s.out_sum += g * g
        s.out_bias -= rate * g / np.sqrt(s.out_sum)
        sums[-2] += g_act**2
        bias -= rate * g_act / np.sqrt(sums[-2])
        for i, width in enumerate(WIDTHS):
            ga, top = g_act[i * FILTERS : (i + 1) * FILTERS], where[i]
            gf = np.zeros_like(filters[i])
            for j in range(width):
                gf[j * DIM : (j + 1) * DIM] = (x[top + j] * ga[:, None]).T
                for q in np.flatnonzero(ga):
                    if (p := top[q] + j) < n:
                        ge = ga[q] * filters[i][j * DIM : (j + 1) * DIM, q]
                        for b in (w[p], h[p]):
                            sums[0][b] += ge**2
                            emb[b] -= rate * ge / np.sqrt(sums[0][b])
            sums[1 + i] += gf**2
            filters[i] -= rate * gf / np.sqrt(sums[1 + i])


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 3, rate: float = 0.08) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, float]:
    """(embeddings, filters by width, filter biases, output weights, output bias) from rows that are all at hand."""
    seen, total = np.zeros((2, 1 << BITS)), np.zeros(2)
    count(seen, total, rows)
    state, rng = begun(seen, total), np.random.default_rng(11)
    for _ in range(epochs):
        pass_over(state, rows, rng, rate)
    return state.parts


def assembled(emb, filters, bias, out, out_bias) -> Model:
    cols = [emb @ f[j * DIM : (j + 1) * DIM] for f, w in zip(filters, WIDTHS, strict=True) for j in range(w)]
    return Model(np.ascontiguousarray(np.concatenate(cols, 1), np.float32), bias, out, float(out_bias))


def fit(docs: DataFrame, labels: DataFrame, shard_rows: int = 8000, epochs: int = 3) -> Model:
    """Learns from all labelled rows outside the held-out fold, a quarter of them for calibration only.

    Each pass is a job: a task goes over its shard of about `shard_rows` rows, batch by batch, from the model so far, and
    the shards' changes are averaged by bucket. The driver gets counts by bucket, the mean changes and the cuts. A
    repeated doc_id counts once. Shards are dealt by id and sums are exact, so that a repeated run gives the same model.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = []
            for buf, offsets in common.unpacked(batch.column(3)):
                whole, head, first = words(buf, offsets)
                f += [np.concatenate([whole[a:b], head[a:b]]).astype(np.int32).tobytes() for a, b in zip(first, first[1:], strict=False)]
            z = [len(x).to_bytes(8, "little") + pa.compress(x, codec="zstd", asbytes=True) for x in f]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(z, pa.binary())], ["doc_id", "label", "lang", "f"])

    # languages only serve the thresholds
    rows = common.labelled(docs, labels, "toxic", shard_rows, lang=True).select("doc_id", "label", "lang", "z").mapInArrow(run, "doc_id long, label int, lang string, f binary")
    rows = common.checkpointed(rows.withColumn("test", F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 3))
    shards = rows.where("NOT test").select("label", "f")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros((2, 1 << BITS)), np.zeros(2)
        for batch in batches:
            count(seen, total, _rows(batch))
        key = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(key, -1)), *[pa.array(np.append(seen[y, key], total[y]).astype(np.int64)) for y in (0, 1)]], ["key", "n0", "n1"])

    got = shards.mapInArrow(counted, "key long, n0 long, n1 long").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    seen = np.zeros((2, (1 << BITS) + 1))
    for y in (0, 1):
        seen[y, got["key"].to_numpy()] = got[f"n{y}"].to_numpy()  # all rows stand at -1, the end
    state = begun(seen[:, :-1], seen[:, -1])
    for number in range(epochs):

        def passed(batches: Iterator[pa.RecordBatch], state: State = state, number: int = number) -> Iterator[pa.RecordBatch]:
            own, rng, any_row = copy.deepcopy(state), np.random.default_rng([11, number]), False
            for batch in batches:
                pass_over(own, _rows(batch), rng)
                any_row |= batch.num_rows > 0
            if any_row:
                yield own.since(state)

        state.add(*common.mean_changes(shards, passed, 2 * DIM))
    model = assembled(*state.parts)
    model.slope, model.shift, model.by_lang = _calibrated(rows.where("test").select("label", "f", "lang"), model)
    return model


def _rows(batch: pa.RecordBatch) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(label, words, heads) of rows whose first columns are label and f."""
    out = []
    for y, f in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        both = np.frombuffer(common.unpacked_one(f.as_py()), np.int32)
        out.append((y, both[: len(both) // 2], both[len(both) // 2 :]))
    return out


def _calibrated(rows: DataFrame, model: Model) -> tuple[float, float, dict[str, float]]:
    """(slope, shift, cuts by language) from all calibration rows: those of largest F1, halfway to the next value below.

    Values are counted and summed up in order by Spark; the driver gets a few rows for each language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [_raw_of(model, w, h) for _, w, h in _rows(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array(z, pa.float64())], ["lang", "y", "z"])

    return _cuts(rows.mapInArrow(run, "lang string, y int, z double").groupBy("lang", "z").agg(F.count("*").alias("n"), F.sum("y").alias("hits")))


def _cuts(each: DataFrame) -> tuple[float, float, dict[str, float]]:
    """`_calibrated` of (lang, z, n, hits): how many rows have a value, and how many of them are toxic."""
    each = common.checkpointed(each)
    whole = each.groupBy("z").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).select(F.lit("all").alias("of"), "z", "n", "hits")
    each = whole.union(each.where("lang IS NOT NULL").select(F.concat(F.lit("in "), "lang").alias("of"), "z", "n", "hits"))
    fixed = F.rint(F.col("z") * float(common.FRACTION)).cast("decimal(28,0)")
    totals = {r["of"]: r for r in each.groupBy("of").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum(fixed * F.col("hits")).alias("z1"), F.sum(fixed * (F.col("n") - F.col("hits"))).alias("z0")).collect()}
    most = totals.get("all")
    if most is None or not 0 < most.hits < most.n:
        return 1.0, 0.0, {}
    fair = [k for k, r in totals.items() if k == "all" or min(r.hits, r.n - r.hits) >= 5]
    both = F.col("hits") * (1 << 32) + F.col("n")  # two running sums in one
    run_up = accumulated(each.where(F.col("of").isin(fair)), [F.col("z").desc()], both, ["of"], SINGLE_TASK_VALUES)
    hit, k, positives = F.floor(F.col("incl") / (1 << 32)), F.col("incl") % (1 << 32), F.floor(F.col("total") / (1 << 32))
    best = run_up.select("of", "z", (2 * hit / (k + positives)).alias("f1")).groupBy("of").agg(F.max_by("z", F.struct("f1", "z")).alias("best"))
    best = common.checkpointed(best)
    below = each.join(F.broadcast(best), "of").groupBy("of", "best").agg(F.max(F.when(F.col("z") < F.col("best"), F.col("z"))).alias("next"))
    cut = {r["of"]: (r.best + r.next) / 2 if r.next is not None else r.best - 1 for r in below.collect()}
    mean = lambda total, n: float(total) / common.FRACTION / n
    slope = 6 / max(1e-3, mean(most.z1, most.hits) - mean(most.z0, most.n - most.hits))
    shift = -cut["all"] * slope
    return slope, shift, {of.removeprefix("in "): float(1 / (1 + np.exp(-(slope * z + shift)))) for of, z in cut.items() if of != "all"}


def _raw_of(model: Model, w: np.ndarray, h: np.ndarray) -> float:
    n, pad = len(w), max(WIDTHS) - 1
    z = np.zeros((n + 2 * pad, _WIDE), np.float32)
    z[:n] = model.table[w] + model.table[h]
    peak, col = [], 0
    for width in WIDTHS:
        c = sum(z[j : n + pad + j, col + j * FILTERS : col + (j + 1) * FILTERS] for j in range(width))
        peak.append(c.max(0))
        col += width * FILTERS
    return float(np.maximum(np.concatenate(peak) + model.bias, 0) @ model.out + model.out_bias)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """(doc_id, held_out, score, predicted, lang_threshold, flagged) of every row; flagged goes by the language's threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.pieces(batch):
                score = model.score(*common.buffers(common.as_array(part.column(1))))
                cut = [model.by_lang.get(x, 0.5) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score, pa.float64()), pa.array(cut, pa.float64())], ["doc_id", "score", "lang_threshold"])

    lang = F.col(lang_col).cast("string") if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), lang.alias("lang"))
    got = source.mapInArrow(run, "doc_id long, score double, lang_threshold double")
    return got.select(
        "doc_id",
        F.coalesce(common.fold("doc_id") == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "lang_threshold",
        (F.col("score") >= F.col("lang_threshold")).cast("int").alias("flagged"),
    )
