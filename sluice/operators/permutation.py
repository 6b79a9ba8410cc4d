"""Keyed permutations of 0 to n - 1 in constant time a row: no sort, no shuffle, no state.

A Feistel network over a grid of a x b places (a b >= n, both about the root of n): rounds add a keyed function of one
coordinate to the other, so each round, and the whole, is one-to-one on the grid. A number that leaves the range is sent
through again until it is back (cycle walking); the grid has fewer than a places more than the range, so that is rare.
A batch of numbers goes through at once, as numpy arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS, WALKS = 6, 24
# Multipliers and moduli of the round function.
A, B, M, N = 48271, 69621, 2147483647, 2147483629


def grid(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    return [((seed + 1) * 1_000_003 + 7_919 * (r + 1) ** 3) % M for r in range(rounds)]


def _mixed(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A round's function: products stay under 2^48 in any order of seeds and places."""
    return np.fmod((np.fmod(np.fmod(np.fmod(x, M) + key, M) * A, M) + 12_345) * B, N)


def _once(v: np.ndarray, seed: np.ndarray, n: int, inverse: bool) -> np.ndarray:
    """All rounds, once: place v of the grid under each seed."""
    (a, b), sign = grid(n), -1 if inverse else 1
    r = np.mod(v, b)
    left = (v - np.fmod(v, b)) // b
    for i in range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS):
        key = np.fmod((seed + 1) * 1_000_003 + 7_919 * (i + 1) ** 3, M)  # as in `keys`
        if i % 2:
            r = np.mod(r + sign * np.fmod(_mixed(left, key), b), b)
        else:
            left = np.mod(left + sign * np.fmod(_mixed(r, key), a), a)
    return left * b + r


def _turned(x: Column, n: int, seed: Column | int, inverse: bool) -> Column:
    @F.arrow_udf("bigint")
    def turned(x: pa.Array, seed: pa.Array) -> pa.Array:
        known = pc.and_(pc.is_valid(x), pc.is_valid(seed))
        key = pc.fill_null(seed, 0).to_numpy(zero_copy_only=False)
        v = _once(pc.fill_null(x, 0).to_numpy(zero_copy_only=False), key, n, inverse)
        for _ in range(WALKS):
            out = np.flatnonzero(v >= n)
            if not len(out):
                break
            v[out] = _once(v[out], key[out], n, inverse)
        if ((v >= n) & known.to_numpy(zero_copy_only=False)).any():
            raise ValueError("the walk did not come back")
        return pc.if_else(known, pa.array(v), pa.scalar(None, pa.int64()))

    return turned(x.cast("long"), (seed if isinstance(seed, Column) else F.lit(seed)).cast("long"))


def permuted(x: Column, n: int, seed: Column | int = 0) -> Column:
    """Where the x-th of n goes; x from 0. The seed may be a column (an epoch, say)."""
    return _turned(x, n, seed, False)


def restored(x: Column, n: int, seed: Column | int = 0) -> Column:
    """Which of n goes to place x: the inverse of `permuted`."""
    return _turned(x, n, seed, True)


def epoch_positions(indexed: DataFrame, n: int, epochs: int, index: str = "row_index", seed: int = 42) -> DataFrame:
    """Rows numbered 0 to n - 1, once for each epoch, with their position there; a projection, whatever n is."""
    own = indexed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    return own.withColumn("position", permuted(F.col(index), n, F.lit(seed) * 1000 + F.col("epoch")))


def batches(indexed: DataFrame, n: int, batch_rows: int, index: str = "row_index", seed: int = 42, key: str = "position") -> Iterator[DataFrame]:
    """Without end, whole batches of an epoch's rows after another's, each looked up by the numbers that belong there.

    A batch's places are a range; the inverse gives their rows' numbers, a set of `batch_rows`, by which the rows are
    joined (a broadcast, so the rows stay where they are).
    """
    for epoch in count():
        for batch in range(n // batch_rows):
            places = indexed.sparkSession.range(batch * batch_rows, (batch + 1) * batch_rows).select(F.col("id").alias(key), restored(F.col("id"), n, seed * 1000 + epoch).alias(index))
            yield indexed.join(F.broadcast(places), index).withColumn("epoch", F.lit(epoch)).withColumn("batch", F.lit(batch))
