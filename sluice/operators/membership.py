"""Membership joins with a Bloom filter in front: most rows that can't match go at the scan, before any shuffle.

The filter is made by aggregation: each key sets a few bits, which are put together by bit_or in groups of seven to a
byte (so that a byte is an ASCII character, and a built-in function reads it). Its size is a parameter, not that of the
data: with more keys than it was sized for it only lets more rows through, as the exact join follows anyway.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a filter at most; it travels with the plan.
MOST_BYTES = 1 << 20


def sized(keys: int, rate: float = 0.01, most: int = MOST_BYTES) -> tuple[int, int]:
    """(bytes of 7 bits, bits set by a key) for so many keys and so many false hits, within the bound."""
    bits = -max(1, keys) * math.log(rate) / math.log(2) ** 2
    size = min(most, max(8, math.ceil(bits / 7)))
    return size, max(1, min(8, round(7 * size / max(1, keys) * math.log(2))))


def _places(key: Column, size: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), key), F.lit(7 * size)) for i in range(hashes)]


def bloom(keys: DataFrame, on: str, size: int, hashes: int) -> bytes:
    """The filter of a column's keys; a byte for each group of seven bits comes to the driver, nothing else."""
    place = keys.where(F.col(on).isNotNull()).select(F.explode(F.array(*_places(F.col(on), size, hashes))).alias("p"))
    rows = place.groupBy(F.expr("p div 7").cast("int").alias("b")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("p") % 7).cast("int"))).alias("v")).toArrow()
    out = np.zeros(size, np.uint8)
    out[rows["b"].to_numpy()] = rows["v"].to_numpy()
    return out.tobytes()


def may_hold(table: bytes, key: Column, hashes: int) -> Column:
    """False only for keys that aren't in the filter; null keys aren't."""
    own = F.lit(bytearray(table))
    out = key.isNotNull()
    for p in _places(key, len(table), hashes):
        byte = F.ascii(F.substring(own, F.call_function("div", p, F.lit(7).cast("long")).cast("int") + 1, F.lit(1)).cast("string"))
        out = out & (F.call_function("getbit", byte, (p % 7).cast("int")) == 1)
    return out


def members(docs: DataFrame, ids: DataFrame, on: str = "id", expected: int | None = None, rate: float = 0.01) -> DataFrame:
    """As a left semi join. `expected`: about how many keys there are (counted if it isn't given)."""
    own = ids.select(on).where(F.col(on).isNotNull())
    size, hashes = sized(own.count() if expected is None else expected, rate)
    return docs.where(may_hold(bloom(own, on, size, hashes), F.col(on), hashes)).join(own, on, "left_semi")


def strangers(docs: DataFrame, ids: DataFrame, on: str = "id", expected: int | None = None, rate: float = 0.01) -> DataFrame:
    """As a left anti join: rows that the filter turns away are answers at once, only the others are joined."""
    own = ids.select(on).where(F.col(on).isNotNull())
    size, hashes = sized(own.count() if expected is None else expected, rate)
    hit = may_hold(bloom(own, on, size, hashes), F.col(on), hashes)
    return docs.where(~hit).unionByName(docs.where(hit).join(own, on, "left_anti"))
