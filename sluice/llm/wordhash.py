"""Words and their 64-bit hashes out of UTF-8 buffers, without a Python object for each word.

A word is read in blocks of eight bytes, each mixed into the state of those before it, all words at once. Unlike a
polynomial modulo 2**64, whose prefix sums would be quicker to take, the chain has no collisions that can be written
down (long words of two letters in the Thue-Morse order, for one). Words of over LONG bytes are hashed by BLAKE2b.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span's bytes and their number."""
    size = end - start
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    block = np.ndarray((len(buf) + 1,), np.uint64, padded, strides=(1,))  # the eight bytes from each place on
    out = mix(size.astype(np.uint64) + U(0x9E3779B97F4A7C15))
    live = np.flatnonzero(size <= LONG)
    for at in range(0, LONG, 8):
        live = live[size[live] > at]
        if not len(live):
            break
        left = np.minimum(size[live] - at, 8)
        word = block[start[live] + at] & (U(0xFFFFFFFFFFFFFFFF) >> (U(64) - U(8) * left.astype(np.uint64)))
        out[live] = mix(out[live] ^ word)
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def digests(h: np.ndarray, at: np.ndarray, size: np.ndarray, lanes: int = 2) -> list[np.ndarray]:
    """`lanes` independent 64-bit hashes of each sequence h[at : at + size]: words and their order."""
    cut = np.append(0, np.cumsum(size))
    idx = ranges(at, size)
    place = (idx - np.repeat(at, size)).astype(np.uint64)
    out = []
    for lane in range(1, lanes + 1):
        salt = mix(place + U(0xD1B54A32D192ED03 * lane % (1 << 64)))
        total = np.append(U(0), np.cumsum(mix(h[idx] ^ salt)))
        out.append(mix(total[cut[1:]] - total[cut[:-1]] + size.astype(np.uint64)))
    return out


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: ASCII that is neither letter nor digit separates; bytes over 127 belong to words.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def spans(buf: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte spans of the words of all texts, and each text's first word's index (n + 1 long)."""
    word = ~separator[buf]
    left = np.zeros(len(buf) + 1, bool)
    left[1:] = word
    left[offsets] = False  # a text's first byte has nothing before it
    start = np.flatnonzero(word & ~left[:-1])
    right = np.zeros(len(buf) + 1, bool)
    right[:-1] = word
    right[offsets] = False
    end = np.flatnonzero(word & ~right[1:]) + 1
    return start, end, np.searchsorted(start, offsets, "left")


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive items; max(0, len - n + 1) of them. Runs over the borders of texts."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    acc = np.zeros(m, np.uint64)
    for j in range(n):
        acc *= U(0xD6E8FEB86659FD93)
        acc += h[j : j + m]
    return mix(acc)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... count[0] of them, then those of start[1], and so on."""
    total = int(count.sum())
    before = np.cumsum(count) - count
    return np.repeat(start - before, count) + np.arange(total)
