"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Code points become classes by one table lookup. A small automaton walks the classes; each class acts on its states
as a transition function, the functions the classes generate form a monoid of a few dozen elements, and so the state
before every code point is an associative scan of table lookups: within columns, over the columns' totals, and down
again. A token starts where the state and the class say so. No regular expression takes part. The resulting byte
slices go through a cache to pair merging, which works on all slices that the cache lacks at once.

Null texts count as empty; an empty text has no tokens. Repeated rows are encoded each by itself. Texts of any length
are taken whole. An empty table gives no rows; further columns aren't read, whatever their names. Offsets (in bytes) of
every token are kept by `Encoded.offsets`.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordhash
from .wordhash import U, ranges

# Classes of code points, refined by what follows them.
LETTER, NUMBER, OTHER, SPACE_MORE, SPACE_LAST, BLANK_LAST, SHORT, LONG, RESET = range(9)
# States: what the last code point belongs to. BLANK: one that joins the next token. GO1, GO2: code points of a
# contraction still to come. DONE: a contraction has just ended.
NONE, IN_L, IN_N, IN_O, IN_S, AFTER_S, BLANK, GO1, GO2, DONE = range(10)

#: The first code points of the contractions' tails: one letter, or two.
TAIL1, TAIL2 = "stmd", ("re", "ve", "ll")


def _step(state: int, kind: int) -> tuple[int, bool]:
    """(next state, whether a token starts here)."""
    if kind == RESET:
        return NONE, True
    if kind == LETTER and state in (GO1, GO2):  # only letters follow there
        return (DONE if state == GO1 else GO1), False
    if kind in (SHORT, LONG):
        if state in (IN_O, BLANK):  # within a run of other signs it's one of them
            return IN_O, False
        return (GO1 if kind == SHORT else GO2), True
    if kind == SPACE_MORE:
        return IN_S, state != IN_S
    if kind == SPACE_LAST:
        return AFTER_S, True
    if kind == BLANK_LAST:
        return BLANK, True
    own = {LETTER: IN_L, NUMBER: IN_N, OTHER: IN_O}[kind]
    return own, state not in (own, BLANK)


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of each class's function, table of compositions "first a, then b", value of each function at each state)."""
    gens = [tuple(_step(s, k)[0] for s in range(10)) for k in range(9)]
    known = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(10)), *gens]))}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in gens:
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    table = np.array([[known[tuple(g[x] for x in f)] for g in known] for f in known], np.uint8)
    return np.array([known[g] for g in gens], np.uint8), table, np.array(list(known), np.uint8)


GENERATOR, COMPOSE, VALUE = _monoid()
START = np.array([[_step(s, k)[1] for k in range(9)] for s in range(10)])
_N = len(COMPOSE)
_FLAT = COMPOSE.reshape(-1)


def scanned(f: np.ndarray) -> np.ndarray:
    """Inclusive scan of composition: element i is the function of items 0..i."""
    n = len(f)
    if n <= 64:
        out = f.copy()
        for i in range(1, n):
            out[i] = COMPOSE[out[i - 1], out[i]]
        return out
    width = 128 if n > 1 << 14 else 16
    rows = -(-n // width)
    grid = np.zeros((rows, width), np.uint8)  # function 0 changes nothing
    grid.reshape(-1)[:n] = f
    grid = np.ascontiguousarray(grid.T)  # position in the column first, so that each step is over a contiguous row
    for j in range(1, width):
        np.take(_FLAT, grid[j - 1].astype(np.int32) * _N + grid[j], out=grid[j])
    carry = np.zeros(rows, np.uint8)
    carry[1:] = scanned(grid[-1])[:-1]
    grid = np.take(_FLAT, carry.astype(np.int32)[None, :] * _N + grid)
    return np.ascontiguousarray(grid.T).reshape(-1)[:n]


@lru_cache(1)
def _classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE_MORE of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    # White_Space of Unicode: fixed values
    for c in (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[c] = SPACE_MORE
    return out


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, byte position of each) of valid UTF-8."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    return np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), at


def boundaries(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte starts of all slices and the total length, each text's first slice's index (n + 1 long))."""
    if not len(buf):
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    cp, at = code_points(buf)
    kind = _classes()[cp]
    n = len(cp)
    first = np.searchsorted(at, np.unique(offsets[:-1][offsets[:-1] < offsets[1:]]))
    ends = np.zeros(n + 1, bool)  # a text starts at i
    ends[first] = ends[n] = True
    space = kind == SPACE_MORE
    last = space[:-1] & ~space[1:] & ~ends[1:n]  # white space whose text goes on with something else
    where = np.flatnonzero(last)
    kind[where] = np.where(cp[where] == 0x20, BLANK_LAST, SPACE_LAST)
    for i in np.flatnonzero(cp == 0x27):
        room = 1 if i + 1 < n and not ends[i + 1] else 0
        if room and chr(cp[i + 1]) in TAIL1:
            kind[i] = SHORT
        elif room and i + 2 < n and not ends[i + 2] and chr(cp[i + 1]) + chr(cp[i + 2]) in TAIL2:
            kind[i] = LONG
    # the state before each code point: a reset goes in front of each text's first one
    f = GENERATOR[kind]
    inner = first[1:]
    reset = np.zeros(n, bool)
    reset[inner] = True
    before = f[:-1].copy() if n > 1 else np.empty(0, np.uint8)
    before[inner - 1] = GENERATOR[RESET]  # what came before is forgotten just ahead of a text's start
    state = np.zeros(n, np.uint8)
    if n > 1:
        state[1:] = VALUE[scanned(before), NONE]
    start = START[state, kind]
    start[first] = True
    cut = at[start]
    return np.append(cut, len(buf)), np.searchsorted(cut, offsets, "left")


class Merges:
    """Ranks of byte pairs as a hash table, and pair merging of many slices at once."""

    ABSENT = np.int64(1 << 30)

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        self.bytes = [b""] * size
        for k, v in ranks.items():
            self.bytes[v] = k
        self.length = np.array([len(b) for b in self.bytes])
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.offset = np.cumsum(self.length) - self.length
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.ranks = ranks
        self.name_array = np.array([str(i) for i in range(size)], object)
        left, right, out = [], [], []
        for token, rank in ranks.items():  # each way to cut a token into two tokens is a pair that merges into it
            for cut in range(1, len(token)):
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                    left.append(a)
                    right.append(b)
                    out.append(rank)
        key = (np.array(left, np.uint64) << U(32)) | np.array(right, np.uint64)
        out = np.array(out, np.int64)
        self.shift = 64 - 20
        self.keys, self.vals, over = self._table(key, out, 20, 0x9E3779B97F4A7C15)
        order = np.argsort(key[over])
        self.more, self.more_vals = key[over][order], out[over][order]
        slot = (self.more * U(0x9E3779B97F4A7C15)) >> U(self.shift)
        self.full = np.zeros(1 << 20, bool)
        self.full[slot] = True

    @staticmethod
    def _table(key, val, bits, mul):
        slot = (key * U(mul)) >> U(64 - bits)
        _, first = np.unique(slot, return_index=True)
        keys, vals = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64), np.zeros(1 << bits, np.int64)
        keys[slot[first]], vals[slot[first]] = key[first], val[first]
        over = np.ones(len(key), bool)
        over[first] = False
        return keys, vals, np.flatnonzero(over)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint64) << U(32)) | b.astype(np.uint64)
        slot = (key * U(0x9E3779B97F4A7C15)) >> U(self.shift)
        out = np.where(self.keys[slot] == key, self.vals[slot], self.ABSENT)
        if len(miss := np.flatnonzero((out == self.ABSENT) & self.full[slot])) and len(self.more):
            i = np.minimum(np.searchsorted(self.more, key[miss]), len(self.more) - 1)
            out[miss] = np.where(self.more[i] == key[miss], self.more_vals[i], self.ABSENT)
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all slices, how many each has): the lowest rank merges first, the leftmost of equals."""
        size = np.array([len(w) for w in words])
        long = np.flatnonzero(size > 96)
        apart = [self._long(words[i]) for i in long.tolist()]
        short = np.flatnonzero(size <= 96)
        flat, group = self._many([words[i] for i in short.tolist()], size[short])
        count = np.zeros(len(words), np.int64)
        count[short] = np.bincount(group, minlength=len(short))
        count[long] = [len(x) for x in apart]
        if not apart:
            return flat, count
        out, begin = np.empty(int(count.sum()), np.int64), np.cumsum(count) - count
        out[ranges(begin[short], count[short])] = flat
        for b, x in zip(begin[long].tolist(), apart, strict=True):
            out[b : b + len(x)] = x
        return out, count

    def _many(self, words: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token ids, index of the slice of each), in the order of the slices."""
        token = self.single[np.frombuffer(b"".join(words), np.uint8)]
        group = np.repeat(np.arange(len(words)), size)
        rank = np.full(len(token), self.ABSENT)
        if len(pair := np.flatnonzero(group[:-1] == group[1:])):
            rank[pair] = self.rank(token[pair], token[pair + 1])
        done, done_group = [], []
        while len(token):
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            best = np.minimum.reduceat((rank << 32) | np.arange(len(token)), first)
            ready = (best >> 32) >= self.ABSENT
            keep = np.repeat(~ready, np.diff(np.append(first, len(token))))
            done.append(token[~keep])
            done_group.append(group[~keep])
            at = best[~ready] & 0xFFFFFFFF
            token[at] = best[~ready] >> 32
            keep[at + 1] = False
            rank[at] = -1  # to be looked up again, and the pair before as well
            token, group, rank = token[keep], group[keep], rank[keep]
            if not len(token):
                break
            at = np.flatnonzero(rank < 0)
            rank[at] = self.ABSENT
            at = np.concatenate([at, at[at > 0] - 1])
            at = at[at + 1 < len(token)]
            at = at[group[at] == group[at + 1]]
            rank[at] = self.rank(token[at], token[at + 1])
        group = np.concatenate(done_group) if done else np.empty(0, np.int64)
        order = np.argsort(group, kind="stable")
        return (np.concatenate(done)[order] if done else np.empty(0, np.int64)), group[order]

    def _long(self, word: bytes) -> list[int]:
        """One slice with a heap of pairs: n log n in its length."""
        tok = [int(self.single[b]) for b in word]
        nxt, prv = list(range(1, len(tok) + 1)), list(range(-1, len(tok) - 1))
        piece = [bytes([b]) for b in word]
        heap = [(r, i, tok[i], tok[i + 1]) for i in range(len(tok) - 1) if (r := self.ranks.get(piece[i] + piece[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if tok[i] != a or j >= len(tok) or tok[j] != b:
                continue
            tok[i], tok[j], piece[i] = r, -1, piece[i] + piece[j]
            nxt[i] = nxt[j]
            if nxt[j] < len(tok):
                prv[nxt[j]] = i
            for left in (prv[i], i):
                if left >= 0 and (right := nxt[left]) < len(tok) and (q := self.ranks.get(piece[left] + piece[right])) is not None:
                    heapq.heappush(heap, (q, left, tok[left], tok[right]))
        return [t for t in tok if t >= 0]


class Encoded:
    """Token ids of a run of texts, laid end to end; `first` has each text's first one (n + 1 long)."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, pieces: list[str], piece_first: np.ndarray, merges: Merges):
        self.ids, self.first, self.pieces, self.piece_first, self.merges = ids, first, pieces, piece_first, merges

    def offsets(self) -> np.ndarray:
        """Byte offset of every token from the start of its own text."""
        length = self.merges.length[self.ids]
        at = np.cumsum(length) - length
        count = np.diff(self.first)
        base = np.append(at, length.sum())[self.first[:-1]]
        return at - np.repeat(base, count)

    def decode(self) -> list[bytes]:
        length = self.merges.length[self.ids]
        flat = self.merges.flat[ranges(self.merges.offset[self.ids], length)].tobytes()
        ends = np.append(0, np.cumsum(length))[self.first].tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]


class Codec:
    """Encodes runs of texts. The cache keeps about `cache` slices by hash and length, and starts anew beyond that."""

    def __init__(self, path: str, cache: int = 150_000):
        with open(path, "rb") as f:
            self.merges = Merges({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
        self.limit = cache
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slot = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.ids, self.begin, self.count = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.width, self.spelled = np.empty(0, np.int64), np.empty(0, object)

    def _slots(self, raw: bytes, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Where the cache has each of these different slices (ascending keys); it gets those that it lacks."""
        if len(self.keys) + len(key) > self.limit:
            self._forget()
        at = np.searchsorted(self.keys, key)
        hit = np.zeros(len(key), bool)
        if len(self.keys):
            inside = np.minimum(at, len(self.keys) - 1)
            hit = (self.keys[inside] == key) & (self.width[self.slot[inside]] == end - start)
        out = np.empty(len(key), np.int64)
        out[hit] = self.slot[at[hit]]
        if len(miss := np.flatnonzero(~hit)):
            flat, size = self.merges.merge([raw[a:b] for a, b in zip(start[miss].tolist(), end[miss].tolist(), strict=True)])
            names = self.merges.name_array[flat].tolist()
            cut = np.append(0, np.cumsum(size)).tolist()
            spelled = np.empty(len(miss), object)
            spelled[:] = [" ".join(names[a:b]) for a, b in zip(cut, cut[1:])]
            out[miss] = len(self.width) + np.arange(len(miss))
            self.begin = np.append(self.begin, len(self.ids) + np.cumsum(size) - size)
            self.count, self.ids = np.append(self.count, size), np.append(self.ids, flat)
            self.width, self.spelled = np.append(self.width, (end - start)[miss]), np.append(self.spelled, spelled)
            self.keys, self.slot = np.insert(self.keys, at[miss], key[miss]), np.insert(self.slot, at[miss], out[miss])
        return out

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> Encoded:
        cut, first = boundaries(buf, offsets)
        start, end = cut[:-1], cut[1:]
        if not len(start):
            return Encoded(np.empty(0, np.int64), np.zeros(len(offsets), np.int64), [], first, self.merges)
        key, raw = wordhash.span_hashes(buf, start, end), buf.tobytes()
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.append(True, ordered[1:] != ordered[:-1])
        where = order[fresh]
        slot = np.empty(len(key), np.int64)
        slot[order] = self._slots(raw, ordered[fresh], start[where], end[where])[np.cumsum(fresh) - 1]
        n = self.count[slot]
        return Encoded(self.ids[ranges(self.begin[slot], n)], np.append(0, np.cumsum(n))[first], self.spelled[slot].tolist(), first, self.merges)


@lru_cache(4)
def codec(path: str) -> Codec:
    return Codec(path)


#: Bytes of text encoded at once; with the cache's limit this keeps a worker under 300 MB.
CHUNK = 1 << 19
FIELDS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, offsets]) of every row; see the module for special cases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in common.pieces(batch, size=CHUNK):
                e = own.encode(*common.buffers(common.as_array(part.column(1))))
                at = e.piece_first.tolist()
                spelled = [hashlib.sha256(" ".join(e.pieces[a:b]).encode()).hexdigest() for a, b in zip(at, at[1:])]
                decoded = [hashlib.sha256(b).hexdigest() for b in e.decode()]
                cols = [part.column(0), pa.array(np.diff(e.first), pa.int64()), pa.array(spelled, pa.string()), pa.array(decoded, pa.string())]
                if with_ids:
                    cut = pa.array(e.first, pa.int32())
                    cols += [pa.ListArray.from_arrays(cut, pa.array(e.ids, pa.int32())), pa.ListArray.from_arrays(cut, pa.array(e.offsets(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in fields.split(", ")])

    fields = FIELDS + (", ids array<int>, offsets array<bigint>" if with_ids else "")
    source = common.id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return source.mapInArrow(run, fields)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, bytes) of rows that hold doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = codec(path).merges
        for batch in batches:
            out = [b"".join(m.bytes[i] for i in ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, bytes binary")
