"""Language-model scores from n-gram counts of the whole training corpus, in Elias-Fano tries.

Tokens are words (A-Z in lower case) and one end a text. The probability of a token behind a context is smoothed by a
prior: P(w | c) = (n(c w) + mu P(w | c')) / (n(c) + mu), c' being c without its first word, down to the base
P(w) = (n(w) + 1) / (N + V + 1); mu is a parameter for each order. Contexts don't reach over a text's beginning.

The model has no bound, so no task holds it whole and nothing of it is broadcast but N and V. Texts are read once into
runs of about RUN_BYTES: token codes and the run's words. A run's different n-grams of all orders go out by their hashes
with their numbers in training texts, to parts of even size; a part sums each n-gram over all runs and sends each run
the sums it asked for. So a frequent n-gram is one row a run, and no part grows with one. Each run then puts the n-grams
that the corpus has seen, of those that its texts can reach, into a trie, and its tokens are looked up there.

The trie has a level for each order. A level's words are kept relative to their context: the children of a context are
sorted, and each is raised by the last value of the context before, which makes the level one monotone sequence in
Elias-Fano form, searched by successor in the one bucket of its high bits. Pointers to the children are monotone as well.
Log10 probabilities and those of falling back from a context are whole numbers of STEPS to the unit, 16 bits each; so a
score is an exact sum, whatever the order. All levels lie in one buffer of plain arrays, which `Trie.opened` views where
it is, be it a batch of Arrow or a memory-mapped file.

Words are told apart by 62-bit hashes, longer n-grams by as many bits as leave one in 2^20 with another's number added. Null texts are empty, and an empty text is one end.
A row without an id is scored and never learnt from; repeated rows are learnt from and scored each by itself. Texts
are taken whole, however long: one longer than a run is a run. Without training texts every probability is 1. Empty
tables give no rows; further columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordhash
from .wordhash import U

#: Bytes of text of a run, n-grams of a part, steps of a unit of log10.
RUN_BYTES, PART_KEYS, STEPS = 5 << 20, 1 << 21, 2048
#: N-grams that are looked up together.
TOGETHER = 1 << 17
#: Prior weights of orders 2, 3, ...
PRIORS = (300.0, 10.0)
END = U(0x2545F4914F6CDD1D)
RUN = "run long, n_tokens long, n_trained long, ids binary, nulls binary, held binary, trained binary, first binary, words binary, codes binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def squeezed(x: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of all, compressed."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def restored(z, dtype) -> np.ndarray:
    z = memoryview(z)
    n, size = int.from_bytes(z[:8], "little"), np.dtype(dtype).itemsize
    raw = np.frombuffer(pa.decompress(z[8:], n * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(dtype)[:, 0] if n else np.empty(0, dtype)


# --- Elias-Fano ---

# Bit patterns that count the ones of all bytes of a word at once.
_55, _33, _0F, _01, _80 = (U(int(x * 8, 16)) for x in ("55", "33", "0F", "01", "80"))
#: Place of the k-th set bit of a byte, at 8 * byte + k.
_NTH = np.zeros(2048, np.int64)
for _b in range(256):
    for _k, _at in enumerate([i for i in range(8) if _b >> i & 1]):
        _NTH[8 * _b + _k] = _at


def _nth_bit(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th (from 0) set bit of each 64-bit word: the byte by running counts, the bit by a table."""
    k = k.astype(np.uint64)
    ones = words - ((words >> U(1)) & _55)
    ones = (ones & _33) + ((ones >> U(2)) & _33)
    ones = ((ones + (ones >> U(4))) & _0F) * _01  # in each byte, the ones up to it
    shift = np.bitwise_count(((k * _01) | _80) - ones & _80).astype(np.uint64) << U(3)  # bytes that end before the bit
    before = ((ones << U(8)) >> shift) & U(255)
    return shift.astype(np.int64) + _NTH[((words >> shift) & U(255)) * U(8) + k - before]


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary, with the ones counted before each word."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones
        self.zeros = np.arange(len(ones)) * 64 - ones.astype(np.int64)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n, top = len(values), int(values[-1]) + 1 if len(values) else 1
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        flags = np.zeros((n * bits + 127) // 64 * 64, np.uint8)
        for b in range(bits):
            flags[b : n * bits : bits] = (values >> b) & 1
        low = np.packbits(flags, bitorder="little").view(np.uint64)
        place = (values >> bits) + np.arange(n)
        flags = np.zeros(((int(place[-1]) + 2 if n else 1) + 63) // 64 * 64, np.uint8)
        flags[place] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        ones = np.append(0, np.cumsum(np.bitwise_count(high), dtype=np.int64))[:-1]
        return cls(n, bits, low, high, ones.astype(np.uint32))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        got = self.low[word] >> shift
        got |= np.where(shift > U(0), self.low[word + 1] << ((U(64) - shift) & U(63)), U(0))
        return (got & U((1 << self.low_bits) - 1)).astype(np.int64)

    def at(self, i: np.ndarray) -> np.ndarray:
        """The values at these places; quickest if they rise."""
        word = np.searchsorted(self.ones, i.astype(np.uint32), "right") - 1
        place = word * 64 + _nth_bit(self.high[word], i - self.ones[word])
        return ((place - i) << self.low_bits) | self._low(i)

    def _bucket(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many values have high bits under h, how many have h or less)."""
        k = np.maximum(h - 1, 0)  # the zero that ends the bucket before
        word = np.searchsorted(self.zeros, k, "right") - 1
        place = np.where(h == 0, -1, word * 64 + _nth_bit(~self.high[word], k - self.zeros[word]))
        begin = place + 1 - h
        # the bucket's ones follow, up to the next zero
        at = place + 1
        bit = at & 63
        rest = ~(self.high[np.minimum(at >> 6, len(self.high) - 1)] >> bit.astype(np.uint64))
        size = np.bitwise_count((rest & (~rest + U(1))) - U(1)).astype(np.int64)
        live = np.flatnonzero(size >= 64 - bit)
        size[live] = 64 - bit[live]
        at[live] += size[live]
        while len(live := live[at[live] < len(self.high) * 64]):  # on in the next words
            rest = ~self.high[at[live] >> 6]
            more = np.bitwise_count((rest & (~rest + U(1))) - U(1)).astype(np.int64)
            size[live] += more
            at[live] += more
            live = live[more == 64]
        return begin, begin + size

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first value that isn't less than x (n: none), whether it is x)."""
        high = x >> self.low_bits
        h = np.minimum(high, len(self.high) * 64 - self.n - 1)  # the last zero
        a, end = self._bucket(h)
        low, b = x & ((1 << self.low_bits) - 1), end.copy()
        live = np.flatnonzero(a < b)
        while len(live):  # halves the bucket
            mid = (a[live] + b[live]) >> 1
            less = self._low(mid) < low[live]
            a[live[less]] = mid[less] + 1
            b[live[~less]] = mid[~less]
            live = live[a[live] < b[live]]
        a[high > h] = self.n
        same = a < end
        same[same] = self._low(a[same]) == low[same]
        return a, same

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.low, self.high, self.ones]

    @classmethod
    def opened(cls, arrays: list[np.ndarray]) -> EliasFano:
        return cls(int(arrays[0][0]), int(arrays[0][1]), *arrays[1:])


# --- trie ---


@dataclass
class Level:
    """n-grams of an order: their last words by context, the first child of each context, log10 values in steps."""

    words: EliasFano | None  # None: the first level's words are 0, 1, ...
    heads: EliasFano | None  # of the level above; None there
    value: np.ndarray  # log10 of the probability, negated
    back: np.ndarray  # log10 of what is left for words that the context hasn't, negated


class Trie:
    def __init__(self, levels: list[Level], n_words: int):
        self.levels, self.n_words = levels, n_words

    @classmethod
    def of(cls, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], n_words: int) -> Trie:
        """Out of (context's place in the level above, word, value, back), sorted by the first two; words under n_words."""
        out = []
        for k, (context, word, value, back) in enumerate(levels):
            words = heads = None
            if k:
                heads_at = np.searchsorted(context, np.arange(len(levels[k - 1][1]) + 1))
                new = np.ones(len(word), bool)
                new[1:] = context[1:] != context[:-1]
                last = np.append(new[1:], True) if len(word) else new
                # each context's words begin over the last value of the context before
                raised = np.cumsum(np.append(0, word[last] + 1))[:-1] if len(word) else word
                words, heads = EliasFano.of(word + np.repeat(raised, np.diff(np.append(np.flatnonzero(new), len(word))))), EliasFano.of(heads_at)
            out.append(Level(words, heads, quantised(value), quantised(back)))
        return cls(out, n_words)

    def child(self, k: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Place in level k of each context's (places in level k - 1, rising) child of that word, or -1."""
        level = self.levels[k]
        if not level.words.n or not len(word):
            return np.full(len(word), -1)
        new = np.ones(len(context), bool)
        new[1:] = context[1:] != context[:-1]
        each, size = context[new], np.diff(np.append(np.flatnonzero(new), len(context)))
        a, b = level.heads.at(each), level.heads.at(each + 1)
        raised = np.where(a > 0, level.words.at(np.maximum(a - 1, 0)) + 1, 0)
        at, same = level.words.successor(np.repeat(raised, size) + word)
        return np.where(same & (at < np.repeat(b, size)), at, -1)

    def costs(self, grams: list[Grams]) -> list[np.ndarray]:
        """Of each order's n-grams: the probability's steps, from the trie or, by falling back, from the n-gram's end."""
        place, out = np.arange(self.n_words), [self.levels[0].value.astype(np.int32)]
        for k in range(1, len(self.levels)):
            context, word = place[grams[k].context], grams[k].word
            known = np.flatnonzero(context >= 0)
            place = np.full(len(word), -1)
            for a in range(0, len(known), TOGETHER):
                part = known[a : a + TOGETHER]
                place[part] = self.child(k, context[part], word[part])
            cost = out[-1][grams[k].suffix]
            cost[known] += self.levels[k - 1].back[context[known]]
            there = place >= 0
            cost[there] = self.levels[k].value[place[there]]
            out.append(cost)
        return out

    def arrays(self) -> list[np.ndarray]:
        out = [np.array([self.n_words, len(self.levels)], np.int64)]
        for level in self.levels:
            out += [*(level.words.arrays() + level.heads.arrays() if level.words else []), level.value, level.back]
        return out

    def buffer(self) -> bytes:
        """All levels in one: the arrays' kinds and lengths, then the arrays, each at a multiple of 8."""
        arrays = self.arrays()
        kinds = {"int64": 0, "uint64": 1, "uint32": 2, "uint16": 3}
        head = np.array([len(arrays), *[x for a in arrays for x in (kinds[a.dtype.name], len(a))]], np.int64)
        return head.tobytes() + b"".join(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays)

    @classmethod
    def opened(cls, raw) -> Trie:
        """The trie in a buffer, or in an np.memmap of bytes; nothing is copied."""
        raw = np.frombuffer(raw, np.uint8) if not isinstance(raw, np.ndarray) else raw
        number = int(raw[:8].view(np.int64)[0])
        head, at, arrays = raw[8 : 8 + 16 * number].view(np.int64), 8 + 16 * number, []
        for kind, n in zip(head[::2].tolist(), head[1::2].tolist(), strict=True):
            dtype = np.dtype(("int64", "uint64", "uint32", "uint16")[kind])
            arrays.append(raw[at : at + n * dtype.itemsize].view(dtype))
            at += n * dtype.itemsize + -(n * dtype.itemsize) % 8
        (n_words, n_levels), rest, levels = arrays[0].tolist(), arrays[1:], []
        for k in range(n_levels):
            words = heads = None
            if k:
                words, heads, rest = EliasFano.opened(rest[:4]), EliasFano.opened(rest[4:8]), rest[8:]
            levels.append(Level(words, heads, rest[0], rest[1]))
            rest = rest[2:]
        return cls(levels, n_words)


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-STEPS * log10), 65535).astype(np.uint16)


# --- runs and their n-grams ---


@dataclass
class Grams:
    """A run's different n-grams of one order, sorted by context, then by word."""

    context: np.ndarray  # place of the n-gram without its last word, in the order below
    suffix: np.ndarray  # place of the n-gram without its first word, there
    word: np.ndarray
    key: np.ndarray
    trained: np.ndarray  # how often training texts of the run have it
    tokens: np.ndarray  # the tokens with which one ends
    at: np.ndarray  # which one that is


#: Places within a run: a run's tokens stay far below 2^31.
PLACE = np.int32


def _different(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different values in order, place of each among them), by sorting value and place as one number if that fits."""
    bits = max(1, len(x) - 1).bit_length()
    if int(x.max(initial=0)) >> (63 - bits):
        each, inverse = np.unique(x, return_inverse=True)
        return each, inverse.astype(PLACE)
    x = x << bits
    x |= np.arange(len(x))
    x.sort()
    at = (x & ((1 << bits) - 1)).astype(PLACE)
    x >>= bits
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    inverse = np.empty(len(x), PLACE)
    inverse[at] = np.cumsum(new, dtype=PLACE) - 1
    return x[new], inverse


def key_bits(tokens: int, order: int) -> int:
    """Bits of the keys of n-grams beyond words: so many that of all n-grams one in 2^20 shares its key with another."""
    return min(62, max(24, (max(1, tokens * order) - 1).bit_length() + 20))


def grams_of(words: np.ndarray, codes: np.ndarray, first: np.ndarray, trained: np.ndarray, order: int, bits: int = 62) -> list[Grams]:
    """The n-grams of orders 1 to `order`: words are hashes, codes their places, trained a flag for each text."""
    m, nth = len(words), (np.arange(len(codes)) - np.repeat(first[:-1], np.diff(first))).astype(PLACE)
    learnt = np.repeat(trained, np.diff(first))
    kept = ~U((1 << (64 - bits)) - 1)
    key = lambda h, k: (wordhash.mix(h + U(k)) & (~U(3) if k == 1 else kept)) | U(min(k, 3))  # noqa: E731  the last bits tell orders apart
    every, node, chain = np.arange(m, dtype=PLACE), codes.astype(PLACE), words
    out = [Grams(every, every, every, key(words, 1), np.bincount(codes, learnt, m).astype(np.int64), np.arange(len(codes), dtype=PLACE), node)]
    for k in range(2, order + 1):
        own = np.flatnonzero(nth >= k - 1).astype(PLACE)
        pair = node[own - 1].astype(np.int64)
        pair *= m
        pair += codes[own]
        each, at = _different(pair)
        del pair
        context = (each // max(1, m)).astype(PLACE)
        word = (each - context.astype(np.int64) * m).astype(PLACE)
        one = np.empty(len(each), PLACE)
        one[at] = own  # any token at which it ends
        suffix = node[one]
        chain = wordhash.mix(chain[context] * U(0xD6E8FEB86659FD93) + words[word])
        out.append(Grams(context, suffix, word, key(chain, k), np.bincount(at[learnt[own]], minlength=len(each)), own, at))
        node = np.full(len(codes), -1, PLACE)
        node[own] = at
    return out


def runs(docs: DataFrame, modulus: int = 7, held: int = 2, run_bytes: int = RUN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each run of texts: ids, folds, words and token codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in common.pieces(batch, size=run_bytes):
                buf, offsets = common.buffers(common.as_array(part.column(1)))
                low = wordhash.LOWER[buf]
                start, end, first = wordhash.spans(low, offsets)
                ends = first[1:] + np.arange(part.num_rows)  # one behind each text's words
                hashes = np.empty(len(start) + part.num_rows, np.uint64)
                of_words = np.ones(len(hashes), bool)
                of_words[ends] = False
                hashes[of_words], hashes[ends] = wordhash.span_hashes(low, start, end), END
                coded = pa.array(hashes).dictionary_encode()
                words, codes = coded.dictionary.to_numpy(), coded.indices.to_numpy()
                # frequent words have small codes, which compress
                by = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
                rank = np.empty(len(words), np.int32)
                rank[by] = np.arange(len(words), dtype=np.int32)
                words, codes = words[by], rank[codes]
                ids = part.column(0)
                fold = np.array([-1 if i is None else zlib.crc32(str(i).encode()) % modulus for i in ids.to_pylist()])
                learnt = (fold >= 0) & (fold != held)
                first = first + np.arange(part.num_rows + 1)
                cols = [
                    [at],
                    [len(codes)],
                    [int(np.diff(first)[learnt].sum())],
                    [ids.fill_null(0).to_numpy().tobytes()],
                    [ids.is_null().to_numpy(zero_copy_only=False).tobytes()],
                    [(fold == held).tobytes()],
                    [learnt.tobytes()],
                    [squeezed(first)],
                    [words.tobytes()],
                    [squeezed(codes)],
                ]
                at += 1
                kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [c.split()[0] for c in RUN.split(", ")])

    return common.id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, RUN)


def _opened(row: dict, order: int, bits: int) -> tuple[list[Grams], np.ndarray, np.ndarray]:
    """(n-grams, codes, first) of a run."""
    words, codes, first = np.frombuffer(row["words"], np.uint64), restored(row["codes"], np.int32), restored(row["first"], np.int64)
    return grams_of(words, codes, first, np.frombuffer(row["trained"], bool), order, bits), codes, first


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part's keys begin among sorted ones: parts are ranges of hashes."""
    bounds = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


def totals(of_runs: DataFrame, order: int, parts: int, bits: int) -> DataFrame:
    """(run, part, sums, n_words): how often training texts have each of a run's n-grams, in the order of their keys."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
                run_id, (grams, _, _) = row["run"], _opened(row, order, bits)
                keys, n = np.concatenate([g.key for g in grams]), np.concatenate([g.trained for g in grams])
                del grams, row
                by = np.argsort(keys)
                keys, n = keys[by], n[by]
                cut = _cuts(keys, parts)
                some = [(p, a, b) for p, (a, b) in enumerate(zip(cut.tolist(), cut[1:].tolist(), strict=False)) if a < b]
                gaps = [squeezed(np.diff(keys[a:b], prepend=U(0))) for _, a, b in some]
                cols = [pa.array([run_id] * len(some), pa.int64()), pa.array([p for p, _, _ in some], pa.int64()), pa.array(gaps, pa.binary()), pa.array([squeezed(n[a:b]) for _, a, b in some], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["run", "part", "keys", "n"])

    def summed(group: pa.Table) -> pa.Table:
        keys = [np.cumsum(restored(x.as_buffer(), np.uint64)) for x in group["keys"]]
        n = [restored(x.as_buffer(), np.int64) for x in group["n"]]
        each = np.unique(np.concatenate(keys))
        place = [np.searchsorted(each, x) for x in keys]
        own = np.zeros(len(each), np.int64)
        for at, x in zip(place, n, strict=True):
            np.add.at(own, at, x)
        back = [squeezed(own[at]) for at in place]
        n_words = np.zeros(len(back), np.int64)
        n_words[0] = int(((each & U(3) == U(1)) & (own > 0)).sum())  # each word is in one part
        return pa.table({"run": group["run"], "part": group["part"], "sums": pa.array(back, pa.binary()), "n_words": pa.array(n_words)})

    out = of_runs.select("run", "trained", "first", "words", "codes").mapInArrow(asked, "run long, part long, keys binary, n binary")
    return out.groupBy("part").applyInArrow(summed, "run long, part long, sums binary, n_words long")


def trie_of(grams: list[Grams], n: list[np.ndarray], n_train: int, n_words: int, priors: tuple[float, ...]) -> Trie:
    """The trie of n-grams that the corpus has seen (words: all), with smoothed probabilities."""
    p, levels, place = (n[0] + 1) / (n_train + n_words + 1), [], None
    for k, (g, c) in enumerate(zip(grams, n, strict=True)):
        mu = priors[min(k, len(priors) - 1)]
        if k:
            prior = priors[min(k - 1, len(priors) - 1)]
            p = (c + prior * p[g.suffix]) / (n[k - 1][g.context] + prior)
        seen = c > 0 if k else np.ones(len(c), bool)
        context = place[g.context[seen]] if k else np.zeros(len(c), PLACE)
        levels.append((context, g.word[seen], np.log10(p[seen]), np.log10(mu / (c[seen] + mu))))
        place = np.where(seen, np.cumsum(seen, dtype=PLACE) - 1, -1)
    return Trie.of(levels, len(grams[0].word))


def scored(docs: DataFrame, order: int = 3, priors: tuple[float, ...] = PRIORS, modulus: int = 7, held: int = 2, run_bytes: int = RUN_BYTES, part_keys: int = PART_KEYS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Texts are learnt from unless crc32(id as text) mod `modulus` is `held`.
    """
    own = common.written(runs(docs, modulus, held, run_bytes, id_col, text_col), "text-runs")
    tokens, n_train = own.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_trained"), F.lit(0))).first()
    bits = key_bits(tokens, order)
    sums = common.written(totals(own, order, max(1, -(-tokens * order // part_keys)), bits), "n-gram-sums")
    n_words = sums.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]

    def score(texts: pa.Table, parts: pa.Table) -> pa.Table:
        row = texts.to_pylist()[0]
        grams, codes, first = _opened(row, order, bits)
        parts = parts.sort_by("part")
        keys, n = np.concatenate([g.key for g in grams]), np.empty(sum(len(g.key) for g in grams), np.int64)
        n[np.argsort(keys)] = np.concatenate([restored(x.as_buffer(), np.int64) for x in parts["sums"]])
        n = np.split(n, np.cumsum([len(g.key) for g in grams])[:-1])
        trie = Trie.opened(trie_of(grams, n, n_train, n_words, priors).buffer())
        steps = np.empty(len(codes), np.int64)  # sums of steps
        for g, cost in zip(grams, trie.costs(grams), strict=True):
            steps[g.tokens] = cost[g.at]  # the longest n-gram comes last
        at = first[:-1]  # every text has its end at least
        base = np.log10((n[0] + 1) / (n_train + n_words + 1))
        size = np.diff(first)
        return pa.table(
            {
                "doc_id": pa.array(np.frombuffer(row["ids"], np.int64), mask=np.frombuffer(row["nulls"], bool)),
                "held_out": pa.array(np.frombuffer(row["held"], bool)),
                "n_tokens": pa.array(size),
                "n_known": pa.array(np.add.reduceat((n[0] > 0)[codes].astype(np.int64), at)),
                "train_tokens": pa.array(np.full(len(size), n_train)),
                "base_score": pa.array(np.add.reduceat(base[codes], at)),
                "score": pa.array(-np.add.reduceat(steps, at) / STEPS),
            }
        )

    return own.drop("n_tokens", "n_trained").groupBy("run").cogroup(sums.drop("n_words").groupBy("run")).applyInArrow(score, SCORED)
