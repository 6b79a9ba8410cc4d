"""Substring deduplication with compressed FM-indexes, one per shard of the repeated passages.

A window is `window` consecutive words (maximal runs of bytes other than ASCII white space). Its minimiser, the smallest
hash of its `k`-word grams, depends on its words alone, so equal windows meet in the shard of their minimiser, and a
window whose minimiser occurs once in the corpus is unique. The windows left form segments (neighbouring windows with
one minimiser); equal segments are counted, not repeated. A shard indexes its different segments: suffixes sorted to the
length of the longest pattern, Burrows-Wheeler transform in a wavelet matrix of packed bits with rank counters. Every
segment is then streamed backwards through the index: matching statistics with multiplicities, a mismatch skipping all
windows that hold it, and intervals of at least `window` words come back. Segments of very frequent minimisers are first
cut to windows whose 64-bit hash occurs again, so that a passage that very many documents share brings its own words to
a shard and not each document's context, and are dealt by a second minimiser as well.

Copies (equal word sequences) are searched once; each of their windows starts elsewhere. Texts of fewer than `window`
words lose nothing; null and empty texts have no words. Repeated rows are copies. Words are compared by 64-bit hashes, segments
by 128 bits, copies by SHA-256. Texts are taken whole, however long. An empty table gives no
rows; further columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordhash
from .wordhash import U, ranges

WINDOW, GRAM = 35, 8


class Wavelet:
    """Wavelet matrix of symbols below 2**bits; ranks over packed bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.words, self.counts, self.zeros = bits, [], [], []
        s = symbols.astype(np.int32)
        for b in range(bits - 1, -1, -1):
            bit = np.zeros(len(s) + 64 + (-len(s)) % 64, bool)
            bit[: len(s)] = (s >> b) & 1
            packed = np.packbits(bit, bitorder="little").view(np.uint64)
            bit = bit[: len(s)]
            ones = np.bitwise_count(packed).astype(np.int64)
            self.words.append(packed)
            self.counts.append((np.cumsum(ones) - ones).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            s = np.concatenate([s[~bit], s[bit]])
        self.base = self._down(np.arange(1 << bits), np.zeros(1 << bits, np.int64)) if bits <= 20 else None

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.bits):
            cell = at >> 6
            below = (U(1) << (at & 63).astype(np.uint64)) - U(1)
            ones = self.counts[level][cell] + np.bitwise_count(self.words[level][cell] & below)
            at = np.where((symbol >> (self.bits - 1 - level)) & 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        base = self.base[symbol] if self.base is not None else self._down(symbol, np.zeros(len(at), np.int64))
        return self._down(symbol, at) - base


class FMIndex:
    """Backward search over segments laid end to end with separators; each occurrence counts its segment's weight.

    Symbols and positions are 32 bits, and little else of the text's length lives at a time: an index takes some 40 bytes
    a word while it is built.
    """

    def __init__(self, symbols: np.ndarray, weights: np.ndarray, depth: int):
        n = len(symbols)
        rank = symbols.astype(np.int32)
        width = 1
        while width < depth:  # suffixes by their first `width` symbols, then twice as many
            key = rank * np.int64(n + 1)
            key[: n - width] += rank[width:] + 1
            order = np.argsort(key, kind="stable").astype(np.int32)
            key = key[order]
            new = np.zeros(n, np.int32)
            np.cumsum(key[1:] != key[:-1], out=new[1:])
            del key
            rank = np.empty(n, np.int32)
            rank[order] = new
            width *= 2
            if new[-1] == n - 1:
                break
        del order, new
        suffixes = np.argsort(rank, kind="stable").astype(np.int32)
        del rank
        self.n = n
        self.total = np.append(0, np.cumsum(weights[suffixes]))
        count = np.bincount(symbols)
        self.before = np.cumsum(count) - count
        self.wavelet = Wavelet(symbols[suffixes - 1], max(1, int(symbols.max()).bit_length()))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self.before[symbol]
        return base + both[: len(symbol)], base + both[len(symbol) :]

    def weight(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.total[high] - self.total[low]


def repeated_windows(index: FMIndex, text: np.ndarray, start: np.ndarray, size: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each segment (text[start : start + size]), flags of its windows that occur again; segments end to end.

    A window is read backwards. If the part read so far is unique, all windows that hold it are; the search goes on
    behind its first word. After a hit the rest of the segment is read from its end in one go: where it becomes unique,
    all windows behind are repeated.
    """
    count = size - window + 1
    begin = np.cumsum(count) - count
    flags = np.zeros(int(count.sum()) + 1, np.int64)  # differences
    own = np.arange(len(start))
    i, last = np.zeros(len(own), np.int64), count - 1  # windows still to be told: i to last
    gallop = np.zeros(len(own), bool)
    end = i + window
    p, low, high = end.copy(), np.zeros(len(own), np.int64), np.full(len(own), index.n, np.int64)
    while len(own):
        p = p - 1
        low, high = index.extend(text[start[own] + p], low, high)
        unique = index.weight(low, high) < 2
        stop = unique | (p == i)
        if not stop.any():
            continue
        s = np.flatnonzero(stop)
        u, g, q, o, a, z = unique[s], gallop[s], p[s], own[s], i[s], last[s]
        # forward: a miss rules out the windows up to q, a hit marks the window a
        hit = ~g & ~u
        np.add.at(flags, begin[o[hit]] + a[hit], 1)
        np.add.at(flags, begin[o[hit]] + a[hit] + 1, -1)
        # from the end: what lies behind a unique part, or everything, is repeated
        from_ = np.where(u, q + 1, a)
        mark = g & (from_ <= z)
        np.add.at(flags, begin[o[mark]] + from_[mark], 1)
        np.add.at(flags, begin[o[mark]] + z[mark] + 1, -1)
        i[s] = np.where(g, a, np.where(u, q + 1, a + 1))
        last[s] = np.where(g, np.where(u, np.minimum(q, z - 1), a - 1), z)
        gallop[s] = hit
        e = np.where(hit, last[s] + window, i[s] + window)
        p[s], low[s], high[s] = e, 0, index.n
        going = i <= last
        if not going.all():
            own, i, last, gallop, p, low, high = (x[going] for x in (own, i, last, gallop, p, low, high))
    return np.cumsum(flags[:-1]) > 0


def _sliding(x: np.ndarray, n: int, best) -> np.ndarray:
    """Least or greatest of each n neighbours."""
    width = 1
    while width * 2 <= n:
        x, width = best(x[:-width], x[width:]), width * 2
    return best(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


class Texts:
    """Words, hashes and minimisers of a run of texts."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, window: int, k: int):
        self.buf = buf
        self.start, self.end, self.first = wordhash.spans(buf, offsets)
        self.word = wordhash.span_hashes(buf, self.start, self.end)
        self.size, self.window, self.k = np.diff(self.first), window, k
        n, grams = len(self.word), window - k + 1
        self.count = np.maximum(self.size - window + 1, 0)
        self.at = ranges(self.first[:-1], self.count)  # first words of all windows
        self.text = np.repeat(np.arange(len(self.size)), self.count)
        self.gram = wordhash.grams(self.word, k)
        self.least = np.empty(0, np.uint64)
        if len(self.at):
            self.least = _sliding(self.gram, grams, np.minimum)[self.at]

    def minimisers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text, places) of each text's different grams that are the least of some window."""
        if not len(self.at):
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        grams = self.window - self.k + 1
        top = np.zeros(len(self.gram) + grams, np.uint64)  # by first word of the window, shifted by grams - 1
        top[self.at + grams - 1] = self.least
        most = _sliding(top, grams, np.maximum)[: len(self.gram)]
        where = np.flatnonzero((most == self.gram) & (most != 0))
        h, text = self.gram[where], np.searchsorted(self.first, where, "right") - 1
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        return h[at], text[at], np.diff(np.append(at, len(h)))

    def second(self) -> np.ndarray:
        """Each window's least gram by another hash."""
        if not len(self.at):
            return self.least
        return _sliding(wordhash.mix(self.gram ^ U(0xA0761D6478BD642F)), self.window - self.k + 1, np.minimum)[self.at]

    def member(self, sets: pa.Array) -> np.ndarray:
        """Whether each window's minimiser is in its text's set."""
        offsets, values = sets.offsets.to_numpy().astype(np.int64), sets.values.to_numpy(zero_copy_only=False)
        values = values[offsets[0] : offsets[-1]].astype(np.int64).view(np.uint64)
        salt = lambda t: wordhash.mix(t.astype(np.uint64) + U(41))
        return np.isin(self.least ^ salt(self.text), values ^ salt(np.repeat(np.arange(len(sets)), np.diff(offsets))))


def _scan(docs: DataFrame, window: int, k: int) -> DataFrame:
    """A row per document: digest of its words, their number, digest of them all joined, minimisers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.pieces(batch):
                buf, offsets = common.buffers(common.as_array(part.column(1)))
                t = Texts(buf, offsets, window, k)
                raw, key = buf.tobytes(), []
                s, e = t.start.tolist(), t.end.tolist()
                for a, b in zip(t.first.tolist(), t.first[1:].tolist(), strict=False):
                    key.append(hashlib.sha256(b" ".join(map(raw.__getitem__, map(slice, s[a:b], e[a:b])))).digest())
                h, text, places = t.minimisers()
                cut = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)), pa.int32())
                lists = pa.ListArray.from_arrays(cut, pa.array(h.view(np.int64)))
                times = pa.ListArray.from_arrays(cut, pa.array(places, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(key, pa.binary()), pa.array(t.size, pa.int64()), lists, times], ["doc_id", "rid", "key", "n_words", "least", "places"])

    return docs.mapInArrow(run, "doc_id long, rid binary, key binary, n_words long, least array<bigint>, places array<int>")


def _binary16(x: np.ndarray) -> pa.Array:
    """Values of 16 bytes as a binary column."""
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * 16), pa.py_buffer(np.ascontiguousarray(x))])


def _fixed16(col: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(common.buffers(common.as_array(col))[0].tobytes(), "S16")


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with their texts as (bytes, offsets); column 1 has the compressed texts."""
    at = 0
    for buf, offsets in common.unpacked(batch.column(1)):
        yield batch.slice(at, len(offsets) - 1), buf, offsets
        at += len(offsets) - 1


def _hot_windows(rows: DataFrame, window: int, k: int) -> DataFrame:
    """(rid, pos, h) of the windows with very frequent minimisers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in _unpacked(batch):
                t = Texts(buf, offsets, window, k)
                hot = np.flatnonzero(t.member(part.column(2)))
                h = np.zeros(len(hot), np.uint64)
                for j in range(window):
                    h = h * U(0xD6E8FEB86659FD93) + t.word[t.at[hot] + j]
                rid = part.column(0).take(pa.array(t.text[hot]))
                yield pa.RecordBatch.from_arrays([rid, pa.array(t.at[hot] - t.first[t.text[hot]], pa.int64()), pa.array(wordhash.mix(h).view(np.int64))], ["rid", "pos", "h"])

    return rows.select("rid", "z", "hot").mapInArrow(run, "rid binary, pos long, h long")


def _segments(rows: DataFrame, shards: int, window: int, k: int) -> DataFrame:
    """(rid, start, count, seg, shard, n, words): segments of each document; the words stand with one of each batch's equals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in _unpacked(batch):
                t = Texts(buf, offsets, window, k)
                hot = t.member(part.column(3))
                ok = t.member(part.column(2)) & ~hot
                # windows of one very frequent minimiser are dealt by a second one, so that no shard has them all
                least = np.where(hot, wordhash.mix(t.least ^ t.second()), t.least) if hot.any() else t.least
                pos = part.column(4)
                if len(pos.values):
                    off = pos.offsets.to_numpy().astype(np.int64)
                    text = np.repeat(np.arange(len(pos)), np.diff(off))
                    begin = np.cumsum(t.count) - t.count
                    ok[begin[text] + pos.values.to_numpy()[off[0] : off[-1]]] = True
                w = np.flatnonzero(ok)
                if not len(w):
                    continue
                new = np.ones(len(w), bool)
                new[1:] = (np.diff(w) != 1) | (t.text[w][1:] != t.text[w][:-1]) | (least[w][1:] != least[w][:-1])
                head = np.flatnonzero(new)
                nth = np.arange(len(w)) - head[np.cumsum(new) - 1]
                head = np.flatnonzero(nth % (window - k + 1) == 0)  # no segment has more windows than a gram lies in
                count = np.diff(np.append(head, len(w)))
                at, text, key = t.at[w[head]], t.text[w[head]], least[w[head]]
                size = count + window - 1
                # a segment is known by 128 bits of its words and their order
                h = np.stack(wordhash.digests(t.word, at, size), axis=1).view("S16")[:, 0]
                _, first, again = np.unique(h, return_index=True, return_counts=True)
                n = np.zeros(len(h), np.int64)
                n[first] = again
                words: list = [None] * len(h)
                for j in first.tolist():
                    words[j] = t.word[at[j] : at[j] + size[j]].tobytes()
                cols = [part.column(0).take(pa.array(text)), pa.array(at - t.first[text], pa.int64()), pa.array(count, pa.int64()), _binary16(h), pa.array((key % U(shards)).astype(np.int64)), pa.array(n), pa.array(words, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["rid", "start", "count", "seg", "shard", "n", "words"])

    return rows.select("rid", "z", "repeated", "hot", "good").mapInArrow(run, "rid binary, start long, count long, seg binary, shard long, n long, words binary")


def _searched(segments: DataFrame, window: int, k: int) -> DataFrame:
    """(seg, flags): a bit for each window of each different segment, out of its shard's index."""
    depth = 1 << (2 * window - 1 - k).bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[bytes, int] = {}
        n, parts = [], []  # of each different segment; its words are kept once, whatever number of batches has them
        for batch in batches:
            seg = _fixed16(batch.column(1))
            ids, first, group = np.unique(seg, return_index=True, return_inverse=True)
            again = np.bincount(group, batch.column(2).to_numpy()).astype(np.int64).tolist()
            for key, at, times in zip((x.ljust(16, b"\0") for x in ids.tolist()), first.tolist(), again, strict=True):
                if (i := place.setdefault(key, len(n))) < len(n):
                    n[i] += times
                else:
                    n.append(times)
                    parts.append(np.frombuffer(batch.column(3)[at].as_py(), np.uint64))
        size = np.array([len(x) for x in parts])
        words = np.concatenate(parts)
        del parts
        symbol = np.unique(words, return_inverse=True)[1].astype(np.int32)
        del words
        start = np.cumsum(size + 1) - size - 1
        text = np.ones(int((size + 1).sum()) + 1, np.int32)  # 1 separates, 0 ends
        text[-1] = 0
        text[ranges(start, size)] = symbol + 2
        del symbol
        weight = np.append(np.repeat(np.array(n), size + 1), 0)
        index = FMIndex(text, weight, depth)
        del weight
        flags = repeated_windows(index, text, start, size, window)
        cut = np.append(0, np.cumsum(size - window + 1)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(list(place), pa.binary()), pa.array([np.packbits(flags[a:b]).tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary())], ["seg", "flags"])

    return segments.where("words is not null").select("shard", "seg", "n", "words").groupBy("shard").applyInArrow(run, "seg binary, flags binary")


def _removed(rows: DataFrame, window: int) -> DataFrame:
    """(rid, n_removed, kept_sha256, spans) of documents with repeated windows; spans are word intervals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in _unpacked(batch):
                s, e, first = wordhash.spans(buf, offsets)
                gone = np.zeros(len(s) + 1, np.int64)
                for i, found in enumerate(part.column(2).to_pylist()):
                    for x in found:
                        for j in np.flatnonzero(np.unpackbits(np.frombuffer(x["flags"], np.uint8))[: x["count"]]).tolist():
                            a = first[i] + x["start"] + j
                            gone[a] += 1
                            gone[a + window] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                raw, number, digest, spans = buf.tobytes(), [], [], []
                for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
                    keep = np.flatnonzero(~gone[a:b]) + a
                    number.append(b - a - len(keep))
                    digest.append(hashlib.sha256(b" ".join(map(raw.__getitem__, map(slice, s[keep].tolist(), e[keep].tolist())))).hexdigest())
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b], [0]]).astype(np.int8)))
                    spans.append([{"from": x, "to": y} for x, y in edge.reshape(-1, 2).tolist()])
                kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(number, pa.int64()), pa.array(digest), pa.array(spans, kind)], ["rid", "n_removed", "kept_sha256", "spans"])

    return rows.select("rid", "z", "found").mapInArrow(run, "rid binary, n_removed long, kept_sha256 string, spans array<struct<from:bigint,to:bigint>>")


def deduplicated(docs: DataFrame, window: int = WINDOW, k: int = GRAM, hot: int = 200, shard_bytes: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) of every row; spans (from, to) are the removed word intervals."""
    # texts are known by half of their SHA-256, which stays the same however often and wherever a row is computed
    rid = F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("rid")
    base = common.id_text(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text", rid)
    scan = common.written(_scan(base, window, k), "words")
    # copies meet within tasks before the shuffle; one of them is searched
    copies = scan.where(F.col("n_words") >= window).groupBy("key").agg(F.min("rid").alias("rid"), F.count("*").alias("copies"), F.first("least").alias("least"), F.first("places").alias("places"))
    copies = common.checkpointed(copies)
    grams = copies.select("rid", F.inline(F.arrays_zip("least", "places"))).withColumnRenamed("least", "h")
    # a table of its own, so that a very frequent gram's partition can be split in the join
    repeated = common.checkpointed(grams.groupBy("h").agg(F.sum("places").alias("n")).where("n > 1"))
    sets = grams.join(repeated, "h").groupBy("rid").agg(F.collect_set("h").alias("repeated"), F.collect_set(F.when(F.col("n") > hot, F.col("h"))).alias("hot"))
    texts = common.written(common.packed(base, ["rid"]).join(sets, "rid").groupBy("rid").agg(*[F.first(c).alias(c) for c in ("z", "repeated", "hot")]), "candidates")
    again = common.checkpointed(_hot_windows(texts.where(F.size("hot") > 0), window, k))
    twice = common.checkpointed(again.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    good = again.join(twice, "h").groupBy("rid").agg(F.collect_set("pos").alias("good"))
    none = F.array().cast("array<bigint>")
    rows = texts.join(good, "rid", "left").withColumn("good", F.coalesce("good", none))
    shards = max(1, -(-int(texts.agg(F.sum(F.octet_length("z"))).first()[0] or 0) // shard_bytes))
    segments = common.written(_segments(rows, shards, window, k), "segments")
    found = _searched(segments, window, k).where(F.hex("flags").rlike("[^0]"))
    hits = segments.select("rid", "start", "count", "seg").join(found, "seg").groupBy("rid").agg(F.collect_list(F.struct("start", "count", "flags")).alias("found"))
    cut = _removed(texts.select("rid", "z").join(hits, "rid"), window)
    out = scan.select("doc_id", "key", "n_words").join(copies.select("key", "rid", "copies").join(cut, "rid", "left"), "key", "left")
    whole = F.coalesce(F.col("copies") > 1, F.lit(False))
    all_words = F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("n_words").alias("to")))
    return out.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("key")))).alias("kept_sha256"),
        F.when(whole, all_words).otherwise(F.coalesce("spans", F.slice(all_words, 1, 0))).alias("spans"),
    )
