"""Ranked lexical search: document-sharded CSR postings with precomputed integer impacts.

A shard is a run of documents of one task: its terms, and for each term the documents that hold it with their impacts.
An impact is what an occurrence count is worth in a document of that length, (10^9 tf) div (1000 tf + 8 m); a term's
weight depends on the queries' terms alone and multiplies a whole posting list. Two passes over the texts build the
index: the first counts documents and terms, which lengths are measured by, the second writes the shards.

Searching goes through a shard term at a time, into one dense accumulator of its documents for each query; a partition
finds the k-th best score, and of equal scores there those of smallest ids are taken, as documents of a shard stand in
the order of ids. Queries are broadcast in blocks of at most BLOCK_BYTES of terms; a sixteenth of the shards is searched
first and gives each query the score that others have to reach; each task keeps k documents a query, and these are merged.

Terms are maximal runs of letters and digits of ASCII and of all code points beyond it, A-Z in lower case. Texts that are
null or have no term count for nothing and are never found; so do queries without terms, or with none that a document
has. Repeated rows are documents of their own, and repeated items queries of their own; a row without an id comes last
among ties. Texts are taken whole, however long: one longer than a shard is a shard. Empty tables give no rows, further
columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, maxscore, wordhash

#: Bytes of text of a shard, and of terms of the queries that are broadcast together.
SHARD_BYTES, BLOCK_BYTES = 1 << 23, 1 << 24
SHARD = "wave int, n int, ids binary, nulls binary, words binary, cuts binary, heads binary, docs binary, impacts binary"
QUERY = "item_id long, words binary, cuts binary, counts binary"
FOUND = "qrow long, item_id long, doc_id long, score long"


def terms_of(text: pa.Array) -> tuple[pa.LargeStringArray, np.ndarray]:
    """(terms of all texts one after another, index of each text's first term (n + 1 long))."""
    buf, offsets = common.buffers(text)
    start, end, first = wordhash.spans(buf, offsets, wordhash.NOT_ALNUM)
    letters = wordhash.LOWER[buf[~wordhash.NOT_ALNUM[buf]]]
    return strings(letters, np.append(0, np.cumsum(end - start))), first


def strings(letters: np.ndarray, cuts: np.ndarray) -> pa.LargeStringArray:
    return pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), pa.py_buffer(np.ascontiguousarray(letters, np.uint8))])


def _counts(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, all their terms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            for part in common.pieces(batch):
                buf, offsets = common.buffers(common.as_array(part.column(1)))
                size = np.diff(wordhash.spans(buf, offsets, wordhash.NOT_ALNUM)[2])
                n, total = n + int((size > 0).sum()), total + int(size.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "total"])

    got = docs.mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return got[0] or 0, got[1] or 0


def impacts(tf: np.ndarray, size: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What `tf` occurrences are worth in a document of `size` terms."""
    if int(size.max(initial=0)) * 75 * n_docs < 1 << 63:
        long = (75 * size * n_docs) // n_terms
    else:
        long = np.array([(75 * s * n_docs) // n_terms for s in size.tolist()], np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * (25 + long))


@dataclass
class Index:
    shards: DataFrame
    n_docs: int


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> Index:
    """The index of all documents, written to the shared folder without a shuffle."""
    docs = common.id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    n_docs, n_terms = _counts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 20
        for batch in batches:
            for part in common.pieces(batch, size=shard_bytes):
                at += 1
                none = part.column(0).is_null().to_numpy(zero_copy_only=False)
                ids = part.column(0).fill_null(0).to_numpy()
                order = np.lexsort((ids, none))  # documents stand in the order of ties
                terms, first = terms_of(common.as_array(part.column(1).take(pa.array(order))))
                if not len(terms):
                    continue
                coded = terms.dictionary_encode()
                words, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
                size, n = np.diff(first), len(ids)
                held, tf = np.unique(code * n + np.repeat(np.arange(n), size), return_counts=True)
                code, doc = held // n, held % n
                letters, cuts = common.buffers(words)
                cols = [
                    [int(wordhash.mix(np.array([at], np.uint64))[0] % np.uint64(16) > 0)],
                    [n],
                    [ids[order].tobytes()],
                    [none[order].tobytes()],
                    [letters.tobytes()],
                    [cuts.tobytes()],
                    [np.searchsorted(code, np.arange(len(words) + 1)).tobytes()],
                    [doc.astype(np.int32).tobytes()],
                    [impacts(tf.astype(np.int64), size[doc], n_docs, n_terms).astype(np.int32).tobytes()],
                ]
                kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [c.split()[0] for c in SHARD.split(", ")])

    return Index(common.written(docs.mapInArrow(run, SHARD), "lexical-shards", "wave"), n_docs)


def _queries(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(qrow, item_id, its different terms, their numbers), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, first = terms_of(common.as_array(batch.column(1)))
            cols: list[list] = [[], [], []]
            for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
                own = terms.slice(a, b - a).value_counts()
                letters, cuts = common.buffers(own.field("values"))
                for col, x in zip(cols, (letters, cuts, own.field("counts").to_numpy()), strict=True):
                    col.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.binary()) for c in cols]], ["item_id", "words", "cuts", "counts"])

    own = items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, QUERY)
    return common.written(own.where("octet_length(words) > 0").withColumn("qrow", F.monotonically_increasing_id()), "lexical-queries")


class Block:
    """Queries that are broadcast together: their terms once each, and each query's terms with their numbers."""

    def __init__(self, rows: pa.Table):
        self.qrow, self.items = rows["qrow"].to_numpy(), rows["item_id"].fill_null(0).to_numpy()
        self.none = rows["item_id"].is_null().to_numpy()
        own = [strings(np.frombuffer(w.as_buffer(), np.uint8), np.frombuffer(c.as_buffer(), np.int64)) for w, c in zip(rows["words"], rows["cuts"], strict=True)]
        coded = pa.concat_arrays(own).dictionary_encode()
        self.words, self.term = coded.dictionary, coded.indices.to_numpy()
        self.count = np.concatenate([np.frombuffer(c.as_buffer(), np.int64) for c in rows["counts"]])
        self.first = np.append(0, np.cumsum([len(x) for x in own]))
        self.weight = np.zeros(len(self.words), np.int64)

    def places(self, words: pa.LargeStringArray) -> np.ndarray:
        """Each of the block's terms' place among a shard's, or -1."""
        return pc.index_in(self.words, value_set=words).fill_null(-1).to_numpy()


def _shard_words(batch: pa.RecordBatch, i: int, words: int) -> tuple[pa.LargeStringArray, np.ndarray]:
    letters, cuts, heads = (batch.column(words + k)[i].as_buffer() for k in range(3))
    return strings(np.frombuffer(letters, np.uint8), np.frombuffer(cuts, np.int64)), np.frombuffer(heads, np.int64)


def _document_counts(shards: DataFrame, block: Block) -> np.ndarray:
    """In how many documents each of the block's terms stands; tasks sum what they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(block.words), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                words, heads = _shard_words(batch, i, 0)
                at = block.places(words)
                there = at >= 0
                df[there] += heads[at[there] + 1] - heads[at[there]]
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[term])], ["term", "df"])

    out = np.zeros(len(block.words), np.int64)
    got = shards.select("words", "cuts", "heads").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a number for each of the block's terms
    out[got["term"].to_numpy()] = got["df"].to_numpy()
    return out


def top(acc: np.ndarray, k: int, least: int) -> np.ndarray:
    """Places of the k highest scores of at least `least` (and above 0), of equal ones the first."""
    if len(acc) > k:
        least = max(least, int(acc[np.argpartition(acc, len(acc) - k)[len(acc) - k :]].min()))
    least = max(1, least)
    above, equal = np.flatnonzero(acc > least), np.flatnonzero(acc == least)
    return np.append(above, equal[: max(0, k - len(above))])


def _search(shards: DataFrame, block: Block, floor: np.ndarray, k: int) -> DataFrame:
    """Each task's k best documents for each query of the block, if they reach the query's floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = floor.copy()
        who, score, none, ids = (np.empty(0, t) for t in (np.int64, np.int64, bool, np.int64))
        for batch in batches:
            for i in range(batch.num_rows):
                n, own_ids, own_none, _, _, _, docs, worth = (batch.column(c)[i].as_py() for c in range(8))
                own_ids, own_none = np.frombuffer(own_ids, np.int64), np.frombuffer(own_none, bool)
                docs, worth = np.frombuffer(docs, np.int32), np.frombuffer(worth, np.int32)
                words, heads = _shard_words(batch, i, 3)
                at, fresh = block.places(words)[block.term], []
                weight = block.weight[block.term] * block.count
                acc = np.empty(n, np.int64)
                for q, (a, b) in enumerate(zip(block.first.tolist(), block.first[1:].tolist(), strict=False)):
                    acc[:] = 0
                    for t in (np.flatnonzero((at[a:b] >= 0) & (weight[a:b] > 0)) + a).tolist():
                        x = slice(heads[at[t]], heads[at[t] + 1])
                        acc[docs[x]] += weight[t] * worth[x]  # a document stands once in a list
                    fresh.append((best := top(acc, k, int(least[q])), acc[best]))
                size = [len(p) for p, _ in fresh]
                who = np.append(who, np.repeat(np.arange(len(size)), size))
                place = np.concatenate([p for p, _ in fresh])
                score, none, ids = np.append(score, np.concatenate([s for _, s in fresh])), np.append(none, own_none[place]), np.append(ids, own_ids[place])
                order = np.empty(len(who), np.int64)
                order[by := np.lexsort((ids, none))] = np.arange(len(who))
                who, order, score = maxscore.best(who, order, score, k)
                none, ids = none[by][order], ids[by][order]
                full = np.flatnonzero(np.bincount(who, minlength=len(least)) >= k)
                least[full] = np.maximum(least[full], score[np.searchsorted(who, full, "right") - 1])
        if len(who):
            yield pa.RecordBatch.from_arrays([pa.array(block.qrow[who]), pa.array(block.items[who], mask=block.none[who]), pa.array(ids, mask=none), pa.array(score)], ["qrow", "item_id", "doc_id", "score"])

    return shards.select("n", "ids", "nulls", "words", "cuts", "heads", "docs", "impacts").mapInArrow(run, FOUND)


def search(index: Index, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    queries = _queries(items, id_col, text_col)
    size = queries.agg(F.coalesce(F.sum(F.octet_length("words") + F.octet_length("cuts") + F.octet_length("counts") + 32), F.lit(0))).first()[0]
    blocks = -(-size // block_bytes)
    order = Window.partitionBy("qrow").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    found = queries.sparkSession.createDataFrame([], FOUND)
    for number in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("qrow"), F.lit(blocks)) == number).toArrow()
        if not rows.num_rows:
            continue
        block = Block(rows)
        df = _document_counts(index.shards, block)
        block.weight[:] = [math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()]
        floor = np.zeros(rows.num_rows, np.int64)
        first = common.checkpointed(_search(index.shards.where("wave = 0"), block, floor, k))
        kth = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("qrow", "score").toArrow()  # a number for each query of the block
        place = {r: i for i, r in enumerate(block.qrow.tolist())}
        for r, s in zip(kth["qrow"].to_pylist(), kth["score"].to_pylist(), strict=True):
            floor[place[r]] = s
        found = found.union(first).union(_search(index.shards.where("wave = 1"), block, floor, k))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
