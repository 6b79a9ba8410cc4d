"""Near-duplicate classes by BagMinHash signatures of weighted word shingles, banding, and exact verification.

A text's multiset has its shingles of five words (letters and digits, ASCII case ignored; a text of fewer words is one
shingle) with their counts. The weight axis is cut at 0, 1, 2, 4, 8 and so on; every shingle has an independent Poisson
process for each piece, its points spread over the unit cells of the piece by successive halving, and each point falls
on one of m signature components. A component is the smallest point, over all shingles, that lies below the shingle's
count; two signatures agree in a component with the probability of the weighted Jaccard similarity. Points are made in
ascending order and only up to a time at which all components are surely filled; a text for which they aren't goes on.

Copies (equal word sequences) are one node. A node is named by a 64-bit digest; a second one beside it tells word
sequences of one name apart, and where it does all but one of them get other names. Nodes that share a band's hash meet in a bucket. In each bucket all members
are compared with a pivot, the member whose buckets hold most nodes; buckets with more than `residue` members left out
of the pivot's class get further pivots, and what is left is compared with every member of another class (small buckets
as pairs that the triangle inequality allows, large ones in blocks over postings), so that no link between classes is
lost and no bucket emits all its pairs. Comparisons are exact multiset overlaps. Classes are the
connected components of the links.

Texts without a word (null, empty) resemble nothing and are classes of their own. Repeated rows are in one class and
count as one document. Classes are named by their smallest doc_id, null if a document without an id is in it.
Texts are taken whole, however long. An empty table has no classes. Only ids and texts are read, so further columns may
have any name; `kept` passes them on as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordhash
from .wordhash import U

WORDS, THRESHOLD, BANDS, ROWS = 5, 0.8, 16, 4


def shingles(buf: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, index of its text), texts in order."""
    low = wordhash.LOWER[buf]
    start, end, first = wordhash.spans(low, offsets, wordhash.NOT_ALNUM)
    h = wordhash.span_hashes(low, start, end)
    count = np.diff(first)
    full = np.maximum(count - n + 1, 0)
    g = wordhash.grams(h, n)
    at = wordhash.ranges(first[:-1], full)
    text = np.repeat(np.arange(len(count)), full)
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):  # the words there are, as one shingle
        whole = np.array([int(wordhash.grams(h[a:b], b - a)[0]) for a, b in zip(first[few].tolist(), first[few + 1].tolist(), strict=True)], np.uint64)
        text = np.concatenate([text, few])
        order = np.argsort(text, kind="stable")
        return np.concatenate([g[at], whole])[order], text[order]
    return g[at], text


def counted(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, text, count) of the different shingles of each text; texts ascending, then shingles."""
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return h[at], text[at], np.diff(np.append(at, len(h)))


def _uniform(bits: np.ndarray) -> np.ndarray:
    return ((bits >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(h: np.ndarray, text: np.ndarray, count: np.ndarray, texts: int, m: int) -> np.ndarray:
    """Component values (texts x m; infinite for texts without shingles) from different shingles with counts."""
    out = np.full((texts, m), np.inf)
    if not len(h):
        return out
    weight = np.bincount(text, count, texts)
    until = np.where(weight > 0, (np.log(m) + 5) / np.maximum(weight, 1), 0.0)
    open_texts = weight > 0
    done = np.zeros(texts)  # points up to this time are in
    while open_texts.any():
        keep = open_texts[text]
        _points(h[keep], text[keep], count[keep], until, done, m, out)
        open_texts &= np.isinf(out).any(1)
        done, until = until.copy(), np.where(open_texts, until * 2, until)
    return out


def _points(h: np.ndarray, text: np.ndarray, count: np.ndarray, until: np.ndarray, done: np.ndarray, m: int, out: np.ndarray) -> None:
    """Puts the points of all processes up to each text's time into the components."""
    level, flat = 0, out.reshape(-1)
    alive = np.arange(len(h))
    while len(alive):
        low, width = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
        rate = float(width)  # of each component times m components, in units in which a component has rate `width`
        state = wordhash.mix(h[alive] + U((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64)))
        time, own, step = np.zeros(len(alive)), alive, 0
        while len(own):
            step += 1
            draw = wordhash.mix(state + U((0xD1B54A32D192ED03 * step) % (1 << 64)))
            time = time - np.log(_uniform(draw)) / (rate * m)
            stay = time <= until[text[own]]
            own, state, time = own[stay], state[stay], time[stay]
            if not len(own):
                break
            second = wordhash.mix(draw[stay] ^ U(0xA0761D6478BD642F))
            component = (second >> U(40)).astype(np.int64) % m
            cell = low + (second & U(width - 1)).astype(np.int64)  # the halving's binary digits
            hit = (cell < count[own]) & (time > done[text[own]])
            np.minimum.at(flat, text[own][hit] * m + component[hit], time[hit])
        level += 1
        alive = alive[count[alive] > (1 << (level - 1))]


def bands(values: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Hash of each band's values (texts x bands)."""
    bits = wordhash.mix(values.view(np.uint64)).reshape(len(values), bands, rows)
    acc = np.zeros((len(values), bands), np.uint64)
    for j in range(rows):
        acc = wordhash.mix(acc * U(0xD6E8FEB86659FD93) + bits[:, :, j])
    return acc


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (shingles ascending, counts)."""
    i = np.searchsorted(b[0], a[0])
    i[i == len(b[0])] = 0
    same = b[0][i] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    both = np.minimum(a[1][same], b[1][i[same]]).sum()
    return float(both / max(1, a[1].sum() + b[1].sum() - both))


def _signed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, node, check, bands) of every row: two 64-bit digests of its word sequence, null without words; th: hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.pieces(batch):
                n = part.num_rows
                buf, offsets = common.buffers(common.as_array(part.column(1)))
                low = wordhash.LOWER[buf]
                start, end, first = wordhash.spans(low, offsets, wordhash.NOT_ALNUM)
                w, size = wordhash.span_hashes(low, start, end), np.diff(first)
                node, check = (pa.array(x.view(np.int64), mask=size == 0) for x in wordhash.digests(w, first[:-1], size))
                h, text, count = counted(*shingles(buf, offsets))
                got = bands(signatures(h, text, count, n, BANDS * ROWS)).astype(np.int64).reshape(-1)
                cut = pa.array(np.arange(n + 1) * BANDS, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), node, check, pa.ListArray.from_arrays(cut, pa.array(got))], ["doc_id", "th", "node", "check", "bands"])

    return docs.mapInArrow(run, "doc_id long, th long, node long, check long, bands array<bigint>")


def _multisets(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(different shingles ascending, counts) of each compressed text, unpacked a run of bounded bytes at a time."""
    out = []
    for buf, offsets in common.unpacked(texts):
        h, text, count = counted(*shingles(buf, offsets))
        cut = np.searchsorted(text, np.arange(len(offsets)))
        # copies, so that no result holds the arrays of its whole run
        out += [(h[a:b].copy(), count[a:b].copy()) for a, b in zip(cut, cut[1:], strict=False)]
    return out


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs of nodes, exact; the texts (node, z) are joined to both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.packed_pieces(batch, "z_a", "z_b"):
                # a node that stands in many pairs of the run is unpacked once
                nodes = np.concatenate([part.column(0).to_numpy(), part.column(1).to_numpy()])
                _, one, each = np.unique(nodes, return_index=True, return_inverse=True)
                both = pa.concat_arrays([part.column(2), part.column(3)])
                sets = _multisets(both.take(pa.array(one)))
                out = [overlap(sets[i], sets[j]) for i, j in zip(each[: part.num_rows].tolist(), each[part.num_rows :].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.float64())], ["a", "b", "similarity"])

    a = texts.select(F.col("node").alias("a"), F.col("z").alias("z_a"))
    b = texts.select(F.col("node").alias("b"), F.col("z").alias("z_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "z_a", "z_b").mapInArrow(run, "a long, b long, similarity double")


def compact(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """A checkpoint of the rows, in partitions of about so many; small tables then make few tasks and few shuffle files."""
    out = common.checkpointed(df)
    return out.coalesce(max(1, -(-out.count() // rows)))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes in links (a, b): the smallest node each one is connected with.

    Alternates stars: neighbours larger than a node hang onto its smallest neighbour, then smaller ones do. The number
    of rounds grows with the logarithm of the longest path. A hub's edges meet in sums or in joins that can be split.
    """
    edges = compact(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    digest = lambda x: tuple(x.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first())
    before = digest(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = compact(small)
        # at the end edges are stars: every node but the root has one edge, to its root
        after = digest(edges)
        if before == after:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        before = after


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _searched(queries: DataFrame, members: DataFrame, texts: DataFrame, threshold: float, block: int = 1024) -> DataFrame:
    """Links (a, b) of left-out members of large buckets to members of other classes: exact, in blocks, without pairs as rows.

    A task gets a block of a bucket's members and a block of its queries, adds up overlaps over the members' postings of
    a query's shingles, and gives one link for each query and class.
    """
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    spread = lambda n: F.pmod(F.xxhash64("node"), blocks(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    keys = ["bucket", "part", "block"]
    fresh = lambda: [F.col(c).alias(c) for c in (*keys, "node", "root", "z")]  # noqa: E731  both sides come from the same tables
    left = queries.select("bucket", "node", "root", spread("n_left").alias("part"), all_of("n").alias("block")).join(texts, "node").select(*fresh())
    right = members.select("bucket", "node", "root", spread("n").alias("block"), all_of("n_left").alias("part")).join(texts, "node").select(*fresh())

    def multisets(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shingle, row, count), rows in order."""
        sets = _multisets(common.as_array(t["z"]))
        row = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
        return np.concatenate([h for h, _ in sets]), row, np.concatenate([n for _, n in sets])

    def run(q: pa.Table, x: pa.Table) -> pa.Table:
        out = []
        if q.num_rows and x.num_rows:
            h, member, count = multisets(x)
            weight = np.bincount(member, count, x.num_rows)
            order = np.argsort(h, kind="stable")
            h, member, count = h[order], member[order], count[order]
            node, root = x["node"].to_numpy(), x["root"].to_numpy()
            hq, of, cq = multisets(q)
            cut = np.searchsorted(of, np.arange(q.num_rows + 1))
            for i, (a, b) in enumerate(zip(q["node"].to_pylist(), q["root"].to_pylist(), strict=True)):
                own, n = hq[cut[i] : cut[i + 1]], cq[cut[i] : cut[i + 1]]
                low = np.searchsorted(h, own, "left")
                size = np.searchsorted(h, own, "right") - low
                at = wordhash.ranges(low, size)
                both = np.bincount(member[at], np.minimum(count[at], np.repeat(n, size)), x.num_rows)
                hits = np.flatnonzero((both >= threshold * (weight + n.sum() - both)) & (root != b))
                _, one = np.unique(root[hits], return_index=True)
                out += [(min(a, c), max(a, c)) for c in node[hits[one]].tolist()]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "a long, b long")


def linked(nodes: DataFrame, source: DataFrame, threshold: float = THRESHOLD, residue: int = 32, rounds: int = 3) -> DataFrame:
    """(node, root) of all nodes that have similar ones among those that share a bucket.

    nodes: (node, doc_id, th, bands); source: (doc_id, th, z), the texts compressed. The weighted Jaccard distance is a metric, so that two
    members of a bucket whose distances to its first pivot differ by more than 1 - threshold can't be similar.
    """
    spread = nodes.select("node", F.posexplode("bands").alias("band", "hash")).select("node", F.xxhash64("band", "hash").alias("bucket"))
    # sizes are a table of their own here and below, so that a large bucket's partition can be split in the join
    size = compact(spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), 500_000)
    shared = compact(spread.join(size, "bucket"))
    weight = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    members = compact(shared.join(weight, "node").select("bucket", "node", "weight"))
    wanted = nodes.join(members.select("node").distinct(), "node").select("node", "doc_id", "th")
    # a null id is an id like any other
    wanted = wanted.select("node", F.col("doc_id").alias("_id"), F.col("th").alias("_th"))
    texts = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).groupBy("node").agg(F.first("z").alias("z"))
    texts = common.written(texts, "node-texts")
    left, tried, first = members, None, None
    for k in range(rounds):
        top = left.groupBy("bucket").agg(F.max(F.struct("weight", "node")).alias("top"), F.count("*").alias("n"))
        pivot = compact(top.where("n > 1" if k == 0 else f"n > {residue}").select("bucket", F.col("top.node").alias("pivot")))
        if k and pivot.isEmpty():
            break
        pairs = members.join(pivot, "bucket").where("node <> pivot").select(*_pair("node", "pivot")).distinct()
        new = compact(_compared(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), texts))
        tried = new if tried is None else tried.union(new)
        with_pivot = left.join(pivot, "bucket").select("*", *_pair("node", "pivot")).join(tried, ["a", "b"], "left")
        # a pivot is like itself; every other member was compared
        known = F.when(F.col("node") == F.col("pivot"), 1.0).when(F.col("similarity").isNotNull(), F.col("similarity")).otherwise(F.raise_error(F.concat(F.lit("no similarity of node "), F.col("node").cast("string"))).cast("double"))
        with_pivot = with_pivot.withColumn("similarity", known)
        if first is None:
            first = compact(with_pivot.select("bucket", "node", "weight", "pivot", "similarity"))
            left = first.where(F.col("similarity") < threshold).select("bucket", "node", "weight")
        else:
            left = compact(with_pivot.where(F.col("similarity") < threshold).select("bucket", "node", "weight"))
    root = components(tried.where(F.col("similarity") >= threshold))
    # what isn't similar to its bucket's first pivot meets every member of another class
    open_buckets = compact(first.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(F.col("similarity") < threshold).alias("n_left")).where("n_left > 0"))
    base = first.join(open_buckets, "bucket").join(root, "node", "left")
    base = compact(base.select("bucket", "node", F.coalesce("root", "node").alias("root"), "similarity", "n", "n_left"))
    out = base.where(F.col("similarity") < threshold)
    one = out.where(f"n <= {2 * residue}").select("bucket", F.col("node").alias("one"), F.col("root").alias("one_root"), F.col("similarity").alias("one_similarity"))
    near = F.abs(F.col("similarity") - F.col("one_similarity")) <= F.lit(1 - threshold + 1e-9)
    rest = base.join(one, "bucket").where((F.col("root") != F.col("one_root")) & near)
    rest = rest.select(*_pair("node", "one")).distinct().join(tried, ["a", "b"], "left_anti")
    found = _compared(rest, texts).where(F.col("similarity") >= threshold).select("a", "b")
    last = compact(found.union(_searched(out.where(f"n > {2 * residue}"), base.where(f"n > {2 * residue}"), texts, threshold)))
    if last.isEmpty():
        return root
    return components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).union(last.select("a", "b")))


def _renamed(nodes: DataFrame) -> DataFrame:
    """Nodes (node, check, ...) with names of their own where different word sequences share one."""
    shared = compact(nodes.groupBy("node").agg(F.min("check").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"))
    if shared.isEmpty():
        return nodes.withColumn("name", F.col("node"))
    other = F.when(F.col("check") > F.col("least"), F.xxhash64("node", "check")).otherwise(F.col("node"))
    return nodes.join(shared, "node", "left").withColumn("name", other).drop("least")


def _named(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows (doc_id, th, node, check), classes (node, check, class_id, class_th)): a class's document is its smallest (doc_id, th)."""
    source = common.id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("th", F.xxhash64("text"))
    rows = common.written(_signed(source.select("doc_id", "text", "th")), "signatures")
    # copies meet within tasks before the shuffle
    node = rows.where("node is not null").groupBy("node", "check").agg(F.min(F.struct("doc_id", "th")).alias("own"), F.first("bands").alias("bands"))
    node = compact(_renamed(compact(node)).select("node", "check", "name", "own", "bands"))
    packed = common.packed(source.where(F.col("text") != ""), ["doc_id", "th"])
    root = linked(node.select(F.col("name").alias("node"), "own.doc_id", "own.th", "bands"), packed, threshold)
    named = node.join(root.withColumnRenamed("node", "name"), "name", "left").select("node", "check", F.coalesce("root", "name").alias("root"), "own")
    head = compact(named.groupBy("root").agg(F.min("own").alias("head")))
    return rows.select("doc_id", "th", "node", "check"), compact(named.join(head, "root").select("node", "check", F.col("head.doc_id").alias("class_id"), F.col("head.th").alias("class_th")))


def classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id): one row per row of docs."""
    rows, named = _named(docs, threshold, id_col, text_col)
    return rows.join(named, ["node", "check"], "left").select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def kept(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, all columns; rows without words all stay, but for repeated rows."""
    rows, named = _named(docs, threshold, id_col, text_col)
    heads = named.select(F.col("class_id").alias("_id"), F.col("class_th").alias("_th")).union(rows.where("node is null").select("doc_id", "th")).distinct()
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).cast("long").alias("_i"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_t"))
    stay = packed.join(heads, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_th")), "left_semi")
    return stay.groupBy("_i", "_t").agg(F.first("_row").alias("_row")).select("_row.*")
