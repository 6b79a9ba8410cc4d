"""Ranks, token budgets, bands, samples and splits by running sums."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.text import let
from sluice.sources.storage import checkpointed

from .filters import is_usable, token_weight
from .prefix import SINGLE_TASK_ROWS, accumulated, lagged


def seeded(seed: int | str, *keys: str) -> Column:
    """A pseudo-random order that any engine can compute: MD5 of seed and keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def sha_order(*keys: str) -> Column:
    return F.sha2(F.concat_ws(":", *[F.col(k).cast("string") for k in keys]), 256)


def difficulty_rank(df: DataFrame, metric: str, key: str = "id", easy_is_high: bool = False, rank: str = "rank") -> DataFrame:
    """Rank from 0 (easy) over usable values; ties by key, ascending in both directions."""
    usable = df.where(is_usable(F.col(metric)))
    order = F.desc(metric) if easy_is_high else F.asc(metric)
    return accumulated(usable, [order, key]).withColumn(rank, F.col("rn") - 1).drop("rn", "incl", "excl", "total")


def middle_mass(df: DataFrame, score: str, tokens: str, key: str = "id", keep: float = 0.6) -> DataFrame:
    """Documents whose middle token lies in the middle `keep` share of all tokens in the order of scores."""
    usable = df.where(is_usable(F.col(score)) & (F.col(tokens) > 0))
    tail, mid = (1 - keep) / 2, F.col("incl") - F.col(tokens) / 2
    run = accumulated(usable, [score, key], tokens)
    return run.where((mid >= tail * F.col("total")) & (mid < (1 - tail) * F.col("total"))).drop("rn", "excl", "total")


def top_fraction(df: DataFrame, score: str, tokens: str | tuple[str, ...], key: str = "id", keep: float = 0.6, low_first: bool = False) -> DataFrame:
    """Best documents until their tokens reach ceil(total x keep); the one that crosses it is kept."""
    names = (tokens,) if isinstance(tokens, str) else tokens
    usable = df.where(is_usable(F.col(score))).withColumn("_w", token_weight(*[F.col(t) for t in names])).where("_w > 0")
    run = accumulated(usable, [F.asc(score) if low_first else F.desc(score), key], "_w")
    return run.where(F.col("excl") < F.ceil(F.col("total") * keep)).drop("rn", "total", "_w")


def fill_budget(df: DataFrame, tokens: str, budget: Column | float, order: list, by: list[str] | None = None, keep: Column | None = None, over: float = 1.02) -> DataFrame:
    """Documents in order until the budget is reached, without the last one if it goes beyond `over` times it."""
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    run = accumulated(df if keep is None else df.where(keep), order, tokens, by)
    return run.where((F.col("excl") < budget) & (F.col("incl") <= over * budget)).drop("total")


def trim_budget(df: DataFrame, tokens: str, budget: int, order: list[str], by: list[str]) -> DataFrame:
    """All documents until floor(.98 budget); from there those are skipped that would go beyond floor(1.02 budget).

    The head is a running sum. What comes behind it is gone through in a task for each group, by jumps from one document that
    is skipped to the next. As long as the budget
    isn't reached, every document of at most 1.02 - 1 budgets is taken; so the fold gets no rows from where these alone
    have reached it.
    """
    low, high = int(budget * 0.98), int(budget * 1.02)
    names = df.columns
    run = accumulated(df, order, tokens, by)
    head = run.where(F.col("excl") < low)
    base = head.groupBy(*by).agg(F.sum(tokens).alias("_kept")).withColumnsRenamed({b: f"_b_{b}" for b in by})
    same = reduce(lambda x, b: x & F.col(b).eqNullSafe(F.col(f"_b_{b}")), by, F.lit(True))  # a null is a group like any other
    kept = F.coalesce("_kept", F.lit(0))
    # a document of n tokens can only be kept while n <= high - kept, and kept is at least the head's sum
    tail = run.where(F.col("excl") >= low).join(base, same, "left").where((kept < budget) & (F.col(tokens) + kept <= high))
    sure = F.when(F.col(tokens) <= high - budget, F.col(tokens)).otherwise(0)
    tail = accumulated(tail.select(*names, kept.alias("_kept"), F.col("rn").alias("_rn"), sure.alias("_sure")), ["_rn"], "_sure", by)
    tail = tail.where(F.col("excl") < budget - F.col("_kept")).select(*names, "_kept", "_rn")
    n_at, k_at, by_at = names.index(tokens), len(names), [names.index(b) for b in by]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kept = object(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            n, first = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (n_at, k_at))
            new = np.zeros(batch.num_rows, bool)
            for i in by_at:
                code = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            take = np.zeros(batch.num_rows, bool)
            for a, b in itertools.pairwise([0, *np.flatnonzero(new), batch.num_rows]):
                if (own := tuple(batch.column(i)[a].as_py() for i in by_at)) != group:
                    group, kept = own, int(first[a])
                total, at = np.append(0, np.cumsum(n[a:b])), 0
                while at < b - a and kept < budget:  # from document to document that is skipped
                    fits = int(np.searchsorted(total, total[at] + high - kept, "right")) - 1
                    to = min(fits, int(np.searchsorted(total, total[at] + budget - kept, "left")), b - a)
                    take[a + at : a + to] = True
                    kept, at = kept + int(total[to] - total[at]), to + 1
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(take)).columns[: len(names)], names)

    rest = tail.repartition(*by).sortWithinPartitions(*by, "_rn").mapInArrow(fold, df.schema)
    return head.select(*names).unionByName(rest)


def upsample_budget(df: DataFrame, tokens: str, budget: int, key: str, by: list[str], cycles: int, seed: int = 42) -> DataFrame:
    """As trim_budget over `cycles` differently shuffled copies of the group."""
    copies = df.withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(cycles - 1))))
    copies = copies.withColumn("_order", F.concat(F.format_string("%06d", "cycle"), seeded(seed, "cycle", key)))
    return trim_budget(copies, tokens, budget, ["_order", key], by).drop("_order")


def equal_buckets(df: DataFrame, order: list, n: int = 10, by: list[str] | None = None) -> DataFrame:
    """Bucket from 0 of nearly equal counts, the first ones larger by one."""
    run = accumulated(df, order, None, by)
    base, rem = F.floor(F.col("total") / n), F.col("total") % n
    i = F.col("rn") - 1
    edge = rem * (base + 1)
    bucket = F.when(i < edge, F.floor(i / (base + 1))).otherwise(rem + F.floor((i - edge) / F.greatest(base, F.lit(1))))
    return run.withColumn("bucket", bucket.cast("int")).drop("rn", "incl", "excl", "total")


def work_chunks(df: DataFrame, key: str, tokens_per_doc: str, target: int, min_docs: int, by: list[str]) -> DataFrame:
    """Chunk number of each document: as many documents as reach the target tokens, `min_docs` at least."""
    per = F.greatest(F.lit(min_docs), F.floor(F.lit(target) / F.greatest(F.col(tokens_per_doc), F.lit(1))))
    return accumulated(df, [key], None, by).withColumn("chunk", F.floor((F.col("rn") - 1) / per).cast("int")).drop("rn", "incl", "excl", "total")


def curriculum(df: DataFrame, metric: str, key: str = "id", fraction: float = 1.0, limit: int | None = None, descending: bool = False, shard: int | None = None) -> DataFrame:
    """The first max(1, floor(n fraction)) documents by metric, at most `limit`; with shard numbers if asked for."""
    run = accumulated(df.where(is_usable(F.col(metric))), [F.desc(metric) if descending else F.asc(metric), key])
    out = run.where(F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("total") * fraction)))
    out = out if limit is None else out.where(F.col("rn") <= limit)
    out = out if shard is None else out.withColumn("shard", F.floor((F.col("rn") - 1) / shard))
    return out.withColumn("rank", F.col("rn") - 1).drop("rn", "incl", "excl", "total")


def source_offsets(shards: DataFrame, by: str = "source", order: str = "path", tokens: str = "n_tokens") -> DataFrame:
    """Start of each shard in its source's stream."""
    return accumulated(shards, [order], tokens, [by]).withColumn("start", F.col("excl")).drop("rn", "incl", "excl", "total")


def offset_gaps(shards: DataFrame, by: str = "source", start: str = "start", tokens: str = "n_tokens") -> DataFrame:
    """Shards that don't start where the one before ends; empty if offsets are contiguous from 0."""
    w = Window.partitionBy(by).orderBy(start)
    due = F.coalesce(F.lag(F.col(start) + F.col(tokens)).over(w), F.lit(0))
    return shards.withColumn("expected", due).where(F.col(start) != F.col("expected"))


def tail_holdout(df: DataFrame, tokens: str, order: list, by: list[str], fraction: float = 0.0015, align: int = 1) -> DataFrame:
    """`n_val`: how many of each row's tokens are in the last floor(total x fraction) ones, aligned; `split` of whole rows."""
    run = accumulated(df, order, tokens, by)
    val = F.floor(F.floor(F.col("total") * fraction) / align) * align
    cut = F.col("total") - val
    n = F.greatest(F.lit(0), F.least(F.col(tokens), F.col("incl") - cut))
    return run.withColumn("n_val", n.cast("long")).withColumn("split", F.when(F.col("excl") >= cut, "val").when(F.col("incl") > cut, "cut").otherwise("train")).drop("rn", "incl", "excl", "total")


def capped_prefix(df: DataFrame, tokens: str, cap: int, order: list, by: list[str] | None = None) -> DataFrame:
    """Rows until `cap` tokens; the last one is cut."""
    n = F.least(F.col(tokens), F.lit(cap) - F.col("excl"))
    return accumulated(df, order, tokens, by).withColumn("included", n).where("included > 0").withColumn("truncated", F.col("included") < F.col(tokens)).drop("rn", "incl", "excl", "total")


def estimated(files: DataFrame, pool: Column | float, size: str = "size", by: list[str] | None = None) -> DataFrame:
    """est_tokens: each file's share of the pool's tokens by its bytes."""
    pool = pool if isinstance(pool, Column) else F.lit(float(pool))
    by = by or []
    sums = files.groupBy(*by).agg(F.sum(size).alias("_all")).withColumnsRenamed({b: f"_b_{b}" for b in by})
    on = reduce(lambda x, b: x & F.col(b).eqNullSafe(F.col(f"_b_{b}")), by, F.lit(True))
    # without groups the sums are one row
    return files.join(sums if by else F.broadcast(sums), on).withColumn("est_tokens", pool * F.col(size) / F.col("_all")).drop("_all", *[f"_b_{b}" for b in by])


def shard_sample(files: DataFrame, target: Column | float, key: str, by: list[str] | None = None, seed: int = 42, over: float = 1.0, tokens: str = "est_tokens", one_at_least: bool = True) -> DataFrame:
    """Files in seeded order until their tokens reach over x target; the one that crosses it is taken."""
    target = (target if isinstance(target, Column) else F.lit(float(target))) * over
    run = accumulated(files, [seeded(seed, key), key], tokens, by)
    keep = F.col("excl") < target
    return run.where(keep | (F.col("rn") == 1) if one_at_least else keep).drop("rn", "total")


def stratified_sample(files: DataFrame, weights: DataFrame, total: float, key: str, by: str = "domain", weight: str = "weight", seed: int = 42) -> DataFrame:
    return shard_sample(files.join(weights, by), F.col(weight) * total, key, [by], seed)


def policy_sample(files: DataFrame, policies: DataFrame, key: str, by: str = "domain", seed: int = 42) -> DataFrame:
    """Domains of policy `pass` whole; others up to their `target`."""
    run = accumulated(files.join(policies, by), [seeded(seed, key), key], "est_tokens", [by])
    return run.where((F.col("policy") == "pass") | (F.col("excl") < F.col("target"))).drop("rn", "total")


def strict_sample(files: DataFrame, peak: float, key: str, seed: int = 42, tokens: str = "n_tokens") -> DataFrame:
    """As shard_sample over everything, but an error if there aren't enough tokens."""
    run = accumulated(files, [seeded(seed, key), key], tokens)
    short = F.raise_error(F.concat(F.lit("only "), F.col("total").cast("string"), F.lit(" tokens"))).cast("boolean")
    return run.where(F.when(F.col("total") < peak, short).otherwise(F.col("excl") < peak)).drop("rn", "total")


def sha_budget(files: DataFrame, budget: float, keys: list[str], size: str = "size", over: float = 1.3) -> DataFrame:
    """Files in the order of SHA-256 of their keys until over x budget bytes."""
    return accumulated(files, [sha_order(*keys), *keys], size).where(F.col("excl") < over * budget).drop("total")


def _fitting(sizes: np.ndarray, target: float) -> list[int]:
    """Places taken, in the order of taking, until the sizes reach the target.

    What a need of x admits has at most max(2 x, x + 1) tokens. Needs only fall, so a place that is admitted late was so
    before: one pass over the places, which leaves out those too large for good, and then, as long as the target isn't
    reached, the smallest ones left.
    """
    taken, got = [], 0.0
    for i, n in enumerate(sizes):
        need = target - got
        if need <= 0:
            return taken
        if n <= max(2 * need, need + 1):
            taken.append(i)
            got += n
    rest = np.setdiff1d(np.arange(len(sizes)), taken)
    for i in rest[np.argsort(sizes[rest], kind="stable")].tolist():
        if got >= target:
            break
        taken.append(i)
        got += sizes[i]
    return taken


def fitting_sample(files: DataFrame, by: str, key: str, tokens: str = "est_tokens", target: str = "target", seed: int = 42) -> DataFrame:
    """By group (a manifest's, so small): seeded draw that avoids shards of more than twice the remaining need."""
    schema = files.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_order", key])
        return pdf.iloc[_fitting(pdf[tokens].to_numpy(float), float(pdf[target].iloc[0]))][schema.names]

    return files.withColumn("_order", seeded(seed, key)).groupBy(by).applyInPandas(run, schema)


def top_up(files: DataFrame, by: str, key: str, size: str = "size", rate: str = "rate", current: str = "current", target: str = "target", tolerance: float = 0.02) -> DataFrame:
    """Smallest files (by size x rate) first until current + taken reaches target / (1 + tolerance), skipping what passes target / (1 - tolerance).

    As sizes rise, what is skipped is followed by skipped files only: the files taken are a prefix, given by running sums.
    """
    run = accumulated(files.withColumn("_n", F.col(size) * F.col(rate)), ["_n", key], "_n", [by])
    low, high = F.col(target) / (1 + tolerance), F.col(target) / (1 - tolerance)
    return run.where((F.col(current) + F.col("excl") < low) & (F.col(current) + F.col("incl") <= high)).select(*files.columns)


def holdout(df: DataFrame, key: str, by: list[str], fraction: float = 0.0015, seed: int = 42) -> DataFrame:
    """split: round-half-even(n x fraction) documents of each group for validation, at least one stays for training."""
    if not 0 < fraction < 0.5:
        raise ValueError("the fraction has to be between 0 and 0.5")
    run = accumulated(df, [seeded(seed, key), key], None, by)
    n = F.least(F.bround(F.col("total") * fraction), F.col("total") - 1)
    return run.withColumn("split", F.when(F.col("rn") <= n, "val").otherwise("train")).drop("rn", "incl", "excl", "total")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """A uniform sample of n rows: the first ones in seeded order. (A top-n by task, then one merge.)"""
    return df.orderBy(seeded(seed, key), key).limit(n)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """A whole shuffle, which a buffer of 10 000 rows only comes near to."""
    return df.orderBy(seeded(seed, key), key)


def buffered_shuffle(df: DataFrame, order: list[str], key: str, buffer: int = 10_000, seed: int = 42) -> DataFrame:
    """Adds `position`: a shuffle within each `buffer` neighbours of the order, as a stream with a buffer gives it."""
    block = accumulated(df, order).withColumn("_block", F.floor((F.col("rn") - 1) / buffer)).drop("rn", "incl", "excl", "total")
    w = Window.partitionBy("_block").orderBy(seeded(seed, key), key)
    return block.withColumn("position", F.col("_block") * buffer + F.row_number().over(w) - 1).drop("_block")


def assigned(df: DataFrame, order: str, n: int, k: int | None = None) -> DataFrame:
    """Round-robin worker of each row in order; only worker k's rows if given."""
    out = accumulated(df, [order]).withColumn("worker", F.pmod(F.col("rn") - 1, F.lit(n)).cast("int")).drop("rn", "incl", "excl", "total")
    return out if k is None else out.where(F.col("worker") == k)


def largest_first(files: DataFrame, size: str = "size", key: str = "path") -> DataFrame:
    return files.orderBy(F.desc(size), key)


def validation_windows(df: DataFrame, tokens: str, key: str, seq_len: int, target: int, seed: int = 42) -> DataFrame:
    """Windows of seq_len tokens over the shuffled stream until their loss tokens (seq_len - 1 each) reach the target."""
    run = accumulated(df, [seeded(seed, key), key], tokens)
    windows = F.least(F.floor(F.col("total") / seq_len), F.lit(-(-target // (seq_len - 1))))
    first, last = F.floor(F.col("excl") / seq_len), F.floor((F.col("incl") - 1) / seq_len)
    return run.where((F.col(tokens) > 0) & (first < windows)).select(key, F.explode(F.sequence(first, F.least(last, windows - 1))).alias("window"))


def random_blocks(domains: DataFrame, block: int, by: str = "domain", available: str = "available", needed: str = "needed", seed: int = 42, mix: int = 0) -> DataFrame:
    """(domain, start, n): aligned blocks without replacement in seeded order, exactly `needed` long together.

    If all whole blocks don't suffice, the ragged tail behind them tops up.
    """
    own = domains.where(F.col(needed) > 0).withColumn("_ok", F.when(F.col(needed) > F.col(available), F.raise_error(F.lit("not enough sequences")).cast("boolean")).otherwise(F.lit(True))).where("_ok")
    whole = F.floor(F.col(available) / block)
    tiny = own.where(whole == 0).select(by, F.lit(0).cast("long").alias("start"), F.col(needed).cast("long").alias("n"))
    blocks = own.where(whole > 0).select(by, needed, available, F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("block"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(mix)), F.col(by), F.col("block").cast("string")))
    ranked = lambda df, by_order, name: accumulated(df, by_order, None, [by]).withColumnRenamed("rn", name).drop("incl", "excl", "total")
    chosen = ranked(blocks, [order, "block"], "_k").where(F.col("_k") <= F.ceil(F.col(needed) / block))
    chosen = ranked(chosen, ["block"], "_i").withColumn("n", F.least(F.lit(block).cast("long"), F.col(needed) - (F.col("_i") - 1) * block))
    got = chosen.where("n > 0").select(by, (F.col("block") * block).alias("start"), F.col("n").cast("long").alias("n"))
    rest = F.col(needed) - whole * block
    tail = own.where((whole > 0) & (rest > 0)).select(by, (whole * block).cast("long").alias("start"), rest.cast("long").alias("n"))
    return got.unionByName(tail).unionByName(tiny)


def near_optimal(candidates: DataFrame, weights: list[str], score: str, band: float, distance: float, keep: int = 8, metric: str = "l1") -> list[dict]:
    """At most `keep` candidates within the band of the best score, pairwise at least `distance` apart (L1 or largest).

    The best candidate by score and weights is taken, those near it go, and so on. Candidates are deduplicated by
    weights to two decimals first; one row a turn comes to the driver.
    """
    best = candidates.agg(F.min(score)).first()[0]
    if best is None:
        return []
    rounded = [F.round(w, 2).alias(f"_{w}") for w in weights]
    close = candidates.where(F.col(score) <= best + band).select(*weights, score, *rounded)
    one = close.groupBy(*[f"_{w}" for w in weights]).agg(F.min(F.struct(score, *weights)).alias("r"))
    left = checkpointed(one.select("r.*"))
    out: list[dict] = []
    while len(out) < keep:
        row = left.agg(F.min(F.struct(score, *weights)).alias("r")).first()["r"]
        if row is None:
            break
        out.append(row.asDict())
        gaps = [F.abs(F.col(w) - F.lit(row[w])) for w in weights]
        apart = reduce(lambda a, b: a + b, gaps) if metric == "l1" else F.greatest(*gaps, F.lit(0.0))
        left = left.where(apart >= distance)
    return out


def circular(df: DataFrame, tokens: str, start: int, n_tokens: int, order: str) -> DataFrame:
    """n_tokens of the stream from row `start` on, beginning again at the end; the last row is cut."""
    run = accumulated(df, [order]).withColumn("_turn", F.pmod(F.col("rn") - 1 - F.lit(start), F.col("total"))).drop("rn", "incl", "excl", "total")
    return capped_prefix(run, tokens, n_tokens, ["_turn"]).drop("_turn")


def report(df: DataFrame, by: str, n: int = 12, descending: bool = False) -> DataFrame:
    return df.orderBy(F.desc(by) if descending else F.asc(by)).limit(n)


def checkpoint_ladder(df: DataFrame, total: str = "total", interval: int = 125) -> DataFrame:
    """(…, step): every interval-th step and the last; a grid point less than an interval before the last is left out."""
    t = F.col(total)
    grid = F.floor(t / interval) * interval
    steps = F.filter(F.sequence(F.lit(0).cast("long"), grid.cast("long"), F.lit(interval).cast("long")), lambda s: (s == 0) | (s != grid) | (grid == t))
    return df.select("*", F.explode(F.array_sort(F.array_union(steps, F.array(t.cast("long"))))).alias("step"))


def row_mask(scores: Column, valid: Column, k: float, middle: bool = False) -> Column:
    """Mask of a row's kept positions: round-half-even(n k), at least 1, of the valid ones; the highest, or the middle ones.

    Ties go to earlier positions. A row without valid positions keeps none.
    """
    paired = F.transform(scores, lambda s, i: F.struct(s.cast("double").alias("s"), i.alias("i")))
    own = F.filter(F.zip_with(paired, valid, lambda x, v: F.when(v, x)), lambda x: x.isNotNull())
    falling = lambda a, b: F.when(a["s"] < b["s"], 1).when(a["s"] > b["s"], -1).otherwise(a["i"] - b["i"])
    ranked = F.array_sort(own) if middle else F.array_sort(own, falling)
    kept = lambda r: F.greatest(F.lit(1), F.least(F.size(r), F.bround(F.size(r) * F.lit(float(k))).cast("int")))
    skip = lambda r: F.floor((F.size(r) - kept(r)) / 2).cast("int") if middle else F.lit(0)
    chosen = let(ranked, lambda r: F.transform(F.slice(r, skip(r) + 1, kept(r)), lambda x: x["i"]))
    return let(F.struct(chosen.alias("c"), scores.alias("s")), lambda x: F.transform(x["s"], lambda s, i: F.array_contains(x["c"], i).cast("int")))


def row_min_max(scores: Column, valid: Column, eps: float = 1e-8) -> Column:
    """Scores from 0 to 1 within the row; invalid positions get 0."""
    own = F.filter(F.zip_with(scores, valid, lambda s, v: F.when(v, s.cast("double"))), lambda s: s.isNotNull())
    parts = F.struct(F.array_min(own).alias("low"), F.greatest(F.array_max(own) - F.array_min(own), F.lit(eps)).alias("spread"), scores.alias("s"), valid.alias("v"))
    return let(parts, lambda x: F.zip_with(x["s"], x["v"], lambda s, v: F.when(v, (s.cast("double") - x["low"]) / x["spread"]).otherwise(0.0)))


def loss_mask(method: str, valid: Column, k: float, current: Column | None = None, history: Column | None = None, reference: Column | None = None, early: Column | None = None, late: Column | None = None, attention: Column | None = None, seed: int = 42, row: Column | None = None, warmup: bool = False) -> Column:
    """Masks by method: full, random, rel_ema, rho_excess, middle_ppl, learnability, attention; all valid ones in warm-up."""
    less = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    if warmup or method in ("full", "warmup"):
        return F.transform(valid, lambda v: v.cast("int"))
    if method == "random":
        place = lambda i: F.concat_ws(":", F.lit(str(seed)), (row if row is not None else F.lit(0)).cast("string"), i.cast("string"))
        at = F.transform(valid, lambda v, i: F.conv(F.substring(F.md5(place(i)), 1, 12), 16, 10).cast("double"))  # 48 bits of a hash that any engine has
        return row_mask(at, valid, k)
    if method == "middle_ppl":
        return row_mask(reference, valid, k, middle=True)
    score = {"rel_ema": lambda: less(history, current), "rho_excess": lambda: less(current, reference), "learnability": lambda: less(early, late), "attention": lambda: attention}[method]()
    return row_mask(score, valid, k)


def masked_loss(loss: Column, mask: Column) -> Column:
    """struct(sum, n) of the losses where the mask is set."""
    both = F.zip_with(loss, mask, lambda x, m: F.when(m.cast("int") == 1, x.cast("double")))
    kept = F.filter(both, lambda x: x.isNotNull())
    return F.struct(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x).alias("sum"), F.size(kept).alias("n"))


def rate_between(df: DataFrame, at: str, value: str, by: list[str] | None = None, target: float | None = None, single_task_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """Rate between each two samples, and time left until `target` at that rate."""
    own = lagged(df, [at], [at, value], by, single_task_rows)
    rate = F.try_divide(F.col(value) - F.col(f"_before.{value}"), F.col(at).cast("double") - F.col(f"_before.{at}").cast("double"))
    out = own.withColumn("rate", rate).drop("_before")
    return out if target is None else out.withColumn("eta", F.when(F.col("rate") > 0, (F.lit(target) - F.col(value)) / F.col("rate")))
