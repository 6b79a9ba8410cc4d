"""Ways that only large inputs take, against the plain ones; files that are read back; drawing without replacement."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import Window
from pyspark.sql import functions as F

from sluice.functions import text as tx
from sluice.operators import aggregates as ag
from sluice.operators import contracts, joins, mixing, packing, prefix, selection
from sluice.sources import files, readers, sinks


def grouped(spark, n=400):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot"] * 8 + ["a", "b", None]), i, rnd.randrange(0, 50)) for i in range(n)]
    return spark.createDataFrame(rows, "g string, k int, v int").repartition(3)


@pytest.mark.parametrize("by", [["g"], []])
def test_two_phases_give_what_a_window_gives(spark, by):
    df = grouped(spark)
    w = Window.partitionBy(*by).orderBy("v", "k")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("k", F.row_number().over(w).alias("rn"), F.sum("v").over(run).alias("incl"), F.sum("v").over(Window.partitionBy(*by)).alias("total"))
    got = prefix.accumulated(df, ["v", "k"], "v", by, single_task_rows=20, ranges=7)
    assert prefix.ranged(df, by, [F.col("v"), F.col("k")], 20, 7)[1]
    assert sorted(map(tuple, got.select("k", "rn", "incl", "total").collect())) == sorted(map(tuple, want.collect()))
    assert got.where("excl <> incl - v").isEmpty() and got.columns == ["g", "k", "v", "rn", "incl", "excl", "total"]


def test_sums_of_many_groups_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(prefix, "BROADCAST_BYTES", 0)
    df = grouped(spark)
    got = prefix.accumulated(df, ["k"], "v", ["g"], single_task_rows=20, ranges=7)
    want = prefix.accumulated(df, ["k"], "v", ["g"])
    assert sorted(map(tuple, got.select("k", "rn", "incl", "excl", "total").collect())) == sorted(map(tuple, want.select("k", "rn", "incl", "excl", "total").collect()))


def test_last_values_are_carried_over_ranges(spark):
    df = grouped(spark).withColumn("x", F.when(F.col("k") % 11 == 0, F.col("k")))
    got = prefix.carried(df, ["k"], "x", ["g"], single_task_rows=20, ranges=9).select("k", "_last").collect()
    want = df.select("k", F.last("x", ignorenulls=True).over(Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))).collect()
    assert sorted(map(str, got)) == sorted(str(r).replace(r.__fields__[1], "_last") for r in want)


def test_owners_and_zip_of_a_hot_group(spark, monkeypatch):
    layout = spark.createDataFrame([("h", i, 10 * i, 10 * i + 10) for i in range(40)], "g string, doc int, start int, end int")
    points = spark.createDataFrame([("h", 7 * i) for i in range(50)], "g string, offset int")
    plain = sorted(map(tuple, joins.owners(points, layout, "g", strict=True).collect()))
    ranged = prefix.ranged
    monkeypatch.setattr(prefix, "ranged", lambda df, by, order, rows, ranges: ranged(df, by, order, 5, 6))
    assert sorted(map(tuple, joins.owners(points, layout, "g", strict=True).collect())) == plain
    assert [r[2] for r in sorted(plain, key=lambda r: r[1])][:3] == [0, 0, 10]


def test_fingerprint_is_a_tree(spark):
    df = spark.range(1000).withColumn("x", F.col("id") * 3)
    one = packing.fingerprint(df.repartition(4), ["id"], ["id", "x"], fan=10).first()[0]
    assert one == packing.fingerprint(df, ["id"], ["x", "id"], fan=10).first()[0]
    assert one != packing.fingerprint(df.where("id <> 500"), ["id"], ["id", "x"], fan=10).first()[0]
    assert packing.fingerprint(df.limit(0), ["id"], ["id", "x"]).count() == 1


def test_quantiles_by_ranks(spark):
    df = grouped(spark).withColumn("v", F.when(F.col("k") % 13 != 0, F.col("v").cast("double")))
    args = (df, "v", {"a": 0.5, "b": 0.95, "c": 1.0}, ["g"], [F.count("*").alias("n")])
    plain, ranks = (sorted((str(r.g), r.n, *(round(x, 9) for x in (r.a, r.b, r.c))) for r in ag.with_quantiles(*args, single_task_rows=n).collect()) for n in (10**6, 15))
    assert plain == ranks and len(plain) == 4
    one = ag.with_quantiles(df, "v", {"a": 0.9}, [], [F.max("v").alias("m")], single_task_rows=15).first()
    assert one.a == pytest.approx(df.agg(F.percentile("v", F.lit(0.9))).first()[0]) and one.m == df.agg(F.max("v")).first()[0]


def test_lines_of_a_file_in_many_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i} {'x' * (i % 50)}\n" for i in range(3000)))
    (tmp_path / "b.txt").write_text("only\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = readers.lines(spark, str(tmp_path)).collect()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r.path[-5:], r.line_index): r.value.split()[-1 if r.path.endswith("b.txt") else 1] for r in got} == {("b.txt", 0): "only"} | {("a.txt", i): str(i) for i in range(3000)}


# --- files ---


def test_zstandard_lines_are_read_back(spark, tmp_path):
    df = spark.createDataFrame([(i, f"é text {i}\n") for i in range(25)], "id long, text string").repartition(2, "id")
    assert sinks.jsonl_zstd(df, str(tmp_path / "z"), docs_per_shard=7) == {"n_docs": 25, "n_chars": sum(len(f"é text {i}\n") for i in range(25))}
    found = sorted((tmp_path / "z").glob("*.jsonl.zst"))
    assert len(found) >= 4 and (tmp_path / "z" / "_SUCCESS").exists() and not list((tmp_path / "z").glob("_temporary*"))
    assert all(1 <= zstandard.ZstdDecompressor().stream_reader(f.read_bytes(), read_across_frames=True).read().count(b"\n") <= 7 for f in found)
    assert sorted(r.id for r in readers.mixed(spark, str(tmp_path / "z"), zstd_schema="id long, text string").collect()) == list(range(25))
    assert sinks.annotations(df.limit(0), str(tmp_path / "none")) is None and not (tmp_path / "none").exists()


def test_token_files_and_markers(spark, tmp_path):
    docs = spark.createDataFrame([("d", i, list(range(10 * i, 10 * i + 7))) for i in range(5)], "domain string, k int, ids array<int>")
    shards = sinks.token_shards(docs, "ids", ["k"], 16, 99, ["domain"])
    sinks.token_files(shards, str(tmp_path / "t"), ["domain"])
    raw = [np.frombuffer(f.read_bytes(), "<u4").tolist() for f in sorted((tmp_path / "t" / "d").glob("*.bin"))]
    assert [len(r) for r in raw] == [16, 16, 8] and list(itertools.chain(*raw)) == [t for i in range(5) for t in [*range(10 * i, 10 * i + 7), 99]]
    keys = spark.createDataFrame([("a",), ("b.c",)], "key string")
    assert files.done_keys(spark, str(tmp_path / "t")).count() == 0
    files.mark_done(keys, str(tmp_path / "m"))
    assert {r.key for r in files.done_keys(spark, str(tmp_path / "m")).collect()} == {"a", "b.c"}
    sinks.publish(spark.range(3).withColumnRenamed("id", "key"), str(tmp_path / "p"), key="key", ready=True)
    again = spark.range(5).withColumnRenamed("id", "key")
    sinks.publish(again, str(tmp_path / "p"), files.done_keys(spark, str(tmp_path / "p" / "_done")), "key")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 5 and contracts.ready(spark, str(tmp_path / "p" / "_state")) and not contracts.ready(spark, str(tmp_path / "none"))


def test_byte_shards_close_before_a_document_that_overflows(spark):
    rnd = random.Random(3)
    docs = [(g, i, "x" * rnd.choice([1, 5, 30, 130]) + "\n" * rnd.randrange(3)) for g in "ab" for i in range(60)]
    want = {}
    for g in "ab":
        shards = [b""]
        for _, _, t in (d for d in docs if d[0] == g):
            body = t.rstrip("\n").encode() + b"\n"
            if shards[-1] and len(shards[-1]) + 2 + len(body) > 100:
                shards.append(b"")
            shards[-1] += (b"\n\n" if shards[-1] else b"") + body
        want |= {(g, i): s for i, s in enumerate(shards)}
    df = spark.createDataFrame(docs, "g string, k int, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert {(r.g, r.shard): bytes(r.content) for r in sinks.byte_shard_contents(df, ["k"], "g", shard_tokens=100).collect()} == want
        assert {(r.g, r.shard): r.n_bytes for r in sinks.byte_shards(df, ["k"], "g", shard_tokens=100).collect()} == {k: len(v) for k, v in want.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# --- draws, selections, metrics ---


def test_draws_repeat_only_where_the_pool_is_too_small(spark):
    steps = spark.range(0, 1200, 37).withColumnRenamed("id", "step")
    for n, take in ((400, 9), (30, 9), (13, 9), (9, 9)):
        for r in mixing.draws(steps, F.lit(n), take, "control").groupBy("step").agg(F.collect_list("chunk").alias("c")).collect():
            assert len(r.c) == take == len(set(r.c)) and set(r.c) <= set(range(n))
    few = mixing.draws(steps, F.lit(4), 9, "control").groupBy("step").agg(F.collect_list("chunk").alias("c")).collect()
    assert all(len(r.c) == 9 and set(r.c) <= set(range(4)) for r in few)


def test_weights_change_while_drawing(spark):
    w = spark.createDataFrame([(0, "a", 1.0), (0, "b", 0.0), (100, "a", 0.0), (100, "b", 1.0)], "since int, domain string, weight double")
    sizes = spark.createDataFrame([("a", 3), ("b", 5)], "domain string, n_chunks int")
    got = mixing.domain_draws(spark.range(200).withColumnRenamed("id", "draw"), w, sizes).collect()
    assert all(r.domain == ("a" if r.draw < 100 else "b") for r in got) and len(got) == 200


@pytest.mark.parametrize("metric", ["l1", "largest"])
def test_near_optimal_walks_through_all_candidates(spark, metric):
    rnd = random.Random(5)
    rows = [(a := rnd.random(), 1 - a, rnd.random() * 0.1 + (a > 0.6)) for _ in range(300)]
    left, want = sorted(rows, key=lambda r: (r[2], r[0])), []
    size = sum if metric == "l1" else max
    seen = {}
    for r in left:
        seen.setdefault((round(r[0], 2), round(r[1], 2)), r)
    for r in sorted(seen.values(), key=lambda r: (r[2], r[0])):
        if r[2] <= left[0][2] + 0.5 and len(want) < 5 and all(size((abs(r[0] - o[0]), abs(r[1] - o[1]))) >= 0.2 for o in want):
            want.append(r)
    got = selection.near_optimal(spark.createDataFrame(rows, "a double, b double, s double"), ["a", "b"], "s", 0.5, 0.2, 5, metric)
    assert [r["a"] for r in got] == [r[0] for r in want]


def naive_mtld(words):
    def one(ws):
        factors, seen, n = 0.0, set(), 0
        for w in ws:
            n, seen = n + 1, seen | {w}
            if len(seen) / n <= 0.72:
                factors, seen, n = factors + 1, set(), 0
        factors += (1 - len(seen) / n) / 0.28 if n else 0
        return len(ws) / factors if factors else float(len(ws))

    return float(len(set(words))) if len(words) < 10 else (one(words) + one(words[::-1])) / 2


def test_lexical_diversity_by_definition(spark):
    rnd = random.Random(6)
    texts = [" ".join("w" + str(rnd.randrange(k)).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(n)) for k, n in ((3, 9), (5, 40), (40, 300), (400, 900), (10**6, 700), (2, 500))]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.difficulty(F.col("t")).alias("m")).orderBy("i").collect()
    for r, t in zip(got, texts, strict=True):
        assert r.m.mtld == pytest.approx(naive_mtld(t.split()))


def test_fitting_takes_the_first_that_fits():
    rnd = random.Random(7)
    for _ in range(200):
        sizes, target = [rnd.choice([1, 3, 8, 20, 90]) * 1.0 for _ in range(rnd.randrange(1, 15))], rnd.choice([5, 30, 100])
        left, want, got = list(range(len(sizes))), [], 0.0
        while left and got < target:
            need = target - got
            fits = [i for i in left if sizes[i] <= max(2 * need, need + 1)] or [min(left, key=lambda i: sizes[i])]
            want.append(fits[0])
            left.remove(fits[0])
            got += sizes[fits[0]]
        assert selection._fitting(np.array(sizes), target) == want


def test_trimming_by_definition(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice(["a", "b", None]), i, rnd.choice([1, 2, 5, 40, 90])) for i in range(300)]
    want = []
    for g in ("a", "b", None):
        kept = 0
        for r in rows:
            if r[0] == g and (kept < 980 or (kept < 1000 and kept + r[2] <= 1020)):
                want.append(r[1])
                kept += r[2]
    df = spark.createDataFrame(rows, "g string, k int, n int").repartition(3)
    got = selection.trim_budget(df, "n", 1000, ["k"], ["g"])
    assert sorted(r.k for r in got.collect()) == sorted(want) and got.columns == df.columns
