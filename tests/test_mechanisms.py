"""Learnt scores, taggers, permutations, filters before joins, buckets, sketches and state."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.functions import tagging
from sluice.operators import aggregates, filters, joins, language, membership, permutation, prefix, selection, sketches
from sluice.sources import bucketed
from sluice.streaming import stateful, streams


def test_english_is_told_from_other_languages(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet").where("length(text) > 20")
    table = language.learnt(docs, 300)
    assert len(table) == language.BUCKETS and all(1 <= b <= 127 for b in table) and table == language.learnt(docs.repartition(3), 300)
    seen = {r[0] for r in docs.select("doc_id").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(300).collect()}
    got = docs.select("doc_id", "lang", filters.document_score(F.col("text"), language.english_score(table)).alias("s")).where(~F.col("doc_id").isin(seen)).collect()
    right = [(r.s >= 0.5) == (r.lang == "en") for r in got]
    assert len(right) > 500 and np.mean(right) > 0.97


def test_english_scores_by_hand(spark):
    texts = ["", "12 34\n", "The cat", "der hund\n\nthe dog is 7", "ÄÖ é", None]
    counts = {b: ((b * 7) % 50, (b * 13) % 40) for b in range(0, language.BUCKETS, 3)}
    table = language.weights(counts)

    def plain(p):
        own = []
        for w in re.findall(r"[^\x00-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), p)):
            for g, shift in ((w[:3], 0), (w[-3:], language.BUCKETS // 2)):
                c = [ord(x) for x in g] + [0] * (3 - len(g))
                own.append(table[(c[0] * 961 + c[1] * 31 + c[2]) % (language.BUCKETS // 2) + shift] - 64)
        return 1 / (1 + np.exp(-2.0 / language.STEPS * sum(own) / max(1, len(own))))

    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", filters.document_score(F.col("t"), language.english_score(table)).alias("s")).collect()
    for r in got:
        parts = [p for p in (texts[r.i] or "").split("\n") if p.strip()]
        assert r.s is None if not parts else r.s == pytest.approx(sum(plain(p) * len(p) for p in parts) / sum(map(len, parts)))
    assert language.weights({}) == bytes([64] * language.BUCKETS)


def plain_blocks(text):
    lines, at, rows = text.split("\n"), 0, []
    for line in lines:
        hit = bool(re.search(tagging.LICENCE, line))
        rows.append((at, at + len(line), hit, hit or bool(re.search(tagging.COMMENT, line))))
        at += len(line) + 1
    out, k = [], 0
    while k < len(rows):
        j = k
        while j < len(rows) and rows[j][3]:
            j += 1
        if j > k:
            hits = sum(r[2] for r in rows[k:j])
            out.append((rows[k][0], rows[j - 1][1], hits / (j - k) if hits else (j - k) / len(lines), "copyright" if hits else "comment"))
        k = j + 1 if j == k else j
    return out


def test_tagged_blocks(spark):
    rnd = random.Random(6)
    kinds = ["# a", "  // b", "plain text", "", "Copyright (c) 1999 é", "All rights reserved.", "/* x", " * y", " */", "x = 1  # no", "% t", "SPDX-License-Identifier: MIT", "--", "Ünï"]
    texts = ["", "\n", "# only", "plain"] + ["\n".join(rnd.choice(kinds) for _ in range(rnd.randrange(1, 30))) for _ in range(200)] + ["# c\n" * 3000]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string")
    got = {r.i: r for r in df.select("i", tagging.tagged_blocks(F.col("t")).alias("b"), filters.replace_scored_spans(F.col("t"), tagging.tagged_blocks(F.col("t")), 0.5, "@").alias("cut")).collect()}
    assert got[-1].b is None
    for i, text in enumerate(texts):
        blocks = plain_blocks(text)
        assert [(b.s, b.e, pytest.approx(b.score), b.kind) for b in got[i].b] == [(s, e, x, k) for s, e, x, k in blocks]
        want, at = "", 0
        for s, e, x, _ in blocks:
            if x >= 0.5:
                want, at = want + text[at:s] + "@", e
        assert got[i].cut == want + text[at:]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1023, 5000])
def test_permutations_are_bijections(spark, n):
    df = spark.range(n).select("id", permutation.permuted(F.col("id"), n, 5).alias("p"), permutation.permuted(F.col("id"), n, 6).alias("q"))
    rows = df.withColumn("back", permutation.restored(F.col("p"), n, 5)).collect()
    assert sorted(r.p for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)
    if n >= 1000:
        p, q = np.array([r.p for r in rows]), np.array([r.q for r in rows])
        assert abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.1 and abs(np.corrcoef(p, q)[0, 1]) < 0.1 and (p == np.arange(n)).mean() < 0.01
        assert abs(np.corrcoef(p[1:], p[:-1])[0, 1]) < 0.1  # neighbours part


def test_epochs_need_no_shuffle(spark):
    n = 10_000_000_019
    few = spark.range(5).select((F.col("id") * 1_999_999_999).alias("row_index"))
    out = permutation.epoch_positions(few, n, 2)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.collect()
    assert len({(r.epoch, r.position) for r in got}) == 10 and all(0 <= r.position < n for r in got)
    back = out.select("row_index", permutation.restored(F.col("position"), n, F.lit(42) * 1000 + F.col("epoch")).alias("b")).collect()
    assert all(r.b == r.row_index for r in back)
    rows = spark.range(50).withColumnRenamed("id", "row_index")
    stream = permutation.batches(rows, 50, 20, seed=1)
    first = [next(stream) for _ in range(4)]
    ids = [{r.row_index for r in b.collect()} for b in first]
    assert all(len(x) == 20 for x in ids) and not ids[0] & ids[1] and ids[0] != ids[2] and [b.first().epoch for b in first] == [0, 0, 1, 1]


def test_filters_before_joins(spark):
    docs = spark.range(20_000).select("id", (F.col("id") % 3).alias("x")).union(spark.createDataFrame([(None, 1), (5, 5)], "id long, x long"))
    ids = spark.range(0, 20_000, 97).union(spark.createDataFrame([(None,)], "id long")).union(spark.range(30_000, 30_010))
    same = lambda a, b: sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    for rate in (0.01, 0.5):
        assert same(membership.members(docs, ids, rate=rate), docs.join(ids, "id", "left_semi"))
        assert same(membership.strangers(docs, ids, rate=rate), docs.join(ids, "id", "left_anti"))
    assert membership.members(docs, ids.limit(0)).count() == 0 and membership.strangers(docs, ids.limit(0)).count() == docs.count()
    size, hashes = membership.sized(ids.count())
    table = membership.bloom(ids, "id", size, hashes)
    passed = docs.where(membership.may_hold(table, F.col("id"), hashes)).count()
    hits = docs.join(ids, "id", "left_semi").count()
    assert hits <= passed <= hits + 0.03 * 20_000  # so few rows reach the join
    assert membership.sized(10**12)[0] == membership.MOST_BYTES
    text = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert [r.k for r in membership.members(text, spark.createDataFrame([("b",)], "k string"), "k").collect()] == ["b"]


def test_buckets_join_without_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.range(3000).select("id", F.concat(F.lit("t"), "id").alias("text"))
        labels = spark.range(0, 4000, 2).select("id", (F.col("id") % 5).alias("y"))
        spans = spark.range(9000).select((F.col("id") % 3000).alias("id"), F.col("id").alias("fact_idx"), F.lit("s").alias("span"))
        a, b, c = (bucketed.write(x, "id", 6) for x in (docs, labels, spans))
        for got, want in (
            (joins.joined_labels(a, b), joins.joined_labels(docs, labels)),
            (joins.kept(a, b), joins.kept(docs, labels)),
            (joins.with_spans(a, c, "id"), joins.with_spans(docs, spans, "id")),
            (joins.coverage(a, b), joins.coverage(docs, labels)),
        ):
            assert bucketed.exchanges(got) == 0 < bucketed.exchanges(want)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sketches_merge(spark):
    rnd = np.random.default_rng(8)
    rows = [(int(d), float(x)) for d in range(20) for x in rnd.lognormal(3, 1, 2000)] + [(20, None), (21, 5.0)]
    df = spark.createDataFrame(rows, "day int, v double").withColumn("month", F.floor(F.col("day") / 10))
    stored = sketches.sketched(df, ["month", "day"], "v", 200)
    assert stored.count() == 21
    got = {r.month: r for r in sketches.reported(sketches.rolled_up(stored, ["month"], 200), {"p5": 0.05, "p50": 0.5, "p99": 0.99}).collect()}
    for m in (0, 1):
        own = np.sort([x for d, x in rows if d // 10 == m])
        assert got[m].n == 20_000 and got[m].low == own[0] and got[m].high == own[-1]
        for q, name in ((0.05, "p5"), (0.5, "p50"), (0.99, "p99")):
            assert abs(np.searchsorted(own, got[m][name]) / 20_000 - q) < 0.03
    assert (got[2].p5, got[2].p99) == (5.0, 5.0)


def test_lag_over_ranges(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", None, "b"]), i, rnd.choice([1, 2, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(4)
    one, many = (prefix.lagged(df, ["i"], ["v"], ["g"], limit, 5) for limit in (10**6, 1))
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    runs = [aggregates.changes(df, "v", ["i"], ["g"], limit) for limit in (10**6, 1)]
    assert sorted(map(str, runs[0].collect())) == sorted(map(str, runs[1].collect()))
    rates = [selection.rate_between(df.na.fill(0), "i", "v", ["g"], 5.0, limit) for limit in (10**6, 1)]
    assert sorted(map(str, rates[0].collect())) == sorted(map(str, rates[1].collect()))


def test_rows_that_explode_makes_are_counted(spark, tmp_path):
    spark.createDataFrame([(i, 3_000_000) for i in range(4)], "shard int, n int").write.parquet(str(tmp_path / "m"))
    made = spark.read.parquet(str(tmp_path / "m")).select("shard", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("chunk"))
    assert prefix.planned_bytes(made) is None and not prefix.is_small(made, prefix.SINGLE_TASK_ROWS)
    assert prefix.is_small(spark.read.parquet(str(tmp_path / "m")), prefix.SINGLE_TASK_ROWS)
    ranked = prefix.accumulated(made.where("chunk % 1000 = 0"), ["shard", "chunk"], single_task_rows=1000, ranges=4)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "_range" in plan  # ranks are made by ranges, not in one task
    assert ranked.agg(F.max("rn"), F.count("*")).first() == (12_000, 12_000)


def test_null_groups_zip(spark):
    a = spark.createDataFrame([(None, 1), (None, 2), ("x", 3)], "d string, a int")
    b = spark.createDataFrame([(None, 10), ("x", 30), ("y", 40)], "d string, b int")
    got = sorted(map(str, ((r.d, r.ordinal, r.a, r.b) for r in joins.zipped(a, b, "d", ["a"], ["b"]).collect())))
    assert got == sorted(map(str, [(None, 0, 1, 10), (None, 1, 2, None), ("x", 0, 3, 30), ("y", 0, None, 40)]))


# --- streams ---

SEGMENT = "id string, segment long, loss double, n_tokens long, n_total long, at timestamp"


def fed(spark, tmp_path, number, rows, schema):
    """A file that comes after those before it."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    time.sleep(0.1)


def totals(spark, tmp_path):
    stream = stateful.prepared(spark).readStream.schema(SEGMENT).parquet(str(tmp_path / "in"))
    q = stateful.document_totals(stream, late="10 minutes", patience_ms=3_600_000).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log"))
    q.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(180)
    return sorted(tuple(r) for r in spark.read.schema(stateful.TOTALS).parquet(str(tmp_path / "out")).collect())


def test_documents_out_of_segments(spark, tmp_path):
    from datetime import datetime, timedelta

    at = lambda m: datetime(2024, 5, 1) + timedelta(minutes=m)
    fed(spark, tmp_path, 0, [("a", 0, 1.0, 10, 3, at(0)), ("a", 1, 2.0, 20, 3, at(1)), ("b", 0, 0.5, 5, 1, at(1)), ("c", 0, 9.0, 1, 2, at(2))], SEGMENT)
    assert totals(spark, tmp_path) == [("b", 5, 0.5, 1, True)]
    # after a restart: a segment that comes again counts once, and the last one completes
    fed(spark, tmp_path, 1, [("a", 1, 2.0, 20, 3, at(1)), ("a", 2, 4.0, 40, 3, at(5))], SEGMENT)
    assert totals(spark, tmp_path) == [("a", 70, 7.0, 3, True), ("b", 5, 0.5, 1, True)]
    # c never comes to its end: it goes once the watermark is an hour behind its first segment
    fed(spark, tmp_path, 2, [("d", 0, 1.0, 1, 1, at(120))], SEGMENT)
    fed(spark, tmp_path, 3, [("e", 0, 1.0, 1, 1, at(121))], SEGMENT)
    got = totals(spark, tmp_path)
    assert ("c", 1, 9.0, 1, False) in got and {r[0] for r in got} == {"a", "b", "c", "d", "e"}


def test_counters_grow_or_fail(spark, tmp_path):
    schema = "run_name string, step long, n_tokens long"

    def run():
        stream = stateful.prepared(spark).readStream.schema(schema).parquet(str(tmp_path / "in"))
        stateful.counted(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
        return sorted(tuple(r) for r in spark.read.schema(stateful.COUNTERS).parquet(str(tmp_path / "out")).collect())

    fed(spark, tmp_path, 0, [("r", 2, 5), ("r", 1, 4), ("s", 7, 1)], schema)
    assert run() == [("r", 1, 4, 4), ("r", 2, 5, 9), ("s", 7, 1, 1)]
    fed(spark, tmp_path, 1, [("r", 3, 1)], schema)
    assert ("r", 3, 1, 10) in run()  # the total is state, not read back
    fed(spark, tmp_path, 2, [("r", 3, 1)], schema)
    with pytest.raises(Exception, match="grow"):
        run()


def test_a_stream_ends_at_its_budget(spark, tmp_path):
    for i in range(8):
        fed(spark, tmp_path, i, [(i * 10 + k, 10) for k in range(10)], "id long, n_tokens long")
    stream = lambda: spark.readStream.schema("id long, n_tokens long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    go = lambda budget: streams.ingest_until(stream(), str(tmp_path / "out"), str(tmp_path / "log"), budget)
    first = go(250)
    assert first.awaitTermination(120) and first.reached.is_set() and not first.query.isActive
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n_tokens")).first()[0] == 300  # three batches of 100
    read = len(list((tmp_path / "log" / "commits").glob("[0-9]*")))
    assert read <= 5  # what is behind the budget stays unread
    again = go(250)  # a restart knows from its log, not from the sink
    assert again.awaitTermination(120) and spark.read.parquet(str(tmp_path / "out")).count() == 30
    more = go(10**9)
    assert more.awaitTermination(120) and not more.reached.is_set()
