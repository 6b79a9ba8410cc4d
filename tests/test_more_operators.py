"""Operators that no registered query runs: expected values on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.functions import config
from sluice.functions import text as tx
from sluice.operators import aggregates as ag
from sluice.operators import contracts, filters, joins, mixing, packing, selection, sets
from sluice.sources import readers, sinks
from sluice.streaming import streams


def test_selection(spark):
    docs = spark.createDataFrame([(i, 10) for i in range(20)], "id long, n long")
    assert selection.circular(docs, "n", 18, 35, "id").agg(F.sum("included")).first()[0] == 35
    assert {r.id for r in selection.circular(docs, "n", 18, 35, "id").collect()} == {18, 19, 0, 1}
    windows = selection.validation_windows(docs, "n", "id", 8, 21).select("window").distinct().count()
    assert windows == 3
    blocks = spark.createDataFrame([("a", 103, 103), ("b", 5, 3), ("c", 40, 13)], "domain string, available long, needed long")
    got = selection.random_blocks(blocks, 10).collect()
    assert {d: sum(r.n for r in got if r.domain == d) for d in "abc"} == {"a": 103, "b": 3, "c": 13}
    assert ("a", 100, 3) in {(r.domain, r.start, r.n) for r in got}
    files = spark.createDataFrame([(f"f{i}", float(i + 1), "d") for i in range(10)], "path string, size double, domain string")
    est = selection.estimated(files, 550.0, by=["domain"])
    assert est.agg(F.sum("est_tokens")).first()[0] == pytest.approx(550)
    assert selection.shard_sample(est, 1.0, "path", ["domain"]).count() == 1
    policies = spark.createDataFrame([("d", "pass", 0.0)], "domain string, policy string, target double")
    assert selection.policy_sample(est, policies, "path").count() == 10
    assert selection.stratified_sample(est, spark.createDataFrame([("d", 0.5)], "domain string, weight double"), 550, "path").agg(F.sum("est_tokens")).first()[0] >= 275
    with pytest.raises(Exception, match="only"):
        selection.strict_sample(est, 1e9, "path", tokens="est_tokens").collect()
    assert selection.sha_budget(files, 10, ["path"]).count() >= 1
    rate = selection.rate_between(spark.createDataFrame([(0, 0.0), (10, 5.0)], "t long, v double"), "t", "v", target=10.0).where("rate is not null").first()
    assert rate.rate == 0.5 and rate.eta == 10
    cand = spark.createDataFrame([(0.5, 0.5, 1.0), (0.501, 0.499, 1.01), (0.9, 0.1, 1.02), (0.1, 0.9, 9.0)], "a double, b double, s double")
    assert [r["a"] for r in selection.near_optimal(cand, ["a", "b"], "s", 0.1, 0.2)] == [0.5, 0.9]
    assert selection.report(files, "size", 3, True).first().path == "f9" and selection.largest_first(files).first().path == "f9"


def test_loss_masks(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [4.0, 1.0, 9.0, 2.0], [True, True, True, True])], "c array<double>, h array<double>, v array<boolean>")
    of = lambda m, **k: df.select(selection.loss_mask(m, F.col("v"), 0.5, **k)).first()[0]
    assert of("rel_ema", current=F.col("c"), history=F.col("h")) == [1, 0, 1, 0]
    assert of("rho_excess", current=F.col("c"), reference=F.col("h")) == [0, 1, 0, 1]
    assert of("learnability", early=F.col("h"), late=F.col("c")) == [1, 0, 1, 0]
    assert of("middle_ppl", reference=F.col("c")) == [0, 1, 1, 0] and of("full") == [1, 1, 1, 1] and sum(of("random")) == 2
    assert of("attention", attention=F.col("c")) == [0, 0, 1, 1]


def test_aggregates(spark):
    seg = spark.createDataFrame([("a", 10.0, 5), ("a", 20.0, 5), ("b", 900.0, 10)], "id string, loss double, n_tokens long")
    got = {r.id: r for r in ag.nll(seg, ["id"]).collect()}
    assert got["a"].avg_nll == 3 and got["a"].perplexity == pytest.approx(math.exp(3)) and got["b"].perplexity == math.inf
    labels = spark.createDataFrame([(1, "arc_val_rc_bpb", 1.0), (1, "mmlu_stem_val_rc_bpb", 3.0), (2, "arc_val_rc_bpb", 2.0)], "step long, label string, bpb double")
    macro = {r.step: r for r in ag.task_loss(labels, ["step"], labels=2).collect()}
    assert macro[1].macro == 2 and macro[2].macro is None and macro[1].mmlu_avg == 3
    assert labels.select(ag.task_family(F.col("label")).alias("f")).first().f == "arc"
    assert {r.step: r.macro for r in ag.family_macro(labels, ["step"], ["arc", "mmlu_stem"]).collect()} == {1: 2.0, 2: None}
    key = spark.createDataFrame([("eval/downstream_bpb/arc_val_bpb_bpb",), ("train/x",)], "k string").select(ag.eval_label(F.col("k"))).collect()
    assert [r[0] for r in key] == ["arc_val_bpb", None]
    choice = spark.createDataFrame([(1, 0, 0.5, 0), (1, 1, 0.7, 0), (2, 0, 0.4, 1), (2, 1, 0.6, 1)], "item long, choice long, bpb double, gold long")
    assert ag.choice_scores(choice).first().accuracy == 0.5
    err = ag.fit_errors(spark.createDataFrame([("f", 1.0, 2.0), ("f", 3.0, 3.0)], "family string, predicted double, observed double"), "family").first()
    assert err.max_error == 1 and err.rmse == pytest.approx(math.sqrt(0.5))
    assert ag.placement(spark.createDataFrame([(0, 0)], "n_facts long, n_facts_placed long")).first().rate is None
    manifest = spark.createDataFrame([("b", 5), ("a", 3)], "path string, est_tokens long")
    fresh = ag.remeasured(manifest, spark.createDataFrame([("b", 7)], "path string, n_tokens long")).orderBy("index").collect()
    assert [(r.path, r.tokens) for r in fresh] == [("a", 3), ("b", 7)]
    assert ag.window_stats(spark.createDataFrame([(0, 0, 1), (0, 5, 2)], "w long, token long, doc long"), "w").first().nonzero == 0.5
    weights = spark.createDataFrame([(0, "d", 1.0)], "mix_id long, domain string, weight double")
    there = spark.createDataFrame([("d", 10)], "domain string, available long")
    assert ag.failing_mixtures(weights, there, 20).count() == 1 and ag.peak_demand(weights.withColumn("n_tokens", F.lit(100))).first().peak_tokens == 102


def test_mixing(spark):
    domains, rng = ["a", "b"], np.random.default_rng(0)
    t = rng.dirichlet([1, 1], 16)
    y = 1.0 + np.exp(0.2) * np.exp(t @ np.array([-1.0, 0.3]))
    rows = spark.createDataFrame([("f", float(p), float(q), float(v)) for (p, q), v in zip(t, y, strict=True)], "family string, a double, b double, loss double")
    law = mixing.mixing_laws(rows, domains).first()
    assert law.error < 1e-3
    out = mixing.mixing_laws(rows, domains, leave_one_out=True)
    assert ag.fit_errors(out, "family").first().rmse < 0.1
    best, _ = mixing.best_mixture([{"a": law.a, "b": law.b, "r": law.r}], np.zeros(2), np.ones(2))
    assert best.sum() == pytest.approx(1) and best[0] > 0.9
    assert mixing.fit_trees(rows, domains, "loss", rounds=3).transform(rows).count() == 16
    steps = np.arange(1, 13) * 100
    low, high = mixing.bootstrap_interval(steps, 2 + 5 * steps**-0.5 + rng.normal(0, 1e-3, 12), 2000, draws=20)
    assert low <= high
    fit = spark.createDataFrame([("f", "a", 1.0, 2.0, -1.0), ("f", "b", 1.0, 2.0, 0.5)], "family string, domain string, c double, k double, t double")
    w = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "domain string, weight double")
    a = {r.domain: r.a for r in mixing.online_adjacency(fit, w).collect()}
    assert a["a"] == pytest.approx(2 * math.exp(-0.25)) and a["b"] == 0
    assert mixing.as_matrix(mixing.online_adjacency(fit, w), ["f"]).count() == 2
    d = mixing.draws(spark.range(990, 1010).withColumnRenamed("id", "step"), F.lit(50), 4, "warmup")
    assert d.where("step < 1000").select("chunk").collect()[0].chunk == 990 * 4 % 50 and d.where("chunk between 0 and 49").count() == 80
    for pacing in ("control", "linear", "interleave", "expanding"):
        assert mixing.draws(spark.range(5).withColumnRenamed("id", "step"), F.lit(7), 3, pacing).where("chunk between 0 and 6").count() == 15
    sizes = spark.createDataFrame([("a", 10), ("b", 20)], "domain string, n_chunks long")
    got = mixing.domain_draws(spark.range(2000).withColumnRenamed("id", "draw"), w, sizes).groupBy("domain").count().collect()
    assert all(900 < r["count"] < 1100 for r in got)
    assert spark.range(1).select(mixing.ema_alpha(F.lit(50), t0=0, total=100, start=0.0, end=1.0)).first()[0] == 0.5
    assert mixing.alpha_of_half_life(1) == 0.5 and mixing.token_budget(100, 10, 64, 8)[1] == 15
    assert ag.merged(spark.createDataFrame([(0, "k", 0, 1.0), (1, "k", 0, 3.0)], "ckpt long, key string, idx long, value double")).first().value == 2


def test_joins_sets_packing(spark):
    a = spark.createDataFrame([("p", 0), ("q", 1), ("r", 2)], "path string, index long")
    assert [r.path for r in joins.to_do(a, a.limit(0), a.where("path = 'p'")).collect()] == ["q", "r", "p"]
    assert joins.with_sidecars(a, a.where("index = 1").select("path")).where("status = 'ok'").count() == 1
    m = lambda rows: spark.createDataFrame(rows, "step long, metrics map<string,double>")
    got = {r.step: r.metrics for r in joins.overlaid(m([(1, {"x": 1.0, "y": 2.0}), (2, {"x": 5.0})]), m([(1, {"x": 9.0}), (3, {"z": 1.0})])).collect()}
    assert got == {1: {"x": 9.0, "y": 2.0}, 2: {"x": 5.0}, 3: {"z": 1.0}}
    assert sets.concatenated([a, a]).count() == 6 and sets.common_keys(a, a, "path").count() == 3 and sets.union_keys(a, a, "path").count() == 3 and sets.difference(a, a, "path").count() == 0
    assert sets.merged_manifest(a.limit(1), a, a.where("index = 2")).count() == 2
    ids = spark.createDataFrame([([1, 2, 3, 4, 5],)], "ids array<int>")
    assert ids.select(packing.segments(F.col("ids"), 3)).first()[0] == [[1, 2, 3], [3, 4, 5]]
    assert packing.permuted(a.withColumn("rank", -F.col("index")), index="index").orderBy("position").first().path == "r"
    assert packing.is_permutation(a, "index").first().ok
    contracts.require_permutation(a, "index")
    assert packing.fingerprint(a, ["path"], ["path", "index"]).first()[0] == packing.fingerprint(a.repartition(3), ["path"], ["index", "path"]).first()[0]
    shards = spark.createDataFrame([("s", "a", 4097), ("s", "b", 10)], "source string, path string, n_tokens long")
    c = packing.chunks(shards, "source", ["path"]).orderBy("global_chunk").collect()
    assert [(r.path, r.global_chunk, r.offset) for r in c] == [("a", 0, 0), ("a", 1, 2048)]
    assert packing.usable_prefix(shards, ["source"], ["path"], 2048).agg(F.sum("kept")).first()[0] == 4096
    assert packing.rebuilt_lengths(spark.createDataFrame([("d", 3), ("d", 4)], "domain string, n_tokens long"), spark.createDataFrame([("d", 9)], "domain string, packed long")).first().ok
    docs = spark.createDataFrame([("d", 0, "abc"), ("d", 1, "de"), ("d", 2, "f" * 9)], "g string, k long, text string")
    assert [(r.shard, r.n_docs, r.n_bytes) for r in sinks.byte_shards(docs, ["k"], "g", shard_tokens=10).collect()] == [(0, 2, 9), (1, 1, 10)]
    assert packing.byte_stream(docs, "g", ["k"]).count() == 3 and len(packing.attention_received([[1.0], [1.0]], [[1.0], [1.0]])) == 2
    assert sum(packing.attention_received([[1.0], [1.0]], [[1.0], [1.0]])) == pytest.approx(2)


def test_contracts(spark):
    side = spark.createDataFrame([("a", 2, "t", "u4", 9, 8, "d")], "path string, n_tokens long, tokenizer string, dtype string, eos_token_id long, bytes long, domain string")
    assert contracts.built_manifest(side).first().n_tokens == 2
    with pytest.raises(contracts.ContractError):
        contracts.built_manifest(side.union(side.withColumn("tokenizer", F.lit("other"))))
    pay = spark.createDataFrame([(1, 2, 1.0), (2, 1, float("nan"))], "step long, schema_version long, loss double")
    assert contracts.payload_violations(pay, ["loss"]).count() == 2
    status, rows = contracts.finalised(side.select("path"), side.limit(0))
    assert status.first().status == "missing"
    pub = spark.createDataFrame([("p", "1"), ("q", "2")], "dataset string, fingerprint string")
    assert contracts.dependency_violations(pub, spark.createDataFrame([("p", "9")], "dataset string, fingerprint string")).count() == 2
    layout = spark.createDataFrame([("a", "s", 0, 5), ("b", "s", None, 5)], "path string, source string, start long, n_tokens long")
    bad = contracts.layout_violations(layout, spark.createDataFrame([("x",)], "dataset_id string"), {"dataset_id": "y"})
    assert {r.reason for r in bad.collect()} == {"identity", "no start"}


def test_files_and_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "y")], "id long, dump string, text string")
    sinks.parquet_by(df, str(tmp_path / "h"))
    assert {r.dump for r in spark.read.parquet(str(tmp_path / "h")).collect()} == {"a", "unknown"}
    assert sinks.jsonl_zstd(df, str(tmp_path / "z")) == {"n_docs": 2, "n_chars": 2}
    assert sinks.jsonl_by_domain(df.withColumn("domain", F.lit("d")), str(tmp_path / "j")).first().n_docs == 2
    assert sinks.size_capped(df, ["id"], 30).select(F.max("shard")).first()[0] >= 1
    assert sinks.manifest(df, ["id"]).first().json.startswith('[{"dump":"a"')
    sinks.publish(df, str(tmp_path / "p"))
    sinks.publish(df, str(tmp_path / "p"), spark.read.parquet(str(tmp_path / "p")), "id")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    sinks.jsonl(df, str(tmp_path / "mix" / "one"))
    sinks.parquet(df, str(tmp_path / "mix" / "two"))
    assert readers.mixed(spark, str(tmp_path / "mix"), ["id", "text"]).count() == 4
    (tmp_path / "d.json").write_text('{"data": [{"text": "a"}, {"text": "b"}]}')
    (tmp_path / "d.tsv").write_text("text\tn\nhello\t1\n")
    (tmp_path / "d.txt").write_text("one\ntwo\n")
    assert [readers.records(spark, str(tmp_path / f"d.{k}")).first().text for k in ("json", "tsv", "txt")] == ["a", "hello", "one\ntwo\n"]
    assert readers.has_documents(df)[0] and not readers.has_documents(df.drop("text"))[0]
    (tmp_path / "m.json").write_text('[\n{"id": "1", "c": "x"},\n{"id": "1", "c": "y"},\n{"id": "2", "c": "z"}\n]\n')
    meta = readers.last_by_id(readers.metadata_lines(spark, str(tmp_path / "m.json"), "id string, c string"))
    assert {r.id: r.c for r in meta.collect()} == {"1": "y", "2": "z"}
    assert [(r.lo, r.hi) for r in readers.key_ranges(spark, 1, 10, 3).orderBy("lo").collect()] == [(1, 5), (5, 9), (9, 11)]
    import sqlite3

    with sqlite3.connect(tmp_path / "x.db") as db:
        db.execute("create table t (k integer, s text)")
        db.executemany("insert into t values (?, ?)", [(i, str(i)) for i in range(1, 11)])
    got = readers.sqlite_ranges(spark, str(tmp_path / "x.db"), "select k, s from t where k >= ? and k < ?", readers.key_ranges(spark, 1, 10, 3), "k long, s string")
    assert got.count() == 10
    assert readers.projected(df, "repo", ["body"]).count() == 2
    assert streams.epoch_order(df, "id", 2).count() == 4 and streams.migrated(df.select(F.col("id").alias("step"), F.lit(3).alias("tokens"))).first().n_tokens == 3
    w = spark.createDataFrame([("a", 1.0)], "domain string, p double")
    assert streams.adaptive_updates(w, [1, 2], lambda x, s: x, lambda x: x).count() == 1
    with pytest.raises(ValueError, match="finite"):
        streams.adaptive_updates(w, [1], lambda x, s: x, lambda x: x.withColumn("p", F.lit(float("nan"))))
    assert config.substituted("a ${B}", {"B": "c"}) == "a c"
    with pytest.raises(KeyError):
        config.substituted("${X}", {})
    names = spark.createDataFrame([("data/wiki/x.jsonl.gz", 3)], "p string, i long").select(tx.domain_of_path(F.col("p")), tx.shard_stem(F.col("i"), F.col("p")), tx.stable_name(F.col("p")), filters.is_data_file(F.col("p"))).first()
    assert names[0] == "wiki" and names[1].startswith("shard-00003-") and names[2] == "data_wiki_x.jsonl.gz" and names[3]
