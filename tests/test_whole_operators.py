"""Fits and searches, readers with fallbacks, tokenizers, pollers and metric logs."""

from __future__ import annotations

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.operators import mixing, packing, selection
from sluice.sources import ranges, readers
from sluice.streaming import streams


def pilots(n=24, seed=0):
    rng = np.random.default_rng(seed)
    t = rng.dirichlet(np.ones(3), n)
    return t, 1.0 + 0.6 * np.exp(t @ np.array([-2.0, 0.5, 1.0]))


def test_trees_learn_steps_and_bound_their_leaves():
    rng = np.random.default_rng(1)
    x = rng.random((60, 3))
    y = np.where(x[:, 1] > 0.5, 2.0, 1.0) + np.where(x[:, 0] > 0.3, 0.5, 0.0)
    model = mixing.Trees(leaves=4, depth=2, min_rows=3, rate=0.2, ridge=0.1, rounds=60).fit(x, y)
    assert np.abs(model.predict(x) - y).max() < 0.05
    assert all(len(t) <= 4 and all(len(p) <= 2 for p, _ in t) for t in model.trees)
    assert mixing.Trees(rounds=3).fit(x[:2], y[:2]).predict(x[:2]) == pytest.approx([y[:2].mean()] * 2)


def test_surrogate_grid(spark):
    t, y = pilots(10)
    rows = [(f"r{i}", f, float(v + 0.1 * (f == "b")), *map(float, w)) for f in ("a", "b") for i, (w, v) in enumerate(zip(t, y, strict=True))]
    df = spark.createDataFrame(rows, "run_name string, family string, loss double, d0 double, d1 double, d2 double")
    grid = {"leaves": (3,), "depth": (2,), "min_rows": (2, 4), "rate": (0.1,), "ridge": (0.1,), "rounds": (20,)}
    got = mixing.surrogate_grid(df, ["d0", "d1", "d2"], grid=grid).collect()
    order = np.argsort([f"r{i}" for i in range(10)])
    for r in got:
        left = [float(mixing.Trees(3, 2, int(r.min_rows), 0.1, 0.1, 20).fit(np.delete(t[order], i, 0), np.delete(y[order], i)).predict(t[order][i : i + 1])[0]) - y[order][i] for i in range(10)]
        assert r.mean_rmse == pytest.approx(np.sqrt(np.mean(np.square(left)))) and r.macro_rmse == pytest.approx(r.mean_rmse)
    assert len(got) == 2 and got[0].macro_rmse <= got[1].macro_rmse


# --- sources ---


def test_metadata_in_lines_lists_and_whole_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n{"id": "1", "c": "x"},\n{"id": "2", "c": "y"}\n]\n')
    (tmp_path / "b.json").write_text('[{"id": "3",\n "c": "z"}, {"id": "4",\n"c": "w"}]')
    (tmp_path / "c.json").write_text('{"id":\n "5", "c": "v"}')
    got = readers.metadata_documents(spark, str(tmp_path), "id string, c string")
    assert {(r.id, r.c) for r in got.collect()} == {("1", "x"), ("2", "y"), ("3", "z"), ("4", "w"), ("5", "v")}


def test_fallback_ids_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(None, f"t{i}") for i in range(30)] + [("own", "x"), (None, "  ")], "id string, body string")
    a, b = ({(r.id, r.text) for r in readers.projected(x, "repo", ["body"]).collect()} for x in (df, df.repartition(7)))
    assert a == b and len(a) == 31 and ("own", "x") in a


def test_instruct_rows_fall_back(spark, tmp_path):
    other = spark.createDataFrame([("remote",)], "text string")
    assert readers.instruct_rows(spark, str(tmp_path / "none"), "text string", other).first().text == "remote"
    (tmp_path / "s.jsonl").write_text("\n".join(json.dumps({"text": "local " * 50}) for _ in range(8)) + "\nnot json\n")
    assert readers.instruct_rows(spark, str(tmp_path), "text string", other).count() == 8
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "manifest.jsonl").write_text('{"path": "data/web/1.jsonl.gz", "bytes": 7}\n{"path": "data/web/x.txt", "size": 3}\n')
    assert [tuple(r) for r in readers.manifest_listing(spark, str(tmp_path / "m" / "manifest.jsonl")).collect()] == [("data/web/1.jsonl.gz", 7, "web")]
    got = list(readers.batches(spark.range(5).withColumn("x", F.lit("a")), ["id"], 2))
    assert [b.num_rows for b in got] == [2, 2, 1] and got[0].schema.names == ["id"]


def test_token_files_are_sniffed(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(np.arange(1, 9, dtype="<u2").tobytes())
    (tmp_path / "b.bin").write_bytes(np.arange(1, 9, dtype="<u4").tobytes())
    got = {r.path[-5:]: r.ids for r in ranges.token_ranges(spark, str(tmp_path), None).collect()}
    assert got == {"a.bin": list(range(1, 9)), "b.bin": list(range(1, 9))}


# --- tokens ---


def test_vocabularies_of_three_kinds(spark):
    vocab = pytest.importorskip("public_tokenizers")
    tokenizers, tiktoken = pytest.importorskip("tokenizers"), pytest.importorskip("tiktoken")
    texts = ["Hello wörld", "", None, "a  b\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    own = tokenizers.Tokenizer.from_file(vocab.path("byte_bpe_50k.json"))
    ids = packing.tokenised(df, tokenizer=packing.tokenizer_ids(vocab.path("byte_bpe_50k.json")), eos=7).orderBy("i").collect()
    assert [r.ids for r in ids] == [[*own.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]
    ranks = packing.tokenised(df, tokenizer=packing.tokenizer_ids(vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN), skip_empty=True)
    assert ranks.count() == 2 and tiktoken
    rows = spark.createDataFrame([([1, 2, 3], [0, 1, 0])], "input_ids array<int>, loss_mask array<int>")
    assert packing.training_rows(rows).first().labels == [1, -100, 3]


def test_usable_content_and_attention(spark):
    shards = spark.createDataFrame([("d", i, bytearray(np.arange(10 * i, 10 * i + 5, dtype="<u4").tobytes())) for i in range(3)], "domain string, k int, content binary")
    got = packing.usable_content(shards, ["domain"], ["k"], 4).orderBy("k").collect()
    assert b"".join(bytes(r.content) for r in got) == np.array([*range(5), *range(10, 15), 20, 21], "<u4").tobytes()
    q = [[0.1, 0.2], [0.3, -0.1], [1.0, 0.0]]
    df = spark.createDataFrame([(q, q), (None, None)], "q array<array<double>>, k array<array<double>>")
    got = [r.a for r in df.select(packing.attention_of_rows("q", "k").alias("a")).collect()]
    assert got[0] == pytest.approx(packing.attention_received(q, q)) and got[1] == [] and sum(got[0]) == pytest.approx(3)


def test_buffered_shuffle_stays_in_its_buffer(spark):
    got = {r.id: r.position for r in selection.buffered_shuffle(spark.range(50), ["id"], "id", 8).collect()}
    assert sorted(got.values()) == list(range(50)) and all(p // 8 == i // 8 for i, p in got.items()) and any(p != i for i, p in got.items())


# --- streams ---


def test_incomplete_suites_are_read_again(spark, tmp_path):
    folder, sink = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    write = lambda step, labels: (folder / f"step{step}.json").write_text(json.dumps({"step": step, "labels": labels}))
    write(1, {"a": 1.0, "b": 3.0})
    write(2, {"a": 1.0})
    assert streams.poll_into(spark, str(folder), sink, 2) == 1
    write(2, {"a": 1.0, "b": 5.0})
    assert streams.poll_into(spark, str(folder), sink, 2) == 1 and streams.poll_into(spark, str(folder), sink, 2) == 0
    assert {(r.step, r.macro) for r in spark.read.parquet(sink).collect()} == {(1, 2.0), (2, 3.0)}


def test_epochs_have_no_end_and_logs_only_grow(spark, tmp_path):
    three = list(itertools.islice(streams.epochs(spark.range(10), "id", 4), 3))
    orders = [[r.id for r in e.orderBy("position").collect()] for e in three]
    assert all(len(o) == 8 == len(set(o)) for o in orders) and orders[0] != orders[1]
    rows = lambda *r: spark.createDataFrame(r, "run_name string, step long, n_tokens long")
    log = str(tmp_path / "log")
    streams.log_metrics(rows(("r", 1, 5), ("r", 2, 6), ("q", 1, 1)), log)
    streams.log_metrics(rows(("r", 3, 1)), log)
    assert {(r.run_name, r.step, r.total_tokens) for r in spark.read.json(log).collect()} == {("r", 1, 5), ("r", 2, 11), ("q", 1, 1), ("r", 3, 12)}
    for bad in (("r", 3, 1), ("r", 4, -1)):
        with pytest.raises(streams.CounterError):
            streams.log_metrics(rows(bad), log)
    with pytest.raises(streams.CounterError):
        streams.log_metrics(rows(("n", 1, 1), ("n", 1, 1)), log)
    assert spark.read.json(log).count() == 4


def test_listings_curves_and_fixtures(spark, tmp_path):
    for name, text in (("data/web/1.jsonl", "{}"), ("data/web/2.parquet", "xyz"), ("data/code/1.json.gz", "1"), ("data/code/readme.md", "no")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = [(r.path.rsplit("/", 1)[-1], r["size"], r.domain) for r in readers.shard_listing(spark, str(tmp_path / "data")).collect()]
    assert got == [("1.json.gz", 1, "code"), ("1.jsonl", 2, "web"), ("2.parquet", 3, "web")]
    run = tmp_path / "runs" / "r7" / "eval"
    run.mkdir(parents=True)
    rows = [{"step": 5, "task_loss_bpb": {"arc": 1.0}}, {"step": 10, "task_loss_bpb": {"arc": 0.9, "mmlu": 2.0}}, {"step": 10, "task_loss_bpb": {"arc": 0.8}}, {"other": 1}]
    (run / "curve.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert {tuple(r) for r in readers.curves(spark, str(tmp_path / "runs")).collect()} == {("r7", 5, "arc", 1.0), ("r7", 10, "arc", 0.8)}
    assert [r.run_name for r in readers.missing_runs(spark.createDataFrame([("r7",), ("r8",)], "run_name string"), readers.curves(spark, str(tmp_path / "runs"))).collect()] == ["r8"]
    (tmp_path / "fixture.json").write_text('{"a": 1, "_config": "x"}\n{"a": 2}')
    assert [(r.a, r.config) for r in readers.fixtures(spark, str(tmp_path / "fixture.json")).orderBy("a").collect()] == [(1, "x"), (2, None)]
    (tmp_path / "parts").mkdir()
    (tmp_path / "parts" / "a.jsonl").write_text("x" * 2000 + "\n")
    (tmp_path / "parts" / "b.jsonl").write_text("small\n")
    assert readers.snapshots(spark, str(tmp_path / "parts")).count() == 1
