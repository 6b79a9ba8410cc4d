"""What tables at size showed: memory of Python workers, tasks of readers, trees of digests."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluice.functions import text as tx
from sluice.operators import packing, permutation
from sluice.sources import files, ranges, readers, sinks


def test_byte_ids_hold_a_piece_at_once(spark):
    """ids of a batch of texts came as one list of Python numbers."""
    texts = ["é" * 3000, None, ""] * 3000
    parts = list(tx.byte_ids.func(iter([pa.array(texts)])))
    assert max(len(p.flatten()) for p in parts) <= tx.PIECE_BYTES + 6000 and len(parts) > 3
    assert [len(x) for p in parts for x in p.to_pylist()] == [6000, 0, 0] * 3000
    got = spark.createDataFrame([(0, "aé"), (1, None), (2, "")], "k int, t string").select("k", packing.byte_tokens(F.col("t")).alias("x")).orderBy("k").collect()
    assert [r.x for r in got] == [[97, 0xC3, 0xA9], [], []]


@pytest.mark.parametrize("name", ["packed_contents", "pack_rows"])
def test_packed_rows_are_shuffled_as_bytes(spark, sf_dir, name):
    """rows were sorted, shuffled and spelled as arrays of ids."""
    from sluice.plans import registry

    plan = registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "lambdafunction" not in plan


def test_packed_raw_is_packed(spark):
    docs = spark.createDataFrame([(s, k, [256 - k] * n) for s in "ab" for k, n in enumerate([3, 0, 40, 1, 16, 700, 5])], "s string, k int, ids array<int>")
    want = {(r.s, r.row): r.input_ids for r in packing.packed(docs, "ids", None, 16, ["k"], ["s"]).collect()}
    got = {(r.s, r.row): np.frombuffer(r.content, ">u2").tolist() for r in packing.packed_raw(docs, "ids", 16, ["k"], ["s"], ">u2").collect()}
    assert got == want and len(got) == 2 * (765 // 16)


def test_token_shards_shuffle_bytes(spark):
    """shards went through Python group by group, as ids."""
    docs = spark.createDataFrame([(k, list(range(k, k + 700))) for k in range(20)], "k int, ids array<int>")
    out = sinks.token_shards(docs, "ids", ["k"], 1000, dtype="<u2")
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = out.orderBy("shard").collect()
    want = np.concatenate([np.arange(k, k + 700) for k in range(20)]).astype("<u2")
    assert b"".join(bytes(r.content) for r in rows) == want.tobytes() and [r.n_tokens for r in rows] == [1000] * 14


def test_many_token_files_take_few_tasks(spark, tmp_path):
    """each file was opened to plan and had a task for each run."""
    ids = np.arange(4000)
    for i in range(600):
        (tmp_path / f"{i:03d}.bin").write_bytes((ids + 100 * i).astype("<u4").tobytes())
    rows = ranges.token_ranges(spark, str(tmp_path), None, 1000, 1024)
    assert rows.rdd.getNumPartitions() <= 2 * ranges.TASKS  # files are not split to fill tasks
    got = rows.orderBy("path", "start").collect()
    assert [r.ids[0] for r in got] == [100 * i + s for i in range(600) for s in range(0, 4000, 1000)] and {len(r.ids) for r in got} == {1000}


def test_token_counts_list_folders_once(spark, tmp_path):
    """each file that the pattern names was listed as a path of its own."""
    for name in ("a/x.bin", "b/y.bin", "b/c/z.bin", "a/x.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"0" * 8)
    for root in (str(tmp_path), f"file://{tmp_path}"):
        out = readers.token_counts(spark, f"{root}/*/*.bin")
        assert sorted((r.path.rpartition("/")[2], r.n_tokens) for r in out.collect()) == [("x.bin", 2), ("y.bin", 2)]
        assert "(1 paths)" in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [3, 10, 101, 1001])
def test_fingerprint_of_two_levels(spark, n):
    """over fan * fan rows the tree got a third level, under fan rows it had one."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = [sha('{"id":%d}' % i) for i in range(n)]
    want = sha("\n".join(sha("\n".join(rows[a : a + 10])) for a in range(0, n, 10)))
    assert packing.fingerprint(spark.range(n), ["id"], ["id"], 10, levels=2).first()[0] == want


def test_stems_of_long_numbers(spark, tmp_path):
    """the query's SQL cuts numbers to five digits, the operator keeps all, of longs as well."""
    import duckdb

    from sluice.plans import registry

    spark.createDataFrame([(i, "a") for i in (7, 99_999, 100_000, 1_234_567, 5_000_000_000)], "doc_id long, source string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, registry.QUERIES["shard_stems"](spark, str(tmp_path)).collect())) == sorted(db.execute(registry.ORACLE_SQL["shard_stems"]).fetchall())
    assert spark.range(1).select(tx.shard_stem(F.lit(5_000_000_000), F.lit("a"))).first()[0].startswith("shard-5000000000-")


def test_zstandard_files_are_written_by_frames(spark, tmp_path):
    """a task held a whole file before it wrote it."""
    rows = spark.createDataFrame([("a", b"1", True), ("a", b"2", True), ("a", b"3", False), ("b", b"4", False)], "name string, content binary, more boolean").coalesce(1)
    assert files.write(rows, str(tmp_path / "p")) == 2
    assert (tmp_path / "p" / "a").read_bytes() == b"123" and (tmp_path / "p" / "b").read_bytes() == b"4"
    with pytest.raises(Exception, match="without its last piece"):
        files.write(rows.where("name = 'a' AND more"), str(tmp_path / "q"))


def test_permutation_by_batches(spark):
    """each row's rounds were interpreted; nulls stay null."""
    n = 1000
    df = spark.range(n).select("id", permutation.permuted(F.col("id"), n, 5).alias("p"))
    assert "lambdafunction" not in df._jdf.queryExecution().optimizedPlan().toString()
    a, b = permutation.grid(n)

    def once(v):
        x, y = divmod(v, b)
        for r, key in enumerate(permutation.keys(5)):
            mix = lambda z, key=key: (((z % permutation.M + key) % permutation.M * permutation.A % permutation.M + 12_345) * permutation.B) % permutation.N
            x, y = (x, (y + mix(x) % b) % b) if r % 2 else ((x + mix(y) % a) % a, y)
        return x * b + y

    for r in df.collect():
        v = once(r.id)
        while v >= n:
            v = once(v)
        assert r.p == v
    assert spark.range(1).select(permutation.permuted(F.lit(None).cast("long"), n)).first()[0] is None


def test_long_words_do_not_widen_all_words():
    """one long word gave each word of its text as much room."""
    import tracemalloc

    words = [f"w{i % 700}" for i in range(20_000)] + ["x" * 20_000]
    tracemalloc.start()
    got = tx._mtld(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6 and got == tx._mtld([*words[:-1], "y"])


@pytest.mark.parametrize("name", ["toxic", "quality"])
def test_classifiers_learn_from_all_labelled_rows(spark, name):
    """F8: rows beyond a limit, and texts beyond a number of bytes, were not learnt from."""
    from sluice.llm import common, quality, toxicity

    docs = spark.range(400).select("id", F.concat(F.lit("word number "), F.col("id") % 7, F.when(F.col("id") % 3 == 0, " vile").otherwise(" fine")).alias("text")).withColumnRenamed("id", "doc_id")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias(name))
    want = labels.where(common.fold("doc_id") != 0).count()
    rows = common.labelled(docs.union(docs), labels.union(labels), name, 50)
    got = [r.doc_id for r in rows.collect()]
    assert len(got) == len(set(got)) == want and rows.rdd.getNumPartitions() == -(-want // 50)
    module = {"toxic": toxicity, "quality": quality}[name]
    few, one = (module.fit(docs, labels, n) for n in (50, 10_000))
    for model in (few, one):
        assert all(r.predicted == (r.doc_id % 3 == 0) for r in module.scored(docs, model, *([0.5] if name == "quality" else [])).collect())
    again = module.fit(docs.repartition(5), labels, 50)
    assert (few.table if name == "toxic" else few.weights).tobytes() == (again.table if name == "toxic" else again.weights).tobytes()


def test_cuts_are_of_all_calibration_rows(spark, monkeypatch):
    """F8: the cuts by running sums of Spark are those of all scores in one array."""
    from sluice.llm import toxicity

    rng = np.random.default_rng(4)
    y = (rng.random(3000) < 0.3).astype(int)
    z = np.round(rng.normal(0, 1, 3000) + y, 2)
    lang = np.array(["de", "en"])[rng.integers(0, 2, 3000)]
    monkeypatch.setattr(toxicity, "SINGLE_TASK_VALUES", 100)
    rows = spark.createDataFrame([(a, float(b), c) for a, b, c in zip(y.tolist(), z, lang.tolist(), strict=True)], "y int, z double, lang string").select("lang", "z", "y")
    slope, shift, by_lang = toxicity._cuts(rows.groupBy("lang", "z").agg(F.count("*").alias("n"), F.sum("y").alias("hits")))

    def plain(z, y):
        f1 = {c: 2 * y[z >= c].sum() / ((z >= c).sum() + y.sum()) for c in np.unique(z)}
        best = max(f1, key=lambda c: (f1[c], c))
        return (best + max(c for c in f1 if c < best)) / 2

    assert slope == pytest.approx(6 / (z[y == 1].mean() - z[y == 0].mean())) and -shift / slope == pytest.approx(plain(z, y))
    for k in ("de", "en"):
        assert by_lang[k] == pytest.approx(1 / (1 + np.exp(-(slope * plain(z[lang == k], y[lang == k]) + shift))))


def test_texts_are_cut_into_segments_as_bytes(spark, tmp_path):
    """a text's bytes went to Python and came back as numbers, to be cut; the parts are those of the id arrays."""
    from sluice.plans import operator_queries, registry  # noqa: F401

    texts = [None, "", "a", "ab", "é", "x" * 511, "x" * 512, "x" * 513, "y" * 1023, "z€" * 700]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for n in (2, 3, 512):
        own = docs.select(packing.segments(packing.byte_tokens(F.col("text")), n).alias("ids"), packing.byte_segments(F.col("text"), n).alias("raw"))
        assert all([bytes(x) for x in r.ids] == [bytes(x) for x in r.raw] for r in own.collect())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("overlapping_segments", "segment_contents"):
        assert "Python" not in registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    got = registry.QUERIES["overlapping_segments"](spark, str(tmp_path))
    assert {r.doc_id: r.n_segments for r in got.collect()} == {k: len(range(0, max(len((x or "").encode()) - 1, 0), 511)) for k, x in enumerate(texts)}
