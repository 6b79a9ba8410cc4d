"""Single operators on small tables with expected values, and against plain re-computation."""

import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sluice.functions import text as tx
from sluice.operators import aggregates as ag
from sluice.operators import contracts, filters, joins, mixing, packing, rules, selection, sets
from sluice.operators.prefix import accumulated
from sluice.sources import ranges, readers, sinks


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in zip(values, _types(values), strict=True)))
    return df.select(column.alias("x")).first()["x"]


def _types(values):
    kinds = {str: "string", int: "long", float: "double"}
    return [f"array<{kinds[type(v[0])]}>" if isinstance(v, list) else kinds[type(v)] for v in values.values()]


def test_flatten(spark):
    schema = "text string, messages array<struct<role:string,content:string>>"
    rows = [("", [("user", "Hi"), ("assistant", "Hello")]), ("", [("human", "2+2?"), ("gpt", "4"), ("critic", " ")]), ("already flat", None)]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(tx.flattened(F.col("messages"), F.col("text"))).collect()]
    assert got == ["User: Hi\n\nAssistant: Hello", "User: 2+2?\n\nAssistant: 4", "already flat"]


def test_document_text(spark):
    get = lambda s: one(spark, tx.document_text(F.col("o")), o=s)
    assert get('{"text": "", "content": "b"}') == "b"
    assert get('{"code": "x", "body": "y"}') == "x"
    assert get('{"p": "one", "q": "two", "n": 3}') == "one\ntwo"


@pytest.mark.parametrize(("source", "row", "keep"), [
    ("tulu-3", {"source": "ai2/WildGuardMix"}, False), ("tulu-3", {"source": "flan"}, True), ("tulu-3", {"source": "tulu-3-sft-personas-math"}, True),
    ("dolci", {"domain": "Safety"}, False), ("dolci", {"domain": "precise if"}, False), ("dolci", {"source_dataset": "Tool Use"}, False), ("dolci", {"domain": "math"}, True),
    ("openhermes-25", {"language": None}, True), ("openhermes-25", {"language": "EN"}, True), ("openhermes-25", {"language": "fr"}, False),
    ("smoltalk", {"config": "apigen-80k"}, False), ("hermes-3", {}, True),
])
def test_exclusion(spark, source, row, keep):
    names = ["source", "id", "domain", "source_dataset", "language", "config"]
    df = spark.createDataFrame([(source, *[row.get(n) for n in names])], "rule_source string, " + ", ".join(f"{n} string" for n in names))
    assert df.select(rules.keep_by_source(df.columns)).first()[0] is keep


def test_domains(spark):
    names = ["source", "id", "dataset", "category", "domain", "source_dataset", "config"]
    cases = [("smoltalk", {"config": "numina-cot-100k"}, "math"), ("tulu-3", {"source": "SciRIFF"}, "science"), ("tulu-3", {"source": "WildChat"}, "chat"), ("tulu-v2", {"dataset": "code_alpaca"}, "code"), ("tulu-v2", {"dataset": "unknown_slice"}, "general"), ("dolci", {"domain": " ", "source_dataset": "Python Algorithms"}, "code")]
    df = spark.createDataFrame([(s, *[r.get(n) for n in names]) for s, r, _ in cases], "rule_source string, " + ", ".join(f"{n} string" for n in names))
    assert [r[0] for r in df.select(rules.domain_by_source(df.columns)).collect()] == [c for *_, c in cases]
    with pytest.raises(Exception, match="unknown source"):
        df.withColumn("rule_source", F.lit("x")).select(rules.domain_by_source(df.columns)).collect()


def test_math_filters(spark):
    def keep(score, native, legacy=0):
        meta = '{"extraction_info": {"math_score": %s, "mathjax_inline_tex": %d, "codecogs_latex": %d}}' % (score, native, legacy)
        return one(spark, filters.web_math_relaxed(F.col("t"), tx.extraction_info(F.col("m"))), t="some text", m=meta)

    assert keep(0.72, 2) and not keep(0.71, 2) and not keep(0.72, 1) and not keep(0.72, 2, 3) and keep(0.72, 3, 3)
    cats = lambda f, c: one(spark, f(F.col("c")), c=c)
    assert cats(filters.pure_math, "math.AG math.NT") and not cats(filters.pure_math, "math.AG cs.LG") and not cats(filters.pure_math, "math.ST")
    assert cats(filters.primary_is_math, "math.PR,cs.LG") and not cats(filters.all_math, "")
    assert cats(filters.is_english, " English ") and not cats(filters.is_english, "fr")


def test_bibliography_and_noise(spark):
    strip = lambda t: one(spark, tx.strip_bibliography(F.col("t")), t=t)
    assert strip("a\n\\begin{thebibliography}x\\end{thebibliography} b") == "a\n b\n"
    assert strip("a \n\\bibliography{refs} tail") == "a\n"
    assert strip("plain") == "plain"
    noise = one(spark, tx.strip_latex_noise(F.col("t")), t="x\\begin{figure}f\\end{figure}\\includegraphics[w]{p}\n\n\n\ny \\section{Acknowledgments} thanks \\section{Next} z")
    assert "figure" not in noise and "thanks" not in noise and "Next" in noise and "\n\n\n" not in noise
    assert one(spark, tx.paper_id(F.col("t")), t="arXiv:1234.5678v2") == "1234.5678"


def test_metrics(spark):
    text = "The cat sat. A little one came home!"
    ratio, f = spark.createDataFrame([(text,)], "t string").select(tx.compression_ratio("t"), tx.flesch(F.col("t"))).first()
    assert ratio == pytest.approx(len(text) / len(zlib.compress(text.encode(), 6)))
    syllables = [1, 1, 1, 1, 2, 1, 1, 1]
    assert f == pytest.approx(206.835 - 1.015 * 8 / 2 - 84.6 * sum(syllables) / 8)
    div, rep = spark.createDataFrame([(" ".join(f"w{i}" for i in range(160)),), ("alpha beta " * 80,)], "t string").select(tx.mtld(tx.words(F.col("t")))).toPandas().iloc[:, 0]
    assert div > rep
    assert math.isnan(spark.createDataFrame([("",)], "t string").select(tx.flesch(F.col("t"))).first()[0])


def test_mark_spans(spark):
    df = spark.createDataFrame([("a b a b", ["a", "b", "zz", "b", "a"]), ("none", None)], "t string, s array<string>")
    got = [tuple(r[0]) for r in df.select(tx.mark_spans(F.col("t"), F.col("s"))).collect()]
    assert got == [("<FACT>a</FACT> <FACT>b</FACT> a <FACT>b</FACT>", 3), ("none", 0)]


def test_span_mask(spark):
    df = spark.createDataFrame([([(0, 3), (3, 5), (5, 8), (8, 10), (0, 0)], [(3, 8)])], "o array<struct<s:int,e:int>>, s array<struct<s:int,e:int>>")
    assert df.select(tx.span_mask(F.col("o"), F.col("s"))).first()[0] == [0, 1, 1, 0, 0]
    assert [tuple(x) for x in spark.createDataFrame([([(5, 9), (0, 2), (2, 4), (8, 12)],)], "s array<struct<s:int,e:int>>").select(sets.span_union(F.col("s"))).first()[0]] == [(0, 4), (5, 12)]
    bio = spark.createDataFrame([(["B", "I", "O", "I", "B"], [(0, 2), (2, 5), (5, 6), (6, 7), (7, 9)], "ab cd xyz")], "t array<string>, o array<struct<s:int,e:int>>, c string")
    assert [tuple(x) for x in bio.select(tx.bio_spans(F.col("t"), F.col("o"), F.col("c"))).first()[0]] == [(0, 5), (7, 9)]


def test_masks(spark):
    def mask(scores, valid, k, middle=False):
        df = spark.createDataFrame([(scores, valid)], "s array<double>, v array<boolean>")
        return df.select(selection.row_mask(F.col("s"), F.col("v"), k, middle)).first()[0]

    assert mask([float(i) for i in range(10)], [True] * 10, 0.6) == [0] * 4 + [1] * 6
    assert sum(mask([1.0, 2.0, 3.0], [True, False, True], 2 / 3)) == 1
    assert sum(mask([1.0] * 4, [True] * 4, 0.5)) == 2
    assert sum(mask([1.0, 2.0, 3.0], [True] * 3, 0.5)) == 2
    assert mask([1.0, 2.0], [False, False], 0.5) == [0, 0]
    assert mask([5.0, 1.0], [True, False], 0.1) == [1, 0]
    assert mask([float(i) for i in range(4)], [True] * 4, 0.5, True) == [0, 1, 1, 0]


def test_selection(spark):
    ten = spark.createDataFrame([(f"d{i}", float(i), 10) for i in range(10)], "id string, score double, n_tokens long")
    assert [r.id for r in selection.middle_mass(ten, "score", "n_tokens").orderBy("id").collect()] == [f"d{i}" for i in range(2, 8)]
    learn = spark.createDataFrame([("C", 1.0, 40), ("A", -2.0, 30), ("B", -0.5, 30)], "id string, s double, n long")
    assert {r.id for r in selection.top_fraction(learn, "s", "n", low_first=True).collect()} == {"A", "B"}
    filled = selection.fill_budget(spark.range(100).select("id", F.lit(5).alias("n")), "n", 50, ["id"])
    assert filled.agg(F.sum("n")).first()[0] == 50
    ladder = spark.createDataFrame([(300,), (250,), (0,)], "total long")
    assert [r.step for r in selection.checkpoint_ladder(ladder).where("total = 300").orderBy("step").collect()] == [0, 125, 300]
    with pytest.raises(ValueError, match="fraction"):
        selection.holdout(ten, "id", [], 0.5)
    for n, val in ((10000, 15), (1000, 2), (1, 0)):
        split = selection.holdout(spark.range(n).withColumn("g", F.lit(1)), "id", ["g"])
        assert split.where("split = 'val'").count() == val


def test_trim_budget_is_the_sequential_rule(spark):
    rnd = random.Random(4)
    docs = [(g, i, rnd.choice([1, 5, 30, 80])) for g in range(20) for i in range(rnd.randrange(1, 60))]
    budget, want = 500, set()
    for g in range(20):
        kept = 0
        for _, i, n in sorted(x for x in docs if x[0] == g):
            if kept >= budget:
                break
            if kept >= int(budget * 0.98) and kept + n > int(budget * 1.02):
                continue
            kept += n
            want.add((g, i))
    df = spark.createDataFrame(docs, "g long, id long, n long")
    assert {(r.g, r.id) for r in selection.trim_budget(df, "n", budget, ["id"], ["g"]).collect()} == want


def test_two_phase_sums_equal_one_window(spark):
    df = spark.range(1000).select("id", (F.xxhash64("id") % 50).alias("n"))
    plain = accumulated(df, ["n", "id"], "n").orderBy("id").collect()
    split = accumulated(df, ["n", "id"], "n", single_task_rows=10, ranges=7).select(*plain[0].asDict()).orderBy("id").collect()
    assert plain == split


def test_allocation(spark):
    rows = [(0, "a", 0.5), (0, "b", 0.3), (0, "c", 0.2), (0, "z", 0.0)]
    got = {r.domain: r.n_sequences for r in mixing.allocated(spark.createDataFrame(rows, "mix_id int, domain string, weight double"), 7, ["mix_id"]).collect()}
    assert got == {"a": 4, "b": 2, "c": 1, "z": 0}
    a = spark.createDataFrame([("x", "f", 1.0), ("x", "g", 0.0), ("y", "f", 0.0), ("y", "g", 1.0), ("z", "f", 0.0), ("z", "g", 0.0)], "domain string, family string, a double")
    p = {r.domain: r.p for r in mixing.skill_update(a, spark.createDataFrame([("f", 2.0), ("g", 0.5)], "family string, loss double")).collect()}
    z = [math.exp(v) for v in (0.4, 0.1, 0.0)]
    assert [p[d] for d in "xyz"] == pytest.approx([v / sum(z) for v in z])
    assert ag.ema_weights(4, 0.8) == pytest.approx([0.512, 0.128, 0.16, 0.2])


def test_step_law(spark):
    rows = [("r", "f", s, 2.0 + 5.0 * s**-0.5) for s in range(120, 1441, 120)] + [("r", "g", 1, 2.0)]
    got = {r.family: r for r in mixing.step_laws(spark.createDataFrame(rows, "run_name string, family string, step long, loss double"), 2400).collect()}
    assert got["f"].l_inf == pytest.approx(2.0, abs=1e-3) and got["f"].extrapolated == pytest.approx(2 + 5 * 2400**-0.5, abs=1e-3)
    assert got["g"].l_inf is None


def test_joins_and_contracts(spark):
    a = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0), ("c", "y", 3.0)], "id string, domain string, m double")
    b = spark.createDataFrame([("a", "z", 9.0), ("b", None, 8.0), ("d", "z", 7.0)], "id string, domain string, m double")
    assert {(r.id, r.domain, r.m) for r in joins.joined_labels(a, b).collect()} == {("a", "x", 9.0), ("b", "x", 8.0)}
    c = joins.coverage(a, b).first()
    assert (c.n_joined, c.n_left_only, c.n_right_only) == (2, 1, 1)
    manifest = spark.createDataFrame([("a.u32le.bin", 10, "t", "u4"), ("../b.u32le.bin", 5, "t", "u4"), ("c.npy", 5, "t", "u4")], "path string, n_tokens long, tokenizer string, dtype string")
    files = spark.createDataFrame([("a.u32le.bin", 40), ("../b.u32le.bin", 20), ("c.npy", 22), ("stray.npy", 4)], "path string, bytes long")
    reasons = {r.reason for r in contracts.manifest_violations(manifest, files, 21).collect()}
    assert {"path escapes", "not listed", "not whole tokens", "wrong total"} <= reasons
    with pytest.raises(contracts.ContractError):
        contracts.require(contracts.manifest_violations(manifest, files, 21), "manifest")
    gaps = spark.createDataFrame([("s", 0, 5), ("s", 6, 2)], "source string, start long, n_tokens long")
    assert selection.offset_gaps(gaps).count() == 1


def test_packing(spark):
    docs = spark.createDataFrame([("d", [10, 11, 12, 2], [0, 1, 1, 0]), ("e", [5, 2], [0, 0])], "id string, ids array<int>, mask array<int>")
    row = packing.packed(docs, "ids", "mask", 4, ["id"]).collect()
    assert [(r.row, r.input_ids, r.loss_mask) for r in row] == [(0, [10, 11, 12, 2], [0, 1, 1, 0])]
    n = spark.createDataFrame([(x,) for x in (2048, 2049, 4096, 4097, 0, 2047, 5000)], "n long")
    assert [r[0] for r in n.select(packing.n_chunks(F.col("n"))).collect()] == [0, 1, 1, 2, 0, 0, 2]


def test_files(spark, tmp_path):
    import gzip

    import zstandard

    lines = b'{"text": "one"}\n\n{"content": "two"}\n{"n": 1}\n'
    (tmp_path / "a.jsonl").write_bytes(lines)
    (tmp_path / "b.jsonl.gz").write_bytes(gzip.compress(lines))
    (tmp_path / "c.jsonl.zst").write_bytes(zstandard.compress(lines))
    for name in ("a.jsonl", "b.jsonl.gz", "c.jsonl.zst"):
        assert [(r.line_index, r.text) for r in readers.documents_strict(spark, str(tmp_path / name)).orderBy("line_index").collect()] == [(0, "one"), (2, "two")]
    (tmp_path / "bad.jsonl").write_bytes(lines + b"{oops\n")
    assert readers.documents_tolerant(spark, str(tmp_path / "bad.jsonl")).count() == 2
    with pytest.raises(Exception, match="bad JSON"):
        readers.documents_strict(spark, str(tmp_path / "bad.jsonl")).collect()
    ids = spark.createDataFrame([(0, [1, 2, 3]), (1, [4, 5])], "k int, ids array<int>")
    shards = sinks.token_shards(ids, "ids", ["k"], 4, eos=9).orderBy("shard").collect()
    assert [bytes(r.content) for r in shards] == [sinks.u32le([1, 2, 3, 9]), sinks.u32le([4, 5, 9])]
    (tmp_path / "t.bin").write_bytes(bytes(shards[0].content))
    assert ranges.token_ranges(spark, str(tmp_path / "t.bin")).first().ids == [1, 2, 3, 9]
    assert readers.token_counts(spark, str(tmp_path / "t.bin")).first().n_tokens == 4
    log = spark.createDataFrame([("f", i, v) for i, v in enumerate(["x", "step=5", " loss: 1.5", "junk here", "step=6", "loss: 1.25"])], "path string, line_index long, value string")
    assert [(r.step, r.value) for r in readers.log_points(log).orderBy("step").collect()] == [(5, 1.5), (6, 1.25)]


def test_streams(spark, tmp_path):
    from sluice.streaming import streams

    src, out = tmp_path / "in", str(tmp_path / "out")
    spark.createDataFrame([("a", 1.0, 2, 2), ("b", 5.0, 1, 2), ("a", 3.0, 4, 2)], "id string, loss double, n_tokens long, n_total int").write.parquet(str(src))
    stream = spark.readStream.schema("id string, loss double, n_tokens long, n_total int").parquet(str(src))
    q = streams.accumulate_segments(stream).writeStream.format("memory").queryName("acc").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    assert [(r.id, r.n_loss_tokens, r.sum_loss) for r in spark.table("acc").collect()] == [("a", 6, 4.0)]
    evals = tmp_path / "evals"
    evals.mkdir()
    (evals / "s1.json").write_text('{"step": 1, "labels": {"x": 1.0, "y": 3.0}}')
    (evals / "s2.json").write_text('{"step": 2, "labels": {"x": 1.0}}')
    q = streams.poll_evaluations(spark, str(evals), 2).writeStream.format("memory").queryName("ev").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    assert [(r.step, r.macro) for r in spark.table("ev").collect()] == [(1, 2.0)]
    q = streams.ingest_until(spark.readStream.schema("id string, loss double, n_tokens long, n_total int").parquet(str(src)), out, str(tmp_path / "c3"), 100)
    q.awaitTermination()
    assert spark.read.parquet(out).count() == 3
