"""Registered queries of the library over the driver's tables, whole, and their DuckDB equivalents.

Tokens are UTF-8 bytes, seeded orders are MD5 of seed and id, floats are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.functions import text as tx
from sluice.operators import aggregates as ag
from sluice.operators import contracts, filters, joins, mixing, packing, rules, selection, sets
from sluice.operators.prefix import accumulated

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("tok", F.octet_length("text"))


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def r6(c):
    return F.round(c, 6)


# --- samples, reports ---


@query("SELECT doc_id, source FROM documents WHERE ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 10 = 0")
def md5_sample(spark, d):
    return documents(spark, d).where(filters.md5_sample(F.col("doc_id"), 10)).select("doc_id", "source")


@query("SELECT count(*) AS n_docs, sum(strlen(text))::BIGINT AS n_tokens, round(avg(strlen(text)), 6) AS avg_tokens, quantile_cont(strlen(text), 0.5) AS p50_tokens, round(quantile_cont(strlen(text), 0.95), 6) AS p95_tokens, abs(sum(strlen(text)) - 2500000) / 2500000 <= 0.5 AS on_target FROM documents")
def corpus_qa(spark, d):
    out = ag.quality_report(documents(spark, d), "tok")
    return out.select("n_docs", "n_tokens", r6("avg_tokens").alias("avg_tokens"), "p50_tokens", r6("p95_tokens").alias("p95_tokens"), ag.within(F.col("n_tokens"), 2_500_000.0, 0.5).alias("on_target"))


@query("SELECT count(*) AS n_docs, coalesce(sum(strlen(text)), 0)::BIGINT AS n_tokens FROM documents WHERE lang = 'xx'")
def empty_totals(spark, d):
    return ag.totals(documents(spark, d).where("lang = 'xx'"), "tok")


@query("SELECT source, count(*) AS n_docs, sum(strlen(text))::BIGINT AS n_tokens, round(sum(strlen(text)) / sum(sum(strlen(text))) OVER (), 6) AS share FROM documents GROUP BY source")
def source_shares(spark, d):
    out = ag.by_group(documents(spark, d), "source", "tok")
    return out.withColumn("share", r6(F.col("n_tokens") / F.sum("n_tokens").over(Window.partitionBy())))


# --- text metrics ---

FLESCH = r"""
w AS (SELECT doc_id, source, strlen(text) AS tok, regexp_extract_all(text, '[A-Za-z]+(?:''[A-Za-z]+)?|[A-Za-z]*[0-9]+[A-Za-z0-9]*') AS ws, greatest(1, len(regexp_extract_all(text, '[.!?]+'))) AS ns FROM documents),
y AS (SELECT *, list_transform(ws, lambda v: CASE WHEN len(v) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(CASE WHEN lower(v) LIKE '%e' AND lower(v) NOT LIKE '%le' THEN substr(lower(v), 1, len(v) - 1) ELSE lower(v) END, '[aeiouy]+'))) END) AS sy FROM w),
f AS (SELECT doc_id, source, tok, len(ws) AS n_words, 206.835 - 1.015 * (len(ws) / ns) - 84.6 * (list_sum(sy) / len(ws)) AS flesch FROM y WHERE len(ws) > 0)"""


def fleschs(spark, d):
    return documents(spark, d).select("doc_id", "source", "tok", F.size(tx.words(F.col("text"))).alias("n_words"), tx.flesch(F.col("text")).alias("flesch")).where(filters.is_usable(F.col("flesch")))


@query(f"WITH {FLESCH} SELECT doc_id, n_words::INTEGER AS n_words, round(flesch, 6) AS flesch FROM f")
def flesch_scores(spark, d):
    return fleschs(spark, d).select("doc_id", "n_words", r6("flesch").alias("flesch"))


@query(f"WITH {FLESCH} SELECT doc_id, row_number() OVER (ORDER BY round(flesch, 9) DESC, doc_id) - 1 AS rank FROM f")
def difficulty_rank(spark, d):
    own = fleschs(spark, d).withColumn("flesch", F.round("flesch", 9))
    return selection.difficulty_rank(own, "flesch", "doc_id", easy_is_high=True).select("doc_id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {FLESCH}, r AS (SELECT doc_id, source, row_number() OVER (ORDER BY round(flesch, 9) DESC, doc_id) AS k, count(*) OVER () AS n FROM f) SELECT r.doc_id, k - 1 AS rank, lang FROM r JOIN documents USING (doc_id) WHERE k <= greatest(1, floor(n * 0.2))")
def curriculum_top20(spark, d):
    ids = selection.curriculum(fleschs(spark, d).withColumn("flesch", F.round("flesch", 9)), "flesch", "doc_id", 0.2, descending=True)
    return joins.materialised(table(spark, d, "documents").select("doc_id", "lang"), ids, "doc_id").select("doc_id", F.col("rank").cast("long").alias("rank"), "lang")


@query(f"WITH {FLESCH}, c AS (SELECT doc_id, tok, sum(tok) OVER (ORDER BY round(flesch, 9), doc_id) AS incl, sum(tok) OVER () AS t FROM f) SELECT doc_id, tok::INTEGER AS tok FROM c WHERE incl - tok / 2 >= 0.2 * t AND incl - tok / 2 < 0.8 * t")
def middle_token_mass(spark, d):
    return selection.middle_mass(fleschs(spark, d).withColumn("flesch", F.round("flesch", 9)), "flesch", "tok", "doc_id").select("doc_id", "tok")


# --- budgets, samples, splits ---


@query("WITH j AS (SELECT doc_id, quality, strlen(text) AS tok FROM documents JOIN labels USING (doc_id)), c AS (SELECT *, sum(tok) OVER (ORDER BY quality DESC, doc_id) - tok AS excl, sum(tok) OVER () AS t FROM j) SELECT doc_id, tok::INTEGER AS tok FROM c WHERE excl < ceil(t * 0.6)")
def top_token_fraction(spark, d):
    j = joins.joined_labels(documents(spark, d).select("doc_id", "tok"), table(spark, d, "labels"), "doc_id")
    return selection.top_fraction(j, "quality", "tok", "doc_id").select("doc_id", "tok")


@query("WITH c AS (SELECT source, doc_id, strlen(text) AS tok, sum(strlen(text)) OVER w AS incl FROM documents WHERE lang = 'en' WINDOW w AS (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id ROWS UNBOUNDED PRECEDING)) SELECT source, doc_id, tok::INTEGER AS tok FROM c WHERE incl - tok < 40000 AND incl <= 40800.0")
def fill_until_budget(spark, d):
    own = documents(spark, d).select("source", "doc_id", "lang", "tok")
    return selection.fill_budget(own, "tok", 40000, [selection.seeded(42, "doc_id"), "doc_id"], ["source"], F.col("lang") == "en").select("source", "doc_id", "tok")


@query("WITH e AS (SELECT p_brand, p_partkey, 1e6 * p_size / sum(p_size) OVER (PARTITION BY p_brand) AS est FROM part), c AS (SELECT *, sum(est) OVER w AS incl, row_number() OVER w AS rn FROM e WINDOW w AS (PARTITION BY p_brand ORDER BY md5('42:' || p_partkey), p_partkey ROWS UNBOUNDED PRECEDING)) SELECT p_brand, p_partkey FROM c WHERE round(incl - est, 3) < 250000 * 1.15 OR rn = 1")
def greedy_shard_sample(spark, d):
    files = selection.estimated(table(spark, d, "part").select("p_brand", "p_partkey", "p_size"), 1e6, "p_size", ["p_brand"])
    run = accumulated(files, [selection.seeded(42, "p_partkey"), "p_partkey"], "est_tokens", ["p_brand"])
    return run.where((F.round("excl", 3) < 250000 * 1.15) | (F.col("rn") == 1)).select("p_brand", "p_partkey")


@query("WITH c AS (SELECT o_orderkey, o_totalprice, sum(floor(o_totalprice)) OVER (ORDER BY sha256(o_orderpriority || ':' || o_orderkey), o_orderkey ROWS UNBOUNDED PRECEDING) - floor(o_totalprice) AS excl FROM orders) SELECT o_orderkey FROM c WHERE excl < 1.3 * 1e7")
def sha_order_budget(spark, d):
    files = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.floor("o_totalprice").alias("size"))
    run = accumulated(files, [selection.sha_order("o_orderpriority", "o_orderkey"), "o_orderkey"], "size")
    return run.where(F.col("excl") < 1.3 * 1e7).select("o_orderkey")


@query("WITH c AS (SELECT doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY md5('42:' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY source, lang) AS n FROM documents) SELECT doc_id, CASE WHEN rn <= least(round_even(n * 0.05, 0), n - 1) THEN 'val' ELSE 'train' END AS split FROM c")
def holdout_split(spark, d):
    return selection.holdout(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id", ["source", "lang"], 0.05).select("doc_id", "split")


@query("WITH c AS (SELECT source, doc_id, strlen(text) AS tok, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS incl, sum(strlen(text)) OVER (PARTITION BY source) AS t FROM documents), v AS (SELECT *, t - floor(t * 0.015 / 4) * 4 AS cut FROM c) SELECT source, doc_id, greatest(0, least(tok, incl - cut))::BIGINT AS n_val, CASE WHEN incl - tok >= cut THEN 'val' WHEN incl > cut THEN 'cut' ELSE 'train' END AS split FROM v")
def tail_val_carve(spark, d):
    return selection.tail_holdout(documents(spark, d).select("source", "doc_id", "tok"), "tok", ["doc_id"], ["source"], 0.015, 4).select("source", "doc_id", "n_val", "split")


@query("WITH c AS (SELECT doc_id, strlen(text) AS tok, sum(strlen(text)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - strlen(text) AS excl FROM documents) SELECT doc_id, least(tok, 500000 - excl)::BIGINT AS included, tok > 500000 - excl AS truncated FROM c WHERE excl < 500000 AND tok > 0")
def token_prefix_cap(spark, d):
    out = selection.capped_prefix(documents(spark, d).select("doc_id", "tok"), "tok", 500_000, ["doc_id"])
    return out.select("doc_id", F.col("included").cast("long").alias("included"), "truncated")


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 512")
def reservoir_sample(spark, d):
    return selection.sample_rows(table(spark, d, "documents").select("doc_id"), 512, "doc_id")


@query("WITH c AS (SELECT doc_id, source, strlen(text) AS tok, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, avg(strlen(text)) OVER (PARTITION BY source) AS per FROM documents) SELECT doc_id, floor(i / greatest(4, floor(20000 / greatest(per, 1))))::INTEGER AS chunk FROM c")
def lm_chunks(spark, d):
    docs = documents(spark, d).select("doc_id", "source", "tok")
    own = docs.join(docs.groupBy("source").agg(F.avg("tok").alias("per")), "source")
    return selection.work_chunks(own, "doc_id", "per", 20000, 4, ["source"]).select("doc_id", "chunk")


@query("SELECT doc_id, (ntile(10) OVER (PARTITION BY lang ORDER BY doc_id) - 1)::INTEGER AS bucket FROM documents")
def bucket10(spark, d):
    return selection.equal_buckets(table(spark, d, "documents").select("doc_id", "lang"), ["doc_id"], 10, ["lang"]).select("doc_id", "bucket")


@query("WITH s AS (SELECT DISTINCT o_clerkless AS total FROM (SELECT o_custkey % 7 * 130 AS o_clerkless FROM orders)), g AS (SELECT total, unnest(range(0, total // 125 * 125 + 1, 125)) AS step FROM s) SELECT DISTINCT total, step FROM (SELECT total, step FROM g WHERE step = 0 OR step <> total // 125 * 125 OR total % 125 = 0 UNION ALL SELECT total, total FROM s)")
def checkpoint_ladders(spark, d):
    own = table(spark, d, "orders").select((F.col("o_custkey") % 7 * 130).alias("total")).distinct()
    return selection.checkpoint_ladder(own)


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) % 4)::INTEGER AS worker FROM documents")
def round_robin(spark, d):
    return selection.assigned(table(spark, d, "documents").select("doc_id"), "doc_id", 4).select("doc_id", "worker")


@query()
def trim_to_budget(spark, d):
    return selection.trim_budget(documents(spark, d).select("source", "doc_id", "tok"), "tok", 60_000, ["doc_id"], ["source"])


@query()
def upsample_to_budget(spark, d):
    return selection.upsample_budget(documents(spark, d).select("source", "doc_id", "tok"), "tok", 300_000, "doc_id", ["source"], 8).select("source", "cycle", "doc_id", "tok")


@query()
def fitting_shards(spark, d):
    files = selection.estimated(table(spark, d, "part").select("p_brand", "p_partkey", "p_size"), 1e6, "p_size", ["p_brand"]).withColumn("target", F.lit(3e5))
    return selection.fitting_sample(files, "p_brand", "p_partkey").select("p_brand", "p_partkey")


@query()
def shard_top_up(spark, d):
    files = table(spark, d, "part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("size"), F.lit(2.0).alias("rate"), F.lit(100.0).alias("current"), F.lit(1000.0).alias("target"))
    return selection.top_up(files, "p_brand", "p_partkey").select("p_brand", "p_partkey")


@query("WITH c AS (SELECT source, count(*) AS available FROM documents GROUP BY source) SELECT source, least(available, 25)::BIGINT AS n FROM c")
def random_block_plan(spark, d):
    own = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("available")).withColumn("needed", F.least(F.col("available"), F.lit(25)))
    return selection.random_blocks(own, 4, "source").groupBy("source").agg(F.sum("n").alias("n"))


# --- joins ---


@query("WITH a AS (SELECT doc_id FROM documents), b AS (SELECT doc_id FROM labels), j AS (SELECT count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS n_joined, count(*) FILTER (b.doc_id IS NULL) AS n_left_only, count(*) FILTER (a.doc_id IS NULL) AS n_right_only FROM a FULL JOIN b ON a.doc_id = b.doc_id) SELECT *, round(n_joined / (n_joined + n_left_only), 6) AS left_rate, round(n_joined / (n_joined + n_right_only), 6) AS right_rate FROM j")
def label_coverage(spark, d):
    out = joins.coverage(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")
    return out.withColumn("left_rate", r6("left_rate")).withColumn("right_rate", r6("right_rate"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def kept_docs_semi(spark, d):
    return joins.kept(table(spark, d, "documents"), table(spark, d, "labels").where("quality = 1"), "doc_id").select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_anti(spark, d):
    return joins.missing(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN 'not_listed' WHEN quality = 0 THEN 'quality' WHEN toxic = 1 THEN 'toxic' ELSE 'kept' END AS reason FROM documents LEFT JOIN labels USING (doc_id)")
def lookup_reasons(spark, d):
    return joins.with_lookup(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", [("quality", F.col("quality") == 1), ("toxic", F.col("toxic") == 0)]).select("doc_id", "reason")


OWNERS = "WITH p AS (SELECT source, doc_id, strlen(text) + 1 AS n, sum(strlen(text) + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS stop FROM documents), t AS (SELECT source, max(stop) AS total FROM p GROUP BY source), c AS (SELECT source, unnest(range(0, greatest(0, (total - 1) // 2048)::BIGINT)) AS chunk FROM t), o AS (SELECT c.source, c.chunk, p.doc_id FROM c ASOF JOIN (SELECT *, stop - n AS start FROM p) p ON c.source = p.source AND c.chunk * 2048 >= p.start)"


def chunk_owners(spark, d):
    own = documents(spark, d).select("source", "doc_id", (F.col("tok") + 1).alias("n"))
    layout = selection.source_offsets(own, "source", "doc_id", "n").withColumn("end", F.col("start") + F.col("n"))
    points = layout.groupBy("source").agg(F.max("end").alias("total")).where(packing.n_chunks(F.col("total")) > 0).select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), packing.n_chunks(F.col("total"))) - 1)).alias("chunk")).withColumn("offset", F.col("chunk") * 2048)
    return joins.owners(points, layout.select("source", "doc_id", "start", "end"), "source", strict=True).select("source", "chunk", "doc_id")


@query(f"{OWNERS} SELECT source, chunk, doc_id FROM o")
def chunk_owner(spark, d):
    return chunk_owners(spark, d)


@query(f"{OWNERS} SELECT source, chunk, row_number() OVER (ORDER BY doc_id % 97, doc_id, source, chunk) - 1 AS position FROM o")
def chunk_permutation(spark, d):
    own = chunk_owners(spark, d).withColumn("rank", F.struct(F.col("doc_id") % 97, "doc_id"))
    return accumulated(own, ["rank", "source", "chunk"]).select("source", "chunk", (F.col("rn") - 1).cast("long").alias("position"))


@query("WITH a AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS ordinal FROM documents), b AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) - 1 AS ordinal FROM documents) SELECT source, ordinal, doc_id, n_chars FROM a FULL JOIN b USING (source, ordinal)")
def zip_join(spark, d):
    docs = table(spark, d, "documents")
    out = joins.zipped(docs.select("source", "doc_id"), docs.select("source", "n_chars", F.col("doc_id").alias("k")).withColumn("k", -F.col("k")), "source", ["doc_id"], ["k"])
    return out.select("source", F.col("ordinal").cast("long").alias("ordinal"), "doc_id", "n_chars")


@query("SELECT l_orderkey, count(*) AS n_segments, round(sum(l_extendedprice) / sum(l_quantity), 6) AS avg_nll, sum(l_quantity)::BIGINT AS n_loss_tokens, CASE WHEN sum(l_extendedprice) / sum(l_quantity) > 80 THEN 'inf' ELSE 'finite' END AS perplexity FROM lineitem GROUP BY l_orderkey")
def nll_rollup(spark, d):
    own = table(spark, d, "lineitem")
    out = ag.nll(own, ["l_orderkey"], "l_extendedprice", "l_quantity").join(own.groupBy("l_orderkey").agg(F.count("*").alias("n_segments")), "l_orderkey")
    return out.select("l_orderkey", "n_segments", r6("avg_nll").alias("avg_nll"), F.col("n_loss_tokens").cast("long").alias("n_loss_tokens"), F.when(F.col("perplexity") == float("inf"), "inf").otherwise("finite").alias("perplexity"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def last_write_wins(spark, d):
    return ag.last_written(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


# --- aggregates ---


@query("WITH d AS (SELECT n_chars::DOUBLE AS a, strlen(text)::DOUBLE AS b, (doc_id % 100)::DOUBLE AS c FROM documents), u AS (SELECT 'a' AS x, 'b' AS y, a AS u, b AS v FROM d UNION ALL SELECT 'a', 'c', a, c FROM d UNION ALL SELECT 'b', 'c', b, c FROM d) SELECT x, y, count(*) AS n, round(corr(u, v), 6) AS r, round(regr_slope(v, u), 6) AS slope, round(regr_intercept(v, u), 4) AS intercept, round(regr_r2(v, u), 6) AS r2 FROM u GROUP BY x, y")
def metric_correlations(spark, d):
    own = documents(spark, d).select(F.col("n_chars").cast("double").alias("a"), F.col("tok").cast("double").alias("b"), (F.col("doc_id") % 100).cast("double").alias("c"))
    return ag.correlations(own, ["a", "b", "c"]).select("x", "y", "n", r6("r").alias("r"), r6("slope").alias("slope"), F.round("intercept", 4).alias("intercept"), r6("r2").alias("r2"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def loss_quantiles(spark, d):
    return ag.loss_summary(table(spark, d, "events"), "value", ["event_type"]).select("event_type", *[r6(c).alias(c) for c in ("mean", "median", "p90", "p99")])


@query("SELECT event_type, round(min(value), 6) AS min, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(100.0 * avg((value BETWEEN 10 AND 50)::INT), 6) AS pct_in_range, count(*) FILTER (value > 50) AS n_above FROM events GROUP BY event_type")
def plausibility_report(spark, d):
    out = ag.plausibility(table(spark, d, "events"), "event_type", "value", 10, 50, 50)
    return out.select("event_type", "n_above", *[r6(c).alias(c) for c in ("min", "p5", "p50", "p95", "p99", "max", "mean", "std", "pct_in_range")])


@query("SELECT source, count(*) AS n_shards, sum(strlen(text))::BIGINT AS n_tokens, sum(n_chars)::BIGINT AS bytes, array_to_string(list_sort(list(doc_id::VARCHAR)), ',') AS shards FROM documents GROUP BY source")
def shard_rollup(spark, d):
    own = documents(spark, d).withColumn("path", F.col("doc_id").cast("string"))
    return ag.shard_rollup(own, "source", "path", "n_chars", "tok").withColumn("shards", F.array_join("shards", ","))


@query("WITH b AS (SELECT source, sum(strlen(text)) AS n, 100000 AS budget FROM documents GROUP BY source) SELECT source, n::BIGINT AS n_tokens, abs(n - budget) / budget <= 0.25 AS ok FROM b")
def acceptance_report(spark, d):
    own = documents(spark, d)
    each, _ = ag.acceptance(own, own.select("source").distinct().withColumn("budget", F.lit(100000)), "source", "tok", "budget", 0.25)
    return each.select("source", "n_tokens", "ok")


@query("SELECT CASE WHEN lang <> 'en' THEN 'language' WHEN n_chars < 500 THEN 'short' WHEN n_chars > 8000 THEN 'long' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def drop_reasons(spark, d):
    return filters.reasons(table(spark, d, "documents"), [("language", F.col("lang") == "en"), ("short", F.col("n_chars") >= 500), ("long", F.col("n_chars") <= 8000)])


@query("WITH s AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT user_id, sum((p IS NULL OR p <> event_type)::INT)::BIGINT AS n_docs FROM s GROUP BY user_id")
def change_points(spark, d):
    return ag.changes(table(spark, d, "events"), "event_type", ["ts", "event_id"], ["user_id"])


MIXTURES = "w AS (SELECT l_suppkey % 8 AS mix_id, l_shipmode AS domain, sum(l_quantity) AS q FROM (SELECT l_suppkey, l_returnflag || l_linestatus AS l_shipmode, l_quantity FROM lineitem) GROUP BY 1, 2), m AS (SELECT mix_id, domain, q / sum(q) OVER (PARTITION BY mix_id) AS weight FROM w)"


def mixtures(spark, d):
    own = table(spark, d, "lineitem").select((F.col("l_suppkey") % 8).alias("mix_id"), F.concat("l_returnflag", "l_linestatus").alias("domain"), "l_quantity")
    return mixing.normalised(own.groupBy("mix_id", "domain").agg(F.sum("l_quantity").alias("weight")))


@query(f"WITH {MIXTURES}, r AS (SELECT *, weight * 1000 AS raw FROM m), k AS (SELECT *, 1000 - sum(floor(raw)) OVER (PARTITION BY mix_id) AS rest, row_number() OVER (PARTITION BY mix_id ORDER BY round(raw - floor(raw), 9) DESC, round(raw, 9) DESC, domain) AS k FROM r) SELECT mix_id, domain, (floor(raw) + (k <= rest)::INT)::BIGINT AS n_sequences FROM k")
def largest_remainder(spark, d):
    return mixing.allocated(mixtures(spark, d), 1000, ["mix_id"]).select("mix_id", "domain", "n_sequences")


@query(f"WITH {MIXTURES}, a AS (SELECT l_returnflag || l_linestatus AS domain, sum(l_quantity) AS available FROM lineitem GROUP BY 1), p AS (SELECT domain, max(weight * 2000000) AS peak, arg_min(mix_id, (-weight, mix_id)) AS binding_mix FROM m GROUP BY domain) SELECT domain, round(peak, 4) AS peak, binding_mix, CASE WHEN available < peak THEN 'SHORT' ELSE 'OK' END AS status FROM p JOIN a USING (domain)")
def demand_vs_available(spark, d):
    available = table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("domain")).agg(F.sum("l_quantity").alias("available"))
    return ag.demand(mixtures(spark, d), available, 2_000_000).select("domain", F.round("peak", 4).alias("peak"), "binding_mix", "status")


@query(f"WITH {MIXTURES}, a AS (SELECT l_returnflag || l_linestatus AS domain, sum(l_quantity) AS available FROM lineitem GROUP BY 1), c AS (SELECT domain, floor(available / max(weight)) AS cap FROM m JOIN a USING (domain) GROUP BY domain, available) SELECT min(cap)::BIGINT AS max_tokens, arg_min(domain, (cap, domain)) AS binding FROM c")
def feasible_budget(spark, d):
    available = table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("domain")).agg(F.sum("l_quantity").alias("available"))
    return ag.feasible_budget(mixtures(spark, d), available).select(F.col("max_tokens").cast("long").alias("max_tokens"), "binding")


ADJACENCY = "a AS (SELECT event_type AS domain, user_id % 5 AS family, avg(value) / 100 AS a FROM events GROUP BY 1, 2), l AS (SELECT user_id % 5 AS family, avg(value) / 50 AS loss FROM events GROUP BY 1)"


@query(f"WITH {ADJACENCY}, s AS (SELECT domain, sum(a * loss) * 0.2 AS score FROM a JOIN l USING (family) GROUP BY domain), e AS (SELECT domain, exp(score - max(score) OVER ()) AS e FROM s) SELECT domain, round(e / sum(e) OVER (), 6) AS p FROM e")
def skill_update(spark, d):
    ev = table(spark, d, "events").withColumn("family", F.col("user_id") % 5)
    a = ev.groupBy(F.col("event_type").alias("domain"), "family").agg((F.avg("value") / 100).alias("a"))
    losses = ev.groupBy("family").agg((F.avg("value") / 50).alias("loss"))
    return mixing.skill_update(a, losses).select("domain", r6("p").alias("p"))


@query("WITH l AS (SELECT user_id % 5 AS family, avg(value) AS ref FROM events GROUP BY 1), p AS (SELECT event_type AS domain, user_id % 5 AS family, avg(value) AS loss FROM events GROUP BY 1, 2) SELECT domain, family, round(greatest(0, ref - loss), 6) AS a FROM p JOIN l USING (family)")
def offline_adjacency(spark, d):
    ev = table(spark, d, "events").withColumn("family", F.col("user_id") % 5)
    probes = ev.groupBy(F.col("event_type").alias("domain"), "family").agg(F.avg("value").alias("loss"))
    return mixing.offline_adjacency(ev.groupBy("family").agg(F.avg("value").alias("loss")), probes).select("domain", "family", r6("a").alias("a"))


@query("WITH w AS (SELECT user_id, event_type, avg(value) AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_type) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events GROUP BY 1, 2), x AS (SELECT user_id, i, n, v, CASE WHEN i = 0 THEN pow(0.8, n - 1) ELSE pow(0.8, n - 1 - i) * 0.2 END AS w FROM w) SELECT user_id, round(sum(w * v) / sum(w), 6) AS value FROM x WHERE n = (SELECT count(DISTINCT event_type) FROM events) GROUP BY user_id")
def ema_merge(spark, d):
    ev = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("ckpt")).agg(F.avg("value").alias("value"))
    n = ev.select("ckpt").distinct().count()
    whole = ev.withColumn("n", F.count("*").over(Window.partitionBy("user_id"))).where(F.col("n") == n)
    return ag.merged(whole, 0.8, key=["user_id"]).select("user_id", r6("value").alias("value"))


# --- conversations, rules, noise ---


@query(r"""WITH t AS (SELECT conv_id, turn, CASE lower(role) WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'tool' THEN 'Tool' ELSE upper(role[1]) || lower(role[2:]) END AS r, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS x FROM conversations) SELECT conv_id, string_agg(r || ': ' || x, chr(10) || chr(10) ORDER BY turn) AS text FROM t WHERE x <> '' GROUP BY conv_id""")
def flatten_conversation(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    return turns.select("conv_id", tx.flattened(F.col("messages")).alias("text")).where("text <> ''")


@query("SELECT doc_id, NOT (lang IN ('fr') OR source || ' ' || doc_id LIKE '%src1%') AS keep FROM (SELECT doc_id, lower(lang) AS lang, lower(source) AS source FROM documents)")
def exclusion_rules(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("domain"))
    rule = rules.Exclusion(fields=("source", "id"), substrings=("src1",), domains=("FR",))
    return docs.select("doc_id", rules.keep(rule, docs.columns).alias("keep"))


@query("SELECT event_id, CASE WHEN event_type LIKE '%click%' THEN 'math' WHEN event_type LIKE '%view%' THEN 'code' ELSE 'general' END AS domain FROM events")
def domain_map(spark, d):
    ev = table(spark, d, "events")
    return ev.select("event_id", rules.domain(rules.DomainRule(("event_type",), (("click", "math"), ("view", "code"))), ev.columns).alias("domain"))


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]'), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents), c AS (SELECT doc_id, len(ls) AS n, len(list_filter(ls, lambda x: regexp_matches(x, '\\\\[a-zA-Z0-9_.$-]+\\') OR regexp_matches(x, '[a-zA-Z]:\\') OR regexp_matches(x, '(?i)(?:^|\s)file\s+\d+:'))) AS p FROM l) SELECT doc_id, n = 0 OR p >= 5 OR (p >= 3 AND p / n >= 0.15) AS noise FROM c""")
def path_noise(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.is_path_noise(F.col("text")).alias("noise"))


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(x, '--')), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents), c AS (SELECT doc_id, len(ls) AS n, list_filter(ls, lambda x: NOT regexp_matches(x, '^(open\s+)?import\s+|^module\s+')) AS body FROM l) SELECT doc_id, n >= 4 AND ((n - len(body) >= 5 AND len(body) <= 2) OR ((n - len(body)) / n > 0.75 AND NOT (regexp_matches(array_to_string(body, chr(10)), '(?i)\b(data|record|theorem|lemma|def|postulate|axiom|class|instance|structure)\b') OR contains(array_to_string(body, chr(10)), ':=')))) AS shell FROM c""")
def import_shell(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.is_import_shell(F.col("text")).alias("shell"))


@query(r"""SELECT doc_id, list_max(list_transform(string_split(text, chr(10)), lambda x: len(x)))::INTEGER AS max_line, round(list_avg(list_transform(string_split(text, chr(10)), lambda x: len(x))), 6) AS avg_line, round(len(regexp_extract_all(text, '[A-Za-z0-9]')) / greatest(1, len(text)), 6) AS alnum_share FROM documents""")
def code_line_stats(spark, d):
    s = tx.code_line_stats(F.col("text"))
    return table(spark, d, "documents").select("doc_id", s["max_line"].alias("max_line"), r6(s["avg_line"]).alias("avg_line"), r6(s["alnum_share"]).alias("alnum_share"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, '(?i)\\begin\{(?:theorem|lemma|proposition|corollary|proof)\*?\}'))::INTEGER AS n_proofs, len(html) BETWEEN 1000 AND 200000 AS fits FROM pages""")
def proof_gate(spark, d):
    return table(spark, d, "pages").select("page_id", tx.proof_environments(F.col("html")).alias("n_proofs"), F.length("html").between(1000, 200000).alias("fits"))


@query("WITH i AS (SELECT substr(text, 1, 40) AS span, row_number() OVER (ORDER BY item_id) - 1 AS k, count(*) OVER () AS n FROM benchmark), j AS (SELECT doc_id, source, text, substr(text, 1, 12) AS a, span AS b FROM documents JOIN i ON k = doc_id % n), p AS (SELECT *, len(a) > 0 AS first, CASE WHEN len(a) > 0 THEN '<FACT>' || a || '</FACT>' ELSE '' END AS head, substr(text, 1 + len(a)) AS rest FROM j), q AS (SELECT *, CASE WHEN len(b) > 0 THEN strpos(rest, b) ELSE 0 END AS hit FROM p) SELECT doc_id, source, sha256(head || CASE WHEN hit > 0 THEN substr(rest, 1, hit - 1) || '<FACT>' || b || '</FACT>' || substr(rest, hit + len(b)) ELSE rest END) AS marked, 2 AS n_facts, (first::INT + (hit > 0)::INT)::INTEGER AS n_facts_placed FROM q")
def mark_facts(spark, d):
    docs, bench = table(spark, d, "documents"), table(spark, d, "benchmark")
    # facts of a document: its own beginning, and the beginning of the benchmark item that its id points to
    items = accumulated(bench.select("item_id", F.substring("text", 1, 40).alias("span")), ["item_id"]).select((F.col("rn") - 1).alias("k"), "span")
    own = docs.select("doc_id", F.substring("text", 1, 12).alias("span"), F.lit(0).alias("fact_idx"))
    other = docs.select("doc_id", F.pmod(F.col("doc_id"), F.lit(bench.count())).alias("k")).join(items, "k").select("doc_id", "span", F.lit(1).alias("fact_idx"))
    marked = joins.with_spans(docs.select("doc_id", "source", "text"), own.unionByName(other)).withColumn("m", tx.mark_spans(F.col("text"), F.col("spans")))
    return marked.select("doc_id", "source", F.sha2("m.text", 256).alias("marked"), F.coalesce(F.size("spans"), F.lit(0)).alias("n_facts"), F.col("m.placed").alias("n_facts_placed"))


@query()
def difficulty_metrics(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.difficulty(F.col("text")).alias("m")).select("doc_id", "m.*")


@query()
def latex_strip(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(tx.prepare_latex(F.col("html")), 256).alias("cleaned"))


@query()
def python_parse_share(spark, d):
    return table(spark, d, "documents").select(tx.parses_as_python(tx.strip_license_header(F.col("text"))).alias("ok"), "lang").groupBy("lang").agg(F.avg(F.col("ok").cast("double")).alias("share"))


# --- masks and packing ---

SCORES = "s AS (SELECT vec_id, unnest(embedding)::DOUBLE AS s, unnest(range(64)) AS i FROM embeddings), v AS (SELECT *, i % 5 <> 0 AS ok FROM s)"


def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding", F.transform("embedding", lambda x, i: i % 5 != 0).alias("valid"))


@query(f"WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, i) AS k, count(*) OVER (PARTITION BY vec_id) AS n FROM v WHERE ok) SELECT vec_id, string_agg(i::VARCHAR, ',' ORDER BY i) AS kept FROM r WHERE k <= greatest(1, least(n, round_even(n * 0.6, 0))) GROUP BY vec_id")
def topk_mask(spark, d):
    m = selection.row_mask(F.col("embedding"), F.col("valid"), 0.6)
    return vectors(spark, d).select("vec_id", _set_positions(m).alias("kept"))


@query(f"WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s, i) AS k, count(*) OVER (PARTITION BY vec_id) AS n FROM v WHERE ok), b AS (SELECT *, greatest(1, round_even(n * 0.5, 0)) AS keep FROM r) SELECT vec_id, string_agg(i::VARCHAR, ',' ORDER BY i) AS kept FROM b WHERE k > floor((n - keep) / 2) AND k <= floor((n - keep) / 2) + keep GROUP BY vec_id")
def middlek_mask(spark, d):
    m = selection.row_mask(F.col("embedding"), F.col("valid"), 0.5, middle=True)
    return vectors(spark, d).select("vec_id", _set_positions(m).alias("kept"))


def _set_positions(mask):
    return F.array_join(F.filter(F.transform(mask, lambda m, i: F.when(m == 1, i.cast("string"))), lambda x: x.isNotNull()), ",")


@query(f"WITH {SCORES}, g AS (SELECT vec_id, min(s) AS lo, greatest(max(s) - min(s), 1e-8) AS spread FROM v WHERE ok GROUP BY vec_id) SELECT vec_id, i::INTEGER AS i, round(CASE WHEN ok THEN (s - lo) / spread ELSE 0 END, 6) AS x FROM v JOIN g USING (vec_id)")
def minmax_rows(spark, d):
    return vectors(spark, d).select("vec_id", F.posexplode(selection.row_min_max(F.col("embedding"), F.col("valid"))).alias("i", "x")).withColumn("x", r6("x"))


@query(f"WITH {SCORES} SELECT vec_id, round(sum(s), 6) AS sum, count(*)::INTEGER AS n FROM v WHERE ok GROUP BY vec_id")
def masked_loss(spark, d):
    return vectors(spark, d).select("vec_id", selection.masked_loss(F.col("embedding"), F.col("valid")).alias("m")).select("vec_id", r6("m.sum").alias("sum"), "m.n")


@query("WITH p AS (SELECT source, sum(strlen(text) + 1) AS total FROM documents GROUP BY source) SELECT source, (total // 2048)::BIGINT AS n_rows, (total // 2048 * 2048)::BIGINT AS n_tokens FROM p WHERE total >= 2048")
def pack_rows(spark, d):
    docs = packing.tokenised(table(spark, d, "documents").select("source", "doc_id", "text"), eos=256)
    rows = packing.packed_raw(docs.select("source", "doc_id", "ids"), "ids", 2048, ["doc_id"], ["source"], ">u2")
    return rows.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum((F.octet_length("content") / 2).cast("long")).alias("n_tokens"))


@query("WITH s AS (SELECT source, sum(strlen(text)) AS n FROM documents GROUP BY source) SELECT sum(n // 2048)::BIGINT AS n_sequences FROM s")
def one_epoch_budget(spark, d):
    shards = documents(spark, d).groupBy("source").agg(F.sum("tok").alias("n_tokens"))
    return packing.one_epoch(shards, 2048).select(F.col("n_sequences").cast("long").alias("n_sequences"))


@query("SELECT doc_id, len(range(0, greatest(strlen(text) - 1, 0), 511))::INTEGER AS n_segments FROM documents")
def overlapping_segments(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(packing.byte_segments(F.col("text"), 512)).alias("n_segments"))


@query("WITH s AS (SELECT DISTINCT o_custkey % 2385 AS step FROM orders), g AS (SELECT step, CASE WHEN step >= 2250 THEN 9 ELSE step // 250 END AS seg FROM s) SELECT step, seg::INTEGER AS segment, round(CASE WHEN step >= 1000 THEN 1 ELSE 0.25 + 0.75 * step / 1000 END, 6) AS fraction, least(9, (step - seg * 250) // CASE WHEN seg = 9 THEN 13 ELSE 25 END)::INTEGER AS bucket FROM g")
def pacing(spark, d):
    steps = table(spark, d, "orders").select((F.col("o_custkey") % 2385).alias("step")).distinct()
    return steps.select("step", mixing.segment(F.col("step")).alias("segment"), r6(mixing.eligible_fraction(F.col("step"))).alias("fraction"), mixing.interleaved_bucket(F.col("step")).alias("bucket"))


# --- sets, contracts ---


@query("SELECT 'left' AS side, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'right', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def set_differences(spark, d):
    return joins.differences(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("side", "doc_id")


@query("SELECT lang, min(doc_id) AS doc_id FROM documents GROUP BY lang")
def first_of_each(spark, d):
    return sets.first_of_each(table(spark, d, "documents").select("lang", "doc_id"), ["lang"], ["doc_id"])


@query(f"WITH {MIXTURES} SELECT mix_id, CASE WHEN count(*) <> 4 THEN 'length' ELSE 'sum' END AS reason FROM m GROUP BY mix_id HAVING count(*) <> 4 OR abs(sum(weight) - 1) > 2e-3")
def simplex_violations(spark, d):
    return mixing.simplex_violations(mixtures(spark, d), 4)


@query("WITH g AS (SELECT source, min(doc_id) AS lo, max(doc_id) AS hi, count(*) AS n FROM documents GROUP BY source) SELECT source, 'ordinals' AS reason FROM g WHERE lo <> 0 OR hi <> n - 1")
def stream_violations(spark, d):
    own = documents(spark, d).select("source", F.col("doc_id").alias("ordinal"), F.col("tok").alias("n_tokens"))
    return contracts.stream_violations(own, own.groupBy("source").agg((F.sum("n_tokens") + F.count("*")).alias("total_tokens")))


@query(f"WITH {FLESCH}, s AS (SELECT * FROM f WHERE ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 2 = 0), r AS (SELECT *, row_number() OVER (ORDER BY round(flesch, 9) DESC, doc_id) - 1 AS rank, sum(tok) OVER (ORDER BY round(flesch, 9), doc_id) AS incl, sum(tok) OVER () AS t FROM s) SELECT source, count(*) AS n_docs, sum(tok)::BIGINT AS n_tokens, round(avg(flesch), 6) AS avg_flesch, min(rank) AS first_rank FROM r WHERE incl - tok / 2 >= 0.2 * t AND incl - tok / 2 < 0.8 * t GROUP BY source")
def flagship(spark, d):
    """Hash sample, readability, difficulty rank, middle token mass, summed up by source."""
    own = fleschs(spark, d).where(filters.md5_sample(F.col("doc_id"), 2)).withColumn("_f", F.round("flesch", 9))
    ranked = selection.difficulty_rank(own, "_f", "doc_id", easy_is_high=True)
    band = selection.middle_mass(ranked, "_f", "tok", "doc_id")
    return band.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("tok").alias("n_tokens"), r6(F.avg("flesch")).alias("avg_flesch"), F.min("rank").cast("long").alias("first_rank"))
