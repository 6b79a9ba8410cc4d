"""Registered queries of readers by parts, learnt scores, taggers, permutations, filters in front of joins, sketches and
state, and of sources and sinks written and read back; each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sluice.functions import tagging
from sluice.operators import contracts, filters, language, membership, packing, permutation, selection, sketches
from sluice.operators.prefix import accumulated
from sluice.sources import bucketed, files, ranges, readers, sinks
from sluice.streaming import stateful, streams

from .operator_queries import BYTES, _folder
from .registry import _set_positions, query, r6, table, vectors

# --- parts of files ---


@query("SELECT doc_id::VARCHAR AS id, sha256(text) AS text FROM documents")
def zstandard_runs(spark, d):
    path = _folder(spark, "zstandard-runs")
    own = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    sinks.jsonl_zstd(own, path, frame_docs=64)
    got = ranges.zstd_lines(spark, path, 1 << 16)
    return got.select(F.get_json_object("value", "$.id").alias("id"), F.sha2(F.get_json_object("value", "$.text"), 256).alias("text"))


@query(f"WITH {BYTES}, s AS (SELECT *, unnest(range((len(h) // 2 + 8191) // 8192)) AS shard FROM h), c AS (SELECT source, shard, substr(h, 1 + shard * 16384, 16384) AS h FROM s), r AS (SELECT *, unnest(range(0, len(h) // 2, 1000)) AS start FROM c) SELECT source, printf('shard-%05d.u32le.bin', shard) AS name, start, least(1000, len(h) // 2 - start) AS n, sha256(substr(h, 1 + 2 * start, 2000)) AS ids FROM r")
def token_ids(spark, d):
    path = _folder(spark, "token-ids")
    docs = packing.tokenised(table(spark, d, "documents").select("source", "doc_id", "text"))
    sinks.token_files(sinks.token_shards(docs, "ids", ["doc_id"], 8192, None, ["source"]), path, ["source"])
    parts = F.split("path", "/")
    spelled = F.array_join(F.transform("ids", lambda i: F.lpad(F.hex(i), 2, "0")), "")
    own = ranges.token_ranges(spark, path, None, 1000, 16_000)
    return own.select(F.element_at(parts, -2).alias("source"), F.element_at(parts, -1).alias("name"), "start", F.size("ids").cast("long").alias("n"), F.sha2(spelled, 256).alias("ids"))


@query("SELECT doc_id, sha256(text) AS text FROM documents JOIN labels USING (doc_id) WHERE toxic = 1")
def lines_by_offset(spark, d):
    path = _folder(spark, "lines-by-offset")
    table(spark, d, "documents").select("doc_id", "text").write.json(path)
    own = readers.lines(spark, path).select("path", F.col("line_index").alias("line"), F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"))
    wanted = own.join(table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id")
    got = ranges.lines_at(wanted, ranges.offset_index(spark, path, 32, 1 << 20))
    return got.select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), F.sha2(F.get_json_object("value", "$.text"), 256).alias("text"))


WHOLE = "w AS (SELECT string_agg(hex(encode(text)), '' ORDER BY doc_id) AS h FROM documents)"


@query(f"WITH {WHOLE}, s AS (SELECT h, unnest(range(0, len(h) // 2, 65536)) AS start FROM w) SELECT start, least(65536, len(h) // 2 - start) AS n, sha256(substr(h, 1 + 2 * start, 131072)) AS ids FROM s")
def concatenated_file(spark, d):
    path = _folder(spark, "parts")
    own = table(spark, d, "documents").select(F.concat(F.lit("part-"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("name"), F.encode("text", "utf-8").alias("content"))
    parts = files.written(own, path)
    files.concatenate(parts, f"{path}-whole/all.bin", ["path"], 1, 1 << 18)
    spelled = F.array_join(F.transform("ids", lambda i: F.lpad(F.hex(i), 2, "0")), "")
    return ranges.token_ranges(spark, f"{path}-whole/all.bin", "<u1").select("start", F.size("ids").cast("long").alias("n"), F.sha2(spelled, 256).alias("ids"))


@query("SELECT DISTINCT lang AS key FROM documents")
def done_markers(spark, d):
    path = _folder(spark, "published")
    own = table(spark, d, "documents").select(F.col("lang").alias("key"), "doc_id")
    sinks.publish(own, path, key="key", ready=True)
    if not contracts.ready(spark, f"{path}/_state"):
        raise ValueError("published tables are ready")
    return files.done_keys(spark, f"{path}/_done")


# --- learnt scores and taggers ---

GRAMS = f"""list_transform(regexp_extract_all(translate(THE_TEXT, '{language.UPPER}', '{language.LOWER}'), '{language.WORD}'),
    lambda w: [(ascii(substr(w, 1, 1)) * 961 + ascii(substr(w, 2, 1)) * 31 + ascii(substr(w, 3, 1))) % {language.BUCKETS // 2},
               (ascii(substr(right(w, 3), 1, 1)) * 961 + ascii(substr(right(w, 3), 2, 1)) * 31 + ascii(substr(right(w, 3), 3, 1))) % {language.BUCKETS // 2} + {language.BUCKETS // 2}])"""
ENGLISH = f"""
k AS (SELECT doc_id FROM documents WHERE lang IS NOT NULL ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 2000),
c AS (SELECT b, count(*) FILTER (en) AS y, count(*) FILTER (NOT en) AS n FROM (SELECT lang = 'en' AS en, unnest(flatten({GRAMS.replace("THE_TEXT", "text")})) AS b FROM documents WHERE doc_id IN (SELECT doc_id FROM k)) GROUP BY b),
t AS (SELECT sum(y) + 0.5 * {language.BUCKETS} AS ys, sum(n) + 0.5 * {language.BUCKETS} AS ns FROM c),
v AS (SELECT b, greatest(-{language.MOST}, least({language.MOST}, floor({language.STEPS} * (ln((y + 0.5) / ys) - ln((n + 0.5) / ns)) + 0.5)))::BIGINT AS v FROM c, t),
p AS (SELECT doc_id, row_number() OVER () AS i, p FROM (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '')) AS p FROM documents)),
g AS (SELECT doc_id, i, len(p) AS n, flatten({GRAMS.replace("THE_TEXT", "p")}) AS bs FROM p),
m AS (SELECT i, sum(coalesce(v, 0)) AS s FROM (SELECT i, unnest(bs) AS b FROM g) LEFT JOIN v USING (b) GROUP BY i),
e AS (SELECT doc_id, sum(n / (1 + exp(-2.0 / {language.STEPS} * coalesce(s, 0) / greatest(1, len(bs))))) / sum(n) AS score FROM g LEFT JOIN m USING (i) GROUP BY doc_id)"""


@query(f"WITH {ENGLISH} SELECT doc_id, round(score, 6) AS score, coalesce(round(score, 9) >= 0.5, false) AS keep FROM documents LEFT JOIN e USING (doc_id)")
def english_paragraphs(spark, d):
    docs = table(spark, d, "documents")
    score = language.english_score(language.learnt(docs))
    own = docs.select("doc_id", filters.document_score(F.col("text"), score).alias("score"))
    return own.select("doc_id", r6("score").alias("score"), filters.english_score(F.round("score", 9)).alias("keep"))


BLOCKS = f"""
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS lines FROM documents),
a AS (SELECT *, regexp_matches(line, '{tagging.LICENCE}') AS hit, regexp_matches(line, '{tagging.COMMENT}') OR regexp_matches(line, '{tagging.LICENCE}') AS marked, sum(len(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS behind FROM l),
r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, marked ORDER BY i) AS run FROM a),
b AS (SELECT doc_id, (min(behind - len(line) - 1))::BIGINT AS s, (max(behind) - 1)::BIGINT AS e, CASE WHEN bool_or(hit) THEN count(*) FILTER (hit) / count(*) ELSE count(*) / max(lines) END AS score, CASE WHEN bool_or(hit) THEN 'copyright' ELSE 'comment' END AS kind FROM r WHERE marked GROUP BY doc_id, run),
x AS (SELECT doc_id, string_agg(kind || ':' || s || '-' || e || ':' || floor(score * 1000 + 0.5)::BIGINT, ',' ORDER BY s) AS blocks FROM b GROUP BY doc_id),
y AS (SELECT b.doc_id, string_agg(substr(text, since + 1, s - since) || '#', '' ORDER BY s) AS head, max(e) AS last FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS since FROM b WHERE score >= 0.3) b JOIN documents USING (doc_id) GROUP BY b.doc_id)"""


@query(f"WITH {BLOCKS} SELECT doc_id, coalesce(blocks, '') AS blocks, sha256(CASE WHEN head IS NULL THEN text ELSE head || substr(text, last + 1) END) AS text FROM documents LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)")
def tagged_blocks(spark, d):
    own = table(spark, d, "documents").select("doc_id", "text", tagging.tagged_blocks(F.col("text")).alias("b"))
    said = F.transform("b", lambda x: F.concat(x["kind"], F.lit(":"), x["s"], F.lit("-"), x["e"], F.lit(":"), F.floor(x["score"] * 1000 + 0.5)))
    return own.select("doc_id", F.array_join(said, ",").alias("blocks"), F.sha2(filters.replace_scored_spans(F.col("text"), F.col("b"), by="#"), 256).alias("text"))


# --- permutations, joins, sketches ---


def _network(walks: int = 4, seed: str = "42000::BIGINT + epoch") -> str:
    """CTEs z0, z1, ...: the permutation of v (of n) by the steps that it is defined by."""
    out, last, number = [], "z0", 0
    mixed = lambda x: f"(((({x}) % {permutation.M} + key) % {permutation.M} * {permutation.A} % {permutation.M} + 12345) * {permutation.B}) % {permutation.N}"
    for _ in range(walks):
        out.append(f"i{number} AS (SELECT k, epoch, n, a, b, v, v // b AS l, v % b AS r FROM {last})")
        last = f"i{number}"
        for rnd in range(permutation.ROUNDS):
            key = f"((({seed}) + 1) * 1000003 + {7919 * (rnd + 1) ** 3}) % {permutation.M} AS key"
            new = f"l, (r + {mixed('l')} % b) % b AS r" if rnd % 2 else f"(l + {mixed('r')} % a) % a AS l, r"
            out.append(f"j{number} AS (SELECT k, epoch, n, a, b, v, {new} FROM (SELECT *, {key} FROM {last}))")
            last, number = f"j{number}", number + 1
        out.append(f"w{number} AS (SELECT k, epoch, n, a, b, CASE WHEN v < n AND {int(_ > 0)} = 1 THEN v ELSE l * b + r END AS v FROM {last})")
        last = f"w{number}"
    return ", ".join(out) + f", z AS (SELECT * FROM {last})"


@query(f"WITH o AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS v, count(*) OVER () AS n FROM orders), g AS (SELECT *, floor(sqrt(n - 1))::BIGINT + 1 AS a FROM o), z0 AS (SELECT k, epoch, n, a, (n + a - 1) // a AS b, v FROM g, (SELECT unnest([0, 1]) AS epoch)), {_network()} SELECT k AS o_orderkey, epoch::INTEGER AS epoch, v::BIGINT AS position FROM z")
def keyed_permutation(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    own = accumulated(orders, ["o_orderkey"]).select("o_orderkey", (F.col("rn") - 1).alias("row_index"))
    return permutation.epoch_positions(own, orders.count(), 2).select("o_orderkey", "epoch", "position")


@query("SELECT doc_id, source, quality, toxic, n FROM documents JOIN labels USING (doc_id) JOIN (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) FROM documents) GROUP BY doc_id) USING (doc_id)")
def bucketed_joins(spark, d):
    docs = table(spark, d, "documents")
    spans = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("span"))
    a, b, c = (bucketed.write(x, "doc_id", 8) for x in (docs.select("doc_id", "source"), table(spark, d, "labels"), spans))
    return a.join(b, "doc_id").join(c.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id").select("doc_id", "source", "quality", "toxic", "n")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def filtered_members(spark, d):
    ids = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return membership.members(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ids, "o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def filtered_strangers(spark, d):
    ids = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return membership.strangers(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ids, "o_orderkey")


@query("WITH r AS (SELECT lang, n_chars AS v, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, max(n) AS n, min(v)::DOUBLE AS low, max(v)::DOUBLE AS high, min(v) FILTER (rn >= 0.5 * n)::DOUBLE AS p50, min(v) FILTER (rn >= 0.95 * n)::DOUBLE AS p95 FROM r GROUP BY lang")
def sketched_quantiles(spark, d):
    # by language and source first, as days are stored; a sketch ranks exactly while it has no more than k rows
    stored = sketches.sketched(table(spark, d, "documents"), ["lang", "source"], "n_chars", 1 << 15)
    return sketches.reported(sketches.rolled_up(stored, ["lang"], 1 << 15), {"p50": 0.5, "p95": 0.95})


# --- masks ---

METHODS = """e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
s AS (SELECT vec_id, i, m, CASE m WHEN 'rel_ema' THEN x / 2 - x * x WHEN 'learnability' THEN x - x * x WHEN 'attention' THEN abs(x) WHEN 'middle_ppl' THEN -(x * x) WHEN 'random' THEN ('0x' || substr(md5('7:' || vec_id || ':' || i), 1, 12))::BIGINT::DOUBLE ELSE 0 END AS s FROM e, (SELECT unnest(['full', 'rel_ema', 'learnability', 'attention', 'middle_ppl', 'random']) AS m) WHERE i % 5 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id, m ORDER BY s DESC, i) AS k, count(*) OVER (PARTITION BY vec_id, m) AS n FROM s),
q AS (SELECT *, greatest(1, least(n, round_even(n * 0.3, 0))) AS keep FROM r)"""


@query(f"WITH {METHODS} SELECT vec_id, m AS method, string_agg(i::VARCHAR, ',' ORDER BY i) AS kept FROM q WHERE CASE m WHEN 'full' THEN true WHEN 'middle_ppl' THEN k > floor((n - keep) / 2) AND k <= floor((n - keep) / 2) + keep ELSE k <= keep END GROUP BY vec_id, m")
def mask_methods(spark, d):
    own = F.transform("embedding", lambda x: x.cast("double"))
    square, half = F.transform(own, lambda x: x * x), F.transform(own, lambda x: x / 2)
    given = {
        "full": {},
        "rel_ema": {"history": half, "current": square},
        "learnability": {"early": own, "late": square},
        "attention": {"attention": F.transform(own, F.abs)},
        "middle_ppl": {"reference": square},
        "random": {"row": F.col("vec_id"), "seed": 7},
    }
    masks = F.array(*[F.struct(F.lit(m).alias("method"), selection.loss_mask(m, F.col("valid"), 0.3, **x).alias("mask")) for m, x in given.items()])
    each = vectors(spark, d).select("vec_id", F.inline(masks))
    return each.select("vec_id", "method", _set_positions(F.col("mask")).alias("kept"))


# --- state ---


@query("SELECT source AS id, sum(n_chars)::BIGINT AS n_loss_tokens, round(sum(n_chars * 0.5), 6) AS sum_loss, count(*) AS n_segments, true AS complete FROM documents GROUP BY source")
def segment_totals(spark, d):
    path = _folder(spark, "segments")
    own = table(spark, d, "documents").select(F.col("source").alias("id"), F.col("doc_id").alias("segment"), (F.col("n_chars") * 0.5).alias("loss"), F.col("n_chars").alias("n_tokens"))
    own = own.join(own.groupBy("id").agg(F.count("*").alias("n_total")), "id").withColumn("at", F.timestamp_seconds(F.col("segment") + 86_400))
    own.repartition(3, "segment").write.parquet(f"{path}/in")
    stream = stateful.prepared(spark).readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    stateful.document_totals(stream, late="1000 days").writeStream.option("checkpointLocation", f"{path}/log").trigger(availableNow=True).format("parquet").start(f"{path}/out").awaitTermination()
    got = spark.read.schema(stateful.TOTALS).parquet(f"{path}/out")
    return got.withColumn("sum_loss", r6("sum_loss"))


@query("SELECT lang AS run_name, doc_id AS step, n_chars::BIGINT AS n_tokens, (sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id))::BIGINT AS total_tokens FROM documents")
def growing_counters(spark, d):
    path = _folder(spark, "counters")
    own = table(spark, d, "documents").select(F.col("lang").alias("run_name"), F.col("doc_id").alias("step"), F.col("n_chars").alias("n_tokens"))
    own.write.parquet(f"{path}/in")
    stream = stateful.prepared(spark).readStream.schema(own.schema).parquet(f"{path}/in")
    stateful.counted(stream).writeStream.option("checkpointLocation", f"{path}/log").trigger(availableNow=True).format("parquet").start(f"{path}/out").awaitTermination()
    return spark.read.schema(stateful.COUNTERS).parquet(f"{path}/out")


@query("SELECT count(*) AS n_docs, sum(n_chars)::BIGINT AS n_tokens FROM documents")
def ingested_totals(spark, d):
    path = _folder(spark, "ingested")
    own = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("n_tokens"))
    own.repartition(4, "doc_id").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(own.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    streams.ingest_until(stream, f"{path}/out", f"{path}/log", 1 << 62).awaitTermination()
    return spark.read.parquet(f"{path}/out").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


@query("SELECT user_id AS step, round(sum(m) / 3, 6) AS macro FROM (SELECT user_id, event_type, sum(value) AS m FROM events WHERE event_type IN (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 3) GROUP BY ALL) GROUP BY user_id HAVING count(*) = 3")
def polled_evaluations(spark, d):
    path = _folder(spark, "evaluations")
    kinds = [r[0] for r in table(spark, d, "events").select("event_type").distinct().orderBy("event_type").limit(3).collect()]
    own = table(spark, d, "events").where(F.col("event_type").isin(kinds)).groupBy("user_id", "event_type").agg(F.sum("value").alias("m"))
    suites = own.groupBy(F.col("user_id").alias("step")).agg(F.map_from_entries(F.collect_list(F.struct("event_type", "m"))).alias("labels"))
    suites.write.json(f"{path}/in")
    streams.poll_into(spark, f"{path}/in", f"{path}/out", 3)
    streams.poll_into(spark, f"{path}/in", f"{path}/out", 3)  # adds nothing
    return spark.read.parquet(f"{path}/out").select("step", r6("macro").alias("macro"))


# --- sources and sinks, written and read back ---


@query("SELECT doc_id, sha256(text) AS text FROM documents WHERE text <> ''")
def tolerant_lines(spark, d):
    path = _folder(spark, "tolerant")
    own = table(spark, d, "documents").select("doc_id", "text")
    good = own.select(F.to_json(F.struct("doc_id", "text")).alias("value"))
    bad = own.select(F.concat(F.lit('{"doc_id": '), "doc_id", F.lit(', "text": "cut')).alias("value"))
    good.unionByName(bad).unionByName(own.select(F.lit("").alias("value"))).write.text(path)
    return readers.documents_tolerant(spark, path).select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), F.sha2("text", 256).alias("text"))


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS name FROM nation")
def metadata_lists(spark, d):
    path = _folder(spark, "metadata")
    row = F.to_json(F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name")))
    own = table(spark, d, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("[\n"), F.array_join(F.sort_array(F.collect_list(row)), ",\n"), F.lit("\n]\n")).alias("list"))  # 25 nations
    files.write(own.select(F.concat(F.lit("r"), "n_regionkey", F.lit(".json")).alias("name"), F.encode("list", "utf-8").alias("content")), path)
    return readers.metadata_documents(spark, path, "id string, name string").select("id", "name")


@query("SELECT item_id::VARCHAR AS id, sha256(text) AS text FROM benchmark WHERE trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''")
def projected_rows(spark, d):
    own = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.lit("  ").alias("body"), "text")
    return readers.projected(own.select("id", "text", F.lit("x").alias("other")), "repo", ["content"]).select("id", F.sha2("text", 256).alias("text"))


@query("SELECT 'csv' AS kind, o_orderkey, o_totalprice::VARCHAR AS price FROM orders UNION ALL SELECT 'ndjson', o_orderkey, o_totalprice::VARCHAR FROM orders UNION ALL SELECT 'parquet', o_orderkey, o_totalprice::VARCHAR FROM orders")
def universal_records(spark, d):
    path = _folder(spark, "universal")
    own = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("string").alias("price"))
    own.write.option("header", "true").csv(f"{path}/a.csv")
    own.write.json(f"{path}/b.ndjson")
    own.write.parquet(f"{path}/c.parquet")
    out = None
    for kind, name in (("csv", "a.csv"), ("ndjson", "b.ndjson"), ("parquet", "c.parquet")):
        part = readers.records(spark, f"{path}/{name}", schema="o_orderkey long, price string").select(F.lit(kind).alias("kind"), "o_orderkey", "price")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT lang AS domain, count(*) AS n_docs FROM documents GROUP BY lang")
def domain_shards(spark, d):
    own = table(spark, d, "documents").select(F.col("lang").alias("domain"), "doc_id", "text")
    return sinks.jsonl_by_domain(own, _folder(spark, "domain-shards"), docs_per_shard=100, key="doc_id")


@query("SELECT c_custkey, c_name FROM customer")
def parquet_copies(spark, d):
    path = _folder(spark, "parquet-copy")
    sinks.parquet(table(spark, d, "customer").select("c_custkey", "c_name"), path)
    return spark.read.parquet(path)


@query("SELECT doc_id::VARCHAR AS id, source, quality::VARCHAR AS annotations FROM documents JOIN labels USING (doc_id)")
def annotation_shards(spark, d):
    path = _folder(spark, "annotations")
    own = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    sinks.annotations(own.select(F.col("doc_id").cast("string").alias("id"), "source", F.col("quality").cast("string").alias("annotations")), path, 500)
    return readers.mixed(spark, path, zstd_schema="id string, source string, annotations string")


@query("SELECT lower(l_returnflag) AS domain, count(*) AS n FROM lineitem GROUP BY 1")
def listed_shards(spark, d):
    path = _folder(spark, "listing")
    per = table(spark, d, "lineitem").groupBy(F.lower("l_returnflag").alias("flag"), "l_linenumber").agg(F.count("*").cast("int").alias("n"))  # a file for each
    name = F.concat(F.lit("data/"), "flag", F.lit("/"), "l_linenumber", F.lit(".jsonl"))
    files.write(per.select(name.alias("name"), F.encode(F.repeat(F.lit("x"), F.col("n")), "utf-8").alias("content")), path)
    return readers.shard_listing(spark, path).groupBy("domain").agg(F.sum("size").alias("n"))


@query("SELECT p_brand AS path, max(p_size)::BIGINT AS size, row_number() OVER (ORDER BY max(p_size) DESC, p_brand) AS place FROM part GROUP BY p_brand")
def largest_shards(spark, d):
    own = table(spark, d, "part").groupBy(F.col("p_brand").alias("path")).agg(F.max("p_size").cast("long").alias("size"))
    ordered = selection.largest_first(own).withColumn("_i", F.monotonically_increasing_id())
    return ordered.withColumn("place", F.row_number().over(Window.orderBy("_i")).cast("long")).drop("_i")  # a row for each brand


@query("WITH b AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS block FROM documents) SELECT doc_id, block * 64 + row_number() OVER (PARTITION BY block ORDER BY md5('42:' || doc_id), doc_id) - 1 AS position FROM b")
def buffered_order(spark, d):
    out = selection.buffered_shuffle(table(spark, d, "documents").select("doc_id"), ["doc_id"], "doc_id", 64)
    return out.select("doc_id", F.col("position").cast("long").alias("position"))


@query("SELECT item_id::VARCHAR AS id, sha256(text) AS text, 'c' || (item_id % 3) AS config FROM benchmark")
def fixture_rows(spark, d):
    path = _folder(spark, "fixtures")
    own = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text", F.concat(F.lit("c"), F.col("item_id") % 3).alias("_config"))
    own.write.json(path)
    return readers.fixtures(spark, path).select("id", F.sha2("text", 256).alias("text"), "config")


@query("SELECT item_id::VARCHAR AS id, sha256(text) AS text FROM benchmark")
def snapshot_rows(spark, d):
    path = _folder(spark, "snapshots")
    own = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text")
    lines = own.select(F.to_json(F.struct("id", "text")).alias("v")).agg(F.array_join(F.collect_list("v"), "\n").alias("v"))  # the benchmark is small
    files.write(lines.select(F.lit("a.jsonl").alias("name"), F.encode("v", "utf-8").alias("content")), path)
    return readers.instruct_rows(spark, path, "id string, text string", min_bytes=16).select("id", F.sha2("text", 256).alias("text"))


@query("WITH l AS (SELECT event_id, 'run-' || (user_id % 5) AS run_name, user_id AS step, event_type AS label, value FROM events) SELECT run_name, step, label, arg_max(value, event_id) AS loss FROM l WHERE (run_name, step, event_id) IN (SELECT (run_name, step, max(event_id)) FROM l GROUP BY run_name, step) GROUP BY ALL")
def collected_curves(spark, d):
    path = _folder(spark, "curves")
    own = table(spark, d, "events").select("event_id", F.concat(F.lit("run-"), F.col("user_id") % 5).alias("run"), F.to_json(F.struct(F.col("user_id").alias("step"), F.create_map("event_type", "value").alias("task_loss_bpb"))).alias("v"))
    one = own.groupBy("run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "v"))), lambda x: x["v"]), "\n").alias("v"))  # a curve's lines
    files.write(one.select(F.concat("run", F.lit("/eval/curve.jsonl")).alias("name"), F.encode("v", "utf-8").alias("content")), path)
    return readers.curves(spark, path)
