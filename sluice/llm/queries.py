"""The queries of this package's operators over the documents, pages and embeddings tables, whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import fit, found

    docs = table(spark, sf_dir, "documents")
    return found(docs, fit(docs))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, scored

    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import flagged

    return flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .maxscore import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, scored

    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))


def op6_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bagminhash import classes

    return classes(table(spark, sf_dir, "documents"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_fmindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fmindex import deduplicated

    return deduplicated(table(spark, sf_dir, "documents")).drop("spans")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_count import counted

    return counted(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import build, search

    return search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_lm import scored

    return scored(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mined

    return mined(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_toxicity, op3_decontaminate, op4_maxscore, op5_quality, op6_bagminhash, op7_bpe_codec, op8_fmindex, op9_warc, op10_token_count, op11_lexical_search, op12_ngram_lm, op13_hard_negatives)}

ORACLE_SQL: dict[str, str] = {
    "op4_maxscore": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, k::INTEGER AS rank, vec_id, score FROM r WHERE k <= 10""",
    "op8_fmindex": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
     x AS (SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, words FROM w),
     h AS (SELECT doc_id, i, md5(array_to_string(words[i : i + 34], ' ')) AS h FROM x),
     r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM h) WHERE n > 1),
     g AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 35)))) AS gone FROM r GROUP BY doc_id),
     k AS (SELECT doc_id, words, coalesce(len(gone), 0) AS n_removed,
                  array_to_string(list_filter(words, lambda v, i: gone IS NULL OR NOT list_contains(gone, i)), ' ') AS kept
           FROM w LEFT JOIN g USING (doc_id))
SELECT doc_id, len(words)::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(kept) AS kept_sha256 FROM k""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
     k AS (SELECT payload_digest, max(page_id) AS keeper FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN keeper IS NULL OR page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM d LEFT JOIN k USING (payload_digest)""",
    "op11_lexical_search": r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
     d AS (SELECT doc_id, r, ts, len(ts)::BIGINT AS n FROM t WHERE len(ts) > 0),
     g AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
     b AS (SELECT item_id, row_number() OVER () AS q, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
     i AS (SELECT item_id, q, term, count(*)::BIGINT AS times FROM b GROUP BY ALL),
     p AS (SELECT doc_id, r, n, unnest(ts) AS term FROM d),
     f AS (SELECT doc_id, r, n, term, count(*)::BIGINT AS tf FROM p WHERE term IN (SELECT term FROM i) GROUP BY ALL),
     w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, g GROUP BY term, n_docs),
     s AS (SELECT item_id, q, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
           FROM f JOIN w USING (term) JOIN i USING (term), g GROUP BY ALL),
     k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10""",
    "op13_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, list_inner_product(a.e, c.e)::BIGINT AS score
           FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
     p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
           QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
     n AS (SELECT anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
                  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
           FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
}
