"""Queries that write files and read them back, on odd texts and many files."""

from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest

from sluice.operators import prefix
from sluice.plans import registry
from sluice.sources import files, ranges, sinks
from sluice.sources.storage import checkpointed
from tests.conftest import rows_of


def _documents(spark, folder, texts: list[tuple]) -> str:
    """A folder with documents (doc_id, text, source) as its only table."""
    spark.createDataFrame(texts, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def _same(spark, folder: str, name: str) -> int:
    """Compares the query to its SQL; its rows."""
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got, want = registry.QUERIES[name](spark, folder).toPandas(), db.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
    return len(want)


def test_gzip_lines_leaves_out_rows_without_text(spark, tmp_path):
    texts = ["one", None, "", " ", "\n", "a\x00b", '{"text": "x"}', " ﻿", "null", "7"]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "of no id", "s"), (-3, "", "s")]
    assert _same(spark, _documents(spark, tmp_path, rows), "gzip_lines") == 9


@pytest.mark.parametrize("block_bytes", [64, 400])
def test_token_shards_write_lengths_only(spark, tmp_path, monkeypatch, block_bytes):
    rng = random.Random(5)
    rows = [(g, k, [rng.randrange(1 << 16) for _ in range(rng.choice((0, 1, 3, 40, 333)))]) for g in ("a", "b", None) for k in [None, *rng.sample(range(-50, 50), 60)]]
    rows += [("twice", k // 2, [k] * (k % 7)) for k in range(60)] + [("long", 1, list(range(5000)))]
    docs = spark.createDataFrame(rows, "s string, k int, ids array<int>").repartition(5)
    written = []
    monkeypatch.setattr(prefix, "checkpointed", lambda df: written.append(df.dtypes) or checkpointed(df))
    got = sinks.token_shards(docs, "ids", ["k"], 8, 7, ["s"], "<u2", single_task_rows=0, block_bytes=block_bytes).collect()
    assert written and not any(kind in ("binary", "array<int>") for kinds in written for _, kind in kinds)
    for s in ("a", "b", None, "twice", "long"):
        # documents of one key are in the order of their lengths and contents
        own = sorted((r for r in rows if r[0] == s), key=lambda r: (r[1] is not None, r[1], len(r[2])))
        stream = np.array([x for r in own for x in [*r[2], 7]], "<u2")
        shards = sorted((r.shard, r.n_tokens, bytes(r.content)) for r in got if r.s == s)
        assert shards == [(i, len(stream[a : a + 8]), stream[a : a + 8].tobytes()) for i, a in enumerate(range(0, len(stream), 8))]
    none = sinks.token_shards(docs.where("k > 1000"), "ids", ["k"], 8, single_task_rows=0)
    assert none.collect() == [] and none.columns == ["shard", "n_tokens", "content"]


def test_the_parts_of_a_file_are_not_listed_by_the_driver(spark, tmp_path, monkeypatch):
    rows = [(i, "é" * (i % 5), "s") for i in range(40)]
    monkeypatch.setattr(ranges, "listed", lambda *_: pytest.fail("the driver lists the parts"))
    whole = registry.QUERIES["concatenated_file"](spark, _documents(spark, tmp_path, rows))
    assert whole is not None
    own = spark.createDataFrame([("a", bytearray(b"xyz")), ("b/c", None)], "name string, content binary")
    assert sorted(map(tuple, files.written(own, f"{tmp_path}/w/").collect())) == [(f"{tmp_path}/w/a", 3), (f"{tmp_path}/w/b/c", 0)]
