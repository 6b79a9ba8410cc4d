"""Parts of files: runs of Zstandard frames, token ranges, lines by offset; the sink's commit and concatenation."""

from __future__ import annotations

import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from sluice.sources import files, ranges, readers, sinks


def frames(texts: list[bytes], table: bool) -> bytes:
    packed = [zstandard.ZstdCompressor(write_content_size=bool(i % 2), write_checksum=i % 3 == 0).compress(t) for i, t in enumerate(texts)]
    return b"".join(packed) + (ranges.frame_table([(len(z), len(t)) for z, t in zip(packed, texts, strict=True)]) if table else b"")


@pytest.mark.parametrize("table", [True, False])
@pytest.mark.parametrize("run_bytes", [1, 60, 400, 1 << 20])
def test_lines_of_runs_of_frames(tmp_path, table, run_bytes):
    rnd = random.Random(run_bytes)
    for case in range(12):
        whole = b"".join(rnd.choice([b"", b"line %d" % i, bytes(rnd.choices(range(32, 127), k=rnd.choice([3, 40, 3000])))]) + rnd.choice([b"\n", b"\n", b" "]) for i in range(60))
        whole += rnd.choice([b"", b"\n", b"no end"])
        cuts = sorted(rnd.sample(range(len(whole)), rnd.choice([0, 1, 8, 30])))
        texts = [whole[a:b] for a, b in zip([0, *cuts], [*cuts, len(whole)], strict=True)]
        path = tmp_path / f"{table}-{run_bytes}-{case}.zst"
        path.write_bytes(frames(texts, table))
        with open(path, "rb") as f:
            starts = ranges.frame_starts(f, path.stat().st_size)
        assert len(starts) == len(texts)
        runs = ranges.frame_runs(str(path), run_bytes)
        got = [x for r in runs for x in ranges.lines_of(r, chunk=64)]
        want = whole.split(b"\n")
        assert got == (want[:-1] if want[-1] == b"" else want) and len(runs) >= (2 if run_bytes == 1 and len(texts) > 1 else 1)


def test_line_numbers_go_over_runs(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, n in (("a.jsonl.zst", 500), ("sub/b.jsonl.zstd", 3), ("empty.jsonl.zst", 0)):
        lines = [f"{name} {i}".encode() + b"x" * (i % 50) for i in range(n)]
        (tmp_path / name).write_bytes(frames([b"\n".join(lines[i : i + 7]) + b"\n" for i in range(0, n, 7)], True))
    (tmp_path / "c.txt").write_text("not read")
    got = ranges.zstd_lines(spark, str(tmp_path), 300)
    assert got.rdd.getNumPartitions() > 3
    rows = {(r.path.rsplit("/", 1)[-1], r.line_index): r.value for r in got.collect()}
    assert len(rows) == 503 and all(v.split("x")[0].endswith(f" {i}") for (_, i), v in rows.items())
    assert readers.lines(spark, str(tmp_path / "a.jsonl.zst")).count() == 500
    # a path that pyarrow can't open goes through Spark's reader, file by file
    assert readers._zstd_lines(readers._binary(spark, str(tmp_path / "a.jsonl.zst"))).count() == 500


def test_a_damaged_file_is_an_error(tmp_path):
    (tmp_path / "bad.zst").write_bytes(b"no frame at all, but a few bytes")
    with pytest.raises(ValueError, match="no Zstandard frame"):
        ranges.frame_runs(str(tmp_path / "bad.zst"), 1)


def test_token_ranges_are_bounded(spark, tmp_path):
    ids = np.arange(1000, 11_000)
    (tmp_path / "a.bin").write_bytes(ids.astype("<u4").tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    np.save(tmp_path / "b.npy", ids.astype(np.uint16))
    for name, dtype in (("a.bin", "<u4"), ("a.bin", None), ("b.npy", None)):
        rows = ranges.token_ranges(spark, str(tmp_path / name), dtype, 64, 1024).orderBy("start").collect()
        assert [t for r in rows for t in r.ids] == ids.tolist() and max(len(r.ids) for r in rows) == 64
        assert [r.start for r in rows] == list(range(0, 10_000, 64)) and {r.dtype for r in rows} == {"<u2" if name == "b.npy" else "<u4"}
    assert ranges.token_ranges(spark, str(tmp_path / "a.bin"), "<u4", 64, 1024).rdd.getNumPartitions() == 40
    assert ranges.token_ranges(spark, str(tmp_path / "empty.bin")).count() == 0
    assert ranges.token_ranges(spark, str(tmp_path / "*.bin")).agg(F.sum(F.size("ids"))).first()[0] == 10_000
    (tmp_path / "odd.bin").write_bytes(b"12345")
    with pytest.raises(Exception, match="no whole number"):
        ranges.token_ranges(spark, str(tmp_path / "odd.bin")).count()


def test_lines_by_offset_read_only_their_ranges(spark, tmp_path):
    rnd = random.Random(4)
    lines = [f"é{i} " + "x" * rnd.choice([0, 5, 90]) for i in range(5000)]
    (tmp_path / "a.txt").write_bytes("\n".join(lines).encode())  # no newline at the end
    (tmp_path / "b.txt").write_bytes(b"\n\none\r\n\n")
    (tmp_path / "c.txt").write_bytes(b"")
    index = ranges.offset_index(spark, str(tmp_path), every=16, run_bytes=1000)
    points = {(r.path.rsplit("/", 1)[-1], r.line): r.offset for r in index.collect()}
    at = np.append(0, np.cumsum([len(x.encode()) + 1 for x in lines]))
    assert all(at[line] == offset for (p, line), offset in points.items() if p == "a.txt") and len(points) < 5000 / 8
    a, b = (f"file://{tmp_path / x}" for x in ("a.txt", "b.txt"))
    asked = [0, 1, 15, 16, 17, 1234, 4999, 5000, 70_000, -1]
    wanted = spark.createDataFrame([(a, i) for i in asked] + [(a, 16), (b, 0), (b, 2), (b, 3), (b, 4), (None, 1), ("nowhere", 1)], "path string, line long")
    got = {(r.path[-5:], r.line): (r.value, r.n_bytes) for r in ranges.lines_at(wanted, index).collect()}
    assert {k: v for k, (v, _) in got.items()} == {**{("a.txt", i): lines[i] for i in asked if 0 <= i < 5000}, ("b.txt", 0): "", ("b.txt", 2): "one", ("b.txt", 3): ""}
    assert max(n for _, n in got.values()) <= 16 * 96 + 1000  # of 250 000 bytes


def test_many_files_are_committed_in_tasks(spark, tmp_path):
    rows = spark.range(10_000).select(F.concat(F.col("id") % 10, F.lit("/f-"), "id").alias("name"), F.encode(F.col("id").cast("string"), "utf-8").alias("content"))
    assert files.write(rows.repartition(4), str(tmp_path / "m")) == 10_000
    found = {f.name: f.read_text() for f in (tmp_path / "m").glob("*/*")}
    assert len(found) == 10_000 and all(n == f"f-{t}" for n, t in found.items()) and not list((tmp_path / "m").glob("_temporary*"))


def test_names_that_stand_twice_are_an_error(spark, tmp_path):
    two = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2")), ("a", bytearray(b"3"))], "name string, content binary")
    for df in (two.coalesce(1), two.repartition(3), two.select(F.lit(None).cast("string").alias("name"), "content")):
        with pytest.raises(ValueError, match="two rows|without a name"):
            files.write(df, str(tmp_path / "t"))
    assert not [f for f in (tmp_path / "t").rglob("*") if f.is_file()]
    assert files.write(two.limit(0), str(tmp_path / "none")) == 0 and (tmp_path / "none" / "_SUCCESS").exists()
    assert files.write(spark.createDataFrame([("x", None)], "name string, content binary"), str(tmp_path / "null")) == 1 and (tmp_path / "null" / "x").read_bytes() == b""


@pytest.mark.parametrize("copy_bytes", [8, 64, 1 << 20])
def test_parts_are_joined_to_one_file(spark, tmp_path, copy_bytes):
    rnd = np.random.default_rng(1)
    parts = [rnd.integers(0, 1 << 30, n).astype("<u4").tobytes() for n in (5, 0, 40, 1, 17)]
    rows = []
    for i, p in enumerate(parts):
        (tmp_path / f"part-{i}").write_bytes(p)
        rows.append((i, str(tmp_path / f"part-{i}"), len(p)))
    df = spark.createDataFrame(rows, "i int, path string, length long").repartition(3)
    assert files.concatenate(df, str(tmp_path / "whole.bin"), ["i"], 4, copy_bytes) == sum(map(len, parts))
    assert (tmp_path / "whole.bin").read_bytes() == b"".join(parts) and not list(tmp_path.glob("whole.bin.*"))
    with pytest.raises(Exception, match="not whole items"):
        files.concatenate(df.withColumn("length", F.col("length") + 1), str(tmp_path / "bad.bin"), ["i"])
    assert not (tmp_path / "bad.bin").exists()


def test_shards_say_where_their_frames_are(spark, tmp_path):
    df = spark.createDataFrame([(i, "t" * (i % 40)) for i in range(300)], "id long, text string").coalesce(1)
    sinks.jsonl_zstd(df, str(tmp_path / "z"), docs_per_shard=200, frame_docs=16)
    runs = ranges.frame_runs(str(tmp_path / "z"), 50)
    assert len(runs) > 10 and sorted(int(x.split(b'"id":')[1].split(b",")[0]) for r in runs for x in ranges.lines_of(r)) == list(range(300))
