"""Readers of documents, tokens, manifests and logs. Paths go to Spark's readers only, so any storage serves."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import text as tx
from sluice.operators.prefix import accumulated, carried

from . import ranges

DOC = "id string, text string, source string, metadata string"


def _zstd_lines(files: DataFrame) -> DataFrame:
    """(path, line_index, value) of .zst text files, one stream for each file, line by line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content.as_py()), read_across_frames=True)
                lines, at = [], 0
                for line in io.TextIOWrapper(stream, "utf-8", "replace", newline="\n"):
                    lines.append(line.rstrip("\r\n"))
                    if len(lines) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines)), pa.array(range(at, at + len(lines)), pa.int64()), pa.array(lines)], ["path", "line_index", "value"])
                        at, lines = at + len(lines), []
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(lines), pa.string()), pa.array(range(at, at + len(lines)), pa.int64()), pa.array(lines, pa.string())], ["path", "line_index", "value"])

    return files.select("path", "content").mapInArrow(run, "path string, line_index long, value string")


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def _binary_below(spark: SparkSession, path: str) -> DataFrame:
    """As _binary; where folders of the path hold a *, their common folder is listed once, not each file as a path."""
    folder, _, name = path.rpartition("/")
    if "*" not in folder or re.search(r"[?{}\[\]\\]", path):
        return _binary(spark, path)
    root = folder[: folder.index("*")].rpartition("/")[0]
    wanted = "[^/]*".join(re.escape(x) for x in re.sub(r"^\w+:/*|^/+", "", path).split("*"))
    found = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=name).load(root)
    return found.where(F.col("path").rlike(rf"^\w+:/*{wanted}$"))


def _packed_lines(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".zst", ".zstd")) -> DataFrame:
    """Lines of Zstandard files by runs of frames; where only Spark opens the path, a task for each whole file."""
    try:
        ranges.file_system(path)
    except (OSError, pa.ArrowException):
        names = "{" + ",".join(f"*{s}" for s in suffixes) + "}"
        return _zstd_lines(spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter=names).load(path))
    return ranges.zstd_lines(spark, path, suffixes=suffixes)


def lines(spark: SparkSession, path: str, zstd: bool = False) -> DataFrame:
    """(path, line_index, value); plain and gzip files through Spark's text source, zstd ones by runs of frames.

    Line numbers follow the file: the text source's rows of a file are in order within and across its splits.
    """
    if zstd or path.endswith((".zst", ".zstd")):
        return _packed_lines(spark, path)
    raw = spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"), "value")
    # a split's rows have growing numbers, the splits of a file growing starts; a very long file is no single task
    at = accumulated(raw, ["_b", "_i"], None, ["path"])
    return at.select("path", (F.col("rn") - 1).cast("long").alias("line_index"), "value")


def documents_strict(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_index, text, value): JSON lines; bad JSON is an error, blank lines and objects without text are skipped."""
    own = lines(spark, path).where(tx.strip(F.col("value")) != "")
    good = F.try_parse_json("value").isNotNull()
    own = own.where(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("bad JSON in "), "path", F.lit(" line "), F.col("line_index").cast("string"))).cast("boolean")))
    return own.where(F.col("value").rlike(r"^\s*\{")).withColumn("text", tx.document_text(F.col("value"))).where("text is not null")


def documents_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """As documents_strict, but bad JSON is skipped."""
    own = lines(spark, path).where(F.try_parse_json("value").isNotNull() & F.col("value").rlike(r"^\s*\{"))
    return own.withColumn("text", tx.document_text(F.col("value"))).where("text is not null")


def mixed(spark: SparkSession, root: str, columns: list[str] | None = None, zstd_schema: str = DOC) -> DataFrame:
    """Records under a root in JSON lines (plain, gzip, zstd) and Parquet, by name; each file is read once."""
    parts = []
    options = {"recursiveFileLookup": "true", "ignoreMissingFiles": "true"}
    for glob, kind in (("*.parquet", "parquet"), ("*.{jsonl,jsonl.gz,json.gz,ndjson}", "json")):
        files = spark.read.format("binaryFile").options(**options, pathGlobFilter=glob).load(root).select("path")
        if not files.isEmpty():
            parts.append(spark.read.options(**options, pathGlobFilter=glob).format(kind).load(root))
    packed = (".jsonl.zst", ".jsonl.zstd")
    files = spark.read.format("binaryFile").options(**options, pathGlobFilter="*.jsonl.{zst,zstd}").load(root).select("path")
    if not files.isEmpty():
        parts.append(_packed_lines(spark, root, packed).select(F.from_json("value", zstd_schema).alias("r")).where("r is not null").select("r.*"))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else spark.createDataFrame([], DOC)
    return out if columns is None else out.select(*[c for c in columns if c in out.columns])


UNIVERSAL = {"jsonl": "json", "ndjson": "json", "json": "json", "parquet": "parquet", "csv": "csv", "tsv": "csv", "txt": "text"}


def records(spark: SparkSession, path: str, text_field: str = "text", schema: str | None = None) -> DataFrame:
    """Records of a file by its suffix, with or without .gz: JSON lines, JSON lists or {"data": [...]}, Parquet, CSV, TSV, text."""
    name = path.lower()
    zipped = name.endswith((".zst", ".zstd"))
    stem = name.removesuffix(".gz").removesuffix(".zstd").removesuffix(".zst").rsplit(".", 1)[-1]
    if stem not in UNIVERSAL:
        raise ValueError(f"unknown suffix: {path}")
    if zipped:
        rows = _packed_lines(spark, path)
        if stem == "txt":
            return rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "value"))), lambda x: x["value"]), "\n").alias(text_field)).select(text_field)
        return rows.where(F.try_parse_json("value").isNotNull()).select(F.from_json("value", schema or DOC).alias("r")).select("r.*")
    read = spark.read.schema(schema) if schema else spark.read
    if stem == "parquet":
        return read.parquet(path)
    if stem in ("csv", "tsv"):
        return read.option("header", "true").option("sep", "\t" if stem == "tsv" else ",").option("multiLine", "true").csv(path)
    if stem == "txt":
        return spark.read.text(path, wholetext=True).withColumnRenamed("value", text_field)
    out = read.option("multiLine", "true" if stem == "json" else "false").json(path)
    if stem == "json" and out.columns == ["data"] and isinstance(out.schema["data"].dataType, T.ArrayType):
        return out.select(F.inline("data"))
    return out


def has_documents(df: DataFrame, text_field: str = "text", probe: int = 5) -> tuple[bool, list[str]]:
    """Whether the first records hold a text, and the columns there are."""
    if text_field not in df.columns:
        return False, df.columns
    return not df.limit(probe).where(F.coalesce(F.col(text_field).cast("string"), F.lit("")) != "").isEmpty(), df.columns


def metadata_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON list that stands one to a line: brackets and trailing commas are cut; the last value of an id counts."""
    own = lines(spark, path).withColumn("value", F.regexp_replace(tx.strip(F.col("value")), r",$", "")).where(~F.col("value").isin("[", "]", ""))
    return own.select("path", "line_index", F.from_json("value", schema).alias("r")).where("r is not null").select("path", "line_index", "r.*")


def metadata_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As metadata_lines; a file that gives no object that way is read whole, as one JSON list or object."""
    by_line = metadata_lines(spark, path, schema).where(F.coalesce(*[F.col(f.name).cast("string") for f in T._parse_datatype_string(schema).fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]).isNotNull())
    whole = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    left = whole.join(by_line.select("path").distinct(), "path", "left_anti").where(F.try_parse_json("value").isNotNull())
    many = F.from_json("value", f"array<struct<{_colons(schema)}>>")
    return by_line.unionByName(left.select("path", F.posexplode(many).alias("line_index", "r")).select("path", F.col("line_index").cast("long").alias("line_index"), "r.*"))


def _colons(schema: str) -> str:
    return ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in T._parse_datatype_string(schema).fields)


def last_by_id(df: DataFrame, key: str = "id") -> DataFrame:
    rest = [c for c in df.columns if c not in (key, "path", "line_index")]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("path", "line_index")).alias("r")).select(key, "r.*")


def select_parquet(spark: SparkSession, path: str, predicate: Column | str, columns: list[str]) -> DataFrame:
    """Column pruning and predicate reach the scan."""
    return spark.read.parquet(path).where(predicate).select(*columns)


def batches(df: DataFrame, columns: list[str], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The chosen columns in Arrow batches of `rows` rows (the last one of what is left), columnar all the way.

    Tasks send Arrow streams of at most so many rows; one partition at a time comes to the driver.
    """
    own = df.select(*columns)

    def packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for a in range(0, part.num_rows, rows):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as out:
                    out.write_batch(part.slice(a, rows))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["z"])

    have, n = [], 0
    for row in own.mapInArrow(packed, "z binary").toLocalIterator(prefetchPartitions=True):
        have += pa.ipc.open_stream(bytes(row.z)).read_all().to_batches()
        n = sum(b.num_rows for b in have)
        while n >= rows:
            whole = pa.Table.from_batches(have).combine_chunks()
            yield whole.slice(0, rows).to_batches()[0]
            have, n = whole.slice(rows).to_batches(), n - rows
    if n:
        yield pa.Table.from_batches(have).combine_chunks().to_batches()[0]


def key_ranges(spark: SparkSession, low: int, high: int, n: int) -> DataFrame:
    """(part, lo, hi): [low, high] in n ranges of equal length, rounded up; hi is exclusive."""
    step = max(1, -(-(high - low + 1) // n))
    own = spark.range(n).select(F.col("id").cast("int").alias("part"), (F.lit(low) + F.col("id") * step).alias("lo"))
    return own.withColumn("hi", F.least(F.lit(high + 1), F.col("lo") + step)).where("lo < hi")


def jdbc_ranges(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, n: int, fetch: int = 50_000) -> DataFrame:
    """A table by key ranges, a task each; needs the database's driver on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high + 1, numPartitions=n, fetchsize=fetch).load()


def sqlite_ranges(spark: SparkSession, path: str, query: str, ranges: DataFrame, schema: str, fetch: int = 50_000) -> DataFrame:
    """Rows of a SQLite file that all executors can open: `query` has two parameters, lo (inclusive) and hi (exclusive)."""
    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sqlite3

        for batch in batches:
            for lo, hi in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                    cursor = db.execute(query, (lo, hi))
                    while rows := cursor.fetchmany(fetch):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    return ranges.select("lo", "hi").repartition(max(1, ranges.count())).mapInArrow(run, schema)


def projected(df: DataFrame, repo: str, text_fields: list[str], id_fields: list[str] = ["id", "url"], order: list[str] | None = None) -> DataFrame:  # noqa: B006
    """(id, text): the first filled text field; rows of white space only go; ids fall back to repo-i.

    i is the row's number by `order` (a file and a line, say), or by the hash of its content: the same however often and
    in whatever partitions the rows are read.
    """
    have = [F.col(c).cast("string") for c in dict.fromkeys(text_fields + ["content", "text"]) if c in df.columns]
    ids = [tx.blank_to_null(F.col(c).cast("string")) for c in id_fields if c in df.columns]
    if order is None:
        df, order = df.withColumn("_content", F.sha2(F.to_json(F.struct(*df.columns)), 256)), ["_content"]
    numbered = accumulated(df, order)
    own = numbered.select(F.coalesce(*ids, F.concat(F.lit(f"{repo}-"), (F.col("rn") - 1).cast("string"))).alias("id"), tx.first_text(*have).alias("text"))
    return own.where(F.coalesce(tx.strip(F.col("text")) != "", F.lit(False)))


def snapshots(spark: SparkSession, path: str, min_bytes: int = 1024) -> DataFrame:
    """JSON-lines snapshots; files under min_bytes are stubs and skipped."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jsonl,jsonl.gz}").text(path)
    return raw.where(F.col("_metadata.file_size") >= min_bytes).select("value")


def instruct_rows(spark: SparkSession, path: str, schema: str, fallback: DataFrame | None = None, min_bytes: int = 1024) -> DataFrame:
    """Rows of the local snapshots; of `fallback` (the rows of another source) if there are none. Lines that aren't JSON go."""
    from pyspark.errors import AnalysisException

    try:
        own = snapshots(spark, path, min_bytes).where(F.try_parse_json("value").isNotNull()).select(F.from_json("value", schema).alias("r")).select("r.*")
        if fallback is None or not own.isEmpty():
            return own
    except AnalysisException as e:
        if fallback is None or "PATH_NOT_FOUND" not in str(e):
            raise
    return fallback


def fixtures(spark: SparkSession, path: str, config_field: str = "_config") -> DataFrame:
    """Fixture rows with their configuration apart."""
    df = spark.read.json(path)
    config = F.col(config_field) if config_field in df.columns else F.lit(None).cast("string")
    return df.withColumn("config", config).drop(config_field)


def token_counts(spark: SparkSession, path: str, item_bytes: int = 4) -> DataFrame:
    """Counts from file lengths alone: no content is read."""
    files = _binary_below(spark, path).select("path", "length")
    fits = F.when(F.col("length") % item_bytes == 0, F.col("length") / item_bytes)
    return files.select("path", F.coalesce(fits, F.raise_error(F.concat(F.lit("not whole tokens: "), "path")).cast("double")).cast("long").alias("n_tokens"))


def shard_listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, domain) of data files under root/data/<domain>/, sorted by path; no content is read."""
    from sluice.operators.filters import is_data_file

    files = _binary(spark, root)
    own = files.where(is_data_file(F.lower("path"))).select("path", F.col("length").alias("size"))
    return own.withColumn("domain", tx.domain_of_path(F.col("path"))).orderBy("path")


def manifest_listing(spark: SparkSession, path: str) -> DataFrame:
    """As shard_listing, from a manifest of JSON lines (path, size or bytes)."""
    from sluice.operators.filters import is_data_file

    rows = spark.read.schema("path string, size long, bytes long").json(path).where(is_data_file(F.lower("path")))
    return rows.select("path", F.coalesce("size", "bytes").alias("size"), tx.domain_of_path(F.col("path")).alias("domain")).orderBy("path")


def curves(spark: SparkSession, path: str) -> DataFrame:
    """(run_name, step, label, loss) of JSON-lines loss curves, one folder for each run; the last row of a step counts."""
    raw = lines(spark, path)
    own = raw.select("path", "line_index", F.from_json("value", "step long, task_loss_bpb map<string,double>").alias("r")).where("r.step is not null")
    name = F.element_at(F.split("path", "/"), -3)
    last = own.groupBy(name.alias("run_name"), F.col("r.step").alias("step")).agg(F.max_by("r.task_loss_bpb", "line_index").alias("m"))
    return last.select("run_name", "step", F.explode("m").alias("label", "loss"))


def missing_runs(expected: DataFrame, found: DataFrame, on: str = "run_name") -> DataFrame:
    return expected.select(on).join(found.select(on), on, "left_anti")


def log_points(raw: DataFrame, step: str = r"step[= ](\d+)", value: str = r"^\s*([\w./-]+)\s*[:=]\s*(-?\d+(?:\.\d+)?(?:e-?\d+)?)\s*$") -> DataFrame:
    """(path, step, key, value) from log lines (path, line_index, value): values under the last step header above them."""
    head = F.regexp_extract("value", step, 1)
    own = carried(raw.withColumn("_head", F.when(head != "", head.cast("long"))), ["line_index"], "_head", ["path"]).withColumnRenamed("_last", "step")
    key = F.regexp_extract("value", value, 1)
    return own.where((key != "") & (head == "") & F.col("step").isNotNull()).select("path", "step", key.alias("key"), F.regexp_extract("value", value, 2).cast("double").alias("value"))
