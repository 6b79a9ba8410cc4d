"""Readers of parts of files: runs of Zstandard frames, ranges of raw tokens, lines by their offsets.

Each plans partitions from file lengths and headers alone and streams its part, so that neither a task nor the driver
holds a file. Files are opened by the file system that the path names (as pyarrow knows it).
"""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import file_system

#: Bytes of a file that a task reads, and rows that it sends on together.
RUN_BYTES, ROWS = 1 << 26, 4096
#: Tasks that runs and small files are dealt to before tasks get more than `run_bytes` each (RUN_BYTES at most).
TASKS = 256


def listed(path: str, suffixes: tuple[str, ...] = ()) -> list[tuple[str, int]]:
    """(path, length) of a file, of the files below a folder, or of those that a pattern with * names; by path.

    Local paths have file:// in front.
    """
    from pyarrow.fs import FileSelector, FileType

    fs, root = file_system(path)
    if "*" in root:
        pattern, root = root, root[: root.index("*")].rsplit("/", 1)[0]
        wanted = re.compile("[^/]*".join(map(re.escape, pattern.split("*"))))
        infos = [i for i in fs.get_file_info(FileSelector(root, recursive=True)) if wanted.fullmatch(i.path)]
    else:
        own = fs.get_file_info(root)
        if own.type == FileType.NotFound:
            raise FileNotFoundError(path)
        infos = [own] if own.type == FileType.File else fs.get_file_info(FileSelector(root, recursive=True))
    hidden = lambda p: any(x.startswith(("_", ".")) for x in p.removeprefix(root).split("/"))
    head = "file://" if fs.type_name == "local" else path[: path.index(root)] if root in path else ""
    return sorted((head + i.path, i.size) for i in infos if i.type == FileType.File and not hidden(i.path) and (not suffixes or i.path.endswith(suffixes)))


class Span(io.RawIOBase):
    """The bytes from `at` up to `end` of an open file, and how many have been read."""

    def __init__(self, source, at: int, end: int):
        self.source, self.at, self.end, self.taken = source, at, end, 0
        source.seek(at)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        got = self.source.read(min(len(buffer), self.end - self.at))
        buffer[: len(got)] = got
        self.at, self.taken = self.at + len(got), self.taken + len(got)
        return len(got)


# --- Zstandard ---

# Marks of the format's frames and of the table of frames at a file's end.
MAGIC, SKIPPABLE, TABLE, TABLE_END = 0xFD2FB528, 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


def frame_table(sizes: list[tuple[int, int]]) -> bytes:
    """A frame that decoders skip, with (compressed, plain) bytes of each frame before it; goes to the file's end."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, TABLE_END)
    return struct.pack("<II", TABLE, len(body)) + body


def frame_starts(source, length: int) -> list[int]:
    """Where a Zstandard file's frames begin: by the table at its end, else by going from block header to block header."""
    if length >= 17:
        source.seek(length - 9)
        n, flags, mark = struct.unpack("<IBI", source.read(9))
        if mark == TABLE_END:
            entry = 12 if flags & 0x80 else 8
            source.seek(length - 9 - n * entry)
            sizes = [struct.unpack_from("<I", source.read(entry))[0] for _ in range(n)]
            return np.append(0, np.cumsum(sizes, dtype=np.int64))[:-1].tolist()
    starts, at = [], 0
    while at < length:
        source.seek(at)
        head = source.read(18)
        mark = struct.unpack_from("<I", head)[0]
        if mark & 0xFFFFFFF0 == SKIPPABLE:
            at += 8 + struct.unpack_from("<I", head, 4)[0]
            continue
        if mark != MAGIC:
            raise ValueError(f"no Zstandard frame at byte {at}")
        starts.append(at)
        kind = head[4]
        single, size = kind >> 5 & 1, kind >> 6
        at += 5 + (1 - single) + (0, 1, 2, 4)[kind & 3] + ((0, 2, 4, 8)[size] or single)
        last = 0
        while not last:
            source.seek(at)
            block = int.from_bytes(source.read(3), "little")
            last = block & 1
            at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        at += 4 * (kind >> 2 & 1)
    return starts


@dataclass
class Run(InputPartition):
    path: str
    start: int
    end: int
    length: int


def frame_runs(path: str, run_bytes: int = RUN_BYTES, suffixes: tuple[str, ...] = (".zst", ".zstd")) -> list[Run]:
    """Runs of whole frames of about `run_bytes` compressed bytes; only files longer than that are looked into.

    Runs get longer (up to RUN_BYTES) where there were over TASKS of them else.
    """
    out, found = [], listed(path, suffixes)
    run_bytes = max(run_bytes, min(RUN_BYTES, sum(length for _, length in found) // TASKS))
    for name, length in found:
        starts = [0]
        if length > run_bytes:
            fs, at = file_system(name)
            with fs.open_input_file(at) as source:
                starts = frame_starts(source, length)
        edges = [0]
        for s in starts:
            if s - edges[-1] >= run_bytes:
                edges.append(s)
        out += [Run(name, a, b, length) for a, b in zip(edges, [*edges[1:], length], strict=True)]
    return out


def lines_of(run: Run, chunk: int = 1 << 20) -> Iterator[bytes]:
    """A run's lines: those that begin in it, but for one that begins with it, which the run before reads to its end."""
    import zstandard

    fs, at = file_system(run.path)
    with fs.open_input_file(at) as source:
        plain = lambda a, b: zstandard.ZstdDecompressor().stream_reader(io.BufferedReader(Span(source, a, b), chunk), read_across_frames=True)
        stream, rest, skip = plain(run.start, run.end), b"", run.start > 0
        while block := stream.read(chunk):
            parts = (rest + block).split(b"\n")
            rest = parts.pop()
            if parts and skip:
                parts, skip = parts[1:], False
            yield from parts
        if run.end == run.length:
            if rest and not skip:
                yield rest
            return
        if skip:  # not one line ends here
            return
        stream = plain(run.end, run.length)
        while block := stream.read(chunk):
            head, found, _ = block.partition(b"\n")
            rest += head
            if found:
                break
        else:
            if not rest:
                return
        yield rest


class ZstdReader(DataSourceReader):
    def __init__(self, path: str, run_bytes: int, suffixes: tuple[str, ...]):
        self.path, self.run_bytes, self.suffixes = path, run_bytes, suffixes

    def partitions(self) -> list[Run]:
        return frame_runs(self.path, self.run_bytes, self.suffixes) or [Run("", 0, 0, 0)]

    def read(self, run: Run) -> Iterator[pa.RecordBatch]:
        at, have, size = 0, [], 0

        def batch() -> pa.RecordBatch:
            value = [x.decode("utf-8", "replace").removesuffix("\r") for x in have]
            return pa.RecordBatch.from_arrays([pa.array([run.path] * len(have), pa.string()), pa.array([run.start] * len(have), pa.int64()), pa.array(range(at, at + len(have)), pa.int64()), pa.array(value, pa.string())], ["path", "start", "nth", "value"])

        for line in lines_of(run) if run.length else ():
            have.append(line)
            size += len(line)
            if len(have) == ROWS or size > 1 << 22:
                yield batch()
                at, have, size = at + len(have), [], 0
        if have:
            yield batch()


class ZstdLines(DataSource):
    """Format `sluice_zstd_lines`: (path, start, nth, value), the nth line of the run of frames from byte `start`."""

    @classmethod
    def name(cls) -> str:
        return "sluice_zstd_lines"

    def schema(self) -> str:
        return "path string, start long, nth long, value string"

    def reader(self, schema) -> ZstdReader:
        return ZstdReader(self.options["path"], int(self.options.get("runBytes", RUN_BYTES)), tuple(self.options.get("suffixes", ".zst,.zstd").split(",")))


def zstd_lines(spark: SparkSession, path: str, run_bytes: int = RUN_BYTES, suffixes: tuple[str, ...] = (".zst", ".zstd")) -> DataFrame:
    """(path, line_index, value) of Zstandard text files, each run of frames a task.

    Where a file is several runs, a first pass counts the runs' lines, from which the numbers go on.
    """
    spark.dataSource.register(ZstdLines)
    rows = spark.read.format("sluice_zstd_lines").option("runBytes", run_bytes).option("suffixes", ",".join(suffixes)).load(path)
    if all(r.start == 0 for r in frame_runs(path, run_bytes, suffixes)):
        return rows.select("path", F.col("nth").alias("line_index"), "value")
    from pyspark.sql import Window

    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("path", "start").agg(F.count("*").alias("n"))  # a row for each run
    before = counts.select("path", "start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), ["path", "start"]).select("path", (F.col("before") + F.col("nth")).alias("line_index"), "value")


# --- raw tokens ---


def array_layout(source, length: int, dtype: str | None) -> tuple[str, int]:
    """(dtype, first byte) of a raw token array; with dtype None by its head: .npy, 16 or 32 bits.

    16 bits if the first values may be ids of a vocabulary of 100 000, unless every other one is 0, as upper halves are.
    """
    source.seek(0)
    head = source.read(min(length, 8192))
    if head[:6] == b"\x93NUMPY":
        file = io.BytesIO(head)
        version = np.lib.format.read_magic(file)
        _, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)
        dtype, at = kind.str, file.tell()
        if fortran or kind.kind not in "iu":
            raise ValueError("no array of ids")
    else:
        at = 0
        if dtype is None:
            halves = np.frombuffer(head[: len(head) // 2 * 2], "<u2")
            short = length % 2 == 0 and len(halves) > 0 and int(halves.max()) < 100_000
            dtype = "<u2" if short and not (length % 4 == 0 and len(halves) >= 2 and not halves[1::2].any()) else "<u4"
    if (length - at) % np.dtype(dtype).itemsize:
        raise ValueError(f"{length - at} bytes are no whole number of {np.dtype(dtype).itemsize}-byte tokens")
    return dtype, at


@dataclass
class TokenRun:
    path: str
    dtype: str | None
    at: int  # byte of the file's first token; -1: the whole file, whose layout the task looks up
    start: int  # token
    end: int


@dataclass
class TokenRuns(InputPartition):
    runs: list[TokenRun]


#: What opening a file counts for when files are dealt to tasks, and ids that a task holds at once.
OPEN_BYTES, HELD_IDS = 1 << 12, 1 << 18


class TokenReader(DataSourceReader):
    def __init__(self, path: str, dtype: str | None, row_tokens: int, run_bytes: int):
        self.path, self.dtype, self.row_tokens, self.run_bytes = path, dtype, row_tokens, run_bytes

    def partitions(self) -> list[TokenRuns]:
        found = listed(self.path)
        most = max(self.run_bytes, min(RUN_BYTES, sum(max(OPEN_BYTES, length) for _, length in found) // TASKS))
        runs: list[tuple[int, TokenRun]] = []
        for name, length in found:
            if length <= most:
                runs.append((max(OPEN_BYTES, length), TokenRun(name, self.dtype, -1, 0, 0)))
                continue
            fs, root = file_system(name)
            with fs.open_input_file(root) as source:
                dtype, at = array_layout(source, length, self.dtype)
            item = np.dtype(dtype).itemsize
            n, step = (length - at) // item, max(1, most // item // self.row_tokens) * self.row_tokens
            runs += [((min(n, s + step) - s) * item, TokenRun(name, dtype, at, s, min(n, s + step))) for s in range(0, n, step)]
        out, have = [TokenRuns([])], 0
        for size, run in runs:
            if out[-1].runs and have + size > most:
                out.append(TokenRuns([]))
                have = 0
            out[-1].runs.append(run)
            have += size
        return out

    def read(self, part: TokenRuns) -> Iterator[pa.RecordBatch]:
        for run in part.runs:
            yield from self._rows(run)

    def _rows(self, run: TokenRun) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(run.path)
        with fs.open_input_file(root) as source:
            dtype, at, end = run.dtype, run.at, run.end
            if at < 0:
                dtype, at = array_layout(source, source.size(), dtype)
                end = (source.size() - at) // np.dtype(dtype).itemsize
            item, kind = np.dtype(dtype).itemsize, np.dtype(dtype).str
            held = max(1, HELD_IDS // self.row_tokens) * self.row_tokens
            for s in range(run.start, end, held):
                n = min(held, end - s)
                source.seek(at + s * item)
                ids = np.frombuffer(source.read(n * item), dtype).astype(np.int64)
                if len(ids) != n:
                    raise ValueError(f"{run.path} ends before token {s + n}")
                starts = np.arange(0, n, self.row_tokens)
                rows = pa.ListArray.from_arrays(pa.array(np.append(starts, n), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array([run.path] * len(rows)), pa.array(s + starts, pa.int64()), pa.array([kind] * len(rows)), rows], ["path", "start", "dtype", "ids"])


class Tokens(DataSource):
    """Format `sluice_tokens`: (path, start, dtype, ids), a row for each `rowTokens` tokens of raw arrays."""

    @classmethod
    def name(cls) -> str:
        return "sluice_tokens"

    def schema(self) -> str:
        return "path string, start long, dtype string, ids array<bigint>"

    def reader(self, schema) -> TokenReader:
        return TokenReader(self.options["path"], self.options.get("dtype"), int(self.options.get("rowTokens", 1 << 16)), int(self.options.get("runBytes", RUN_BYTES)))


def token_ranges(spark: SparkSession, path: str, dtype: str | None = "<u4", row_tokens: int = 1 << 16, run_bytes: int = RUN_BYTES) -> DataFrame:
    """(path, start, dtype, ids) of raw token arrays: rows of at most `row_tokens` ids from token `start` on.

    Files are cut into ranges of whole rows by their lengths; only heads of files that are cut are read to plan. A task
    gets about `run_bytes`, of as many files as it takes; more (up to RUN_BYTES) where there were over TASKS tasks else.
    """
    spark.dataSource.register(Tokens)
    rows = spark.read.format("sluice_tokens").option("rowTokens", row_tokens).option("runBytes", run_bytes)
    return (rows.option("dtype", dtype) if dtype else rows).load(path)


# --- lines by offset ---


@dataclass
class Piece(InputPartition):
    path: str
    start: int
    end: int


class OffsetReader(DataSourceReader):
    def __init__(self, path: str, every: int, run_bytes: int):
        self.path, self.every, self.run_bytes = path, every, run_bytes

    def partitions(self) -> list[Piece]:
        return [Piece(name, s, min(length, s + self.run_bytes)) for name, length in listed(self.path) for s in range(0, length, self.run_bytes)] or [Piece("", 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        """Where every n-th of the lines that begin in the piece does, and how many these are (as the last row)."""
        if piece.start == piece.end:
            return
        fs, root = file_system(piece.path)
        at, n, points = piece.start, 0, []
        with fs.open_input_file(root) as source:
            source.seek(at - 1 if at else 0)
            fresh = at == 0 or source.read(1) == b"\n"  # whether a line begins at `at`
            while at < piece.end:
                block = source.read(min(1 << 20, piece.end - at))
                begins = np.flatnonzero(np.frombuffer(block, np.uint8) == 10) + 1
                begins = np.append([0] if fresh else [], begins).astype(np.int64)
                fresh = bool(len(begins)) and int(begins[-1]) == len(block)
                begins = begins[begins < len(block)]
                points += [(n + i, at + int(begins[i])) for i in range(-n % self.every, len(begins), self.every)]
                n, at = n + len(begins), at + len(block)
        cols = [[piece.path] * (len(points) + 1), [piece.start] * (len(points) + 1), [p for p, _ in points] + [n], [o for _, o in points] + [None]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["path", "piece", "nth", "offset"])


class Offsets(DataSource):
    """Format `sluice_offsets`: (path, piece, nth, offset) of every n-th line of each piece; offset null: the piece's number of lines."""

    @classmethod
    def name(cls) -> str:
        return "sluice_offsets"

    def schema(self) -> str:
        return "path string, piece long, nth long, offset long"

    def reader(self, schema) -> OffsetReader:
        return OffsetReader(self.options["path"], int(self.options.get("every", 1024)), int(self.options.get("runBytes", RUN_BYTES)))


def offset_index(spark: SparkSession, path: str, every: int = 1024, run_bytes: int = RUN_BYTES) -> DataFrame:
    """(path, line, offset, next_line, end) of plain text files: a point at least every `every` lines, read once by pieces.

    The lines from `line` to `next_line` are the bytes from `offset` to `end`; at a file's end both are large numbers.
    """
    from pyspark.sql import Window

    spark.dataSource.register(Offsets)
    rows = spark.read.format("sluice_offsets").option("every", every).option("runBytes", run_bytes).load(path)
    pieces = rows.where("offset IS NULL").select("path", "piece", F.col("nth").alias("n"))  # a row for each piece
    earlier = Window.partitionBy("path").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    before = pieces.select("path", "piece", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    points = rows.where("offset IS NOT NULL").join(before, ["path", "piece"]).select("path", (F.col("before") + F.col("nth")).alias("line"), "offset")
    after = Window.partitionBy("path").orderBy("line")
    last = F.lit((1 << 63) - 1)
    return points.withColumn("next_line", F.coalesce(F.lead("line").over(after), last)).withColumn("end", F.coalesce(F.lead("offset").over(after), last))


def lines_at(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """(path, line, value, n_bytes) of the wanted (path, line), each once; n_bytes is what was read for it and its neighbours.

    A wanted line belongs to the last point at or before it; only the ranges of such points are read, each once and by
    one task. Lines that no file has are not there.
    """
    from sluice.operators.joins import owners

    # local paths are file:/x or file:///x, as they were given to Spark
    path = F.regexp_replace("path", "^(?:file:)?/+", "file:///").alias("path")
    own = owners(wanted.select(path, "line").where("path IS NOT NULL AND line >= 0").distinct(), index.select(path, F.col("line").alias("start"), "offset", "end", "next_line"), "path", "line", "start", "next_line")
    ranges = own.where("offset IS NOT NULL").groupBy("path", "start", "offset", "end").agg(F.sort_array(F.collect_list("line")).alias("lines"))  # at most as many as a point has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, offset, end, lines in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, root = file_system(path)
                found = []
                with fs.open_input_file(root) as source:
                    span = Span(source, offset, min(end, source.size()))
                    stream, nth = io.BufferedReader(span, 1 << 16), start
                    for line in lines:
                        while nth < line and stream.readline():
                            nth += 1
                        if nth == line and (value := stream.readline()):
                            found.append((line, value.rstrip(b"\r\n").decode("utf-8", "replace")))
                            nth += 1
                cols = [pa.array([path] * len(found), pa.string()), pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.string()), pa.array([span.taken] * len(found), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["path", "line", "value", "n_bytes"])

    return ranges.select("path", "start", "offset", "end", "lines").mapInArrow(run, "path string, line long, value string, n_bytes long")
