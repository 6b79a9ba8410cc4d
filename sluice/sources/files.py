"""A sink for files that Spark has no format for: one file for each row (name, content), committed by renaming.

Tasks write below a folder of the job, by the file system that the path names (as pyarrow knows it). Their names come
back as rows, so a task that is run again, or twice at once, counts once. The commit is a second pass over these: names
that stand twice are an error before anything moves, tasks rename the files in parallel, and `_SUCCESS` follows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import checkpointed

#: Files that a task of the commit renames (more where there were over COMMIT_TASKS tasks else), and bytes that a task
#: copies at once.
COMMIT_FILES, COMMIT_TASKS, COPY_BYTES = 256, 2048, 1 << 24


def file_system(path: str) -> tuple[object, str]:
    """(file system, path within it)."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _staged(rows: DataFrame, path: str, job: str) -> DataFrame:
    """(name, folder, length) of files written below the job's folder, a folder for each attempt of a task."""

    pieces = "more" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        folder, known, out, length = f"{job}/{uuid.uuid4().hex}", set(), None, 0
        try:
            for batch in batches:
                names, done, lengths = batch.column(0).to_pylist(), [], []
                follows = batch.column(2).to_pylist() if pieces else [False] * len(names)
                for i, (name, content, more) in enumerate(zip(names, batch.column(1), follows, strict=True)):
                    if out is None:
                        # a name that stands twice in a task must not lose a row before the commit sees it
                        target = f"{root}/{folder}/{i if name in known else ''}{name}"
                        known.add(name)
                        fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
                        out, length = fs.open_output_stream(target, compression=None), 0  # the content is what it is, whatever the suffix
                    if content.is_valid:
                        out.write(content.as_buffer())
                        length += content.as_buffer().size
                    if not more:
                        out.close()
                        out = None
                        done.append(name)
                        lengths.append(length)
                yield pa.RecordBatch.from_arrays([pa.array(done, pa.string()), pa.array([folder] * len(done), pa.string()), pa.array(lengths, pa.int64())], ["name", "folder", "length"])
            if out is not None:
                raise ValueError(f"a file without its last piece: {name}")
        finally:
            if out is not None:
                out.close()

    more = [F.col("more").cast("boolean").alias("more")] if pieces else []
    return rows.select(F.col("name").cast("string").alias("name"), F.col("content").cast("binary").alias("content"), *more).mapInArrow(run, "name string, folder string, length long")


def _renamed(staged: DataFrame, path: str) -> DataFrame:
    """Moves each file to its name; one that is there already (the task is run again) stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileType

        fs, root = file_system(path)
        made: set[str] = set()
        for batch in batches:
            for name, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = f"{root}/{name}"
                if (parent := target.rsplit("/", 1)[0]) not in made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                if fs.get_file_info(f"{root}/{folder}/{name}").type == FileType.File:
                    fs.move(f"{root}/{folder}/{name}", target)
                elif fs.get_file_info(target).type != FileType.File:
                    raise FileNotFoundError(f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return staged.mapInArrow(run, "n long")


def write(rows: DataFrame, path: str, commit_files: int = COMMIT_FILES) -> int:
    """Writes each row's content under its name below path, and gives the number of files; the commit replaces older ones.

    A null name, or a name of two rows, is an error, and nothing is committed then. With a column `more`, content comes in
    pieces, each written at once: a file's rows follow each other in their task, and all but the last say that more follows.
    """
    return _written(rows, path, commit_files)[1]


def written(rows: DataFrame, path: str, commit_files: int = COMMIT_FILES) -> DataFrame:
    """As `write`, but gives (path, length) of the files, as the tasks that wrote them say: no folder is listed."""
    return _written(rows, path, commit_files)[0].select(F.concat(F.lit(path.rstrip("/") + "/"), "name").alias("path"), "length")


def _written(rows: DataFrame, path: str, commit_files: int) -> tuple[DataFrame, int]:
    path, job = path.rstrip("/"), f"_temporary-{uuid.uuid4().hex}"
    fs, root = file_system(path)
    fs.create_dir(root, recursive=True)
    try:
        staged = checkpointed(_staged(rows, path, job))
        n, twice, none = staged.groupBy("name").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.max(F.when(F.col("n") > 1, F.col("name"))), F.count_if(F.col("name").isNull())).first()
        if twice is not None or none:
            raise ValueError(f"a file name stands in two rows: {twice}" if twice is not None else "a file without a name")
        tasks = min(COMMIT_TASKS, max(1, -(-n // commit_files)))
        _renamed(staged.select("name", "folder").repartition(tasks, "name"), path).agg(F.sum("n")).collect()
    finally:
        _drop(fs, f"{root}/{job}")
    with fs.open_output_stream(f"{root}/_SUCCESS", compression=None) as out:
        out.write(b"")
    return staged, n


def _drop(fs, folder: str) -> None:
    from pyarrow.fs import FileType

    if fs.get_file_info(folder).type == FileType.Directory:
        fs.delete_dir(folder)


def concatenate(parts: DataFrame, path: str, order: list[str], item_bytes: int = 4, copy_bytes: int = COPY_BYTES) -> int:
    """One file at `path` of the files that `parts` has (path, length) in order; its bytes.

    Where each part begins is planned by a running sum of lengths. On a file system that is mounted everywhere tasks copy
    their pieces side by side to the planned places; elsewhere, where a file has one writer, a task copies all pieces
    one after another. Either way no task holds more than a piece. A part that isn't whole items is an error; the file
    takes its name when it is whole.
    """
    from sluice.operators.prefix import accumulated

    fits = F.when(F.col("length") % item_bytes == 0, F.col("length")).otherwise(F.raise_error(F.concat(F.lit("not whole items: "), "path")).cast("long"))
    layout = checkpointed(accumulated(parts.withColumn("length", fits), order, "length").select("path", "length", F.col("excl").alias("at"), "rn"))
    total = layout.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(copy_bytes).cast("long"))).alias("from")
    pieces = layout.where("length > 0").select("path", "length", "at", "rn", piece)
    pieces = pieces.select("path", "from", F.least(F.lit(copy_bytes), F.col("length") - F.col("from")).alias("n"), (F.col("at") + F.col("from")).alias("to"))
    fs, root = file_system(path)
    fs.create_dir(root.rsplit("/", 1)[0], recursive=True)
    target, local = f"{root}.{uuid.uuid4().hex}", fs.type_name == "local"

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = file_system(path)
        out = open(target, "r+b") if local else own.open_output_stream(target, compression=None)
        with out:
            for batch in batches:
                for name, begin, n, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    other, at = file_system(name)
                    with other.open_input_file(at) as source:
                        source.seek(begin)
                        content = source.read(n)
                    if len(content) != n:
                        raise ValueError(f"{name} is shorter than its length says")
                    if local:
                        out.seek(to)
                    out.write(content)
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    if local:
        with open(target, "wb") as out:
            out.truncate(total)
        pieces = pieces.repartition(max(1, -(-total // (8 * copy_bytes))), "to")
    elif total:
        pieces = pieces.repartition(1).sortWithinPartitions("to")
    else:
        fs.open_output_stream(target, compression=None).close()
    pieces.mapInArrow(copied, "n long").agg(F.sum("n")).collect()
    fs.move(target, root)
    return total


def mark_done(keys: DataFrame, path: str, key: str = "key", suffix: str = ".done") -> None:
    """A file that says `done` for each key; markers come after what they speak of, so this is called last.

    (An empty file would do, but Spark's readers pass over those.)
    """
    write(keys.select(F.concat(F.col(key).cast("string"), F.lit(suffix)).alias("name"), F.lit(b"done\n").alias("content")), path)


def mark_ready(spark: SparkSession, path: str, name: str = "READY") -> None:
    write(spark.createDataFrame([(name, bytearray(b"ready\n"))], "name string, content binary"), path)


def done_keys(spark: SparkSession, path: str, key: str = "key", suffix: str = ".done") -> DataFrame:
    """Keys with a marker below path."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(F.substring(name, F.lit(1), F.length(name) - len(suffix)).alias(key))
