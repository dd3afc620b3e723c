"""Files below a folder, found, read and moved by tasks.

Spark's file sources keep a state per file in the driver.  Here a task lists a folder, one level
of folders after the other, and names and times of the files are rows of a table; the driver holds
what it takes to plan a few tasks.  Names are taken as Spark's sources take them.
"""

from __future__ import annotations

import errno
import math
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from trajmill import scratch

#: Names in one file of a table of names, and names that one task writes.
NAMES = 10_000
TASK_NAMES = 100_000
#: What a worker hands on at once.
OUT_ROWS = 4096
OUT_BYTES = 2 << 20

NAMED = "path string, mtime timestamp"
_ENTRY = "path string, folder boolean, millis bigint"
_ENTRY_ARROW = pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("millis", pa.int64())])


def _split(path: str) -> tuple[str, str]:
    """What names the file system, and the path in it."""
    found = re.match(r"(\w[\w+.-]*:(?://[^/]*)?)(/.*)$", path, re.S)
    return found[1], found[2]


def _store(prefix: str) -> fs.FileSystem:
    return fs.LocalFileSystem() if prefix == "file:" else fs.FileSystem.from_uri(f"{prefix}/")[0]


def _target(spark: SparkSession, path: str) -> tuple[object, object]:
    """The path and its file system, as Spark's readers see them."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return target.makeQualified(system.getUri(), system.getWorkingDirectory()), system


def readable(spark: SparkSession, path: str) -> bool:
    """Whether tasks can open this file system themselves; some are known to Spark's readers only."""
    try:
        _store(_split(_target(spark, path)[0].toString())[0])
    except (pa.ArrowException, ImportError, OSError):
        return False
    return True


def _tasks(spark: SparkSession, per_core: int = 4) -> int:
    return per_core * spark.sparkContext.defaultParallelism


def hidden(name: str, folder: bool) -> bool:
    """Names that Spark's file sources leave out."""
    left_out = name.startswith("_") and "=" not in name or name.startswith(".") or name.endswith("._COPYING_")
    return left_out and not (folder and name.startswith(("_common_metadata", "_metadata")))


def _entries(prefix: str, folder: str) -> Iterator[tuple[str, bool, int]]:
    """Name, whether it is a folder, and the time in milliseconds of all there is in a folder; a folder that went is empty."""
    if prefix != "file:":
        selector = fs.FileSelector(folder, allow_not_found=True)
        yield from ((i.base_name, i.type == fs.FileType.Directory, (i.mtime_ns or 0) // 1_000_000) for i in _store(prefix).get_file_info(selector))
        return
    try:
        scan = os.scandir(folder)
    except FileNotFoundError:
        return
    with scan:
        for entry in scan:
            try:
                yield entry.name, entry.is_dir(), entry.stat().st_mtime_ns // 1_000_000
            except OSError as gone:  # also a link to nothing
                if gone.errno not in (errno.ENOENT, errno.ELOOP):
                    raise


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            (prefix, folder), rows = _split(path), []
            for name, is_folder, millis in _entries(prefix, folder):
                if not hidden(name, is_folder):
                    rows.append({"path": f"{prefix}{folder.rstrip('/')}/{name}", "folder": is_folder, "millis": millis})
                if len(rows) == OUT_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, _ENTRY_ARROW)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _ENTRY_ARROW)


def roots(spark: SparkSession, root: str) -> list[tuple[str, bool, int]]:
    """What the path, which may be a pattern, names: path, whether it is a folder, time in milliseconds."""
    target, system = _target(spark, root)
    return [(s.getPath().toString(), s.isDirectory(), s.getModificationTime()) for s in system.globStatus(target) or ()]


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """``path, mtime`` of the files below ``root`` whose names match the pattern."""
    found = [r for r in roots(spark, root) if r[1] or not hidden(r[0].rsplit("/", 1)[-1], False)]
    level = files = spark.createDataFrame(found, _ENTRY)
    while not (folders := level.where("folder")).isEmpty():
        level = scratch.materialize(folders.repartition(_tasks(spark), "path").mapInArrow(_listed, _ENTRY), "listing")
        files = files.unionByName(level)
    regex = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
    matches = F.substring_index("path", "/", -1).rlike(rf"(?s)\A(?:{regex})\z")
    return files.where(~F.col("folder") & matches).select("path", F.timestamp_millis("millis").alias("mtime"))


def append_names(files: DataFrame, path: str, per_batch: int) -> None:
    """Append ``path, mtime`` to a table of names, the oldest in the first files."""
    n, held = files.count(), names_per_file(per_batch)
    ordered = files.repartitionByRange(max(1, math.ceil(n / max(TASK_NAMES, held))), "mtime", "path").sortWithinPartitions("mtime", "path")
    ordered.write.option("maxRecordsPerFile", held).mode("append").parquet(path)


def files_per_batch(per_batch: int) -> int:
    """Files of a table of names that make a batch of so many names."""
    return math.ceil(per_batch / NAMES)


def names_per_file(per_batch: int) -> int:
    return per_batch // files_per_batch(per_batch)


def stream_names(spark: SparkSession, path: str, per_batch: int) -> DataFrame:
    """A table of names as a stream, with at most so many names in a batch."""
    return spark.readStream.schema(NAMED).option("maxFilesPerTrigger", files_per_batch(per_batch)).parquet(path)


def with_content(names: DataFrame, per_batch: int) -> DataFrame:
    """``path, mtime, content``: the bytes of named files, as many tasks a core as there are thousands of files in a batch, four at most."""
    spark = names.sparkSession
    skip = spark.conf.get("spark.sql.files.ignoreMissingFiles") == "true"
    tasks = min(per_batch, _tasks(spark), max(_tasks(spark, 1), per_batch // 1000))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores: dict[str, fs.FileSystem] = {}

        def content(path: str) -> bytes | None:
            prefix, inner = _split(path)
            if prefix not in stores:
                stores[prefix] = _store(prefix)
            try:
                with stores[prefix].open_input_file(inner) as file:
                    return file.read()
            except FileNotFoundError:
                if not skip:
                    raise
                return None

        def made(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, schema)

        for batch in batches:
            schema, rows, held = batch.schema.append(pa.field("content", pa.binary())), [], 0
            for row in batch.to_pylist():
                if (own := content(row["path"])) is None:
                    continue
                rows.append({**row, "content": own})
                held += len(own)
                if len(rows) == OUT_ROWS or held >= OUT_BYTES:
                    yield made(rows, schema)
                    rows, held = [], 0
            if rows:
                yield made(rows, schema)

    return names.repartition(tasks, "path").mapInArrow(read, f"{NAMED}, content binary")


def check_archive(spark: SparkSession, root: str, archive: str) -> str:
    """The folder for finished files, which has to lie in the file system of ``root`` and not in a folder that is listed."""
    target = _target(spark, archive)[0].toString().rstrip("/")
    for path, _, _ in roots(spark, root):
        if _split(path)[0] != _split(target)[0]:
            raise ValueError(f"{archive} is in another file system than {root}")
        if f"{target}/".startswith(f"{path.rstrip('/')}/"):
            raise ValueError(f"{archive} is in {root}, where its files would be listed again")
    return target


def move_files(files: DataFrame, archive: str) -> None:
    """Move files below a folder, where they keep their whole path; a repeated task goes on."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                prefix, inner = _split(path)
                store, target = _store(prefix), _split(archive)[1] + inner
                if store.get_file_info(inner).type == fs.FileType.NotFound:
                    continue
                store.create_dir(os.path.dirname(target), recursive=True)
                store.move(inner, target)
            yield batch.select(["path"])

    files.select("path").repartition(_tasks(files.sparkSession), "path").mapInArrow(move, "path string").write.format("noop").mode("overwrite").save()
