"""Documents as they land: whole JSON files, a bounded number per batch, damaged ones set aside.

A file is one row with its path and bytes, whatever is in it.  So one that is no UTF-8 and one that
stops in the middle of a document reach the quarantine, with their path.  Tasks list the folders
and append the names of new files to a table; this table is the stream, and tasks read the files
that a batch of it names.  So the driver holds a few bytes per thousands of files.  Documents
are appended by an exactly-once file sink, in two partitions of one table; finished files can be
moved away.

In a file system that only Spark's readers open, Spark's own source takes the files and keeps a
state for each in the driver.  Empty files make no row in its scans; they are the files that the
stream has taken and that are not in the table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from trajmill import schemas, scratch
from trajmill.sources import listing
from trajmill.sources.readers import listing_tasks, path_exists
from trajmill.streaming.keyed_table import KeyedTable, upsert_stream
from trajmill.streaming.streams import append_to_table

FILES_PER_BATCH = 1000
_BAD = "_bad"


@dataclass
class Landed:
    """``documents``: ``path, mtime, doc``; ``quarantine``: ``path, mtime, content`` as bytes."""

    documents: DataFrame
    quarantine: DataFrame
    path: str


def document_files(spark: SparkSession, root: str, pattern: str, files_per_batch: int = FILES_PER_BATCH, archive: str | None = None) -> DataFrame:
    """Spark's stream of files below ``root`` with their bytes.  With ``archive``, files of finished batches move there."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(root).select("path", F.col("modificationTime").alias("mtime"), "content")


def _text(content: Column) -> Column:
    """The bytes as text; null where they are none."""
    return F.try_validate_utf8(content.cast("string"))


def parse_document(content: Column, schema: str) -> Column:
    """A JSON object of the schema; null for anything else."""
    text = _text(content)
    doc = F.from_json(text, f"{schema}, {_BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    whole = F.regexp_like(text, F.lit(r"^\s*\{")) & doc[_BAD].isNull()
    return F.when(whole, doc.dropFields(_BAD))


def parse_map(content: Column, schema: str) -> Column:
    """A JSON object with values of one kind; null for anything else."""
    text = _text(content)
    return F.when(F.regexp_like(text, F.lit(r"^\s*\{")), F.from_json(text, schema))


def ingest(files: DataFrame, parse: Callable[[Column], Column], name: str, path: str | None = None) -> Landed:
    """Land what is there.  With a ``path`` a later call goes on where the last one stopped."""
    spark = files.sparkSession
    path = path or scratch.new_path(spark, name)
    with listing_tasks(spark):  # every batch lists the folders again
        table = append_to_table(_parsed(files, parse), name, path, partition_by=["damaged"])
    landed = _landed(table, path)
    taken = taken_files(spark, f"{path}-checkpoint")
    empty = taken.join(table.select(_plain("path").alias("_file")), "_file", "left_anti").select("path", "mtime", F.lit(b"").alias("content"))
    return Landed(landed.documents, landed.quarantine.unionByName(empty), path)


def ingest_folder(
    spark: SparkSession,
    root: str,
    pattern: str,
    parse: Callable[[Column], Column],
    name: str,
    path: str | None = None,
    files_per_batch: int = FILES_PER_BATCH,
    archive: str | None = None,
) -> Landed:
    """Land the files below ``root`` whose names match; see ``ingest``.  With ``archive``, finished files move there."""
    if not listing.readable(spark, root) or not listing.roots(spark, root):  # without a root this fails
        return ingest(document_files(spark, root, pattern, files_per_batch, archive), parse, name, path)
    archive = archive and listing.check_archive(spark, root, archive)
    path = path or scratch.new_path(spark, name)
    names = f"{path}-files"
    found = new = listing.list_files(spark, root, pattern)
    known = path_exists(spark, names)
    if known:
        new = scratch.materialize(found.join(spark.read.schema(listing.NAMED).parquet(names).select("path"), "path", "left_anti"), "new-files")
    if not known or not new.isEmpty():
        listing.append_names(new, names, files_per_batch)
    files = listing.with_content(listing.stream_names(spark, names, files_per_batch), files_per_batch)
    table = append_to_table(_parsed(files, parse), name, path, partition_by=["damaged"])
    if archive:
        listing.move_files(found, archive)
    return _landed(table, path)


def _parsed(files: DataFrame, parse: Callable[[Column], Column]) -> DataFrame:
    """Documents, and the bytes of what is none."""
    doc = parse(F.col("content"))
    return files.select("path", "mtime", doc.alias("doc"), F.when(doc.isNull(), F.col("content")).alias("content"), doc.isNull().alias("damaged"))


def _landed(table: DataFrame, path: str) -> Landed:
    bad = table.where("damaged").select("path", "mtime", "content")
    return Landed(table.where(~F.col("damaged")).select("path", "mtime", "doc"), bad, path)


def _plain(path: Column | str) -> Column:
    """A path that can be compared: one slash after the scheme."""
    return F.regexp_replace(path, r"^(\w+):/+", "$1:/")


def taken_files(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The files that a stream has taken from its source, from the log in its checkpoint: ``_file, path, mtime``."""
    entry = F.from_json("value", "path string, timestamp bigint")
    files = spark.read.text(f"{checkpoint}/sources/0/*").select(entry.alias("e")).where("e.path is not null")
    path = F.url_decode(F.replace("e.path", F.lit("+"), F.lit("%2B")))
    return files.select(_plain(path).alias("_file"), path.alias("path"), F.timestamp_millis("e.timestamp").alias("mtime")).dropDuplicates(["_file"])


def landed_stream(landed: Landed) -> DataFrame:
    """The sound documents as a stream, for what follows them."""
    schema = landed.documents.schema
    return landed.documents.sparkSession.readStream.schema(T.StructType([*schema.fields, T.StructField("damaged", T.BooleanType())])).parquet(landed.path).where(~F.col("damaged")).select(*schema.names)


def ingest_trajectories(spark: SparkSession, root: str, path: str | None = None, **files: object) -> Landed:
    """Trajectory documents; see ``trajectory_rows`` for their columns."""
    return ingest_folder(spark, root, "*.traj.json", lambda c: parse_document(c, schemas.TRAJECTORY_FILE), "trajectories", path, **files)


def trajectory_rows(documents: DataFrame) -> DataFrame:
    """The columns of ``read_trajectory_files`` from landed documents."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(\.traj)?\.json$", "")
    named = F.when(F.col("doc.instance_id") != "", F.col("doc.instance_id"))
    empty = F.array().cast(schemas.MESSAGES)
    text = lambda c: F.coalesce(c, F.lit(""))
    message = lambda m: F.struct(text(m["role"]).alias("role"), text(m["content"]).alias("content"))
    return documents.select(
        F.coalesce(named, stem).alias("instance_id"),
        text(F.col("doc.info.exit_status")).alias("exit_status"),
        text(F.col("doc.info.submission")).alias("submission"),
        F.col("doc.info.config").alias("config"),
        F.transform(F.coalesce("doc.messages", empty), message).alias("messages"),
        F.col("path").alias("file"),
    )


def ingest_predictions(spark: SparkSession, root: str, path: str | None = None, **files: object) -> Landed:
    """Prediction documents, ``doc`` a map from the instance."""
    return ingest_folder(spark, root, "preds.json", lambda c: parse_map(c, schemas.PREDICTIONS), "prediction-files", path, **files)


def prediction_rows(documents: DataFrame) -> DataFrame:
    """The columns of ``read_predictions`` from landed documents."""
    rows = documents.select("path", "mtime", F.explode("doc").alias("instance_id", "rec"))
    return rows.select("path", "mtime", "instance_id", F.coalesce("rec.model_patch", F.lit("")).alias("model_patch"))


def merge_newest(stream: DataFrame, keys: list[str], newest: list[str], name: str, path: str | None = None) -> DataFrame:
    """The row with the greatest ``newest`` per key of an appended stream, without state in the stream.

    Each batch is reduced on its own and merged into a keyed table.
    """
    path = path or scratch.new_path(stream.sparkSession, name)
    table = KeyedTable(stream.sparkSession, path, stream.schema, keys, newest)
    return upsert_stream(stream, table, name, "append")
