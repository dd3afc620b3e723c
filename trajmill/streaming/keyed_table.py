"""A table with one row per key that a stream keeps up to date.

Batches are appended as runs, and a manifest names the runs that make up a version.  A new
version is a new manifest, put in place by one rename; a reader takes the newest manifest once
and then reads files that nobody changes.  A run is merged with newer ones as soon as it holds
no more than ``GROWTH`` times their rows, so the runs of a version shrink geometrically: a read
costs a constant times the rows of the largest run, whose keys all differ.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

GROWTH = 2
#: Versions whose files stay for readers that are still at work.
KEEP = 8
_BATCH = "_batch"
_MANIFESTS = "_manifests"


@dataclass(frozen=True)
class Run:
    path: str
    rows: int


@dataclass(frozen=True)
class Version:
    number: int = 0
    batch: int = -1  # the last batch that is part of it
    runs: tuple[Run, ...] = ()

    def text(self) -> str:
        return json.dumps({"batch": self.batch, "runs": [[r.path, r.rows] for r in self.runs]})

    @classmethod
    def of(cls, number: int, text: str) -> Version:
        found = json.loads(text)
        return cls(number, found["batch"], tuple(Run(*r) for r in found["runs"]))


class KeyedTable:
    """Rows of ``schema`` with one row per ``keys``.

    Of several rows of a key the one with the greatest ``newest`` columns stays; without them that of the
    last batch, and a batch then holds a key once.  One writer at a time: a second one fails at
    the rename and leaves the table as it was.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], newest: list[str] | None = None) -> None:
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys
        self.order = newest or [_BATCH]
        self.stored = T.StructType([*schema.fields, T.StructField(_BATCH, T.LongType())])
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join([self.path, *parts]))

    # Versions.

    def _numbers(self) -> list[int]:
        folder = self._path(_MANIFESTS)
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(name[:-5]) for name in names if name.endswith(".json") and name[:-5].isdigit())

    def version(self, number: int | None = None) -> Version:
        """The newest version, or the one with this number."""
        numbers = self._numbers()
        if not numbers:
            return Version()
        number = numbers[-1] if number is None else number
        stream = self._fs.open(self._path(_MANIFESTS, f"{number:020d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Version.of(number, text)

    def _publish(self, version: Version) -> None:
        """Write the manifest aside and move it into place, which fails if the place is taken."""
        context, gateway = self.spark.sparkContext, self.spark.sparkContext._gateway
        aside = self._path(_MANIFESTS, f".{uuid.uuid4().hex}")
        out = self._fs.create(aside, True)
        out.write(bytearray(version.text().encode()))
        out.close()
        rename = self._hadoop.Options.Rename
        options = gateway.new_array(rename, 1)
        options[0] = getattr(rename, "NONE")
        files = self._hadoop.FileContext.getFileContext(self._path().toUri(), context._jsc.hadoopConfiguration())
        files.rename(aside, self._path(_MANIFESTS, f"{version.number:020d}.json"), options)

    # Rows.

    def _rows(self, runs: tuple[Run, ...]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).parquet(*(f"{self.path}/{r.path}" for r in runs))

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in self.stored.names if c not in self.keys]
        best = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(*self.order)).alias("_row"))
        return best.select(*[c if c in self.keys else F.col(f"_row.{c}").alias(c) for c in self.stored.names])

    def _write(self, rows: DataFrame) -> Run:
        run = f"run-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{run}")
        return Run(run, self._rows((Run(run, 0),)).count())

    def read(self, version: Version | None = None) -> DataFrame:
        """All keys of a version, by default the newest there is now."""
        version = version or self.version()
        rows = self._rows(version.runs)
        return (self._newest(rows) if len(version.runs) > 1 else rows).select(*self.schema.names)

    # Changes.

    def upsert(self, batch: DataFrame, batch_id: int) -> Version:
        """Add a batch; one that the table already has changes nothing."""
        current = self.version()
        if batch_id <= current.batch:
            return current
        rows = batch.select(*self.schema.names).withColumn(_BATCH, F.lit(batch_id).cast("long"))
        runs = [*current.runs, self._write(self._newest(rows) if self.order != [_BATCH] else rows)]
        while (merged := self._together(runs)) > 1:
            runs[-merged:] = [self._write(self._newest(self._rows(tuple(runs[-merged:]))))]
        after = replace(current, number=current.number + 1, batch=batch_id, runs=tuple(r for r in runs if r.rows))
        self._publish(after)
        self.vacuum()
        return after

    @staticmethod
    def _together(runs: list[Run]) -> int:
        """How many of the last runs to merge: older ones join while they hold at most ``GROWTH`` times what is behind them."""
        n, rows = 1, runs[-1].rows
        while n < len(runs) and runs[-n - 1].rows <= GROWTH * rows:
            rows += runs[-n - 1].rows
            n += 1
        return n

    def vacuum(self, keep: int = KEEP) -> None:
        """Remove what only versions before the last ``keep`` name, and runs that never became part of one."""
        numbers = self._numbers()
        used = {r.path for n in numbers[-keep:] for r in self.version(n).runs}
        for number in numbers[:-keep]:
            self._fs.delete(self._path(_MANIFESTS, f"{number:020d}.json"), False)
        for status in self._fs.listStatus(self._path()):
            name = status.getPath().getName()
            if name.startswith("run-") and name not in used:
                self._fs.delete(status.getPath(), True)


def upsert_stream(stream: DataFrame, table: KeyedTable, name: str, mode: str = "update", checkpoint: str | None = None) -> DataFrame:
    """Process what is there, batch by batch, and return the table.  A later call goes on where the last one stopped."""
    query = (
        stream.writeStream.queryName(name)
        .foreachBatch(lambda batch, batch_id: table.upsert(batch, batch_id) and None)
        .option("checkpointLocation", checkpoint or f"{table.path}-checkpoint")
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return table.read()
