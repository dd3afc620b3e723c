"""Exact deduplication over an extendible-hash index that lies in shared files.

Everything here is DataFrame functions.  The index holds one entry per distinct text:

* **Bytes are compared** when the index is built: rows of one key meet in ``GROUP BY key, text``,
  whose equality is that of the bytes.  Copies collapse before the shuffle, so a text that a
  third of all rows share sends one row per task.
* **The directory** maps the leading bits of a key to a bucket.  A bucket with more entries
  than ``capacity`` is split by one more bit until it fits; the directory doubles by as much.
  Counts of eight more bits are taken at once, so that few passes are needed at any size.
* **Owner tasks** write the index, each a range of buckets, sorted by key.  Entries whose keys
  collide are chained: ``chain`` numbers the different texts of one key.
* **Rows find their entry through the directory**: it names the bucket of a row's key, and the row
  meets the chain of its key in that bucket only.  Where the chain of an indexed row has one entry,
  the grouping has compared its bytes already; in longer chains, and for rows of other tables, the
  bytes are compared with those of every entry of the chain.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from trajmill import scratch

CAPACITY = 8192
STRIDE = 8
KEY_BITS = 64
#: Entries with more than this part of all rows, at most so many, are sent to all tasks.
HOT = 10_000
#: Copies of a directory that is too large to send to all tasks.
SALTS = 16
_BUCKET = ["bucket", "key"]


def _prefix(key: str | Column, depth: int) -> Column:
    """The leading ``depth`` bits of a 64-bit key as a number from 0."""
    return F.shiftrightunsigned(key, 64 - depth) if depth < 64 else F.col(key) if isinstance(key, str) else key


@dataclass
class ExactIndex:
    """``entries``: bucket, depth, key, chain, chained, text_sha256, keep_id, group_size; ``directory``: level, slot, depth.

    ``rows`` are those that were indexed (doc_id, text, key); the texts are not copied.
    """

    entries: DataFrame
    directory: DataFrame
    key_bits: int
    rows: DataFrame

    def lookup(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """One row per row of ``docs``, any table, with the entry of its text; nulls where the index has none."""
        placed = place(_keyed(docs, doc_id, text, self.key_bits), self.directory)
        chains = self._with_texts(placed.select(*_BUCKET).distinct())
        return placed.drop("depth").join(chains, [*_BUCKET, "text"], "left").drop("text")

    def indexed(self) -> DataFrame:
        """One row per indexed row with the entry of its text."""
        placed = scratch.materialize(place(self.rows.drop("text"), self.directory).drop("depth"), "exact-rows")
        single = self.entries.filter("chained = 1")
        total = self.entries.agg(F.sum("group_size")).first()[0] or 0
        often = F.col("group_size") > F.lit(total / HOT)
        hot = F.broadcast(single.filter(often))  # fewer than HOT entries
        found = placed.join(hot, _BUCKET).unionByName(placed.join(hot.select(*_BUCKET), _BUCKET, "left_anti").join(single.filter(~often), _BUCKET))
        collided = self.entries.filter("chained > 1").select(*_BUCKET).distinct()
        if collided.isEmpty():
            return found
        rows = place(self.rows, self.directory).drop("depth").join(collided, _BUCKET, "left_semi")
        return found.unionByName(rows.join(self._with_texts(collided), [*_BUCKET, "text"]).drop("text"))

    def _with_texts(self, chains: DataFrame) -> DataFrame:
        """The entries of these chains with their texts, which the indexed rows have."""
        entries = self.entries.join(chains, _BUCKET, "left_semi")
        texts = self.rows.select("key", "text").join(entries.select("key").distinct(), "key", "left_semi").distinct()
        return entries.join(texts.withColumn("text_sha256", F.sha2("text", 256)), ["key", "text_sha256"])


def _keyed(docs: DataFrame, doc_id: str, text: str, key_bits: int) -> DataFrame:
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    return texts.withColumn("key", _key("text", key_bits))


def place(keyed: DataFrame, directory: DataFrame) -> DataFrame:
    """``keyed`` with the bucket that the directory names for each key, and its depth; nulls where it has no slot."""
    levels = [r.level for r in directory.select("level").distinct().collect()]  # 8, 16, ..: at most 8 rows
    placed = keyed.withColumn("depth", F.lit(None).cast("int"))
    for level in sorted(levels):
        slots = directory.filter(F.col("level") == level).select(F.col("slot").alias("_slot"), F.col("depth").alias("_depth"))
        on = _prefix("key", level) == F.col("_slot")
        if level <= 2 * STRIDE:  # at most 65,536 slots
            slots = F.broadcast(slots)
        else:
            slots = slots.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            placed = placed.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
            on = on & (F.col("_salt") == F.col("_copy"))
        placed = placed.join(slots, on, "left")
        placed = placed.withColumn("depth", F.coalesce("depth", "_depth")).drop("_slot", "_depth", "_salt", "_copy")
    low = F.lit(64) - F.col("depth")  # a shift by 64 would be one by 0
    leading = F.call_function("shiftleft", F.call_function("shiftrightunsigned", "key", low), low)
    return placed.withColumn("bucket", F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(leading))


def _key(text: str, key_bits: int) -> Column:
    """The leading ``key_bits`` bits of the text's hash; fewer bits only make chains longer."""
    return F.xxhash64(text) if key_bits == 64 else F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 64 - key_bits), 64 - key_bits)


def split_buckets(keys: DataFrame, capacity: int) -> DataFrame:
    """The directory for a table of keys: which depth the bucket of each slot has.

    A row is a slot of ``level`` leading bits.  Slots of one bucket say the same depth, at most
    their level; slots of overfull buckets are followed by slots of the next level.
    """
    found, open_keys, level = None, keys.select("key"), 0
    while True:
        deeper = level + STRIDE
        slots = open_keys.groupBy(_prefix("key", deeper).alias("slot")).agg(F.count("*").alias("n"))
        depth = F.lit(None).cast("int")
        for bits in range(STRIDE, -1, -1):  # the fewest bits whose bucket fits
            bucket = Window.partitionBy(F.shiftright("slot", STRIDE - bits))
            depth = F.when(F.sum("n").over(bucket) <= capacity, F.lit(level + bits)).otherwise(depth)
        slots = scratch.materialize(slots.select(F.lit(deeper).alias("level"), "slot", depth.alias("depth")), "directory")
        fits = slots.filter("depth IS NOT NULL")
        found = fits if found is None else found.unionByName(fits)
        overfull = slots.filter("depth IS NULL").select("slot")
        if deeper >= 64 or overfull.isEmpty():
            return found.unionByName(slots.filter("depth IS NULL").withColumn("depth", F.lit(deeper)))
        open_keys = open_keys.join(overfull.select(F.col("slot").alias("full")), _prefix("key", deeper) == F.col("full"), "left_semi")
        level = deeper


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, key_bits: int = KEY_BITS) -> ExactIndex:
    """Index all rows of ``docs``.

    A null text counts as the empty text.  Of equal texts the largest ``doc_id`` is kept; null
    ids lose against any other, and a text that only has null ids keeps null.  An empty table
    gives an empty index.  Other columns are not read.
    """
    rows = _keyed(docs, doc_id, text, key_bits)
    grouped = rows.groupBy("key", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    entries = scratch.materialize(grouped.select("key", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"), "entries")
    directory = split_buckets(entries, capacity)
    chain = Window.partitionBy(*_BUCKET)
    number = F.row_number().over(chain.orderBy(F.col("keep_id").desc_nulls_last(), "text_sha256"))
    owned = place(entries, directory).repartitionByRange("bucket").withColumn("chain", number).withColumn("chained", F.count("*").over(chain))
    return ExactIndex(scratch.materialize(owned, "exact-index"), directory, key_bits, rows)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, key_bits: int = KEY_BITS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256, bucket, chain``.

    Rows that repeat the kept id with the same text are one record and all say ``kept``.
    """
    found = build_index(docs, doc_id, text, capacity, key_bits).indexed()
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket", "chain"
    )
