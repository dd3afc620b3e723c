"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Everything here is DataFrame functions.  Records hash into ``SLOTS`` slots; the map says which
shard owns a slot.  Bytes are summed per slot, and the map is edited (a new version, moving as
few slots as needed) when shards are added, removed or drift apart.

* Copies of one text share a slot while the group is small against a shard.  A larger group
  would decide its shard's size, so its rows are spread over the slots by their row numbers,
  whatever their ids.  There are at most ``shards / WHOLE_SHARE`` such groups, which bounds the
  table that is broadcast.
* The map has ``SLOTS`` rows at any input size: the largest slot goes to the lightest shard, in
  one expression over these rows.
* Places within a shard come from counts per block of a slot, so no task numbers a whole shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from trajmill import scratch

SLOTS = 8192
WHOLE_SHARE = 0.125
BLOCK_ROWS = 4096
RECORD_BYTES = 16


@dataclass
class SlotMap:
    """A folder with one table per version: ``slot, shard, bytes``."""

    spark: SparkSession
    path: str
    version: int = 0

    def table(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={version or self.version}")

    def _store(self, table: DataFrame) -> SlotMap:
        table.write.parquet(f"{self.path}/version={self.version + 1}")
        return SlotMap(self.spark, self.path, self.version + 1)

    @classmethod
    def create(cls, loads: DataFrame, shards: int) -> SlotMap:
        """Version 1 from the bytes of each slot (``slot, bytes``, all slots)."""
        spark = loads.sparkSession
        empty = spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(0).cast("long").alias("load"))
        return cls(spark, scratch.new_path(spark, "slot-map"))._store(_deal(loads, empty))

    def rebalance(self, loads: DataFrame, shards: int) -> SlotMap:
        """The next version: slots leave only shards above the mean, or those that end.

        Each shard keeps slots, the smallest ids first, while they fit the mean; what it gives
        up goes to the lightest shards.  ``loads`` has the present bytes of every slot.
        """
        owned = self.table().select("slot", "shard").join(loads.select("slot", "bytes"), "slot")
        mean = F.sum("bytes").over(Window.partitionBy()) / F.lit(shards)  # SLOTS rows
        so_far = F.sum("bytes").over(Window.partitionBy("shard").orderBy("slot"))
        owned = owned.withColumn("stays", (F.col("shard") < shards) & (so_far <= mean))
        stays = owned.filter("stays").select("slot", "shard", "bytes")
        kept = stays.groupBy("shard").agg(F.sum("bytes").alias("load"))
        every = self.spark.range(shards).select(F.col("id").cast("int").alias("shard"))
        base = every.join(kept, "shard", "left").select("shard", F.coalesce("load", F.lit(0).cast("long")).alias("load"))
        return self._store(stays.unionByName(_deal(owned.filter("NOT stays"), base)))


def _deal(pool: DataFrame, base: DataFrame) -> DataFrame:
    """Give each slot of the pool, largest first, to the shard that is lightest by then."""
    rows = pool.select(F.struct(F.col("bytes"), F.col("slot")).alias("item"), F.lit(None).cast("struct<load:bigint,shard:int>").alias("owner"))
    rows = rows.unionByName(base.select(F.lit(None).cast("struct<bytes:bigint,slot:int>").alias("item"), F.struct("load", "shard").alias("owner")))
    lists = rows.agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"), F.collect_list("owner").alias("owners"))  # SLOTS rows and one per shard

    def with_slots(owner: Column) -> Column:
        return F.struct(owner.load.alias("load"), owner.shard.alias("shard"), F.array().cast("array<struct<bytes:bigint,slot:int>>").alias("got"))

    def give(state: Column, item: Column) -> Column:
        first = state[0]
        more = F.struct((first.load + item.bytes).alias("load"), first.shard.alias("shard"), F.array_append(first.got, item).alias("got"))
        return F.array_sort(F.array_append(F.slice(state, 2, F.size(state) - 1), more))

    dealt = lists.select(F.explode(F.aggregate("items", F.array_sort(F.transform("owners", with_slots)), give)).alias("owner"))
    return dealt.select(F.col("owner.shard").alias("shard"), F.explode("owner.got").alias("item")).select("item.slot", "shard", "item.bytes")


def slot_loads(rows: DataFrame, slots: int) -> DataFrame:
    """Bytes and rows of every slot, empty ones too."""
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    zero = F.lit(0).cast("long")
    return every.join(sums, every.slot == sums.virtual_slot, "left").select("slot", F.coalesce("bytes", zero).alias("bytes"), F.coalesce("n", zero).alias("n"))


def with_slots(docs: DataFrame, shards: int, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot`` and a number ``row`` of every row, written down once."""
    body = F.coalesce(text, F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + F.lit(RECORD_BYTES)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.xxhash64(body).alias("text_key"),
        F.monotonically_increasing_id().alias("row"),  # of the written table: it stays when a task runs again
    )
    rows = scratch.materialize(rows, "sized")
    total = rows.agg(F.sum("size")).first()[0] or 0
    groups = rows.groupBy("text_key").agg(F.sum("size").alias("group_bytes"))
    large = groups.filter(F.col("group_bytes") > F.lit(total * WHOLE_SHARE / shards)).select("text_key", F.lit(True).alias("spread"))
    rows = rows.join(F.broadcast(large), "text_key", "left")  # at most shards / WHOLE_SHARE rows
    place = F.when(F.col("spread"), F.xxhash64("text_key", "row")).otherwise(F.xxhash64("text_key", F.lit(1)))
    return rows.select("doc_id", "size", "text_crc32", "row", F.pmod(place, F.lit(slots)).cast("int").alias("virtual_slot"))


def shard_documents(docs: DataFrame, shards: int, slots: int = SLOTS, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, SlotMap]:
    """Every row with its shard and its place there, and the map that decided it.

    Columns: ``doc_id, size, text_crc32, virtual_slot, shard, place``.  ``size`` is the UTF-8
    bytes of the text plus 16; a null text has none.  Null ids and repeated rows are placed like
    any others.  An empty table gives no rows and a map that shares the slots out evenly.
    """
    if not 0 < shards <= slots:
        raise ValueError("there must be between one shard and one per slot")
    rows = scratch.materialize(with_slots(docs, shards, slots, doc_id, text), "slotted")
    loads = scratch.materialize(slot_loads(rows, slots), "slot-loads")
    owners = SlotMap.create(loads, shards)
    blocks = F.greatest(F.ceil(F.col("n") / F.lit(BLOCK_ROWS)), F.lit(1))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    plan = owners.table().select("slot", "shard").join(loads, "slot")
    plan = plan.select(F.col("slot").alias("virtual_slot"), "shard", blocks.cast("long").alias("blocks"), F.coalesce(before, F.lit(0)).alias("slot_start"))
    rows = rows.join(F.broadcast(plan), "virtual_slot")  # one row per slot: fixed
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row", F.lit(7)), F.col("blocks")))
    counts = rows.groupBy("virtual_slot", "block").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("virtual_slot").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("virtual_slot", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("block_start"))
    inside = F.row_number().over(Window.partitionBy("virtual_slot", "block").orderBy("row")) - 1
    placed = rows.withColumn("inside", inside).join(counts, ["virtual_slot", "block"])
    place = (F.col("slot_start") + F.col("block_start") + F.col("inside")).cast("long").alias("place")
    return placed.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", place), owners
