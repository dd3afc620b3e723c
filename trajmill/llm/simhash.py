"""SimHash fingerprints, links between near fingerprints, and groups of near duplicates.

``fingerprints`` hashes word shingles.  Two searches follow, both over distinct fingerprints, so
that copies collapse before anything is compared:

* ``near_links``: all pairs within a Hamming radius of 2, exactly.  Candidates share three of
  five blocks of bits, as two changed bits leave three blocks as they were.  A pivot table holds
  the distances of every fingerprint to many reference fingerprints; a pair whose distances to
  some pivot differ by more than the radius is discarded (triangle inequality), and the rest is
  verified.  Blocks that very many fingerprints share are not paired up: their fingerprints send
  all words at distance 1 to a grouping, and those that meet at a word are within 2 of each other
  and are linked to the smallest of them.  This loses no link of a component and is linear.
* ``near_duplicates``: documents whose shingle sets have a Jaccard similarity of 0.8 or more.
  Pairs this similar differ in up to a fifth of the fingerprint's bits, which no block leaves
  alone.  Candidates therefore share the sketch of a sample: shingles are dealt by hash into more
  samples than a pair at the threshold has differences, so some are equal, whatever the texts;
  short texts share two of their least hashes.  Pairs that sizes and counts of shingles by
  class rule out are discarded, which loses no pair at the threshold, and the shingle sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trajmill import scratch
from trajmill.llm.arrow import map_rows
from trajmill.llm.components import components
from trajmill.operators.spread import broadcast_if_small

BITS = 64
SEED = 42
RADIUS = 2
BLOCKS = 5
FREE_BLOCKS = 3
PIVOTS = 24
#: Groups up to this size are paired up; larger ones take the linear way.
PAIRED = 32
#: Texts of a group that stays larger, which are held against as many others at once.
BLOCK = 256

SHINGLE = 5
SIMILARITY = 0.8
#: Classes of hashes by which the shingles of a text are counted.
CLASSES = 128
#: Samples that hold a shingle, by the differences of a pair at the threshold, that a text has on average; more are dealt where it has too few.
SPARE = 1.2
#: Samples beyond which no more are dealt; by then a shingle is nearly always alone in its sample.
MOST_SAMPLES = 1 << 40
#: Shingles whose number of texts is known where the rarest of a text are looked for.
COMMON = 1 << 14
#: Counts by class beyond this are taken as this, which sets no pair further apart.
MOST_COUNTED = 32767
#: Texts of up to so many shingles are found by pairs of their least hashes, which misses none.
SMALL = 40


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included.  Only A to Z are lower-cased."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    hashed = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([hashed(b" ".join(tokens), SEED)], dtype=np.uint64)
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    return np.fromiter((hashed(s, SEED) for s in shingles), dtype=np.uint64, count=len(tokens) - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; 0 without hashes.  As a signed number."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp`` for every row; texts without words, null texts too, have the fingerprint 0."""

    @F.arrow_udf(T.LongType())
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(shingle_hashes(t.as_py(), words)) for t in texts], pa.int64())

    return docs.select(F.col(doc_id).alias("doc_id"), of(F.col(text)).alias("fp"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pivot_fingerprints(count: int = PIVOTS) -> list[int]:
    """Reference fingerprints: hashes of their numbers, as signed words."""
    return [int(np.uint64(xxhash.xxh64_intdigest(str(i), SEED)).astype(np.int64)) for i in range(count)]


def with_pivots(nodes: DataFrame, fp: str = "fp", count: int = PIVOTS) -> DataFrame:
    """Adds the table of distances to the pivots."""
    return nodes.withColumn("pivots", F.array(*(distance(F.col(fp), F.lit(p)).cast("byte") for p in pivot_fingerprints(count))))


def pivots_allow(a: Column, b: Column, radius: int) -> Column:
    """Whether no pivot sets the two apart by more than the radius."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))) <= radius


def block_keys(fp: Column) -> Column:
    """For each choice of blocks, its number and the fingerprint's bits in these blocks."""
    edges = [round(i * BITS / BLOCKS) for i in range(BLOCKS + 1)]
    masks = [sum(1 << bit for bit in range(edges[i], edges[i + 1])) for i in range(BLOCKS)]
    keys = []
    for number, chosen in enumerate(combinations(masks, FREE_BLOCKS)):
        mask = int(np.uint64(sum(chosen)).astype(np.int64))
        keys.append(F.struct(F.lit(number).alias("table"), fp.bitwiseAND(F.lit(mask)).alias("bits")))
    return F.array(*keys)


def near_links(distinct: DataFrame) -> DataFrame:
    """Links ``a, b`` (fingerprints, a < b) between fingerprints within ``RADIUS``.

    All pairs of small groups, and for groups of more than ``PAIRED`` so many that the same
    fingerprints are connected as by all pairs.  ``distinct`` has one row per fingerprint.
    """
    table = scratch.materialize(with_pivots(distinct.select("fp")), "pivot-table")
    keyed = table.select("fp", "pivots", F.explode(block_keys(F.col("fp"))).alias("key")).select("fp", "pivots", "key.table", "key.bits")
    sizes = scratch.materialize(keyed.groupBy("table", "bits").agg(F.count("*").alias("n")).filter("n > 1"), "block-sizes")
    members = scratch.materialize(keyed.join(sizes, ["table", "bits"]), "block-members")
    small = members.filter(F.col("n") <= PAIRED)
    left = small.select("table", "bits", F.col("fp").alias("a"), F.col("pivots").alias("pa"))
    right = small.select("table", "bits", F.col("fp").alias("b"), F.col("pivots").alias("pb"))
    pairs = left.join(right, ["table", "bits"]).filter(F.col("a") < F.col("b"))
    pairs = pairs.filter(pivots_allow(F.col("pa"), F.col("pb"), RADIUS)).filter(distance(F.col("a"), F.col("b")) <= RADIUS)
    # Pairs of large groups meet at the words between them.
    crowded = members.filter(F.col("n") > PAIRED).select("fp").distinct()
    flips = [0, *(int(np.uint64(1 << bit).astype(np.int64)) for bit in range(BITS))]
    words = crowded.select("fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(f)) for f in flips))).alias("word"))
    meeting = words.groupBy("word").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").select("word", "a")
    met = words.join(meeting, "word").filter(F.col("a") < F.col("fp")).select("a", F.col("fp").alias("b"))
    return pairs.select("a", "b").unionByName(met).distinct()


def fingerprint_components(docs: DataFrame, words: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    The component id is the smallest id among all rows whose fingerprints are reached by links;
    null ids count only where there is no other.  Repeated rows get the same values.  Extra
    columns are not read, and an empty table gives no rows.
    """
    rows = scratch.materialize(fingerprints(docs, words, doc_id, text), "fingerprints")
    distinct = scratch.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    found = components(near_links(distinct))
    rooted = distinct.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = scratch.materialize(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "component-ids")
    labels = rooted.join(smallest, "root").select("fp", "component_id")
    return rows.join(labels, "fp").select("doc_id", "fp", "component_id")


def _differences(count: float, threshold: float) -> float:
    """In how many shingles a set of so many differs from another one at the threshold, at most."""
    return count * (1 - threshold) / threshold


def _step(count: float, threshold: float) -> int:
    """The least power of two of samples of which about so many shingles fill ``SPARE`` times as many as there are differences."""
    step = 1
    while -step * np.expm1(-count / step) < SPARE * _differences(count, threshold):
        step *= 2
    return step


def samples(count: int, threshold: float = SIMILARITY) -> list[int]:
    """Into how many samples a set of so many shingles is dealt; near a step, both sides of it.

    Two sets whose sizes differ by the threshold at most have one number in common.
    """
    reach = 1.001 / np.sqrt(threshold)
    return sorted({_step(count / reach, threshold), _step(count * reach, threshold)})


def sample_keys(distinct: np.ndarray, count: int, threshold: float) -> np.ndarray:
    """Keys of which two sets of shingles at the threshold or over it share one, if both are dealt into ``count`` samples.

    A difference changes one sample.  So of the samples that hold something all but as many are equal as there
    are differences, and one more than that, in an order that sets have in common, holds an equal one; the fullest
    come first, as few other sets have them.  A set with too few samples for that gives all of them, and is
    dealt again into twice as many.
    """
    most, keys = int(_differences(len(distinct), threshold) + 1e-9), []
    mixed = distinct * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    while True:
        sample = (distinct >> np.uint64(7)) & np.uint64(count - 1)
        order = np.argsort(sample, kind="stable")
        starts = np.flatnonzero(np.diff(sample[order], prepend=-1.0))
        sums = np.add.reduceat(mixed[order], starts)
        sums ^= sample[order][starts] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(count)
        held = np.diff(starts, append=len(distinct))
        keys.append(sums[np.lexsort((sums, -held))[: most + 1]])
        if len(starts) > most or count >= MOST_SAMPLES:
            return np.concatenate(keys)
        count *= 2


def least_keys(distinct: np.ndarray, threshold: float) -> np.ndarray:
    """So many of the least hashes that those left over are fewer than two sets at the threshold share."""
    return distinct[: len(distinct) - int(np.ceil(threshold * len(distinct) - 1e-9)) + 1]


def small_keys(distinct: np.ndarray, threshold: float) -> np.ndarray:
    """Keys of which two sets of shingles at the threshold or over it share one, without exception.

    Sets that share ``s`` hashes share two of their ``n - s + 2`` least ones; the keys are the pairs of those.
    """
    if len(distinct) < 2:
        return distinct
    least = distinct[: len(distinct) - int(np.ceil(threshold * len(distinct) - 1e-9)) + 2]
    one, other = np.triu_indices(len(least), 1)
    return least[one] * np.uint64(0x9E3779B97F4A7C15) ^ least[other] * np.uint64(0xC2B2AE3D27D4EB4F)


class _Sketcher:
    """Fingerprint and number of the distinct shingles, how many are in each class, and the sketches of a text."""

    def __init__(self, words: int, threshold: float = SIMILARITY) -> None:
        self.words, self.threshold = words, threshold

    def __call__(self, row: tuple) -> Iterator[tuple]:
        key, text = row
        distinct = np.unique(shingle_hashes(text, self.words))
        fp, counts = fingerprint(distinct), np.bincount((distinct >> np.uint64(40)).astype(np.int64) % CLASSES, minlength=CLASSES)
        keys: list[int] = []
        if not len(distinct):
            keys.append(0)
        elif len(distinct) <= SMALL / self.threshold:
            keys += small_keys(distinct, self.threshold).view(np.int64).tolist()
        if len(distinct) >= SMALL and SPARE * _differences(1, self.threshold) >= 0.9:  # a low threshold; no samples would do
            keys += least_keys(distinct, self.threshold).view(np.int64).tolist()
        elif len(distinct) >= SMALL:
            for count in samples(len(distinct), self.threshold):
                keys += sample_keys(distinct, count, self.threshold).view(np.int64).tolist()
        yield key, fp, len(distinct), np.minimum(counts, MOST_COUNTED).tolist(), keys


class _Shingler:
    """The hashes of the distinct shingles of a text."""

    def __init__(self, words: int) -> None:
        self.words = words

    def __call__(self, row: tuple) -> Iterator[tuple]:
        key, text = row
        yield key, np.unique(shingle_hashes(text, self.words)).view(np.int64).tolist()


class _Rarest:
    """The least shingles of a text by their number of texts, where it is known, and then by hash."""

    def __init__(self, common: np.ndarray, spread: np.ndarray, threshold: float) -> None:
        self.common, self.spread, self.threshold = common, spread, threshold

    def __call__(self, row: tuple) -> Iterator[tuple]:
        key, hashes = row
        own = np.array(hashes, dtype=np.int64)
        spread = np.zeros(len(own), dtype=np.int64)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, own), len(self.common) - 1)
            spread = np.where(self.common[at] == own, self.spread[at], 0)
        yield key, least_keys(own[np.lexsort((own, spread))], self.threshold).tolist()


class _Similar:
    """The keys and the similarity of a pair of texts whose shingle sets reach the threshold."""

    def __init__(self, words: int, threshold: float) -> None:
        self.words, self.threshold, self.last, self.seen = words, threshold, None, None

    def __call__(self, row: tuple) -> Iterator[tuple]:
        a, b, one, other = row
        if self.seen is None or one != self.last:
            self.last, self.seen = one, np.unique(shingle_hashes(one, self.words))
        hashes = np.unique(shingle_hashes(other, self.words))
        both = len(np.intersect1d(self.seen, hashes, assume_unique=True))
        either = len(self.seen) + len(hashes) - both
        similarity = both / either if either else 1.0
        if similarity >= self.threshold:
            yield a, b, similarity


def similar_links(docs: DataFrame, words: int, threshold: float) -> DataFrame:
    """Links ``a, b`` between keys of ``docs`` (``key, text``; a text may occur in many rows) that are similar enough.

    Texts of fewer words than a shingle are compared as one sequence, texts without words are
    all alike.  All texts with a sketch are compared with the one of them that has the least key,
    which connects most groups.  In the others, texts that are not connected yet are compared: all
    of them where up to ``PAIRED`` texts share the sketch.  The texts of larger groups are grouped
    anew by their rarest shingles, of which every pair at the threshold shares one, and these
    groups are treated in the same way.  What is crowded still is compared with the text nearest to
    the bitwise majority of the group, the leader.  A text leaves a group when it was the leader, or
    when the leader shows that all texts which are not yet connected to it are out of its reach: one
    less the similarity is a metric.  Those that are left are held against each other in blocks by
    their counts of shingles.  So the links connect what the links of all pairs connect.
    """
    schema = T.StructType(
        [
            T.StructField("key", T.LongType()),
            T.StructField("fp", T.LongType()),
            T.StructField("n", T.IntegerType()),
            T.StructField("counts", T.ArrayType(T.ShortType())),
            T.StructField("sketches", T.ArrayType(T.LongType())),
        ]
    )
    sketched = scratch.materialize(map_rows(docs.select("key", "text"), lambda: _Sketcher(words, threshold), schema), "sketches")
    facts = scratch.materialize(sketched.select("key", "fp", "n", "counts").dropDuplicates(["key"]), "sizes")
    links, roots, crowded = _resolved(_members(sketched), None, facts, docs, words, threshold)
    if not crowded.isEmpty():
        again = scratch.materialize(crowded.select("key").distinct(), "crowded-keys")
        texts = docs.select("key", "text").join(broadcast_if_small(again), "key", "left_semi")
        links, roots, crowded = _resolved(_members(scratch.materialize(_rarest(texts, words, threshold), "rarest-shingles")), links, facts, docs, words, threshold)
    if not crowded.isEmpty():
        held = crowded.join(facts.select("key", "fp"), "key")
        held = scratch.materialize(_rooted(held, roots), "crowded")
        leaders = scratch.materialize(_leaders(held, 1), "leaders")
        led = held.select("sketch", "key").join(leaders.select("sketch", "leader"), "sketch").filter(F.col("key") != F.col("leader"))
        asked = led.select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b")).distinct()
        # Two texts similar to each other, of which one is similar to a leader, have at least this similarity to it.
        met = _verified(asked, facts, docs, words, 2 * threshold - 1)
        links = scratch.materialize(links.unionByName(met.filter(F.col("similarity") >= threshold).select("a", "b")), "links-so-far")
        roots = scratch.materialize(components(links), "roots-so-far")
        rest = _unconnected(_unsettled(held.select("sketch", "key"), leaders.select("sketch", "leader"), met, roots, threshold), roots)
        asked = _within(rest).unionByName(_near_in_blocks(rest.filter(F.col("size") > PAIRED), facts, threshold))
        links = links.unionByName(_verified(asked.distinct(), facts, docs, words, threshold).select("a", "b"))
    return links


def _rarest(texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """``key, sketches``: the shingles that occur in the fewest of the texts.

    There are so many of them that those left over are fewer than two sets at the threshold share.
    All sets take their shingles in one order, so such sets share one of those that are given.  In
    this order the ``COMMON`` most frequent ones come last, which are sent to the workers; any
    order would do.
    """
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("hashes", T.ArrayType(T.LongType()))])
    hashed = scratch.materialize(map_rows(texts, lambda: _Shingler(words), schema).dropDuplicates(["key"]), "shingles")
    spread = hashed.select(F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count("*").alias("spread"))
    found = spread.filter(F.col("spread") > PAIRED).orderBy(F.desc("spread"), "hash").limit(COMMON).collect()
    common = np.array(sorted((r.hash, r.spread) for r in found), dtype=np.int64).reshape(-1, 2)
    hashes, spreads = common[:, 0].copy(), common[:, 1].copy()
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("sketches", T.ArrayType(T.LongType()))])
    return map_rows(hashed, lambda: _Rarest(hashes, spreads, threshold), schema)


def _members(sketched: DataFrame) -> DataFrame:
    """``sketch, key`` for the sketches that several texts have, with the least key of the sketch as ``low``."""
    rows = sketched.select("key", F.explode("sketches").alias("sketch"))
    shared = rows.groupBy("sketch").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high").select("sketch", "low")
    return scratch.materialize(rows.join(scratch.materialize(shared, "shared-sketches"), "sketch").distinct(), "sketch-members")


def _resolved(members: DataFrame, links: DataFrame | None, facts: DataFrame, docs: DataFrame, words: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All links so far, roots, and the ``sketch, key`` of groups of more than ``PAIRED`` texts that are not all connected."""
    asked = members.filter("low < key").select(F.col("low").alias("a"), F.col("key").alias("b")).distinct()
    if links is not None:
        asked = asked.join(links, ["a", "b"], "left_anti")
    met = _verified(asked, facts, docs, words, threshold).select("a", "b")
    links = met if links is None else links.unionByName(met)
    roots = scratch.materialize(components(links), "roots-of-low")
    rest = _unconnected(members.select("sketch", "key"), roots)
    links = links.unionByName(_verified(_within(rest).distinct(), facts, docs, words, threshold).select("a", "b"))
    return links, roots, rest.filter(F.col("size") > PAIRED).select("sketch", "key")


def _unconnected(held: DataFrame, roots: DataFrame) -> DataFrame:
    """The members, with roots and sizes, of groups that are not all connected."""
    rest = scratch.materialize(_rooted(held, roots), "unsettled")
    sizes = rest.groupBy("sketch").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
    sizes = scratch.materialize(sizes.filter("low < high").select("sketch", "size"), "unsettled-sizes")
    return scratch.materialize(rest.join(sizes, "sketch"), "unsettled-members")


def _within(members: DataFrame) -> DataFrame:
    """All pairs of the groups of up to ``PAIRED`` that are not connected."""
    small = members.filter(F.col("size") <= PAIRED)
    left = small.select("sketch", F.col("key").alias("a"), F.col("root").alias("root_a"))
    right = small.select("sketch", F.col("key").alias("b"), F.col("root").alias("root_b"))
    return left.join(right, "sketch").filter("a < b AND root_a <> root_b").select("a", "b")


def _near_in_blocks(crowded: DataFrame, facts: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: the pairs of each group that are not connected and that their counts do not rule out.

    Groups are cut into blocks of about ``BLOCK`` texts, and two blocks at a time are compared; a
    row holds two blocks, and no row is made for a pair that is ruled out.
    """
    held = crowded.join(facts.select("key", "n", "counts"), "key")
    block = F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / BLOCK))
    text = F.struct("key", "root", "n", "counts")
    blocks = scratch.materialize(held.groupBy("sketch", block.alias("block")).agg(F.collect_list(text).alias("texts")), "blocks")
    other = blocks.select("sketch", F.col("block").alias("other_block"), F.col("texts").alias("others"))
    both = blocks.join(other, "sketch").filter("block <= other_block").select("texts", "others")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    arrow = to_arrow_schema(schema)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                (keys, roots, n, counts), (keys_b, roots_b, n_b, counts_b) = (_columns(column[at].values) for column in batch.columns)
                for i in range(len(keys)):
                    apart = np.abs(counts_b - counts[i]).sum(axis=1)
                    fits = (np.minimum(n_b, n[i]) >= (threshold - 1e-9) * np.maximum(n_b, n[i])) & (roots_b != roots[i])
                    found = keys_b[fits & (apart <= ((1 - threshold) / (1 + threshold) + 1e-9) * (n_b + n[i]))]
                    if len(found):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(found, keys[i])), pa.array(np.maximum(found, keys[i]))], schema=arrow)

    return both.mapInArrow(near, schema).distinct()


def _columns(texts: pa.StructArray) -> list[np.ndarray]:
    """Keys, roots, numbers of shingles, and their counts by class as one row a text."""
    key, root, n, counts = texts.flatten()
    return [key.to_numpy(), root.to_numpy(), n.to_numpy(), counts.flatten().to_numpy().astype(np.int32).reshape(-1, CLASSES)]


def _rooted(nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Adds the root of each key, which is the key itself where it has no link."""
    if roots is None:
        return nodes.withColumn("root", F.col("key"))
    return nodes.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))


def _unsettled(held: DataFrame, leaders: DataFrame, met: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """The texts of the groups of which a link to a text that is not connected to them may be unknown.

    If no unconnected text of the group is as similar to the leader as ``f``, a text with similarity
    ``s`` to this leader has no link to any of them when ``s - f > 1 - threshold``.  Pairs that are
    not in ``met`` have less than ``2 * threshold - 1``.
    """
    ways = met.select(F.col("a").alias("leader"), F.col("b").alias("key"), "similarity")
    ways = ways.unionByName(met.select(F.col("b").alias("leader"), F.col("a").alias("key"), "similarity"))
    near = held.join(leaders, "sketch").join(ways, ["leader", "key"])
    near = _rooted(near, roots).join(roots.select(F.col("node").alias("leader"), F.col("root").alias("of_leader")), "leader", "left")
    near = scratch.materialize(near.withColumn("own", F.col("root") == F.coalesce("of_leader", "leader")), "near-leaders")
    foreign = near.filter("NOT own").groupBy("sketch", "leader").agg(F.max("similarity").alias("foreign"))
    own = near.filter("own").join(scratch.materialize(foreign, "foreign"), ["sketch", "leader"], "left")
    clear = F.when(F.col("foreign").isNull(), F.col("similarity") >= threshold).otherwise(F.col("similarity") - F.col("foreign") > F.lit(1 - threshold + 1e-9))
    settled = own.filter(clear).select("sketch", "key").unionByName(leaders.select("sketch", F.col("leader").alias("key"))).distinct()
    return held.join(scratch.materialize(settled, "settled"), ["sketch", "key"], "left_anti")


def _verified(pairs: DataFrame, facts: DataFrame, docs: DataFrame, words: int, threshold: float) -> DataFrame:
    """``a, b, similarity`` of the pairs that pass the comparison of shingle sets.

    Before it, pairs go whose sizes or counts by class rule the threshold out: sets differ in as
    many shingles as their counts do, at least.
    """

    def side(name: str) -> DataFrame:
        return facts.select(F.col("key").alias(name), F.col("n").alias(f"n_{name}"), F.col("counts").alias(f"c_{name}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.filter(F.least("n_a", "n_b") >= F.lit(threshold - 1e-9) * F.greatest("n_a", "n_b"))
    apart = F.aggregate(F.zip_with("c_a", "c_b", lambda x, y: F.abs(x.cast("int") - y)), F.lit(0), lambda total, x: total + x)
    both = both.filter(apart <= F.lit((1 - threshold) / (1 + threshold) + 1e-9) * (F.col("n_a") + F.col("n_b")))
    near = scratch.materialize(both.select("a", "b"), "near-pairs")
    ends = scratch.materialize(near.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "near-keys")
    needed = docs.join(broadcast_if_small(ends), "key", "left_semi").groupBy("key", "text").agg(F.count("*").alias("copies"))
    needed = scratch.materialize(needed.select("key", "text"), "near-texts")
    wide = near.join(needed.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    wide = wide.join(needed.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("similarity", T.DoubleType())])
    # Not a column and a filter: Spark evaluates such a column twice, in workers of both.
    same = map_rows(wide.select("a", "b", "text_a", "text_b"), lambda: _Similar(words, threshold), schema)
    return scratch.materialize(same.distinct(), "similar")


def _leaders(held: DataFrame, others: int) -> DataFrame:
    """Per sketch the text nearest to the bitwise majority of its group, and so many others, those of the smallest components first."""
    ones = [F.sum(F.shiftrightunsigned("fp", bit).bitwiseAND(F.lit(1).cast("long"))).alias(f"bit{bit}") for bit in range(BITS)]
    counted = held.groupBy("sketch").agg(F.count("*").alias("held"), *ones)
    majority = F.lit(0).cast("long")
    for bit in range(BITS):
        word = F.lit(int(np.uint64(1 << bit).astype(np.int64)))
        majority = majority.bitwiseOR(F.when(2 * F.col(f"bit{bit}") > F.col("held"), word).otherwise(F.lit(0).cast("long")))
    center = scratch.materialize(counted.select("sketch", majority.alias("center")), "centers")
    off = held.join(center, "sketch").select("sketch", F.struct(distance(F.col("fp"), F.col("center")).alias("off"), "key").alias("at"))
    nearest = off.groupBy("sketch").agg(F.min("at").alias("at")).select("sketch", F.col("at.key").alias("leader"))
    alike = held.groupBy("sketch", "root").agg(F.count("*").alias("alike"))
    order = Window.partitionBy("sketch").orderBy("alike", F.xxhash64("key", "sketch"), "key")
    drawn = held.join(alike, ["sketch", "root"]).withColumn("place", F.row_number().over(order)).filter(F.col("place") < F.lit(others))
    return nearest.select("sketch", "leader").unionByName(drawn.select("sketch", F.col("key").alias("leader"))).distinct()


def without_near_duplicates(
    docs: DataFrame, words: int = SHINGLE, threshold: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``docs``, all columns, of which one of each group of near duplicates stays.

    Of a group, the row with the smallest id stays; null ids come last.  Of rows that repeat this
    id the one with the smallest hash of all columns stays, of identical rows one.  Null and empty
    texts are copies of each other, and so are texts that differ only in white space or in the
    case of A to Z.  An empty table stays empty.
    """
    # Maps, nested ones too, have no hash; their JSON has one.
    plain = [F.to_json(F.struct(f"`{c}`")) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes]
    rows = docs.select(
        F.struct("*").alias("row"),
        F.struct(F.xxhash64(*plain).alias("a"), F.xxhash64(F.lit(1), *plain).alias("b")).alias("row_key"),
        F.col(doc_id).alias("doc_id"),
        F.coalesce(text, F.lit("")).alias("text"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"),
    )
    found = components(similar_links(rows.select("key", "text"), words, threshold))
    narrow = scratch.materialize(rows.select("doc_id", "row_key", "key"), "row-keys")
    grouped = narrow.join(found.select(F.col("node").alias("key"), "root"), "key", "left")
    grouped = scratch.materialize(grouped.select("doc_id", "row_key", F.coalesce("root", "key").alias("root")), "grouped")
    best = scratch.materialize(grouped.groupBy("root").agg(F.min("doc_id").alias("best_id"), F.count("*").alias("rows")).filter("rows > 1"), "best")
    first = grouped.join(best, "root").filter(F.col("doc_id").eqNullSafe(F.col("best_id"))).groupBy("root").agg(F.min("row_key").alias("best_key"))
    first = scratch.materialize(first, "first")
    removed = grouped.join(first, "root").filter("row_key <> best_key").select("row_key").distinct()
    kept = rows.join(broadcast_if_small(scratch.materialize(removed, "removed")), "row_key", "left_anti")
    repeated = scratch.materialize(narrow.groupBy("row_key").agg(F.count("*").alias("n")).filter("n > 1").select("row_key"), "repeated")
    if not repeated.isEmpty():  # identical rows: one of each stays
        once = kept.join(broadcast_if_small(repeated), "row_key", "left_semi").groupBy("row_key").agg(F.first("row").alias("row"))
        kept = kept.join(broadcast_if_small(repeated), "row_key", "left_anti").select("row").unionByName(once.select("row"))
    return kept.select("row.*")
