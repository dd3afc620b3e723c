"""Divergence of the sources of a language, from exact products of one-hot level columns.

The price of a term in two groups depends on its two counts only.  So a group is described by
indicator columns, one per count that occurs in it (its levels); the product of all columns with
their transpose holds, for every pair of groups, how many terms have which two counts.  These
joint tables are made from blocks of terms, in single precision, which is exact up to 2^24 terms
of a block, and added up.  Prices are then worked out once per cell of a table.

A term that a group lacks is at level 0.  That column is never built: the cells beside it follow
from the number of terms at each level and from the cells that are there.

Terms are counted per task before anything is shuffled, and all counts of a term meet in one
partition, so its document frequency needs no further shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from trajmill import scratch
from trajmill.llm.arrow import parts
from trajmill.operators.spread import broadcast_if_small

UNIT = 1_000_000_000
LEAST_DOCUMENTS = 3
RANKS = 200
#: Counts that a task holds before it hands them on.
HELD = 400_000
#: Counts of one block of terms, and columns of one product.
BLOCK_ROWS = 50_000
BLOCK_COLUMNS = 512

# Terms are runs of ASCII letters and of everything beyond ASCII; in UTF-8 the latter are the bytes from 128 on.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_JOINT = pa.schema([("a", pa.int64()), ("level_a", pa.int64()), ("b", pa.int64()), ("level_b", pa.int64()), ("terms", pa.int64())])


def terms(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term in each group, as far as one task sees them."""
    found: dict[tuple, tuple[Counter, Counter]] = {}

    def hand_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in found.items():
            words = pa.array(list(n), pa.binary()).cast(pa.string())
            columns = [pa.repeat(pa.scalar(x, pa.string()), len(n)) for x in (lang, source)]
            numbers = [pa.array(c, pa.int64()) for c in (list(n.values()), list(map(docs.__getitem__, n)))]
            yield pa.RecordBatch.from_arrays([*columns, words, *numbers], schema=_COUNTS)
        found.clear()

    held = 0
    for part in parts(batches):
        for lang, source, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
            n, docs = found.get((lang, source)) or found.setdefault((lang, source), (Counter(), Counter()))
            held -= len(n)
            words = terms(text)
            n.update(words)
            docs.update(set(words))
            held += len(n)
            if held > HELD:
                yield from hand_on()
                held = 0
    yield from hand_on()


def group_counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The groups (``lang, source, group, kept, total, lang_total``) and the counts of their kept terms.

    Counts: ``group, lang, term, n, lang_n``.  ``kept`` is the number of kept terms of the
    language, ``total`` and ``lang_total`` their occurrences in the group and in the language.
    """
    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    ids = rows.select("lang", "source").distinct().withColumn("group", F.monotonically_increasing_id())
    ids = scratch.materialize(ids, "groups")
    partial = rows.mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")
    # Dealt by term, rows of a group and of a term are already together.
    dealt = partial.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    counts = dealt.select("lang", "source", "term", "n", F.sum("n").over(same).alias("lang_n"), F.sum("docs").over(same).alias("lang_docs"), F.min("source").over(same).alias("first"))
    counts = counts.where(F.col("lang_docs") >= LEAST_DOCUMENTS).withColumn("first", F.col("first") == F.col("source"))
    counts = counts.join(broadcast_if_small(ids), ["lang", "source"]).select("group", "lang", "term", "n", "lang_n", "first")
    counts = scratch.materialize(counts, "counts")
    totals = counts.groupBy("group").agg(F.sum("n").alias("total"), F.count_if("first").alias("firsts"))
    groups = ids.join(totals, "group", "left").na.fill(0, ["total", "firsts"])
    langs = groups.groupBy("lang").agg(F.sum("firsts").alias("kept"), F.sum("total").alias("lang_total"))
    groups = groups.drop("firsts").join(langs, "lang")
    return scratch.materialize(groups, "groups"), counts.drop("first")


def _joint(table: pa.Table) -> pa.Table:
    """Nonzero cells of the joint tables of one block of terms, for groups ``a < b``."""
    term = table.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
    keys = np.stack([table.column("group").to_numpy(), table.column("n").to_numpy()])
    columns, column = np.unique(keys, axis=1, return_inverse=True)
    column = column.ravel()
    order = np.argsort(column, kind="stable")
    starts = np.searchsorted(column[order], np.arange(0, columns.shape[1] + BLOCK_COLUMNS, BLOCK_COLUMNS))
    n_terms = int(term.max()) + 1

    def indicators(k: int) -> np.ndarray:
        rows = order[starts[k] : starts[k + 1]]
        block = np.zeros((n_terms, min(BLOCK_COLUMNS, columns.shape[1] - k * BLOCK_COLUMNS)), np.float32)
        block[term[rows], column[rows] - k * BLOCK_COLUMNS] = 1
        return block

    cells = []
    for i in range(len(starts) - 1):
        left = indicators(i)
        for j in range(i, len(starts) - 1):
            product = left.T @ (left if i == j else indicators(j))
            a, b = np.nonzero(product)
            number = product[a, b]
            a, b = a + i * BLOCK_COLUMNS, b + j * BLOCK_COLUMNS
            ordered = columns[0, a] < columns[0, b]
            a, b = a[ordered], b[ordered]
            cells.append(np.stack([*columns[:, a], *columns[:, b], number[ordered].astype(np.int64)]))
    return pa.Table.from_arrays([pa.array(c) for c in np.concatenate(cells, axis=1)], schema=_JOINT)


def joint_tables(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """How many terms have which counts in two groups of a language: ``a, level_a, b, level_b, terms`` with ``a < b``."""
    sizes = counts.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks"))
    blocks = counts.join(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes, "lang").withColumn("block", F.pmod(F.xxhash64("term"), "blocks"))
    cells = blocks.select("lang", "block", "group", "term", "n").groupBy("lang", "block").applyInArrow(_joint, "a bigint, level_a bigint, b bigint, level_b bigint, terms bigint")
    return cells.groupBy("a", "level_a", "b", "level_b").agg(F.sum("terms").alias("terms"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(UNIT (count + 1) / (total + kept))`` without overflow."""
    all_ = F.greatest(total + kept, F.lit(1))  # a language without kept terms prices none
    small = F.lit(1) + F.call_function("div", F.lit(UNIT) * (count + 1), all_)
    wide = F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    large = F.lit(1) + F.call_function("div", wide, all_.cast("decimal(19,0)"))
    return F.when(count < F.lit((1 << 63) // UNIT - 1), small).otherwise(large)


def price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _pairs(groups: DataFrame, counts: DataFrame) -> DataFrame:
    """``source, item, value`` of each ordered pair of groups of a language, with the group's id.

    With ``f`` the price of two levels, a pair's value is the sum over its joint table of
    ``f(x, y) - f(x, 0) - f(0, y) + f(0, 0)``, plus the sums over each group's levels of
    ``f(x, 0) - f(0, 0)`` and ``f(0, y) - f(0, 0)``, plus ``f(0, 0)`` for each kept term.
    """
    of = lambda side: groups.select(*(F.col(c).alias(f"{side}_{c}") for c in ("group", "lang", "kept", "total")))
    a, b = of("a"), of("b")

    def at(side: str, level: Column) -> Column:
        return share(level, F.col(f"{side}_total"), F.col(f"{side}_kept"))

    zero = F.lit(0).cast("long")

    def both(rows: DataFrame, number: Column, forward: Column, backward: Column) -> DataFrame:
        """The contributions to the value of a in b and of b in a."""
        each = [F.struct(F.col(f"{x}_group").alias("group"), F.col(f"{y}_group").alias("other"), (number * v).alias("value")) for x, y, v in (("a", "b", forward), ("b", "a", backward))]
        return rows.select(F.inline(F.array(*each)))

    def beyond(x: Column, y: Column) -> Column:
        """What the cell at ``x, y`` adds to its two levels alone."""
        x, y = at("a", x), at("b", y)
        x0, y0 = at("a", zero), at("b", zero)
        return (price(x, y) - price(x, y0) - price(x0, y) + price(x0, y0)), (price(y, x) - price(y, x0) - price(y0, x) + price(y0, x0))

    cells = joint_tables(groups, counts).withColumnsRenamed({"a": "a_group", "b": "b_group"})
    cells = cells.join(broadcast_if_small(a), "a_group").join(broadcast_if_small(b.drop("b_lang")), "b_group")
    cells = both(cells, F.col("terms"), *beyond(F.col("level_a"), F.col("level_b")))

    levels = counts.groupBy(F.col("group").alias("a_group"), F.col("n").alias("level")).agg(F.count(F.lit(1)).alias("terms"))
    other = b.withColumnRenamed("b_lang", "a_lang")
    levels = levels.join(broadcast_if_small(a), "a_group").join(broadcast_if_small(other), "a_lang").where("a_group <> b_group")
    x, x0, y0 = at("a", F.col("level")), at("a", zero), at("b", zero)
    levels = both(levels, F.col("terms"), price(x, y0) - price(x0, y0), price(y0, x) - price(y0, x0))

    base = a.join(broadcast_if_small(other), "a_lang").where("a_group <> b_group")
    nothing = F.col("a_kept") == 0
    base = base.select(F.col("a_group").alias("group"), F.col("b_group").alias("other"), F.when(nothing, F.lit(0).cast("long")).otherwise(F.col("a_kept") * price(x0, y0)).alias("value"))

    values = cells.unionByName(levels).unionByName(base).groupBy("group", "other").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))
    names = groups.select(F.col("group").alias("other"), F.col("source").alias("item"))
    return values.join(broadcast_if_small(names), "other").select("group", "item", "value")


def _terms(groups: DataFrame, counts: DataFrame) -> DataFrame:
    sizes = groups.select("group", "kept", "total", "lang_total")
    rows = counts.join(broadcast_if_small(sizes), "group")
    rows = rows.select("group", F.col("term").alias("item"), share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"))
    return rows.where("p > q").select("group", "item", price(F.col("p"), F.col("q")).alias("value"))


def audit_sources(docs: DataFrame) -> DataFrame:
    """How the sources of a language differ, and by which terms: ``lang, source, part, item, value, rank``.

    Part ``pair``: for each group and each other source of its language, the sum over the
    language's kept terms of ``(p - q)^2 / q`` in whole numbers, all ranks.  Part ``term``: for each group the
    kept terms that it uses more than its language does, by that price, the first ``RANKS``.  Equal
    values are ranked by item.

    Null language, source and text are empty; a repeated row is a document of its own.  A group
    whose language keeps no term has pairs of value 0 and no terms; an empty table gives no rows.
    """
    groups, counts = group_counts(docs)
    by = Window.partitionBy("group").orderBy(F.desc("value"), "item")
    pairs = _pairs(groups, counts).withColumn("rank", F.row_number().over(by)).select("group", F.lit("pair").alias("part"), "item", "value", "rank")
    terms_ = _terms(groups, counts).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= RANKS)
    found = pairs.unionByName(terms_.select("group", F.lit("term").alias("part"), "item", "value", "rank"))
    return found.join(broadcast_if_small(groups.select("group", "lang", "source")), "group").select("lang", "source", "part", "item", "value", "rank")
