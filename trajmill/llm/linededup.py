"""Removal of lines that spread over many sites.

A line is boilerplate if it occurs on at least ``sites`` different sites.  How far a line
spreads is estimated by HyperLogLog sketches, one per line hash, merged by aggregation; lines
whose estimate lies near the threshold are counted exactly.  Only lines that occur often enough
to matter get a sketch, as a line on ``sites`` sites occurs at least as often.

Of each boilerplate line the occurrence in the row with the smallest id stays (``keep="first"``),
so that no content leaves the corpus; ``keep="none"`` removes it everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trajmill import scratch

SITES = 5
LEAST_WORDS = 3
SKETCH_LG_K = 12
#: Standard deviations of the estimate within which lines are counted exactly.
BAND = 4.0
#: Into so many parts the rows of a line are dealt.
SALTS = 16


def _line_key(line: Column) -> Column:
    """96 bits of a line."""
    return F.struct(F.xxhash64(line).alias("h"), F.hash(line, F.lit(1)).alias("h2"))


def _row_key(docs: DataFrame) -> Column:
    """96 bits of a whole row; rows that agree in all columns are treated alike."""
    # Maps, nested ones too, have no hash; their JSON has one.
    plain = [F.to_json(F.struct(f"`{c}`")) if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes]
    return F.struct(F.xxhash64(*plain).alias("r"), F.hash(*plain, F.lit(1)).alias("r2"))


def lines(docs: DataFrame, site: str, doc_id: str, text: str, least_words: int) -> DataFrame:
    """The lines of enough words: row key, position, line key, site, id.  A null site is a site of its own."""
    rows = docs.select(_row_key(docs).alias("row"), F.col(site).cast("string").alias("site"), F.col(doc_id).alias("id"), F.split(text, "\n").alias("lines"))
    found = rows.select("row", "site", "id", F.posexplode("lines").alias("pos", "line")).withColumn("line", F.trim("line"))
    found = found.filter(F.size(F.split("line", r"\s+")) >= least_words)
    return found.select("row.r", "row.r2", "pos", _line_key(F.col("line")).alias("key"), F.coalesce("site", F.lit("")).alias("site"), "id").select(
        "r", "r2", "pos", "key.h", "key.h2", "site", "id"
    )


def spread_lines(found: DataFrame, sites: int = SITES) -> DataFrame:
    """``h, h2, spread, exact`` of the lines on at least ``sites`` sites; ``spread`` is a count where ``exact``."""
    often = found.groupBy("h", "h2").agg(F.count("*").alias("n")).filter(F.col("n") >= sites).select("h", "h2")
    salted = scratch.materialize(often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "frequent-lines")
    # Hot lines are salted for the join and sketched per salt before the sketches are merged.
    salt = F.pmod(F.xxhash64("r", "pos"), F.lit(SALTS)).cast("int")
    frequent = scratch.materialize(found.withColumn("salt", salt).join(salted, ["h", "h2", "salt"]).select("h", "h2", "salt", "site"), "frequent-sites")
    sketches = frequent.groupBy("h", "h2", "salt").agg(F.hll_sketch_agg("site", F.lit(SKETCH_LG_K)).alias("sketch"))
    merged = sketches.groupBy("h", "h2").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("spread"))
    merged = scratch.materialize(merged, "line-spreads")
    margin = BAND * 1.04 / (1 << SKETCH_LG_K) ** 0.5
    low, high = sites * (1 - margin) - 1, sites * (1 + margin) + 1
    clear = merged.filter(F.col("spread") > high).withColumn("exact", F.lit(False))
    near = merged.filter((F.col("spread") >= low) & (F.col("spread") <= high)).select("h", "h2")
    pairs = frequent.groupBy("h", "h2", "site").agg(F.count("*").alias("n"))  # before the join: a hot line is one row per site
    counted = pairs.join(near, ["h", "h2"]).groupBy("h", "h2").agg(F.count("*").alias("spread")).filter(F.col("spread") >= sites)
    return clear.unionByName(counted.withColumn("exact", F.lit(True)))


def remove_spread_lines(
    docs: DataFrame, sites: int = SITES, site: str = "source", least_words: int = LEAST_WORDS, keep: str = "first", doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``row`` (all columns of ``docs``), ``text`` without the lines, ``n_lines``, ``n_removed`` for every row.

    Null texts stay null and have no lines.  Lines of fewer than ``least_words`` words never
    count.  A null site is one more site; null ids come after all others when the first
    occurrence is looked for, and occurrences in other rows with its id stay too.  Rows whose
    lines are all removed keep an empty text.  An empty table gives no rows.
    """
    found = lines(docs, site, doc_id, text, least_words)
    boilerplate = scratch.materialize(spread_lines(found, sites), "boilerplate")
    hits = scratch.materialize(found.join(boilerplate.select("h", "h2"), ["h", "h2"]), "boilerplate-hits")
    if keep == "first":
        first = scratch.materialize(hits.groupBy("h", "h2").agg(F.min("id").alias("first_id")), "first-ids")
        at = scratch.materialize(hits.join(first, ["h", "h2"]).filter(F.col("id").eqNullSafe(F.col("first_id"))), "first-hits")
        # A line that its first row repeats stays there once.
        once = scratch.materialize(at.groupBy("h", "h2", "r", "r2").agg(F.min("pos").alias("pos")), "kept-hits")
        hits = hits.join(once, ["h", "h2", "r", "r2", "pos"], "left_anti")
    removed = hits.groupBy("r", "r2").agg(F.collect_set("pos").alias("at"))  # at most the lines of one row
    rows = docs.select(F.struct("*").alias("row"), _row_key(docs).alias("key")).select("row", "key.r", "key.r2")
    joined = rows.join(scratch.materialize(removed, "removed-lines"), ["r", "r2"], "left")
    whole = F.col("row").getField(text)
    parts = F.split(whole, "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "at")  # linear in the lines, however many go
    kept = F.transform(places, lambda i: F.get(parts, i))
    cut = F.when(F.col("at").isNull(), whole).otherwise(F.array_join(kept, "\n"))
    n_lines = F.when(whole.isNull(), 0).otherwise(F.size(parts))
    n_removed = F.when(F.col("at").isNull(), 0).otherwise(F.size("at"))
    return joined.select("row", cut.alias("text"), n_lines.cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed"))


def without_spread_lines(docs: DataFrame, length: str | None = "n_chars", text: str = "text", **options) -> DataFrame:
    """``docs`` with its own columns; the text, and its length in characters if there is such a column, are new."""
    cleaned = remove_spread_lines(docs, text=text, **options)
    columns = []
    for name, kind in docs.dtypes:
        old = F.col(f"row.`{name}`")
        if name == text:
            old = F.col("text")
        elif name == length:
            old = F.when(F.col("n_removed") > 0, F.char_length("text").cast(kind)).otherwise(old)
        columns.append(old.alias(name))
    return cleaned.select(*columns)
