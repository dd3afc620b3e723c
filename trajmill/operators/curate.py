"""Corpus building: verified rows, caps per instance, and mixing under a budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from trajmill import constants as C, scratch
from trajmill.functions.numbers import budget
from trajmill.operators.ordering import Cut, find_cut, seed_hash
from trajmill.operators.spread import broadcast_if_small


def verified_rows(df: DataFrame) -> DataFrame:
    """Rows with ``verified = true``.  A bare column, so that the scan can use it."""
    return df.where(F.col("verified"))


def unverified_rows(df: DataFrame) -> DataFrame:
    """Rows that are not verified; null counts as not verified.  The scan can use both tests."""
    return df.where(F.col("verified").isNull() | ~F.col("verified"))


def with_min_messages(df: DataFrame, at_least: int = C.MIN_MESSAGES) -> DataFrame:
    return df.where(F.size("messages") >= at_least)


def within_size(df: DataFrame, size: Column, limit: int = C.MAX_LINE_LENGTH) -> DataFrame:
    return df.where(size <= limit)


def within_length(df: DataFrame, pack_length: int, compat: bool = False) -> DataFrame:
    """Drop rows whose length before truncation exceeds the pack length.

    ``compat=True`` tests the truncated length instead, which every row passes.
    """
    tested = F.get("seq_lengths", F.lit(0)) if compat else F.col("orig_len")
    return df.where(tested <= pack_length)


def training_columns(df: DataFrame) -> DataFrame:
    return df.select("instance_id", "messages", "patch", "model", "verified")


def cap_per_key(df: DataFrame, order: list[str], cap: int = C.MAX_ROWS_PER_KEY, key: str = "instance_id", rank: str | None = None) -> DataFrame:
    """The first ``cap`` rows of each key.

    ``row_number <= cap`` lets Spark limit each group before the shuffle, so a hot key
    sends at most ``cap`` rows per map task.
    """
    name = rank or "_rank"
    window = Window.partitionBy(key).orderBy(*order)
    kept = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= cap)
    return kept if rank else kept.drop(name)


def without_evaluated(df: DataFrame, evaluated: DataFrame, key: str = "instance_id") -> DataFrame:
    """Training rows whose instance is not evaluated.  Null-safe: a null key stays unless null is evaluated."""
    seen = evaluated.select(F.col(key).alias("_seen")).distinct()
    return df.join(seen, df[key].eqNullSafe(seen["_seen"]), "left_anti")


def text_hash(text: Column) -> Column:
    """A digest that ignores case and white space."""
    return F.md5(F.lower(F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))).cast("binary"))


def without_test_texts(df: DataFrame, tests: DataFrame, text: str, test_text: str = "text") -> DataFrame:
    """Rows whose whole text is not that of a test item; rows without a text stay."""
    seen = tests.where(F.col(test_text).isNotNull()).select(text_hash(F.col(test_text)).alias("_seen")).distinct()
    return df.join(seen, text_hash(df[text]) == seen["_seen"], "left_anti")


def uncovered_rows(df: DataFrame, covered: DataFrame, key: str = "instance_id") -> DataFrame:
    """Unverified rows whose key is not covered.

    Null-safe: a null key stays unless null itself is covered.
    """
    covered = covered.select(F.col(key).alias("_covered")).distinct()
    rows = unverified_rows(df)
    return rows.join(covered, rows[key].eqNullSafe(covered["_covered"]), "left_anti")


def build_counters(df: DataFrame, order: list[str], cap: int = C.MAX_ROWS_PER_KEY) -> DataFrame:
    """scanned / verified / written / instances.

    ``written`` needs no ranks: a key with n verified rows writes ``min(n, cap)`` of them.
    """
    per_key = df.groupBy("instance_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce("verified", F.lit(False))).alias("ok")
    )
    return per_key.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n_scanned"),
        F.coalesce(F.sum("ok"), F.lit(0)).alias("n_verified"),
        F.coalesce(F.sum(F.least("ok", F.lit(cap))), F.lit(0)).alias("n_written"),
        F.count_if(F.col("ok") > 0).alias("n_instances"),
    )


def corpus_size(df: DataFrame, size: Column) -> DataFrame:
    # The per-key step keeps the distinct count free of an expanded second aggregation.
    per_key = df.groupBy("instance_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(size.cast("bigint")).alias("chars"))
    return per_key.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("n_chars"),
        F.count(F.lit(1)).alias("n_instances"),
    )


VERIFIED, EXTRA = 0, 1


@dataclass
class Mix:
    """Result of the budget mix.  Everything but ``source`` holds ids, keys and sizes only."""

    source: DataFrame
    verified: DataFrame
    candidates: DataFrame
    eligible: DataFrame
    target: int
    cut: Cut
    cap: int

    def kept(self) -> DataFrame:
        """``row_id, origin, shuffle_key`` of all rows of the mix."""
        first = self.verified.select("row_id", F.lit(VERIFIED).alias("origin"), F.lit(None).cast("string").alias("shuffle_key"))
        return first.unionByName(self._kept_extra())

    def _kept_extra(self) -> DataFrame:
        inside = self.eligible.where(self.cut.covers("_hash", "row_id"))
        return inside.select("row_id", F.lit(EXTRA).alias("origin"), F.col("_hash").alias("shuffle_key"))

    def rows(self) -> DataFrame:
        """Verified rows, then extras; ``origin`` and the order columns keep the sequence."""
        return self.source.join(broadcast_if_small(self.kept()), "row_id")

    def extra(self) -> DataFrame:
        return self.source.join(broadcast_if_small(self._kept_extra()), "row_id")

    def report(self) -> DataFrame:
        """Counters over the candidates that were looked at before the budget was full."""
        seen = self.candidates.where(self.cut.covers("_hash", "row_id"))
        # An oversize row counts as oversize while its key still has room, and as capped
        # after the row that filled the cap.
        full = self.eligible.where(F.col("_rank") == self.cap).select(
            F.col("instance_id").alias("_key"),
            F.struct(F.col("_hash").alias("h"), F.col("row_id").alias("i")).alias("_full_at"),
        )
        big = seen.where(~F.col("fits"))
        big = big.join(full, big["instance_id"].eqNullSafe(full["_key"]), "left")
        at = F.struct(F.col("_hash").alias("h"), F.col("row_id").alias("i"))
        oversize = big.agg(F.count_if(F.col("_full_at").isNull() | (at < F.col("_full_at"))).alias("n_oversize"))
        total = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("c"))
        extra = total(self.eligible.where(self.cut.covers("_hash", "row_id")))
        return (
            total(self.verified)
            .select(
                F.col("n").alias("verified_rows"),
                F.col("c").alias("verified_chars"),
                F.lit(self.target).cast("bigint").alias("target_chars"),
                extra.select(F.struct("n", "c")).scalar().alias("_extra"),
                seen.agg(F.count(F.lit(1))).scalar().alias("_seen"),
                oversize.scalar().alias("n_oversize"),
            )
            .select(
                "verified_rows",
                "verified_chars",
                "target_chars",
                F.col("_extra.n").alias("extra_rows"),
                F.col("_extra.c").alias("extra_chars"),
                "n_oversize",
                (F.col("_seen") - F.col("_extra.n") - F.col("n_oversize")).alias("n_capped"),
                (F.col("verified_rows") + F.col("_extra.n")).alias("final_rows"),
                (F.col("verified_chars") + F.col("_extra.c")).alias("final_chars"),
                F.round(F.col("_extra.c") / F.greatest("verified_chars", F.lit(1)) * 100, 6).alias("extra_pct"),
            )
        )


def mix_under_budget(
    df: DataFrame,
    order: list[str],
    size: str,
    fraction: tuple[int, int] = C.EXTRA_FRACTION,
    max_size: int = C.MAX_LINE_LENGTH,
    seed: int = C.MIX_SEED,
    cap: int = C.MAX_ROWS_PER_KEY,
) -> Mix:
    """Verified rows plus unverified rows of uncovered instances, up to a share of the text.

    The walk over shuffled candidates keeps a row if it fits the size limit, its key has
    room, and the text kept so far is below the target.  As sets: rank among the fitting
    rows of the key at most ``cap``, and exclusive running total below the target.

    ``df`` has a unique ``row_id``, ``instance_id``, ``verified`` and the size column.  Wide
    rows are read twice: once for ids and sizes, once to take the rows of the mix.
    """
    others = [c for c in order if c != "row_id"]
    narrow = scratch.materialize(
        df.select("row_id", "instance_id", "verified", F.col(size).cast("bigint").alias("size"), *others), "mix-rows"
    )
    verified = cap_per_key(verified_rows(narrow), order, cap)
    chars = F.coalesce(F.sum("size"), F.lit(0))
    target = verified.agg(budget(chars, fraction).alias("target")).first()["target"]

    candidates = uncovered_rows(narrow, verified_rows(narrow)).select(
        "row_id",
        "instance_id",
        "size",
        (F.col("size") <= max_size).alias("fits"),
        seed_hash(seed, "row_id").alias("_hash"),
    )
    by_seed = ["_hash", "row_id"]
    eligible = scratch.materialize(cap_per_key(candidates.where("fits"), by_seed, cap, rank="_rank"), "mix-eligible")
    cut = find_cut(eligible, F.col("size"), target, "_hash", "row_id")
    return Mix(df, verified, candidates, eligible, target, cut, cap)
