"""Running totals and neighbours inside one long key, without one task per key.

A key may hold a third of all rows.  Rows are cut into blocks of consecutive positions;
the window runs per (key, block), and a table with one row per block carries totals and
edge values from block to block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trajmill.functions.numbers import whole_div

BLOCK_ROWS = 4096


def in_key_context(
    df: DataFrame,
    key: str,
    position: str,
    sums: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
    block_rows: int = BLOCK_ROWS,
    keep_block: bool = False,
) -> DataFrame:
    """Add inclusive running sums, values of the previous row and values of the next row.

    ``position`` is a whole number that orders the rows of a key and is unique there.  With
    ``keep_block`` the block number stays in the column ``_block``, and a second call on the
    result finds its rows already distributed.
    """
    sums, previous, following = sums or {}, previous or {}, following or {}
    values = {f"_s_{n}": c for n, c in sums.items()}
    values |= {f"_p_{n}": c for n, c in previous.items()}
    values |= {f"_f_{n}": c for n, c in following.items()}
    if "_block" not in df.columns:
        df = df.withColumn("_block", whole_div(F.col(position).cast("bigint"), block_rows))
    rows = df.select("*", *[c.alias(n) for n, c in values.items()])

    edges = rows.groupBy(key, "_block").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(f"_s_{n}").alias(f"_s_{n}") for n in sums],
        *[F.max_by(f"_p_{n}", position).alias(f"_p_{n}") for n in previous],
        *[F.min_by(f"_f_{n}", position).alias(f"_f_{n}") for n in following],
    )
    by_block = Window.partitionBy(key).orderBy("_block")
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        key,
        "_block",
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_cs_{n}") for n in sums],
        *[F.lag(f"_p_{n}").over(by_block).alias(f"_cp_{n}") for n in previous],
        *[F.lead(f"_f_{n}").over(by_block).alias(f"_cf_{n}") for n in following],
    )

    inside = Window.partitionBy(key, "_block").orderBy(position)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    # A neighbour may be null itself, so the first and last row of a block are told by rank.
    first = F.row_number().over(inside) == 1
    last = F.lead(F.lit(True)).over(inside).isNull()
    local = rows.select(
        "*",
        first.alias("_first"),
        last.alias("_last"),
        *[F.sum(f"_s_{n}").over(upto).alias(f"_ls_{n}") for n in sums],
        *[F.lag(f"_p_{n}").over(inside).alias(f"_lp_{n}") for n in previous],
        *[F.lead(f"_f_{n}").over(inside).alias(f"_lf_{n}") for n in following],
    )
    # Null keys are a key as well, and null positions a block.
    carried = carried.withColumnsRenamed({key: "_key", "_block": "_of"})
    joined = local.join(carried, local[key].eqNullSafe(carried["_key"]) & local["_block"].eqNullSafe(carried["_of"]))
    return joined.select(
        *[F.col(c) for c in df.columns if keep_block or c != "_block"],
        *[(F.col(f"_cs_{n}") + F.col(f"_ls_{n}")).alias(n) for n in sums],
        *[F.when(F.col("_first"), F.col(f"_cp_{n}")).otherwise(F.col(f"_lp_{n}")).alias(n) for n in previous],
        *[F.when(F.col("_last"), F.col(f"_cf_{n}")).otherwise(F.col(f"_lf_{n}")).alias(n) for n in following],
    )
