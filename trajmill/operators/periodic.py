"""Texts that fall into repeating a short pattern.

A run of period ``p`` is a stretch in which every character equals the one ``p`` places on.  So a
text is compared with itself shifted by each period, and the stretches are read off the
places where the two differ: work and memory are linear in the text, whatever it repeats.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

PERIODS = (2, 20)
REPEATS = 10
_RUN = "period int, run_start int, run_length int"


def longest_run(text: str, periods: tuple[int, int] = PERIODS, repeats: int = REPEATS) -> tuple[int, int, int] | None:
    """``(period, start, length)`` of the longest run with at least ``repeats`` repeats, in characters.

    Of equally long runs the one with the least period counts, then the first.  A stretch of
    one character has period 1 and is none of these.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    best = None
    for period in range(periods[0], periods[1] + 1):
        if len(codes) < period * repeats:
            break
        differ = np.flatnonzero(codes[period:] != codes[:-period])
        starts = np.append(0, differ + 1)
        lengths = np.append(differ, len(codes) - period) - starts + period
        for at in np.flatnonzero(lengths >= period * repeats).tolist():
            start, length = int(starts[at]), int(lengths[at])
            if (best is None or length > best[2]) and (codes[start : start + period] != codes[start]).any():
                best = (period, start, length)
    return best


def periodic_texts(rows: DataFrame, text: str, periods: tuple[int, int] = PERIODS, repeats: int = REPEATS) -> DataFrame:
    """Adds ``period, run_start, run_length`` of the longest periodic run (null without one) and its share of the text.

    Only the text goes to Python.  A null or empty text has no run.
    """

    @F.pandas_udf(_RUN)
    def find(texts: pd.Series) -> pd.DataFrame:
        runs = [longest_run(t or "", periods, repeats) or (None, None, None) for t in texts]
        return pd.DataFrame(runs, columns=["period", "run_start", "run_length"], dtype="Int32")

    found = rows.withColumn("_run", find(F.col(text)))
    return found.select(*rows.columns, "_run.*").withColumn("run_share", F.coalesce(F.col("run_length") / F.char_length(text), F.lit(0.0)))
