"""Number and time expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def whole_div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def budget(total: Column, fraction: tuple[int, int]) -> Column:
    """``floor(total * num / den)`` in integers, so that no engine rounds differently."""
    num, den = fraction
    return whole_div(total.cast("bigint") * num, den)


def percent(part: Column, whole: Column | int) -> Column:
    whole = F.lit(whole) if isinstance(whole, int) else whole
    return part / F.greatest(whole, F.lit(1)) * 100


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, never below 0."""
    seconds = F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))
    return F.greatest(F.lit(0), seconds)


def to_bf16(x: Column) -> Column:
    """The nearest bfloat16 of the float of a number, as a float; ties go to the even neighbour.

    A bfloat16 has eight significant bits and the exponents of a float.
    """
    value = x.cast("float").cast("double")
    size = F.abs(value)
    # The logarithm may miss a power of two by one, which the scaled number shows.
    guess = F.greatest(F.floor(F.log2(F.when(size > 0, size))), F.lit(-126))
    unit = F.pow(F.lit(2.0), guess - 7)
    unit = F.when(size / unit >= 256, unit * 2).when((size / unit < 128) & (guess > -126), unit / 2).otherwise(unit)
    plain = (size == 0) | F.isnan(value) | (size == float("inf"))
    return F.when(plain, value).otherwise(F.rint(value / unit) * unit).cast("float")


def log_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))
