"""Text forms of points, lists and times, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(hex16: Column) -> Column:
    """The double whose 16 hex digits, highest byte first, are given; NaN and infinities become null."""
    high = F.conv(F.substring(hex16, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(hex16, 9, 8), 16, 10).cast("long")
    sign = F.when(high >= 2**31, -1.0).otherwise(1.0)
    power = F.floor(high / 2**20) % 2048
    part = ((high % 2**20).cast("double") * float(2**32) + low.cast("double")) / float(2**52)
    normal = (1 + part) * F.pow(F.lit(2.0), power - 1023)
    tiny = part * F.pow(F.lit(2.0), F.lit(-1022.0))
    return sign * F.when(power == 2047, None).when(power == 0, tiny).otherwise(normal)


def _reversed(hex16: Column) -> Column:
    return F.concat(*[F.substring(hex16, k, 2) for k in range(15, 0, -2)])


def wkb_point(hexed: Column) -> Column:
    """Struct x, y of a point in hexadecimal well-known binary of either byte order; null for anything else."""
    low = F.lower(hexed)
    little = F.substring(low, 1, 2) == "01"
    kind = F.when(little, F.substring(low, 3, 8) == "01000000").otherwise(F.substring(low, 3, 8) == "00000001")
    x, y = F.substring(low, 11, 16), F.substring(low, 27, 16)
    return F.when(kind & (F.length(low) == 42), F.struct(_double(F.when(little, _reversed(x)).otherwise(x)).alias("x"), _double(F.when(little, _reversed(y)).otherwise(y)).alias("y")))


def numbers(text: Column, kind: str = "double", sep: str = ",") -> Column:
    """An array from a list in text; empty text is an empty array."""
    return F.when(F.trim(text) == "", F.array().cast(f"array<{kind}>")).otherwise(F.transform(F.split(text, sep), lambda x: F.trim(x).cast(kind)))


def listed(values: Column, sep: str = ",") -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), sep)


def leading_time(text: Column) -> Column:
    """The timestamp in the first 19 characters."""
    return F.to_timestamp_ntz(F.substring(text, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))


def seconds_of_day(micros: Column) -> Column:
    """Whole seconds of a difference, wrapped to one day as a duration's seconds part is."""
    return F.pmod(F.floor(micros / 1_000_000), F.lit(86_400)).cast("long")


def box_name(south, west, north, east) -> Column:
    """A folder name from a box, decimals cut off."""
    return F.concat_ws("_", *[F.floor(x).cast("long").cast("string") for x in (south, west, north, east)])
