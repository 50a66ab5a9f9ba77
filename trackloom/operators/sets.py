"""Ordering, distinctness, sampling and numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: Knuth's multiplier.
SCATTER = 2654435761


def scattered(col: str, seed: int = 0) -> Column:
    """A number below 2**32 that looks random, from a whole number; plain arithmetic, so other engines can repeat it."""
    return F.pmod((F.col(col) + F.lit(seed)) * F.lit(SCATTER), F.lit(1 << 32))


def sample(df: DataFrame, col: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement, by a seeded hash of ``col``, which must be unique; the same rows every time."""
    return df.withColumn("_h", scattered(col, seed)).orderBy("_h", col).limit(n).drop("_h")


def share_of(df: DataFrame, col: str, share: float, seed: int = 0) -> DataFrame:
    """About a share of the rows, by a seeded hash; no order, no shuffle."""
    return df.where(scattered(col, seed) < int(share * (1 << 32)))


def one_direction(df: DataFrame, source: str = "source", target: str = "target", tie: str = "edge_id") -> DataFrame:
    """Of edges between the same two nodes, whatever the direction, the one with the smallest id."""
    cols = df.columns
    own = df.groupBy(F.least(source, target).alias("_a"), F.greatest(source, target).alias("_b")).agg(F.min_by(F.struct(*cols), tie).alias("_r"))
    return own.select(*[F.col(f"_r.{c}").alias(c) for c in cols])


def chunked(df: DataFrame, order: list[str], n: int, out: str = "chunk") -> DataFrame:
    """Numbers 0 to n - 1 of equal stretches in an order, by range partitions rather than one sorted task."""
    return df.repartitionByRange(n, *order).withColumn(out, F.spark_partition_id())


def split_evenly(df: DataFrame, order: list[str], n: int, group: str, out: str = "chunk") -> DataFrame:
    """Within each group, the number of the stretch a row falls in, when its rows in order are cut into ``n`` of sizes that differ by one at most."""
    return df.withColumn(out, F.ntile(n).over(W.partitionBy(group).orderBy(*order)) - 1)


def top(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
