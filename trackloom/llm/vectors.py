"""Integer vectors made of arrays of numbers, as the operators on embeddings take them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of a unit.
STEPS = 256
#: Size from which on a component is out of range: its square, times some thousand dimensions, would pass a long.
MOST = float(1 << 18)


def usable(vec: str, most: float = MOST) -> Column:
    """Whether a vector is there and has only finite components, of less than ``most`` in size."""
    fits = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < most)
    return F.coalesce(F.forall(vec, fits), F.lit(False)) & (F.size(vec) > 0)


def steps(vec: str, per_unit: int = STEPS) -> Column:
    """Each component as a whole number of steps, rounded down."""
    return F.transform(vec, lambda c: F.floor(per_unit * c.cast("double")))


def integer_vectors(df: DataFrame, vec_col: str, out: str = "x", most: float = MOST) -> DataFrame:
    """``df`` with ``vec_col`` as whole numbers in ``out``.

    Rows take no part whose vector is null or empty, has a component that is null, not
    finite or out of range, or has another length than most vectors have (of lengths as
    frequent the longest counts).
    """
    good = df.where(usable(vec_col, most))
    length = good.groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return good.limit(0).withColumn(out, steps(vec_col))
    return good.where(F.size(vec_col) == length["d"]).withColumn(out, steps(vec_col))
