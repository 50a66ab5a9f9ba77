"""The next row of each row in the order of an integer id, without one task that sees all rows.

Ids are dealt to buckets of equal width, some ``ROWS`` rows each on average. Rows of a
bucket lie in one task, where a window finds the next row; the first rows of a bucket go
to the bucket before it as well, and the very first to the last. Whole rows are shuffled
once. From the ids alone come width, firsts and the bucket before each, the latter by two
levels of windows.

The order is by id, null ids last, then by a hash of the row's tie columns; rows equal in
all of these may follow each other in any order. Buckets of null ids are made by that
hash, so they are as small as others. All rows that share an id are in one bucket: ids
are meant to be keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import lookup_side, stage_table

#: Rows of a bucket on average, and buckets that a task of the upper level sees.
ROWS, BUCKETS = 256, 4096


def with_next(df: DataFrame, id_col: str, tie: tuple[str, ...], following: dict[str, str], prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``df`` with, for each of ``following``, the next row's column under the name given; the last row is followed by the first.

    ``prepare`` adds columns once rows are where they stay, which saves shuffling them.
    """
    known = df.agg(F.count(F.lit(1)).alias("all"), F.count(id_col).alias("n"), F.min(id_col).alias("least"), F.max(id_col).alias("most")).first()
    if known["all"] == 0:
        return prepare(df).withColumns({new: F.col(old) for old, new in following.items()})
    least, width = known["least"] or 0, 1
    if known["n"]:
        width = max(1, (known["most"] - least + 1) * ROWS // known["n"])
    idless = known["all"] - known["n"]
    top = ((known["most"] or 0) - least) // width + 1  # the first bucket of null ids
    wide = max(1, (1 << 64) * ROWS // max(1, idless))
    hashed = F.xxhash64(*tie)
    number = lambda c: c.cast("decimal(38,0)")
    part = lambda v, by: F.floor(v / F.lit(str(by)).cast("decimal(38,0)")).cast("bigint")
    bucket: Column = part(number(F.col(id_col)) - F.lit(str(least)).cast("decimal(38,0)"), width)
    place: Column = F.col(id_col).cast("bigint")
    if idless:  # reads the tie columns here
        bucket = F.coalesce(bucket, top + part(number(hashed) + F.lit(str(1 << 63)).cast("decimal(38,0)"), wide))
        place = F.coalesce(place, hashed)
    keyed = df.withColumns({"_bucket": bucket, "_place": place})

    firsts = stage_table(keyed.groupBy("_bucket").agg(F.min("_place").alias("_first")).withColumn("_upper", F.floor(F.col("_bucket") / BUCKETS)), "bucket-firsts")
    inside = firsts.withColumn("_before", F.lag("_bucket").over(Window.partitionBy("_upper").orderBy("_bucket")))
    # one row for some million rows of the table
    lasts = firsts.groupBy("_upper").agg(F.max("_bucket").alias("_last"))
    lasts = lasts.withColumn("_last_before", F.lag("_last").over(Window.orderBy("_upper"))).select("_upper", "_last_before")
    end = firsts.agg(F.max("_bucket").alias("m")).first()["m"]
    before = stage_table(inside.join(lookup_side(stage_table(lasts, "upper-lasts")), "_upper").select("_bucket", F.col("_first").alias("_place"), F.coalesce("_before", "_last_before", F.lit(end)).alias("_before"), F.coalesce("_before", "_last_before").isNull().alias("_wraps")), "bucket-order")

    marked = keyed.join(lookup_side(before), ["_bucket", "_place"], "left")
    copies = F.when(F.col("_before").isNull(), F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("k")))).otherwise(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("k")), F.struct(F.col("_before").alias("b"), F.when(F.col("_wraps"), 2).otherwise(1).alias("k"))))
    dealt = marked.withColumn("_c", F.explode(copies)).select(*df.columns, F.col("_c.b").alias("_bucket"), F.col("_c.k").alias("_kind"))
    ready = prepare(dealt.repartition("_bucket"))
    # what came from the bucket after stands last, what came round from the first behind it
    order = Window.partitionBy("_bucket").orderBy("_kind", F.col(id_col).asc_nulls_last(), hashed)
    return ready.withColumns({new: F.lead(old).over(order) for old, new in following.items()}).where("_kind = 0").drop("_bucket", "_kind")
