"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch: with whole documents in them, batches stay a few megabytes.
ARROW_ROWS = 512

#: Rows of a table that is broadcast, of some 40 bytes at most.
BROADCAST_ROWS = 200_000

#: White space as the corpus contracts define it: space and \x09-\x0D, nothing else.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, since one row is a whole document."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A folder of this machine is used only where the session names none, as in
    tests on a local master.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    kept = getattr(spark, "_trackloom_shared", None)
    if kept is None:
        kept = "file://" + tempfile.mkdtemp(prefix="trackloom-")
        spark._trackloom_shared = kept
    return kept


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/trackloom/{label}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    Cuts lineage: what reads the result survives the loss of any executor, and
    joins on it start from plain scans, so adaptive execution can split hot keys.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(*cols: str) -> list[Column]:
    """128 bits that name a row by the columns given; rows equal in all of them are one document."""
    own = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols]
    return [F.xxhash64(*own).alias("_k1"), F.xxhash64(*own[::-1], F.lit("#"), own[0]).alias("_k2")]


def lookup_side(df: DataFrame) -> DataFrame:
    """``df``, a written table of a few numbers a row, marked for broadcast if it has few rows; beyond, joins with it are shuffled."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, a table that grows with the documents, marked so that joins with it are shuffled.

    The planner goes by the size of files, several times less than what a broadcast takes in the driver.
    """
    return df.hint("merge")


def keep_one(keyed: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """Of ``keyed``, with row keys _k1 and _k2, one row of each group, without the keys.

    ``found`` has the id, _k1, _k2 and root, its group, of every row. The row with
    the smallest id stays, null ids last, then the smallest key; of rows equal in key the
    one whose columns (but maps) hash to the smallest number. Text moves only where rows
    to leave out, or kept ones that occur again, are too many to broadcast.
    """
    keys = stage_table(found.groupBy("_k1", "_k2").agg(F.first("root").alias("root"), F.first(id_col).alias("_i"), F.count(F.lit(1)).alias("_n")), "keys")
    first = keys.groupBy("root").agg(F.min(F.struct(F.col("_i").isNull().alias("last"), "_i", "_k1", "_k2")).alias("m"))
    kept = first.select(F.col("m._k1").alias("_k1"), F.col("m._k2").alias("_k2"), F.lit(True).alias("_kept"))
    judged = stage_table(keys.join(shuffled(kept), ["_k1", "_k2"], "left").where("_kept IS NULL OR _n > 1").select("_k1", "_k2", F.col("_kept").isNotNull().alias("_again")), "set-apart")
    cols = [F.col(f"`{c}`") for c in keyed.columns if c not in ("_k1", "_k2")]
    once = keyed.join(lookup_side(judged), ["_k1", "_k2"], "left_anti").select(*cols)
    again = judged.where("_again")
    if again.isEmpty():
        return once
    plain = [F.col(f"`{f.name}`") for f in keyed.schema.fields if not f.dataType.simpleString().count("map<")]
    rows = keyed.join(lookup_side(again.select("_k1", "_k2")), ["_k1", "_k2"]).withColumn("_h", F.xxhash64(*plain))
    least = rows.groupBy("_k1", "_k2").agg(F.min("_h").alias("_h"))
    return once.unionByName(rows.join(shuffled(least), ["_k1", "_k2", "_h"]).dropDuplicates(["_k1", "_k2"]).select(*cols))


def crc_fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(folds)


_HELD: dict = {}


def held(key, make: Callable):
    """``make()``, made once in a Python worker and kept for its next tasks.

    Workers go from one operator to the next, so what was kept under another key goes.
    """
    if key not in _HELD:
        _HELD.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # gives freed memory back where the C library can
            ctypes.CDLL(None).malloc_trim(0)
        _HELD[key] = make()
    return _HELD[key]


class TwoAges:
    """A bounded memo: when the young part is full it becomes the old one.

    Entries that are asked for again move to the young part, so frequent keys
    stay while at most ``2 * limit`` entries are held.
    """

    __slots__ = ("limit", "old", "young")

    def __init__(self, limit: int):
        self.limit = limit
        self.young: dict = {}
        self.old: dict = {}

    def put(self, key, value) -> None:
        if len(self.young) >= self.limit:
            self.old = self.young
            self.young = {}
        self.young[key] = value
