"""Removal of repeated three-line windows across a corpus; DataFrame functions only.

Every three consecutive lines of a text are a window. Windows are hashed (128
bits) and counted over all documents; of a window that occurs more than once the
first occurrence in order of (id, text, line) stays and every later one is
covered. Covered positions of a text are merged into intervals, and the lines in
them go. A removed line equals the line in the same place of an earlier
occurrence, so each line keeps a copy somewhere.

* Lines are what "\\n" separates, compared as they are; windows without any
  character but white space don't count. Texts of one or two lines have no window
  and stay as they are. Null texts stay null with 0 lines.
* Rows equal in id and text are one document and share one result. Null ids sort
  after all others.
* Occurrences in one text may overlap: of four or more equal lines in a row the
  first stays.
* Extra columns stay; an output column of a name that exists replaces it.

The windows are hashed twice, once to find the repeated ones and once to look
them up, rather than kept: a window is far larger than its hash. The table of
repeated windows is written to the shared folder, so the look-up joins two plain
scans and adaptive execution can split windows that are in very many documents.
Text moves once, in the last join, with the few bytes of its covered intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import SPACES, row_key, stage_table

SPAN = 3


def _windows(df: DataFrame, id_col: str, text_col: str, span: int) -> DataFrame:
    """A row for each window: its hash, its document's key and id, and its first line's position."""

    def window(lines: Column, i: Column) -> Column:
        own = [F.get(lines, i + k) for k in range(span)]
        filled = F.greatest(*[F.length(F.btrim(x, F.lit(SPACES))) for x in own]) > 0
        return F.struct(i.cast("int").alias("at"), F.xxhash64(*own).alias("h1"), F.xxhash64(F.lit(span), *own[::-1]).alias("h2"), filled.alias("filled"))

    lines = df.select(F.col(id_col).alias("_id"), *row_key(id_col, text_col), F.split(F.col(text_col), "\n", -1).alias("lines")).where(F.size("lines") >= span)
    each = lines.select("_id", "_k1", "_k2", F.explode(F.transform(F.sequence(F.lit(0), F.size("lines") - span), lambda i: window(F.col("lines"), i))).alias("w"))
    return each.where("w.filled").select("_id", "_k1", "_k2", "w.at", "w.h1", "w.h2")


def covered_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """Per document key (_k1, _k2) the sorted first lines (``starts``) of its windows that occurred before."""
    windows = _windows(df, id_col, text_col, span)
    order = F.struct(F.col("_id").isNull().alias("last"), F.col("_id").alias("id"), F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), F.col("at").alias("at"))
    repeated = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).where("n > 1")
    repeated = stage_table(repeated.select("h1", "h2", F.col("first.k1").alias("f1"), F.col("first.k2").alias("f2"), F.col("first.at").alias("f_at")), "repeated-windows")
    later = windows.join(repeated, ["h1", "h2"]).where((F.col("_k1") != F.col("f1")) | (F.col("_k2") != F.col("f2")) | (F.col("at") != F.col("f_at")))
    return later.groupBy("_k1", "_k2").agg(F.sort_array(F.collect_set("at")).alias("starts"))


def merged(starts: Column, span: int) -> Column:
    """Intervals (start, end exclusive) of the lines that windows beginning at ``starts`` (sorted) cover; touching ones are one."""
    heads = F.filter(starts, lambda s, i: (i == 0) | (s > F.get(starts, i - 1) + span))
    tails = F.filter(starts, lambda s, i: (i == F.size(starts) - 1) | (F.get(starts, i + 1) > s + span))
    return F.zip_with(heads, tails, lambda s, e: F.struct(s.alias("start"), (e + span).alias("end")))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """``df`` with the covered lines taken out of ``text_col``, and three columns more: n_lines (before), n_removed, removed (intervals of lines)."""
    names = ["n_lines", "n_removed", "removed"]
    kept_cols = [c for c in df.columns if c not in names]
    keyed = df.select(*kept_cols, *row_key(id_col, text_col))
    covered = covered_windows(df.select(id_col, text_col), id_col, text_col, span)
    joined = keyed.join(covered, ["_k1", "_k2"], "left")
    found = joined.withColumn("removed", F.when(F.col("starts").isNotNull(), merged(F.col("starts"), span)))
    lines = found.withColumn("_lines", F.split(F.col(text_col), "\n", -1))
    n = F.coalesce(F.size("_lines"), F.lit(0))
    gaps = F.transform(
        F.sequence(F.lit(0), F.size("removed")),
        lambda i: F.struct(F.coalesce(F.get("removed", i - 1)["end"], F.lit(0)).alias("a"), F.coalesce(F.get("removed", i)["start"], F.size("_lines")).alias("b")),
    )
    stay = F.flatten(F.transform(gaps, lambda g: F.slice("_lines", g["a"] + 1, F.greatest(g["b"] - g["a"], F.lit(0)))))
    gone = F.aggregate("removed", F.lit(0), lambda s, x: s + x["end"] - x["start"])
    return lines.select(
        *[F.when(F.col("removed").isNull(), F.col(c)).otherwise(F.array_join(stay, "\n")).alias(c) if c == text_col else F.col(c) for c in kept_cols],
        F.when(F.col(text_col).isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
        F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<struct<start:int,end:int>>")).alias("removed"),
    )
