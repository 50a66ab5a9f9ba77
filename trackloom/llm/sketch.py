"""Bottom-k sketches of texts: the k smallest hashes of their word shingles, by DataFrame functions only.

A sketch is a sorted array of distinct 64-bit hashes (signed) of all shingles of five words
of a whole text; words are what white space separates, a text of fewer words is one shingle,
one without words has an empty sketch. Sketches of parts merge to the sketch of the whole:
the k smallest of all their hashes. Of two sketches, the k smallest hashes of both are a
uniform sample of the distinct shingles of both texts, so

* the share of them that both sketches have estimates the resemblance of the texts (the
  Jaccard similarity of their shingle sets), with a standard error of at most 0.5/sqrt(k),
* k - 1 over the share of hash space that they take up estimates how many distinct shingles
  there are (texts of up to k are counted exactly), and containment follows from both.

Equal texts have equal sketches. Null texts are empty, and two empty ones are alike (1), an
empty and another one not (0). Rows stay as they come, repeated ones too; empty tables give
empty results. Very long texts are sketched whole, an array of a text's hashes at a time.
Columns of the caller stay, but for those named ``out``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import SPACE_CLASS, SPACES

#: Hashes of a sketch and words of a shingle.
K, WORDS = 128, 5
#: Hash values, over two to the 64th.
SPACE = float(1 << 64)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The sketch of each text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    hashes = F.transform(F.split(bare, SPACE_CLASS + "+", -1), lambda w: F.xxhash64(w))
    some = F.transform(F.array(hashes), lambda h: F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - (words - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, words))))[0]
    return F.when(bare == "", F.array().cast("array<bigint>")).otherwise(F.slice(F.sort_array(F.array_distinct(some)), 1, k))


def with_sketch(df: DataFrame, text_col: str = "text", out: str = "sketch", k: int = K, words: int = WORDS) -> DataFrame:
    return df.withColumn(out, sketch(F.col(text_col), k, words))


def merged(df: DataFrame, keys: list[str], col: str = "sketch", k: int = K) -> DataFrame:
    """The sketch of each group: of all its parts together.

    Hashes are made distinct and cut to the k smallest of a group before they are
    shuffled, so a group of any size sends k from each task.
    """
    each = df.select(*keys, F.explode_outer(col).alias("_h")).distinct()
    least = each.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_h").asc_nulls_last()))).where(F.col("_n") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(col))


def union(a: str, b: str, k: int = K) -> Column:
    """The sketch of both texts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct(sketched: Column, k: int = K) -> Column:
    """How many distinct shingles a sketch stands for."""
    taken = (F.get(sketched, F.lit(k - 1)).cast("double") + SPACE / 2 + 1) / SPACE
    return F.when(F.size(sketched) < k, F.size(sketched).cast("double")).otherwise((k - 1) / taken)


def resemblance(a: str, b: str, k: int = K) -> Column:
    """The estimated Jaccard similarity of two sketched texts."""
    both = union(a, b, k)
    common = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, 1.0).otherwise(common / F.size(both))


def containment(a: str, b: str, k: int = K) -> Column:
    """The estimated share of the shingles of ``a`` that ``b`` has too; 1 if ``a`` has none."""
    held = resemblance(a, b, k) * distinct(union(a, b, k), k) / distinct(F.col(a), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), held))


def spelled(col: str) -> Column:
    """A sketch as text: base64 of its hashes, 8 bytes each from the highest on."""
    return F.replace(F.base64(F.unhex(F.array_join(F.transform(col, lambda h: F.lpad(F.hex(h), 16, "0")), ""))), F.lit("\r\n"), F.lit(""))
