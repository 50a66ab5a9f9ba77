"""Quality rules with cross-document line frequency per host; DataFrame functions only.

Base counts come from each text alone. Then every line with a word is normalised
(trimmed, lower-cased, white space runs as one space) and hashed, and the
distinct documents of each host that have it are counted. Lines in more than
``least_docs`` documents and more than ``share`` per cent of those of a host are
boilerplate there and are taken out; a document left with fewer than ``min_left``
per cent of its words is depleted and rejected, as is one that fails the base rules.

* Null texts have no words (and fail); a null host is a host of its own.
* Rows equal in id, text and host are one document and share one result. Copies
  under other ids are documents of their own.
* Extra columns are left out. Empty tables give empty results. Very long texts
  are counted whole.

Counting is partial before each shuffle, on (host, line, document) first, so neither
a hot host nor a hot line gathers in one task. Boilerplate lines, at most one in
``least_docs`` of all lines, are written to the shared folder and broadcast only
while they are few (``lookup_side``); beyond, a shuffled join of two plain scans
takes over, which adaptive execution can split.

Repeated word triples are found inside each row. Most texts repeat none, which the
number of distinct hashes tells. In the others hashes of the triples with their
position in the low bits are sorted as plain longs, and neighbours with equal
high bits are the same triple if their words are. A text in which neighbours of
equal high bits differ in words is settled by all 64 bits of the hashes instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import SPACE_CLASS, SPACES, lookup_side, row_key, stage_table

#: A line is boilerplate in more documents of a host than this, and than so many per cent of them.
LEAST_DOCS, SHARE = 3, 5
#: How many per cent of a document's words must be left.
MIN_LEFT = 80
#: Bits for a position: texts of as many words or more take a slower way.
POSITION_BITS = 21


def _words(text: Column) -> Column:
    """Words of a text: what white space separates."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+", -1))


def _same(words: str, p: Column, q: Column) -> Column:
    return (F.get(words, p) == F.get(words, q)) & (F.get(words, p + 1) == F.get(words, q + 1)) & (F.get(words, p + 2) == F.get(words, q + 2))


def base_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text; write it before filtering by them."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    keep = [c for c in df.columns if c not in names]
    mask = (1 << POSITION_BITS) - 1
    triple = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    starts = F.sequence(F.lit(0), F.size("_words") - 3)
    few = F.size("_words") < 3
    many = F.size("_words") > mask

    # only texts with fewer distinct hashes than triples repeat one
    one = df.withColumn("_words", _words(F.col(text_col)))
    one = one.withColumn("_hashes", F.when(~few, F.transform(starts, triple)))
    one = one.withColumn("_hashes", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.col("_hashes")))
    few = F.col("_hashes").isNull()
    # positions in the low bits: sorting the longs brings equal triples together
    one = one.withColumn("_fast", F.when(~few & ~many, F.sort_array(F.transform("_hashes", lambda h, i: h.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))))))
    high = lambda x: x.bitwiseAND(F.lit(~mask))
    low = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")
    alike = lambda x, y: F.coalesce(high(x) == high(y), F.lit(False))

    # what is left has a neighbour with the same high bits; such neighbours of different words are a clash, which all 64 bits settle
    two = one.withColumn("_near", F.filter("_fast", lambda x, i: alike(x, F.get("_fast", i - 1)) | alike(x, F.get("_fast", i + 1))))
    clash = F.size(F.filter("_near", lambda x, i: alike(x, F.get("_near", i - 1)) & ~_same("_words", low(x), low(F.get("_near", i - 1))))) > 0
    two = two.withColumn("_plain", ~few & ~many & ~clash)
    two = two.withColumn("_slow", F.when(~few & ~F.col("_plain"), F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("p"))))))
    fast = F.when(F.col("_plain"), F.transform("_near", low))
    slow = F.transform(F.filter("_slow", lambda x, i: F.coalesce(x["h"] == F.get("_slow", i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("_slow", i + 1)["h"], F.lit(False))), lambda x: x["p"].cast("int"))
    three = two.withColumn("_at", F.sort_array(F.coalesce(fast, slow, F.array().cast("array<int>"))))
    repeated = F.aggregate(F.transform("_at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_at", i + 1) - p, F.lit(3)))), F.lit(0), lambda s, x: s + x)
    filled = three.withColumn("_lines", F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    return filled.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "[#*$%&|<>]", -1)) - 1).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
    )


def _host_lines(df: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """A row for each line with a word: host, the document's key, the line's place and words, and the normalised line by two hashes."""
    lines = df.select(_host(host_col), "_k1", "_k2", F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("_at", "_raw"))
    line = F.lower(F.regexp_replace(F.btrim("_raw", F.lit(SPACES)), SPACE_CLASS + "+", " "))
    shaped = lines.select("_host", "_k1", "_k2", "_at", line.alias("_line")).where("_line != ''")
    n = F.length("_line") - F.length(F.replace(F.col("_line"), F.lit(" "), F.lit(""))) + 1
    return shaped.select("_host", "_k1", "_k2", "_at", F.xxhash64("_line").alias("_h1"), F.xxhash64(F.lit(1), F.reverse("_line")).alias("_h2"), n.cast("long").alias("_n"))


def _host(host_col: str) -> Column:
    return F.coalesce(F.col(host_col).cast("string"), F.lit("\x00")).alias("_host")


def boilerplate(df: DataFrame, text_col: str = "text", host_col: str = "source", least_docs: int = LEAST_DOCS, share: int = SHARE) -> DataFrame:
    """(_host, _h1, _h2) of the lines in too many documents of their host; ``df`` has document keys _k1 and _k2."""
    once = _host_lines(df, text_col, host_col).select("_host", "_h1", "_h2", "_k1", "_k2").distinct()
    often = once.groupBy("_host", "_h1", "_h2").agg(F.count(F.lit(1)).alias("_docs")).where(F.col("_docs") > least_docs)
    often = stage_table(often, "frequent-lines")
    hosts = stage_table(df.select(_host(host_col), "_k1", "_k2").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_all")), "hosts")
    return often.join(lookup_side(hosts), "_host").where(100 * F.col("_docs") > share * F.col("_all")).select("_host", "_h1", "_h2")


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", least_docs: int = LEAST_DOCS, share: int = SHARE, min_left: int = MIN_LEFT) -> DataFrame:
    """One row per row of ``df``: the id, the base counts, n_boilerplate_words, base_failed and kept."""
    own = df.select(F.col(id_col), F.col(text_col).alias("_text"), F.col(host_col).alias("_source"), *row_key(id_col, text_col, host_col))
    common = stage_table(boilerplate(own, "_text", "_source", least_docs, share), "boilerplate")
    hits = _host_lines(own, "_text", "_source").join(lookup_side(common), ["_host", "_h1", "_h2"])
    placed = hits.groupBy("_k1", "_k2", "_at").agg(F.max("_n").alias("_n"))  # equal rows have equal lines
    gone = placed.groupBy("_k1", "_k2").agg(F.sum("_n").alias("_gone"))
    # written, as conditions on the counts would be pushed into the expressions that make them, which grow beyond use by that
    counts = stage_table(base_counts(own, "_text").drop("_text", "_source"), "counts")
    joined = counts.join(gone, ["_k1", "_k2"], "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("_gone", F.lit(0))
    return joined.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.coalesce("_gone", F.lit(0)).alias("n_boilerplate_words"), failed.alias("base_failed"), (~failed & (100 * left >= min_left * F.col("n_words"))).alias("kept"))
