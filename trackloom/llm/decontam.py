"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of ten consecutive words of the benchmark's items
(an item of fewer words, but not none, is one window). Patterns of one length m
share a table: the shift of a block of two words says how far the search may
move on from a place that ends with this block, m - 1 for blocks of no pattern
(blocks are hashed to ``SHIFTS`` bytes, the least shift of a byte counts); blocks
with shift 0 lead to a bucket, keyed by a hash of the suffix and the first word,
whose patterns are compared with the text directly. Most words are skipped.
Patterns are places in the words of the items, so they take little memory.

Words are runs of digits, letters a-z after lower-casing A-Z, and all characters
from U+0080 on. Every word inside an occurrence is hit.

* Null and empty texts have no words. Items with a null text have no windows;
  items with a null id hit words but aren't counted. Repeated items count once.
* Repeated rows each get their result; extra columns stay; an output column of a
  name that exists replaces it.

Items are cut into pieces of ``PIECE`` words that overlap by a window less a word,
so they may be of any length; documents may, too, and are searched whole. The
benchmark's size is summed first. It is searched in blocks of about ``BLOCK_CHARS``
characters, one pass over the documents for each, so what is broadcast at a time
is bounded whatever the benchmark's size. A Python worker makes the tables of a
block once.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from trackloom.llm.common import held, row_key, small_batches, stage_table

WINDOW = 10
#: Characters of benchmark text that are searched for in one pass, and words of a piece of an item.
BLOCK_CHARS, PIECE = 2_000_000, 5_000
#: Bytes of a shift table, a power of two.
SHIFTS = 1 << 22
#: UTF-8 bytes: A-Z lower-cased, other ASCII than digits and letters a space.
FOLD = bytes((b | 32) if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

SHAPE = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


def pair_key(last: bytes, first: bytes) -> int:
    return zlib.crc32(first, zlib.crc32(last))


class WuManber:
    """Search for patterns of one length: those that begin at some places of a list of words, each with the number of its item."""

    def __init__(self, words: list[bytes], starts: list[tuple[int, int]], m: int):
        self.words, self.m = words, m
        self.block = min(2, m)
        self.shift = bytearray([min(m - self.block + 1, 255)]) * SHIFTS
        self.bucket: dict[int, tuple[tuple[int, int], ...]] = {}
        for at, item in starts:
            for end in range(self.block, m + 1):
                key = pair_key(words[at + end - 1], words[at + end - self.block]) & SHIFTS - 1
                self.shift[key] = min(self.shift[key], m - end)
            key = pair_key(words[at + m - 1], words[at])
            self.bucket[key] = (*self.bucket.get(key, ()), (at, item))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(first word, item) of each occurrence, in order of places."""
        m, n, own, bucket, shift, back, mask, crc = self.m, len(words), self.words, self.bucket, self.shift, self.block - 1, SHIFTS - 1, zlib.crc32
        i = m - 1
        while i < n:
            s = shift[crc(words[i - back], crc(words[i])) & mask]
            if s:
                i += s
                continue
            at = i - m + 1
            for start, item in bucket.get(crc(words[at], crc(words[i])), ()):
                if words[at : i + 1] == own[start : start + m]:
                    yield at, item
            i += 1


class Benchmark:
    """The windows of some items, ready for search."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.names = [n for n, _ in items]
        words: list[bytes] = []
        known: dict[bytes, bytes] = {}  # one object for each word
        by_size: dict[int, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(items):
            w = [known.setdefault(x, x) for x in words_of(text)]
            m = min(window, len(w))
            if m:
                by_size.setdefault(m, []).extend((len(words) + i, k) for i in range(len(w) - m + 1))
            words += w
        self.tables = [WuManber(words, starts, m) for m, starts in sorted(by_size.items())]

    def find(self, text: str | None) -> tuple[int, list[dict], list[str]]:
        """Number of words, merged spans of hit words, and the items with occurring windows."""
        words = words_of(text)
        spans, items = [], set()
        for t in self.tables:
            for at, item in t.search(words):
                spans.append((at, at + t.m))
                items.add(self.names[item])
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        return len(words), [{"start": a, "end": b} for a, b in merged], sorted(items - {None})


def pieces(text: str | None, window: int, size: int = PIECE) -> list[str]:
    """A text, or if it has more than ``size`` words stretches of so many that hold every window."""
    words = words_of(text)
    if len(words) <= size:
        return [text or ""]
    return [b" ".join(words[k : k + size]).decode() for k in range(0, len(words) - window + 1, size - window + 1)]


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[str | None, str | None]]]:
    """The pieces of the items, each once, a bounded block at a time; at least one block, which may be empty."""

    @arrow_udf("array<string>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([pieces(t, window, max(PIECE, 2 * window)) for t in texts.to_pylist()], pa.list_(pa.string()))

    small_batches(benchmark.sparkSession)
    own = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    own = stage_table(own.select("i", F.explode(cut("t")).alias("t")).distinct(), "benchmark")
    total = own.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    if total <= block_chars:
        yield [(r.i, r.t) for r in own.collect()]
        return
    n = -(-2 * total // block_chars)  # blocks by hash come out uneven
    for k in range(n):
        yield [(r.i, r.t) for r in own.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()]


def _found(df: DataFrame, text_col: str, items: list, window: int, out: str) -> DataFrame:
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast((items, window))
    name = uuid.uuid4().hex
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])

    @arrow_udf(SHAPE)
    def searched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = held(name, lambda: Benchmark(*sent.value))
        for texts in batches:
            got = [own.find(t) for t in texts.to_pylist()]
            yield pa.array([{"n_words": n, "spans": s, "items": i} for n, s, i in got], kind)

    return df.withColumn(out, searched(F.col(text_col)))


def find_benchmark(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``df`` with n_words, n_hit, spans (merged, in words, end exclusive) and items (sorted ids)."""
    names = ["n_words", "n_hit", "spans", "items"]
    keep = [c for c in df.columns if c not in names]
    blocks = benchmark_blocks(benchmark, item_id, item_text, window, block_chars)
    first, second = next(blocks), next(blocks, None)
    hit = F.aggregate("_f.spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    if second is None:
        got = _found(df.select(*keep), text_col, first, window, "_f")
        return got.select(*keep, F.col("_f.n_words").alias("n_words"), hit.alias("n_hit"), F.col("_f.spans").alias("spans"), F.col("_f.items").alias("items"))
    # what each block finds is written, a small table, and put together by document
    keyed = df.select(*keep, *row_key(id_col, text_col))
    slim = keyed.select("_k1", "_k2", F.col(text_col).alias("_text"))
    parts = None
    for k, block in enumerate([first, second]):
        parts = _part(parts, slim, block, window, k)
    for k, block in enumerate(blocks, 2):
        parts = _part(parts, slim, block, window, k)
    hit_words = F.array_sort(F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_set("spans")), lambda x: F.sequence(x["start"], x["end"] - 1)))))
    each = parts.groupBy("_k1", "_k2").agg(F.max("n_words").alias("n_words"), hit_words.alias("w"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    heads = F.filter("w", lambda x, i: (i == 0) | (x > F.get("w", i - 1) + 1))
    tails = F.filter("w", lambda x, i: (i == F.size("w") - 1) | (F.get("w", i + 1) > x + 1))
    spans = F.zip_with(heads, tails, lambda s, e: F.struct(s.alias("start"), (e + 1).alias("end")))
    whole = each.select("_k1", "_k2", "n_words", spans.alias("spans"), "items")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return keyed.join(whole, ["_k1", "_k2"]).select(*keep, "n_words", n_hit.alias("n_hit"), "spans", "items")


def _part(parts: DataFrame | None, slim: DataFrame, block: list, window: int, k: int) -> DataFrame:
    own = stage_table(_found(slim, "_text", block, window, "_f").select("_k1", "_k2", "_f.n_words", "_f.spans", "_f.items"), f"benchmark-{k}")
    return own if parts is None else parts.unionByName(own)
