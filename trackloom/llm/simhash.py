"""SimHash near-duplicates by anchor-point covering.

A text's fingerprint has a bit set where over half of the hashes of its word
shingles have it set. Equal fingerprints are one class. Classes are linked if
their fingerprints differ in at most two bits; the search for such links uses a
covering code as anchors:

* bits 0-22 and 23-45 are each covered by the perfect binary Golay code of 4096
  words, whose covering radius is 3; an anchor is a pair of code words, so there
  are 2**24 of them;
* every fingerprint is at home at the anchor whose two words are within the
  covering radius of its two parts, exactly one by perfection;
* it is also replicated to every anchor within the covering radius plus the
  threshold: words up to 3 + s and 3 + t away with s + t <= 2, 61 on average
  whatever the number of documents. Whoever is within two bits is among the
  visitors of one's home, so comparing homes with visitors per anchor, on all 64
  bits, finds every link, once.

Components of the link graph are found by rounds of neighbours' minima, hooking
and pointer jumping over tables written to the shared folder; no links,
components or fingerprints reach the driver. A class has at most 2080 links, the
number of fingerprints within two bits.

Null and empty texts have no shingle and fingerprint zero, linked like any other.
Texts of fewer words than a shingle are one shingle. Null ids take part, but a
component's id is the smallest id that isn't null. Repeated rows stay, each with
its component. Extra columns are left out; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from trackloom.llm.common import keep_one, row_key, small_batches, stage_table

SEED = 42
THRESHOLD = 2
#: Fixed value: the Golay code's generator polynomial, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
LENGTH, CHECKS, RADIUS = 23, 11, 3
#: Hashes whose bits are counted at once.
BLOCK = 1 << 15
#: A-Z to a-z in UTF-8, other bytes as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, words: int = 3, seed: int = SEED) -> int:
    """The 64-bit fingerprint, unsigned."""
    if not text:
        return 0
    w = text.encode().translate(LOWER).split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return digest(b" ".join(w), seed)  # over half of one hash is that hash
    ones = np.zeros(64, np.int64)
    n = len(w) - words + 1
    for at in range(0, n, BLOCK):
        part = w[at : at + BLOCK + words - 1]
        h = np.array([digest(b" ".join(g), seed) for g in zip(*(part[k:] for k in range(words)))], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(df: DataFrame, text_col: str = "text", out: str = "fingerprint", words: int = 3) -> DataFrame:
    """``df`` with each whole text's fingerprint as a long (the bits as a signed number)."""
    small_batches(df.sparkSession)

    @arrow_udf("long")
    def marked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint(t, words) for t in texts.to_pylist()], np.uint64).view(np.int64))

    return df.withColumn(out, marked(F.col(text_col)))


def syndrome_bits() -> np.ndarray:
    """Of each of the 23 positions: the remainder of that power of x by the generator."""
    out = []
    for k in range(LENGTH):
        r = 1 << k
        for top in range(LENGTH - 1, CHECKS - 1, -1):
            if r >> top & 1:
                r ^= GOLAY << (top - CHECKS)
        out.append(r)
    return np.array(out, np.int64)


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Syndromes of the lower 12 and upper 11 bits, and by excess over the radius (0, 1, 2) and syndrome the error patterns, padded with -1."""
    bits = syndrome_bits()

    def linear(at: int, width: int) -> np.ndarray:
        t = np.zeros(1, np.int64)
        for k in range(width):
            t = np.concatenate([t, t ^ bits[at + k]])
        return t

    def patterns(weight: int) -> np.ndarray:
        """All words of that weight."""
        p = np.zeros(1, np.int64)
        top = np.full(1, -1, np.int64)
        for _ in range(weight):
            grown = [(p[top < k] | 1 << k, k) for k in range(LENGTH)]
            p = np.concatenate([g for g, _ in grown])
            top = np.concatenate([np.full(len(g), k) for g, k in grown])
        return p

    low, high = linear(0, 12), linear(12, 11)
    levels = []
    for group in ([w for w in range(RADIUS + 1)], [RADIUS + 1], [RADIUS + 2]):
        p = np.concatenate([patterns(w) for w in group])
        s = low[p & 0xFFF] ^ high[p >> 12]
        order = np.argsort(s, kind="stable")
        p, s = p[order], s[order]
        count = np.bincount(s, minlength=1 << CHECKS)
        table = np.full((1 << CHECKS, count.max()), -1, np.int64)
        table[s, np.arange(len(s)) - np.repeat(np.cumsum(count) - count, count)] = p
        levels.append(table)
    return low, high, levels


def anchors(prints: np.ndarray, excess: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``prints``, anchor) of every anchor within the covering radius plus ``excess``."""
    low, high, levels = golay_tables()
    x = prints.view(np.uint64)
    near = []
    for at in (0, LENGTH):
        part = (x >> np.uint64(at)).astype(np.int64) & ((1 << LENGTH) - 1)
        s = low[part & 0xFFF] ^ high[part >> 12]
        # a code word is known by its upper 12 bits
        near.append([np.where(t[s] >= 0, (part[:, None] ^ t[s]) >> CHECKS, -1) for t in levels])
    index, found = [], []
    for s in range(excess + 1):
        for t in range(excess + 1 - s):
            a, b = near[0][s], near[1][t]
            both = np.where((a[:, :, None] >= 0) & (b[:, None, :] >= 0), a[:, :, None] << 12 | b[:, None, :], -1).reshape(len(x), -1)
            i, j = np.nonzero(both >= 0)
            index.append(i)
            found.append(both[i, j])
    return np.concatenate(index), np.concatenate(found)


def _at_anchors(prints: DataFrame, excess: int, name: str) -> DataFrame:
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False)
            i, a = anchors(own, excess)
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(own[i])], names=["anchor", name])

    return prints.mapInArrow(spread, f"anchor int, {name} long")


def links(prints: DataFrame, col: str = "fingerprint", threshold: int = THRESHOLD) -> DataFrame:
    """All pairs (a < b, as signed longs) of the distinct longs in ``col`` that differ in at most ``threshold`` (0 to 2) bits.

    ``prints`` must hold each value once.
    """
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError("the covering is made for a threshold of at most 2")
    own = prints.select(F.col(col).cast("long"))
    home, visit = _at_anchors(own, 0, "a"), _at_anchors(own, threshold, "b")
    # the planner takes the replicas for as few as the fingerprints, and would send them all to the driver to broadcast them
    return home.join(visit.hint("merge"), "anchor").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node of its component.

    Each round reads and writes tables in the shared folder; rounds grow with the
    logarithm of a component's width.
    """
    both = stage_table(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))), "edges")
    parent = stage_table(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("root"), F.lit(True).alias("changed")), "roots")
    while not parent.where("changed").isEmpty():
        state = parent.select("node", "root")
        # the smallest root among the neighbours, of the node itself and of all that share its root
        least = both.join(state.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("root").alias("c")).withColumnRenamed("u", "node")
        met = stage_table(state.join(least, "node"), "met")
        hook = met.groupBy("root").agg(F.min("c").alias("h")).withColumnRenamed("root", "at")
        hooked = met.join(hook, met.node == hook["at"], "left").select("node", "root", F.least("root", "c", F.coalesce("h", "root")).alias("r"))
        jump = state.select(F.col("node").alias("r"), F.col("root").alias("rr"))
        parent = stage_table(hooked.join(jump, "r").select("node", F.least("r", "rr").alias("new"), "root").select("node", F.col("new").alias("root"), (F.col("new") < F.col("root")).alias("changed")), "roots")
    return parent.select("node", "root")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, threshold: int = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``df``: the id, ``carry``, its fingerprint (a long), component_id, the smallest id reachable over links, and root, the component's smallest fingerprint."""
    marked = stage_table(with_fingerprint(df.select(id_col, text_col, *carry), text_col, "fingerprint", words).select(id_col, *carry, "fingerprint"), "fingerprints")
    classes = stage_table(marked.groupBy("fingerprint").agg(F.min(id_col).alias("least")), "classes")
    roots = components(stage_table(links(classes.select("fingerprint"), threshold=threshold), "links"))
    # classes without links are components of their own
    rooted = classes.join(roots, classes.fingerprint == roots.node, "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    linked = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stage_table(rooted.join(linked, "root").select("fingerprint", "component_id", "root"), "components")
    return marked.join(named, "fingerprint").select(id_col, *carry, "fingerprint", "component_id", "root")


def without_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, threshold: int = THRESHOLD) -> DataFrame:
    """``df`` with one row of each component: the one with the smallest id, null ids last; of rows that share it, one.

    Columns of ``df`` must not begin with _k.
    """
    keyed = df.select("*", *row_key(id_col, text_col))
    return keep_one(keyed, near_duplicates(keyed, id_col, text_col, words, threshold, ("_k1", "_k2")), id_col)
