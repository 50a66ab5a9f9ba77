"""Near copies by exact similarity of word shingles, beside the fingerprints of ``simhash``.

Two texts are near copies if the sets of their five-word shingles (as ``simhash``
cuts words) have a Jaccard similarity of ``SIMILARITY`` or more, or if their
fingerprints are linked. The anchor covering finds all links of fingerprints; all
similar pairs are found by prefix filtering:

* the shingles of a text have a fixed order, those common in a sample of the texts
  last, then by hash. Of n shingles the first n - ceil(t n) + 1 are its prefix,
  and two texts of similarity t share one in both prefixes. The order bears on the
  cost alone;
* of the texts that share a shingle each is held against the one of the smallest
  node, its head, unless lengths and places of the shingle rule similarity out. A
  text's most frequent head comes first, and others only if they aren't connected then;
* parities of the shingles in slots bound from below in how many shingles two sets
  differ, and pairs whose bound is too high go; what is left, few but similar
  pairs, is compared by whole sets of shingles;
* texts that share a shingle and aren't connected by then are compared with each
  other in blocks: what a task is given are rows of texts, not of pairs. By places and
  parities a first pass tells which texts may have a partner in their cell (two blocks
  of a shingle's texts); a second one compares their whole sets and gives only links that
  join components, fewer than the cell has texts. Shingles of the same texts are one.
  Blocks are bounded by bytes, so a large group is dealt to many tasks; only the
  comparisons of texts that stay unconnected are as many as their pairs.

No pair is left out by size of text or group; so components are those of all
links. Shingles and sets of them are known by 64-bit hashes. Null and empty texts
have no shingle and are linked by fingerprint only; texts of fewer words than a
shingle are one shingle. Rows equal in id and text are one document, of which one
row stays; extra columns stay; empty tables give empty results. Very long texts
are shingled whole; only their table of parities is bounded, by ``MOST_BITS``.

No shingle sets or links reach the driver, but the common shingles of the sample,
``COMMON`` at most, and rows to look up while they are few (``lookup_side``). Tables of
nodes, sets and pairs are joined by shuffles, also where the planner takes them for small. Prefixes are shuffled once, by shingle. A shingle that isn't
common in the sample is in few texts, so its texts meet in one task; the texts of
common ones are told the smallest node by a broadcast of at most ``COMMON`` rows and
don't meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from trackloom.llm import simhash
from trackloom.llm.common import held, keep_one, lookup_side, row_key, shuffled, small_batches, stage_table

WORDS = 5
SIMILARITY = 0.8
#: For the order: texts sampled, at least and as one of so many; the least of them that make a shingle common; common shingles kept.
SAMPLE, SAMPLE_ONE_IN, LEAST, COMMON = 10_000, 4, 4, 100_000
#: Bits of parities: a power of two of at least twice the size of a set, within these.
LEAST_BITS, MOST_BITS = 64, 1 << 16
#: A shingle's place in the low bits of a long, the size of its set above.
PLACE = 1 << 31
#: Bytes of parities in a block of texts that share a shingle; pairs compared at once.
BLOCK_BYTES, PAIRS = 1 << 18, 1 << 14
CELL = ("token", "i", "j")


def shingles(text: str | None, words: int = WORDS, seed: int = simhash.SEED) -> np.ndarray:
    """The distinct hashes of the shingles, sorted."""
    w = (text or "").encode().translate(simhash.LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([digest(b" ".join(w), seed)], np.uint64)
    return np.unique(np.fromiter((digest(b" ".join(g), seed) for g in zip(*(w[k:] for k in range(words)), strict=False)), np.uint64, len(w) - words + 1))


def prefix(own: np.ndarray, common: np.ndarray, often: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, int]:
    """The first shingles of a set, and how many of them aren't common; ``often`` says how late each of ``common``, which is sorted, comes."""
    n = len(own)
    if not n:
        return own, 0
    # the small amount keeps rounding from shortening a prefix
    most = n - math.ceil(similarity * n - 1e-9) + 1
    if not len(common):
        return own[:most], most
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    level = np.where(common[at] == own, often[at], 0)
    rare = int((level == 0).sum())
    order = np.flatnonzero(level == 0) if rare >= most else np.lexsort((own, level))
    return own[order[:most]], min(rare, most)


def parities(own: np.ndarray) -> bytes:
    """Of each slot whether an odd number of the set's shingles falls in it."""
    bits = LEAST_BITS
    while bits < min(2 * len(own), MOST_BITS):
        bits *= 2
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def apart(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """In how many shingles the sets of each two rows of parities differ, at least."""
    out = np.zeros(len(a), np.int64)
    kinds: dict[tuple[int, int], list[int]] = {}
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        kinds.setdefault((len(x), len(y)), []).append(k)
    for (m, n), rows in kinds.items():
        sides = []
        for parts, size in ((a, m), (b, n)):
            x = np.frombuffer(b"".join(parts[k] for k in rows), np.uint64).reshape(len(rows), -1)
            while size > min(m, n):  # the halves of a longer table make one of half its bits
                size //= 2
                x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
            sides.append(x)
        out[rows] = np.bitwise_count(sides[0] ^ sides[1]).sum(axis=1, dtype=np.int64)
    return out


def with_shingles(df: DataFrame, text_col: str, out: str = "shingles", words: int = WORDS) -> DataFrame:
    small_batches(df.sparkSession)

    @arrow_udf("array<long>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([shingles(t, words).view(np.int64) for t in texts.to_pylist()], pa.list_(pa.int64()))

    return df.withColumn(out, cut(F.col(text_col)))


def common_shingles(df: DataFrame, text_col: str, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample have, sorted, and the logarithm of their number."""
    n = df.count()
    most = max(SAMPLE, n // SAMPLE_ONE_IN)
    drawn = df if n <= most else df.where(F.pmod(F.xxhash64("_k1", F.lit("sample")), F.lit(1 << 30)) < most / n * (1 << 30))
    counts = with_shingles(drawn.select(text_col), text_col, "s", words).select(F.explode("s").alias("s")).groupBy("s").count().where(F.col("count") >= LEAST)
    got = counts.orderBy(F.desc("count"), "s").limit(COMMON).toArrow()
    found = got["s"].to_numpy().view(np.uint64)
    order = np.argsort(found)
    return found[order], np.log2(got["count"].to_numpy().astype(np.float64)).astype(np.int64)[order]


def marks(df: DataFrame, text_col: str, words: int, similarity: float) -> DataFrame:
    """``df`` with the fingerprint of each text, its node (the hash of its set), the size of the set, its prefix, how many of that aren't common, and its parities."""
    names = ["fingerprint", "node", "size", "rare", "prefix", "parities"]
    sent = df.sparkSession.sparkContext.broadcast(common_shingles(df, text_col, words))
    small_batches(df.sparkSession)

    @arrow_udf("fingerprint long, node long, size int, rare int, prefix array<long>, parities binary")
    def marked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held("near copies", lambda: None)
        common, often = sent.value
        for texts in batches:
            rows = texts.to_pylist()
            sets = [shingles(t, words) for t in rows]
            print_ = np.array([simhash.fingerprint(t) for t in rows], np.uint64).view(np.int64)
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), simhash.SEED) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            first = [prefix(s, common, often, similarity) for s in sets]
            cols = [pa.array(print_), pa.array(node), pa.array([len(s) for s in sets], pa.int32()), pa.array([r for _, r in first], pa.int32())]
            yield pa.StructArray.from_arrays([*cols, pa.array([p.view(np.int64) for p, _ in first], pa.list_(pa.int64())), pa.array([parities(s) for s in sets], pa.binary())], names=names)

    return df.withColumn("_m", marked(F.col(text_col))).select(*df.columns, *[F.col(f"_m.{n}").alias(n) for n in names])


def shared_shingles(sets: DataFrame) -> DataFrame:
    """A row for each text of a shingle in several prefixes, but the text of the smallest node: token, node, place, and the smallest's as head, head_place.

    ``sets`` has each node once or, where rows are repeated, a few times.
    """
    sets = sets.where("size > 0").select("node", "rare", (F.col("size").cast("long") * PLACE).alias("_size"), "prefix")
    own = sets.select("node", "_size", F.posexplode(F.slice("prefix", F.lit(1), F.col("rare"))).alias("_at", "token")).select("token", "node", (F.col("_size") + F.col("_at")).alias("place"))
    w = Window.partitionBy("token").orderBy("node")
    met = own.withColumns({"head": F.first("node").over(w), "head_place": F.first("place").over(w), "_before": F.lag("node").over(w)})
    few = met.where((F.col("node") != F.col("head")) & (F.col("node") != F.col("_before"))).drop("_before")

    late = sets.where(F.size("prefix") > F.col("rare")).select("node", "rare", "_size", F.posexplode(F.slice("prefix", F.col("rare") + 1, F.size("prefix"))).alias("_at", "token")).select("token", "node", (F.col("_size") + F.col("rare") + F.col("_at")).alias("place"))
    heads = late.groupBy("token").agg(F.min("node").alias("head"), F.min_by("place", "node").alias("head_place"))
    many = late.join(F.broadcast(heads), "token").where("node <> head").distinct()  # COMMON heads at most
    return few.unionByName(many.select(few.columns))


def _may(p: str, q: str, similarity: float) -> Column:
    """Whether sets that share the shingles at two places of their order can be similar: those shared are before both or after both."""
    n, m = (F.expr(f"{c} div {PLACE}") for c in (p, q))
    i, j = (F.expr(f"{c} % {PLACE}") for c in (p, q))
    shared = F.least(i, j) + F.least(n - i, m - j)
    return shared >= similarity * (n + m - shared) - 1e-9


def _whole(need: DataFrame, owners: DataFrame, keyed: DataFrame, text_col: str, words: int) -> DataFrame:
    """The whole set, s, of each node that ``need`` has."""
    one = stage_table(owners.join(shuffled(need), "node", "left_semi"), "asked")
    texts = keyed.select("_k1", "_k2", text_col).join(lookup_side(one), ["_k1", "_k2"])
    return stage_table(with_shingles(texts.select("node", text_col), text_col, "s", words).select("node", "s").dropDuplicates(["node"]), "shingle-sets")


def _similar(pairs: DataFrame, sets: DataFrame, owners: DataFrame, keyed: DataFrame, text_col: str, words: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose whole sets are similar."""

    @arrow_udf("long")
    def least(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            yield pa.array(apart(a.to_pylist(), b.to_pylist()))

    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = sets.join(shuffled(asked), "node", "left_semi").groupBy("node").agg(F.first("size").alias("n"), F.first("parities").alias("p"))
    for side in ("a", "b"):
        pairs = pairs.join(shuffled(known.withColumnsRenamed({"node": side, "n": f"n{side}", "p": f"p{side}"})), side)
    # similar sets differ in at most (1 - t) / (1 + t) of their sizes' sum
    pairs = pairs.where(least("pa", "pb") <= (1 - similarity) / (1 + similarity) * (F.col("na") + F.col("nb")) + 1e-9).select("a", "b")
    pairs = stage_table(pairs, "bounded-pairs")

    whole = _whole(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), owners, keyed, text_col, words)
    both = pairs.join(shuffled(whole.select(F.col("node").alias("a"), F.col("s").alias("sa"))), "a").join(shuffled(whole.select(F.col("node").alias("b"), F.col("s").alias("sb"))), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared / (F.size("sa") + F.size("sb") - shared) >= similarity).select("a", "b")


def each_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one cell after the other; rows come sorted by cell."""
    open_: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in CELL], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for at, end in zip(cuts, cuts[1:], strict=False):
            key = tuple(keys[at])
            if open_ and key != last:
                yield pa.concat_batches(open_)
                open_ = []
            open_.append(batch.slice(at, end - at))
            last = key
    if open_:
        yield pa.concat_batches(open_)


def may_meet(right: np.ndarray, place: np.ndarray, root: np.ndarray, parts: list[bytes], similarity: float) -> np.ndarray:
    """Which rows of a cell have a partner on the other side, of another root, that places and parities don't rule out."""
    size, at, hit = place // PLACE, place % PLACE, np.zeros(len(place), bool)
    width, pos = np.array([len(p) for p in parts]), np.zeros(len(parts), np.int64)
    full, half = {}, {}
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        pos[rows] = np.arange(len(rows))
        x = full[w] = np.frombuffer(b"".join(parts[k] for k in rows), np.uint64).reshape(len(rows), -1)
        half[w] = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :] if x.shape[1] > 1 else x
    a, b = np.flatnonzero(~right), np.flatnonzero(right)
    step = max(1, PAIRS // max(1, len(b)))
    for k in range(0, len(a), step):
        x, y = a[k : k + step, None], b[None, :]
        shared = np.minimum(at[x], at[y]) + np.minimum((size - at)[x], (size - at)[y])
        i, j = np.nonzero((root[x] != root[y]) & (shared >= similarity * (size[x] + size[y] - shared) - 1e-9))
        x, y = a[k + i], b[j]
        # sizes alike enough have tables of one width, or of twice the width
        for v in np.unique(width[x]):
            for w in (v // 2, v, 2 * v):
                own = np.flatnonzero((width[x] == v) & (width[y] == w))
                if len(own):
                    p, q = x[own], y[own]
                    differ = np.bitwise_count((half if v > w else full)[v][pos[p]] ^ (half if w > v else full)[w][pos[q]]).sum(axis=1, dtype=np.int64)
                    ok = differ <= (1 - similarity) / (1 + similarity) * (size[p] + size[q]) + 1e-9
                    hit[p[ok]] = hit[q[ok]] = True
    return hit


def joining_links(right: np.ndarray, root: np.ndarray, sizes: np.ndarray, flat: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Rows of a cell that are similar across its sides, of all such pairs as many as join the roots that any of them join."""
    _, label = np.unique(root, return_inverse=True)
    b = np.flatnonzero(right)
    starts = np.cumsum(sizes) - sizes
    values, own = np.unique(flat, return_inverse=True)
    inside = np.concatenate([own[starts[k] : starts[k] + sizes[k]] for k in b]) if len(b) else own[:0]
    first = np.cumsum(sizes[b]) - sizes[b]
    marked, out = np.zeros(len(values), np.int64), []
    for a in np.flatnonzero(~right) if len(b) else ():
        if (label[b] == label[a]).all():
            continue
        mine = own[starts[a] : starts[a] + sizes[a]]
        marked[mine] = 1
        shared = np.add.reduceat(marked[inside], first)
        marked[mine] = 0
        found = b[(shared / (sizes[a] + sizes[b] - shared) >= similarity) & (label[b] != label[a])]
        parts, at = np.unique(label[found], return_index=True)
        out += [(int(a), int(c)) for c in found[at]]
        label[np.isin(label, parts)] = label[a]
    return out


def _met_in_cells(shared: DataFrame, roots: DataFrame, sets: DataFrame, owners: DataFrame, keyed: DataFrame, text_col: str, words: int, similarity: float) -> DataFrame:
    """Links (a, b) that join what similar texts of one shingle are still apart; each has been held against the shingle's head."""
    often = shared.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("token")
    parts = stage_table(shared.join(shuffled(often), "token", "left_semi").select("token", "node", "place").join(shuffled(roots), "node"), "parts")
    size = F.expr(f"place div {PLACE}")
    name = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"_h{k}") for k in (1, 2)]
    kinds = parts.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest(size / 2, F.lit(8)) + 32).alias("bytes"), *name)
    tops = kinds.groupBy("token").agg(F.max(F.struct("n", "root", "bytes")).alias("m"), F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), *[F.bit_xor(h).alias(h) for h in ("_h1", "_h2")]).where("kinds > 1")
    blocks = lambda b: F.ceil(b / BLOCK_BYTES).cast("int")
    tops = tops.select("token", "_h1", "_h2", "n", F.col("m.root").alias("top"), F.greatest(F.lit(1), blocks(F.col("bytes") - F.col("m.bytes"))).alias("_x"), blocks(F.col("bytes")).alias("_y"))
    # of shingles of the same texts one is enough
    once = tops.groupBy("_h1", "_h2", "n").agg(F.min_by(F.struct("token", "top", "_x", "_y"), "token").alias("t")).select("t.*")
    y = stage_table(parts.join(shuffled(stage_table(once, "tops")), "token"), "unconnected")
    block = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    cols = ["node", "place", "root", "token"]
    # those outside the largest part against all
    left = y.where("root <> top").select(*cols, block("_x").alias("i"), F.explode(F.sequence(F.lit(0), F.col("_y") - 1)).alias("j"), F.lit(False).alias("right"))
    right = y.select(*cols, F.explode(F.sequence(F.lit(0), F.col("_x") - 1)).alias("i"), block("_y").alias("j"), F.lit(True).alias("right"))
    known = sets.join(shuffled(y.select("node").distinct()), "node", "left_semi").groupBy("node").agg(F.first("parities").alias("p"))
    small_batches(shared.sparkSession)

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in each_cell(batches):
            side, place, root = (cell.column(c).to_numpy(zero_copy_only=False) for c in ("right", "place", "root"))
            hit = may_meet(side, place, root, cell.column("p").to_pylist(), similarity)
            if hit.any():
                yield cell.select(["node", "root", *CELL, "right"]).filter(pa.array(hit))

    dealt = left.unionByName(right).join(shuffled(known), "node").select("node", "place", "root", *CELL, "right", "p").repartition(*CELL).sortWithinPartitions(*CELL)
    met = stage_table(dealt.mapInArrow(narrowed, "node long, root long, token long, i int, j int, right boolean"), "cells")
    named = met.groupBy(*CELL).agg(*[F.bit_xor(F.xxhash64("node", "right", F.lit(k))).alias(f"_h{k}") for k in (1, 2)], F.count(F.lit(1)).alias("n"))
    once = named.groupBy("_h1", "_h2", "n").agg(F.min(F.struct(*CELL)).alias("c")).select("c.*")
    left = stage_table(met.join(shuffled(once), list(CELL)), "cells")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in each_cell(batches):
            side, node, root = (cell.column(c).to_numpy(zero_copy_only=False) for c in ("right", "node", "root"))
            s = cell.column("s")
            found = joining_links(side, root, s.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), s.flatten().to_numpy(zero_copy_only=False), similarity)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(node[[f[k] for f in found]]) for k in (0, 1)], names=["a", "b"])

    whole = _whole(left.select("node").distinct(), owners, keyed, text_col, words)
    return left.join(shuffled(whole), "node").select("node", "root", *CELL, "right", "s").repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(linked, "a long, b long")


def _joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``roots`` (node, root) of all nodes, after the edges (a, b) have joined what they had as components."""
    for side in ("a", "b"):
        edges = edges.join(shuffled(roots.withColumnsRenamed({"node": side, "root": f"_{side}"})), side)
    new = edges.where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
    moved = simhash.components(stage_table(new, "links")).select(F.col("node").alias("root"), F.col("root").alias("_r"))
    return stage_table(roots.join(lookup_side(moved), "root", "left").select("node", F.coalesce("_r", "root").alias("root")), "roots")


def near_copies(keyed: DataFrame, id_col: str, text_col: str, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``keyed``: the id, _k1, _k2 (see ``row_key``) and the root of its component."""
    marked = stage_table(marks(keyed.select(id_col, text_col, "_k1", "_k2"), text_col, words, similarity).drop(text_col), "marks")
    # equal sets are one node, so what follows holds copies once: in the row of the smallest key
    keys = marked.groupBy("node", "fingerprint").agg(F.min("_k1").alias("_k1"), F.min_by("_k2", F.col("_k1")).alias("_k2"))
    keys = stage_table(keys, "nodes")
    prints = stage_table(keys.groupBy("fingerprint").agg(F.min("node").alias("least")), "classes")
    owners = stage_table(keys.groupBy("node").agg(F.min("_k1").alias("_k1"), F.min_by("_k2", F.col("_k1")).alias("_k2")), "owners")
    sets = stage_table(marked.select("node", "_k1", "_k2", "size", "rare", "prefix", "parities").join(shuffled(owners), ["node", "_k1", "_k2"], "left_semi").drop("_k1", "_k2"), "sets")

    same = keys.join(shuffled(prints), "fingerprint").select(F.col("least").alias("a"), F.col("node").alias("b"))
    near = simhash.links(prints.select("fingerprint"))
    for side in ("a", "b"):
        near = near.join(shuffled(prints.select(F.col("fingerprint").alias(side), F.col("least").alias(f"_{side}"))), side)
    fingers = same.unionByName(near.select(F.col("_a").alias("a"), F.col("_b").alias("b"))).where("a <> b")

    def similar(pairs: DataFrame) -> DataFrame:
        return _similar(pairs, sets, owners, keyed, text_col, words, similarity)

    shared = stage_table(shared_shingles(sets), "shared-shingles")
    stars = stage_table(shared.where(_may("place", "head_place", similarity)).groupBy(F.col("head").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("n")), "pairs")
    # each text is held against the head it shares most with first, and against others only if that leaves them apart
    first = stage_table(stars.groupBy("b").agg(F.max(F.struct("n", "a"))["a"].alias("a")).select("a", "b"), "first-pairs")
    roots = _joined(owners.select("node", F.col("node").alias("root")), fingers.unionByName(similar(first)))
    left = stars.join(shuffled(first), ["a", "b"], "left_anti").select("a", "b")
    for side in ("a", "b"):
        left = left.join(shuffled(roots.withColumnsRenamed({"node": side, "root": f"_{side}"})), side)
    roots = _joined(roots, similar(stage_table(left.where("_a <> _b").select("a", "b"), "pairs")))

    roots = _joined(roots, stage_table(_met_in_cells(shared, roots, sets, owners, keyed, text_col, words, similarity).distinct(), "pairs"))
    return marked.select(id_col, "_k1", "_k2", "node").join(shuffled(roots), "node").select(id_col, "_k1", "_k2", "root")


def without_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``df`` with one row of each component: the one with the smallest id, null ids last; of rows that share it, one (see ``keep_one``).

    Columns of ``df`` must not begin with _k.
    """
    keyed = df.select("*", *row_key(id_col, text_col))
    return keep_one(keyed, near_copies(keyed, id_col, text_col, words, similarity), id_col)
