"""Hard negatives by exact maximum inner product search over k-means inverted lists.

The index deals every vector to the nearest of its centroids, which k-means finds on a
bounded sample, and stores the radius of each list: the largest distance of a member from
the centroid c. For an anchor a and any member x, by Cauchy and Schwarz,

    a.c - |a| radius  <=  a.x  <=  a.c + |a| radius.

A search visits lists by that upper bound. The first few go first; what they give bounds
the k-th score from below, and of the other lists those are visited whose upper bound isn't
strictly below it (equal scores may win by their id) and, where scores must lie in a window,
whose bounds meet the window. So results are exact whatever the index is like.

1. Positives of an anchor: its highest other rows of the same label.
2. Negatives of an anchor and a positive of score s: the highest rows of another label
   whose score is between ``low`` and ``high`` per cent of s.

Higher scores come first, ties by smaller id, null ids last. Scores are whole numbers:
products run in 32- or 64-bit floats where the largest norm shows that they are exact there,
and in Python's own whole numbers beyond.

* "Other rows" have another id than the anchor. Repeated rows each count; repeated anchors
  (equal in id, label and vector) are one. Null ids take part but for anchors.
* Rows with a null label, or a vector that ``vectors.integer_vectors`` refuses, take no part.
* Fewer rows than asked for: all there are. Empty tables, and tables of one label, give
  no rows. Extra columns are left out.

Lists are split into blocks of bounded rows and anchors into parts, so a task never holds
more than a block and a part, whatever the sizes of lists and however many anchors visit
one. To the driver come centroids, radii and sizes, at most ``MOST_LISTS`` of each. The
k best of each anchor are cut to k before the shuffle, too (a limit of the window).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.llm.common import stage_table

#: Rows that the centroids are fitted on, at most.
SAMPLE = 50_000
#: Lists at most; else as many as the root of the number of rows.
MOST_LISTS = 4096
#: Rows of a block and anchors of a part at most.
BLOCK, PART = 4096, 8192
#: Lists that an anchor visits before its other bounds count.
FIRST = 8
#: Scores computed at once.
CELLS = 1 << 20
ROUNDS, SEED = 8, 11
#: Stands for a null id, last among equals.
NO_ID = (1 << 63) - 1


@dataclass
class Index:
    """Lists as a table (block, id, label, x) and what is known of them: centroids, radii and the numbers of their blocks."""

    rows: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    first_block: np.ndarray
    blocks: np.ndarray
    dtype: object


def _exact(norm2: int):
    """The fastest type in which sums of products up to ``norm2`` are exact."""
    return np.float32 if norm2 <= 1 << 24 else np.float64 if norm2 <= 1 << 48 else object  # keys of score and place, too, fit a long up to there


def _matrix(column: pd.Series, dtype) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(dtype)


def build(rows: DataFrame, lists: int | None = None, sample: int = SAMPLE, seed: int = SEED) -> Index | None:
    """The index of a written table (id, label, x) without nulls; None for an empty one."""
    norm2 = F.aggregate("x", F.lit(0).cast("decimal(38,0)"), lambda s, v: (s + v.cast("decimal(19,0)") * v.cast("decimal(19,0)")).cast("decimal(38,0)"))
    n, most = rows.select(F.count(F.lit(1)), F.max(norm2)).first()
    if n == 0:
        return None
    lists = lists or max(1, min(MOST_LISTS, round(n**0.5)))
    points = rows.select(array_to_vector(F.transform("x", lambda v: v.cast("double"))).alias("v"))
    few = points.sample(min(1.0, 1.2 * sample / n), seed).limit(sample) if n > sample else points
    model = KMeans(k=lists, featuresCol="v", initMode="random", maxIter=ROUNDS, seed=seed).fit(few) if lists > 1 else None
    centres = np.array(model.clusterCenters()) if model else np.zeros((1, len(rows.select("x").first()["x"])))
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = sent.value
        half = (c * c).sum(axis=1) / 2
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf["x"], np.float64)
                at = np.concatenate([(x[k : k + 1024] @ c.T - half).argmax(axis=1) for k in range(0, len(x), 1024)])
                yield pdf.assign(list=at.astype(np.int32), far=np.sqrt(((x - c[at]) ** 2).sum(axis=1)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    dealt = stage_table(rows.mapInPandas(deal, f"{fields}, list int, far double"), "inverted-lists")
    known = {r["list"]: r for r in dealt.groupBy("list").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()}
    radii = np.array([known[k]["far"] if k in known else -np.inf for k in range(len(centres))])
    size = np.array([known[k]["n"] if k in known else 0 for k in range(len(centres))])
    blocks = -(-size // max(1, min(BLOCK, 2 * n // len(centres))))
    first = np.cumsum(blocks) - blocks
    where = rows.sparkSession.createDataFrame([(k, int(first[k]), int(blocks[k])) for k in known], "list int, first int, blocks int")
    # at most MOST_LISTS rows
    placed = dealt.join(F.broadcast(where), "list").select((F.col("first") + F.pmod(F.xxhash64("id", "x"), "blocks")).cast("int").alias("block"), "id", "label", "x")
    return Index(placed, centres, radii, first, blocks, _exact(int(most)))


def _best(keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` highest keys above -1 of each row."""
    if k < keys.shape[1]:
        cols = np.argpartition(keys, keys.shape[1] - k, axis=1)[:, -k:]
    else:
        cols = np.broadcast_to(np.arange(keys.shape[1]), keys.shape)
    i, j = np.nonzero(np.take_along_axis(keys, cols, axis=1) >= 0)
    return i, cols[i, j]


def _visits(index: Index, anchors: DataFrame, first: bool) -> DataFrame:
    """A row for each anchor and block to visit now; anchors have lo and hi, the windows they ask for, and least, the k-th scores they have so far."""
    sent = anchors.sparkSession.sparkContext.broadcast((index.centres, index.radii, index.first_block, index.blocks))

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, radii, start, count = sent.value
        there = np.flatnonzero(count > 0)
        for pdf in batches:
            found = []
            for x, lo, hi, least in zip(pdf["x"], pdf["lo"], pdf["hi"], pdf["least"], strict=True):
                a = np.asarray(x, np.float64)
                mid, span = centres[there] @ a, np.sqrt(a @ a) * radii[there]
                slack = 1e-9 * (np.abs(mid) + span + 1)
                top, low = mid + span + slack, mid - span - slack
                lo, hi, least = (np.asarray(v, np.float64)[:, None] for v in (lo, hi, least))
                meets = (top >= lo) & (low <= hi)
                reach = np.where(meets, np.minimum(top, hi), -np.inf)
                order = np.argsort(-reach.max(axis=0), kind="stable")
                early = np.zeros(len(there), bool)
                early[order[:FIRST]] = True
                go = meets.any(axis=0) & early if first else (meets & (reach >= least)).any(axis=0) & ~early
                found.append(np.concatenate([np.arange(start[c], start[c] + count[c]) for c in there[go]] or [np.zeros(0, np.int64)]))
            yield pdf.assign(visited=found)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in anchors.schema)
    return anchors.mapInPandas(bound, f"{fields}, visited array<int>").withColumn("block", F.explode("visited")).drop("visited", "least")


def _scored(index: Index, visits: DataFrame, parts: int, k: int, same: bool) -> DataFrame:
    """The ``k`` best of each anchor, window and visited block: rows of the anchor's label or of others, inside the window."""
    dtype = index.dtype

    def score(own: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(rows):
            ids = rows["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, labels = ids[order], rows["label"].to_numpy()[order]
            x = _matrix(rows["x"], dtype)[order].T
            n = len(ids)
            per = max(1, CELLS // n)
            for at in range(0, len(own), per):
                some = own.iloc[at : at + per]
                scores = _matrix(some["x"], dtype) @ x
                fits = some["label"].to_numpy()[:, None] == labels
                fits = fits & (some["anchor_id"].to_numpy()[:, None] != ids) if same else ~fits
                lo, hi = np.stack(some["lo"].to_numpy()), np.stack(some["hi"].to_numpy())
                for slot in range(lo.shape[1]):
                    inside = fits & ((scores >= lo[:, slot, None]) & (scores <= hi[:, slot, None])).astype(bool)
                    # higher scores first, then smaller ids: a key of both, from 0 on
                    whole = scores if dtype is object else scores.astype(np.int64)
                    keys = np.where(inside, (whole - whole.min()) * n + np.arange(n - 1, -1, -1), -1)
                    i, j = _best(keys, k)
                    out.append(pd.DataFrame({"anchor_id": some["anchor_id"].to_numpy()[i], "key": some["key"].to_numpy()[i], "slot": np.int32(slot), "id": ids[j], "score": scores[i, j].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"anchor_id": [], "key": [], "slot": [], "id": [], "score": []})

    # a block goes to each part of the anchors
    rows = index.rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    grouped = visits.groupBy("block", "part").cogroup(rows.groupBy("block", "part"))
    return grouped.applyInPandas(score, "anchor_id bigint, key bigint, slot int, id bigint, score bigint")


def search(index: Index, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """The ``k`` best rows of each anchor and window: (anchor_id, key, slot, id, score, rank).

    ``anchors``, a written table, has anchor_id, key, label, x and the windows as arrays lo and hi;
    a row's slot is the place of its window. ``same``: rows of the anchor's label, else of the others.
    """
    parts = max(1, -(-anchors.count() // PART))
    asked = anchors.withColumn("part", F.pmod("key", F.lit(parts)).cast("int"))
    rank = F.row_number().over(Window.partitionBy("anchor_id", "key", "slot").orderBy(F.desc("score"), "id"))
    cut = lambda df: df.withColumn("rank", rank).where(F.col("rank") <= k)
    none = F.transform("lo", lambda v: F.lit(-NO_ID - 1))
    early = stage_table(cut(_scored(index, _visits(index, asked.withColumn("least", none), True), parts, k, same)).drop("rank"), "first-visits")
    # the k-th score of each window that has so many
    full = early.groupBy("anchor_id", "key", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).where(F.col("n") == k)
    known = full.groupBy("anchor_id", "key").agg(F.map_from_entries(F.collect_list(F.struct("slot", "s"))).alias("m"))  # a window is in once
    bounded = asked.join(known, ["anchor_id", "key"], "left").withColumn("least", F.transform("lo", lambda v, i: F.coalesce(F.try_element_at("m", i), F.lit(-NO_ID - 1)))).drop("m")
    late = _scored(index, _visits(index, bounded, False), parts, k, same)
    return cut(early.unionByName(late))


def mine(rows: DataFrame, anchor: F.Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, lists: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows (id, label, x) that ``anchor`` holds for.

    ``low`` and ``high`` are whole per cent of the positive's score.
    """
    own = stage_table(rows.where("label IS NOT NULL").select(F.coalesce(F.col("id").cast("bigint"), F.lit(NO_ID)).alias("id"), "label", "x"), "vectors")
    index = build(own, lists)
    if index is None:
        return own.sparkSession.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    keyed = own.where((F.col("id") < NO_ID) & anchor).select(F.col("id").alias("anchor_id"), F.xxhash64("id", "label", "x").alias("key"), "label", "x").dropDuplicates(["anchor_id", "key"])
    keyed = stage_table(keyed, "anchors")
    every = keyed.withColumns({"lo": F.array(F.lit(-NO_ID)), "hi": F.array(F.lit(NO_ID))})
    best = stage_table(search(index, every, positives, True).select("anchor_id", "key", "rank", "id", "score"), "positives")
    # windows in whole numbers: low*s <= 100*t <= high*s; a row for each anchor, with so many windows at most
    windows = best.groupBy("anchor_id", "key").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("p"))
    share = lambda p, cent: p["score"].cast("decimal(19,0)") * F.lit(cent).cast("decimal(5,0)") / F.lit(100).cast("decimal(3,0)")
    edges = {"lo": F.transform("p", lambda p: F.ceil(share(p, low)).cast("bigint")), "hi": F.transform("p", lambda p: F.floor(share(p, high)).cast("bigint"))}
    asked = stage_table(keyed.join(windows, ["anchor_id", "key"]).withColumns(edges), "windows")
    found = search(index, asked.drop("p"), negatives, False)
    shown = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    named = best.withColumn("slot", F.col("rank") - 1).select("anchor_id", "key", "slot", shown("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(named, ["anchor_id", "key", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), shown("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
