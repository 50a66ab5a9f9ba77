"""Equi-joins of the road map, and spatial joins by grid cells."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a prefix of an order, to begin with, and pairs among them that one task takes.
HEAD, FEW_PAIRS = 20_000, 2_000_000


def with_ends(edges: DataFrame, nodes: DataFrame, node_id: str, cols: list[str], source: str = "source", target: str = "target") -> DataFrame:
    """``edges`` with ``cols`` of both end nodes, suffixed 1 and 2; edges without a node at both ends go."""
    out = edges
    for k, key in ((1, source), (2, target)):
        side = nodes.select(F.col(node_id).alias(f"_n{k}"), *[F.col(c).alias(f"{c}{k}") for c in cols])
        out = out.join(side, out[key] == side[f"_n{k}"]).drop(f"_n{k}")
    return out


def on_both_ends(left: DataFrame, right: DataFrame, keys: tuple[str, str] = ("source", "target")) -> DataFrame:
    """Rows of ``left`` whose pair of ends is in ``right``."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_semi")


def known(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def unknown(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def exploded_path(matches: DataFrame, edges: DataFrame, path: str = "opath", edge_id: str = "edge_id", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """A row for each entry of a path that is an edge of ``edges``, with the entry's position."""
    each = matches.select(*keep, F.posexplode(path).alias("pos", edge_id))
    return each.join(edges, edge_id)


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def within_box(left: DataFrame, right: DataFrame, reach: float, on: tuple[str, str] = ("x", "y"), box: tuple[str, str, str, str] = ("x0", "y0", "x1", "y1")) -> DataFrame:
    """Pairs of a point of ``left`` and a box of ``right`` that comes within ``reach`` of it on both axes.

    Cells of size ``cell`` = the reach, at least: the point goes to its own cell,
    the box, widened by the reach, to all it meets; an equi-join on cells does the
    rest and an exact test follows. A pair meets in the point's cell alone, so
    there are no repeats.
    """
    x, y = (F.col(c) for c in on)
    x0, y0, x1, y1 = (F.col(c) for c in box)
    a = left.withColumns({"_cx": cell(x, reach), "_cy": cell(y, reach)})
    b = right.withColumn("_cx", F.explode(F.sequence(cell(x0 - reach, reach), cell(x1 + reach, reach)))).withColumn("_cy", F.explode(F.sequence(cell(y0 - reach, reach), cell(y1 + reach, reach))))
    near = (x >= x0 - reach) & (x <= x1 + reach) & (y >= y0 - reach) & (y <= y1 + reach)
    return a.join(b, ["_cx", "_cy"]).where(near).drop("_cx", "_cy")


def within_distance(left: DataFrame, right: DataFrame, reach: float, left_xy: tuple[str, str], right_xy: tuple[str, str]) -> DataFrame:
    """Pairs of points at most ``reach`` apart, with their distance ``dist``."""
    (lx, ly), (rx, ry) = left_xy, right_xy
    a = left.withColumns({"_cx": cell(F.col(lx), reach), "_cy": cell(F.col(ly), reach)})
    b = right.withColumn("_cx", F.explode(F.sequence(cell(F.col(rx), reach) - 1, cell(F.col(rx), reach) + 1))).withColumn("_cy", F.explode(F.sequence(cell(F.col(ry), reach) - 1, cell(F.col(ry), reach) + 1)))
    d = F.sqrt((F.col(lx) - F.col(rx)) * (F.col(lx) - F.col(rx)) + (F.col(ly) - F.col(ry)) * (F.col(ly) - F.col(ry)))
    return a.join(b, ["_cx", "_cy"]).withColumn("dist", d).where(F.col("dist") <= reach).drop("_cx", "_cy")


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_xy: tuple[str, str], right_xy: tuple[str, str], reach: float, k: int = 1) -> DataFrame:
    """The ``k`` nearest rows of ``right`` for each row of ``left``, all of them if there are fewer: left_id, right_id, dist, rank; of ties the smaller id.

    Rows of ``right`` are counted by cells of size ``reach``, or smaller where these hold many, then of
    twice the size and so on. Of rows at one place the first ``k`` take part. Each row of ``left`` takes part in one join, at the first level at which the
    nine cells around it hold ``k``, so a join meets about as many rows as are asked for,
    however far they are. It ends at cells as large as both sides together. Rows
    without a place have no neighbours.
    """
    from trackloom.operators.raster import saved

    (lx, ly), (rx, ry) = left_xy, right_xy
    placed = lambda df, x, y: df.where(~F.isnan(x) & ~F.isnan(y) & F.col(x).isNotNull() & F.col(y).isNotNull())
    open_ = placed(left.select(left_id, lx, ly), lx, ly)
    right = placed(right.select(right_id, rx, ry), rx, ry)
    # rows at one place are equally far from any other
    place = W.partitionBy(rx, ry).orderBy(right_id)
    right = saved(right.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= k).drop("_r"))
    counted = lambda size: saved(right.groupBy(cell(F.col(rx), size).alias("_cx"), cell(F.col(ry), size).alias("_cy")).agg(F.count(F.lit(1)).alias("_n")))
    counts, size = counted(reach), reach
    n, squares = counts.agg(F.sum("_n"), F.sum(F.col("_n").cast("double") * F.col("_n"))).first()
    n = n or 0
    if n and squares / n > 4 * k:  # rows of the cell of a row
        size = reach / 2 ** math.ceil(math.log(squares / n / (2 * k), 4))
        counts = counted(size)
    ends = lambda df, x, y: df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    boxes = [e for e in (ends(open_, lx, ly), ends(right, rx, ry)) if e[0] is not None]
    out = None
    if n and len(boxes) == 2:
        extent = max(max(e[1 + c] for e in boxes) - min(e[c] for e in boxes) for c in (0, 2))
        while True:
            last = size >= extent
            if last:
                ready, rest = open_, None
            else:
                near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
                asked = open_.select(cell(F.col(lx), size).alias("_ox"), cell(F.col(ly), size).alias("_oy")).distinct().withColumn("_d", near)
                held = asked.withColumns({"_cx": F.col("_ox") + F.col("_d.i"), "_cy": F.col("_oy") + F.col("_d.j")}).join(counts, ["_cx", "_cy"])
                full = held.groupBy("_ox", "_oy").agg(F.sum("_n").alias("_m")).where(F.col("_m") >= min(k, n))
                told = saved(open_.withColumns({"_ox": cell(F.col(lx), size), "_oy": cell(F.col(ly), size)}).join(full, ["_ox", "_oy"], "left"))
                ready, rest = (told.where(F.col("_m").isNotNull() if r else F.col("_m").isNull()).select(left_id, lx, ly) for r in (True, False))
            # k rows lie in the nine cells, so within 2 * sqrt(2) cells; the side with few rows is dealt to several cells
            pairs = within_distance(right, ready, 2.8285 * size, right_xy, left_xy)
            if k == 1:
                best = pairs.groupBy(left_id).agg(F.min(F.struct("dist", right_id)).alias("_m"))
                ranked = best.select(left_id, F.col(f"_m.{right_id}").alias(right_id), F.col("_m.dist").alias("dist"), F.lit(1).alias("rank"))
            else:
                ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy(left_id).orderBy("dist", right_id))).where(F.col("rank") <= k)
                ranked = ranked.select(left_id, right_id, "dist", "rank")
            out = ranked if out is None else out.unionByName(ranked)
            if last or rest.isEmpty():
                break
            open_, size = rest, size * 2
            counts = counts.groupBy(F.floor(F.col("_cx") / 2).alias("_cx"), F.floor(F.col("_cy") / 2).alias("_cy")).agg(F.sum("_n").alias("_n"))
    if out is None:
        return left.select(left_id).join(right.select(right_id), F.lit(False)).withColumns({"dist": F.lit(0.0), "rank": F.lit(0)})
    return out


def distances(left: DataFrame, right: DataFrame, left_xy: tuple[str, str], right_xy: tuple[str, str]) -> DataFrame:
    """Every distance between two small sets; use ``within_distance`` where a cutoff is known."""
    (lx, ly), (rx, ry) = left_xy, right_xy
    d = F.sqrt((F.col(lx) - F.col(rx)) * (F.col(lx) - F.col(rx)) + (F.col(ly) - F.col(ry)) * (F.col(ly) - F.col(ry)))
    return left.crossJoin(right).withColumn("dist", d)


def clear_of(df: DataFrame, key: str, time: str, flag: Column, span: int) -> DataFrame:
    """Rows without ``flag`` that have no flagged row of their key within ``span`` of their time, either way and inclusive."""
    w = W.partitionBy(key).orderBy(time).rangeBetween(-span, span)
    return df.withColumn("_near", F.max(F.when(flag, 1).otherwise(0)).over(w)).where((F.col("_near") == 0) & ~flag).drop("_near")


def onward(edges: DataFrame, source: str = "source", target: str = "target", edge_id: str = "edge_id") -> DataFrame:
    """Pairs of edges of which the second begins where the first ends: edge_id, next_id."""
    a = edges.select(F.col(edge_id), F.col(target).alias("_at"), F.col(source).alias("_from"))
    b = edges.select(F.col(edge_id).alias("next_id"), F.col(source).alias("_at"), F.col(target).alias("_to"))
    return a.join(b, "_at").select(edge_id, "next_id", (F.col("_from") == F.col("_to")).alias("returns"))


def fresh(df: DataFrame) -> DataFrame:
    """The same rows under new column identities, for the second side of a cogroup over relatives."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def first_come(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """The ids chosen when rows are taken in an order and each that is chosen takes away others: id.

    rows: id; blocks: a, b, once each, where a comes before b in the order and takes it away
    if chosen. A row is settled once those before it that could take it away are, so rounds
    are as many as the longest chain of such rows, few if the order is random.
    """
    from trackloom.operators.raster import saved

    blocks = saved(blocks.select("a", "b"))
    # rows that nothing can take away are chosen at once
    open_ = saved(blocks.select(F.col("b").alias("id")).distinct())
    chosen = saved(rows.select("id").join(open_, "id", "left_anti"))
    fresh_, out = chosen, chosen
    while not open_.isEmpty():
        gone = saved(blocks.join(fresh_.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct())
        open_ = saved(open_.join(gone, "id", "left_anti"))
        # what is left of the pairs: both open
        blocks = saved(blocks.join(open_.withColumnRenamed("id", "b"), "b", "left_semi").join(open_.withColumnRenamed("id", "a"), "a", "left_semi"))
        waiting = blocks.select(F.col("b").alias("id")).distinct()
        fresh_ = saved(open_.join(waiting, "id", "left_anti"))
        open_ = saved(waiting)
        out = out.unionByName(fresh_)
    return out


def _taken(pairs: pd.DataFrame) -> pd.DataFrame:
    """Ids taken away, from all pairs (a, b, ka, kb) of a before b, by going through them in order."""
    ids, at = np.unique(np.concatenate([pairs["a"], pairs["b"]]), return_inverse=True)
    key = np.empty(len(ids))
    key[at] = np.concatenate([pairs["ka"], pairs["kb"]])
    a, b = np.split(at, 2)
    by = np.argsort(a, kind="stable")
    b, ends = b[by], np.searchsorted(a[by], np.arange(len(ids) + 1))
    gone = np.zeros(len(ids), bool)
    for i in np.lexsort((ids, key)):
        if not gone[i]:
            gone[b[ends[i] : ends[i + 1]]] = True
    return pd.DataFrame({"id": ids[gone]})


def first_come_near(rows: DataFrame, near: Callable[[DataFrame, DataFrame], DataFrame], head: int = HEAD, few: int = FEW_PAIRS) -> DataFrame:
    """The rows (id, k and what ``near`` needs) taken by k, then id, where each that is chosen takes away others: id, and by, the first chosen one that took it, itself if chosen.

    ``near`` gives the pairs (a, b) of a row of the first table that would take away one of the second;
    k is a double. Prefixes of the order are settled in turn: only pairs within a prefix are
    held, and those of what was chosen with what comes later are aggregated as they are
    made. So most rows are gone before they meet any other. A prefix is half as long after one
    of more than ``few`` pairs, twice as long after one of less than a tenth.
    """
    from trackloom.operators.raster import saved

    k = F.col("k").cast("double")
    open_ = saved(rows.withColumn("k", F.when(k.isNull(), float("-inf")).when(F.isnan(k), float("inf")).otherwise(k)))
    out = None
    while n := open_.count():
        last = n <= head
        top = float("inf") if last else open_.stat.approxQuantile("k", [head / n], 0.1 * head / n)[0]
        own = open_ if last else saved(open_.where(F.col("k") <= top))
        sides = (own.select("id", "k").withColumnsRenamed({"id": c, "k": f"k{c}"}) for c in "ab")
        pairs = near(own, fresh(own))
        for c, side in zip("ab", sides, strict=True):
            pairs = pairs.join(side, c)
        pairs = saved(pairs.where(F.struct("ka", "a") < F.struct("kb", "b")).select("a", "b", "ka", "kb"))
        many = pairs.count()
        if many <= few:
            chosen = own.join(pairs.groupBy().applyInPandas(_taken, "id long"), "id", "left_anti")
        else:
            chosen = own.join(first_come(own, pairs), "id", "left_semi")
        chosen = saved(chosen)
        later = open_.join(chosen.select("id"), "id", "left_anti")
        met = near(chosen, fresh(later)).join(chosen.select(F.col("id").alias("a"), "k"), "a")
        gone = saved(met.groupBy(F.col("b").alias("id")).agg(F.min(F.struct("k", "a")).alias("m")).select("id", F.col("m.a").alias("by")))
        settled = chosen.select("id", F.col("id").alias("by")).unionByName(gone)
        out = settled if out is None else out.unionByName(settled)
        if last:
            break
        open_ = saved(later.join(gone, "id", "left_anti"))
        head = max(1000, head // 2) if many > few else 2 * head if many < few // 10 else head
    return out if out is not None else rows.select("id", F.col("id").alias("by"))
