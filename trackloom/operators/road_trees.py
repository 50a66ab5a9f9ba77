"""Contraction of a point graph into a road tree, over the whole graph, without tiles.

From a seed a ball grows by breadth along links, taking free nodes at walks shorter than
``reach``. If a node farther out ends it and it has more than ``delta`` nodes, it becomes
its member nearest the mean, linked to all neighbours of the ball. Nodes that a ball took
are no seeds and in no ball any more. The order of seeds is free (drawn at random, as the
rule has it); here it is that of rounds:

1. Free nodes without free neighbours are balls of their own, all at once.
2. Seeds of a round are the free nodes with the smallest hash in their ground cell and the
   eight around it. Cells are twice the reach wide, so what seeds can take is disjoint.
3. Each ball grows in a task of its own, from the free nodes within a straight ``reach`` of
   its seed and their links; a walk is never shorter than that.
4. Two balls bear on each other only if a link leads from one to the other; of such, the
   seed with the smaller hash stays and the other one waits.

So a round does what its seeds would do one after another. When ``few`` free nodes are left,
one task takes them in the order of their hashes. Rounds write their tables.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.kernels import cluster as kernels
from trackloom.operators import joins, sets
from trackloom.session import written

#: Free nodes that one task takes.
FEW = 20_000
STEPS = "kind string, seed long, a long, b long"


def _known(rows: pd.DataFrame) -> tuple[dict, dict, set]:
    """Places, neighbours and free nodes of links (u, ux, uy, v, vx, vy, vfree) from free nodes u."""
    place = dict(zip(rows["u"], zip(rows["ux"], rows["uy"], strict=True), strict=True)) | dict(zip(rows["v"], zip(rows["vx"], rows["vy"], strict=True), strict=True))
    near: dict[int, set[int]] = {}
    for u, v in zip(rows["u"], rows["v"], strict=True):
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    return place, near, set(rows["u"]) | set(rows["v"][rows["vfree"]])


def _rows(out: list[tuple]) -> pd.DataFrame:
    """Rows whose whole numbers stay whole beside nulls."""
    return pd.DataFrame(out, columns=["kind", "seed", "a", "b"], dtype=object)


def _grow(reach: float, delta: int):
    def each(rows: pd.DataFrame) -> pd.DataFrame:
        seed = int(rows["seed"].iloc[0])
        place, near, free = _known(rows)
        before = set(free)
        gone, links = kernels.contract_all([seed], place, near, free, reach, delta)
        out = [("take", seed, p, None) for p in before - free] + [("gone", seed, p, None) for p in gone] + [("link", seed, a, b) for a, b in links]
        return _rows(out)

    return each


def _finish(reach: float, delta: int):
    def each(rows: pd.DataFrame) -> pd.DataFrame:
        place, near, free = _known(rows)
        order = [p for _, p in sorted(zip(rows["h"], rows["u"], strict=True))]
        gone, links = kernels.contract_all(list(dict.fromkeys(order)), place, near, free, reach, delta)
        out = [("gone", None, p, None) for p in gone] + [("link", None, a, b) for a, b in links]
        return _rows(out)

    return each


def contracted(points: DataFrame, pairs: DataFrame, reach: float, delta: int, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """Links of the tree (a, b, ax, ay, bx, by; a < b) of points (id, x, y) linked by pairs (a, b), and the seeds of rounds: round, seed.

    Nodes without links are in no link of the tree. Seeds that the last task took have no row.
    """
    spark = points.sparkSession
    place = written(points.select("id", "x", "y", sets.scattered("id").alias("h")), "tree-points")
    links = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "tree-links")
    taken = spark.createDataFrame([], "id long")
    seeds = spark.createDataFrame([], "round int, seed long")
    cell = lambda c: joins.cell(F.col(c), 2 * reach)
    n = 0
    while True:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        state = place.join(taken.withColumn("_t", F.lit(1)), "id", "left").withColumn("free", F.col("_t").isNull()).drop("_t")
        u = state.where("free").select(F.col("id").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy"), "h")
        v = state.select(F.col("id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"), F.col("free").alias("vfree"))
        out = written(both.join(u, "u").join(joins.fresh(v), "v"), "tree-state")
        # free nodes with free neighbours; all others change nothing any more
        open_ = out.where("vfree").select(F.col("u").alias("seed"), "ux", "uy", "h").distinct()
        out = out.join(open_.select(F.col("seed").alias("u")), "u", "left_semi")
        left = open_.count()
        if left == 0:
            break
        if left <= few:
            done = written(out.groupBy().applyInPandas(_finish(reach, delta), STEPS), "tree-end")
        else:
            own = open_.withColumns({"i": cell("ux"), "j": cell("uy")})
            least = own.groupBy("i", "j").agg(F.min(F.struct("h", "seed")).alias("m"))
            around = F.explode(F.array(*[F.struct((F.col("i") + p).alias("i"), (F.col("j") + q).alias("j")) for p in (-1, 0, 1) for q in (-1, 0, 1)]))
            best = least.select("m", around.alias("c")).groupBy("c.i", "c.j").agg(F.min("m").alias("best"))
            chosen = written(own.join(best, ["i", "j"]).where("best.seed = seed").select("seed", F.col("ux").alias("sx"), F.col("uy").alias("sy"), F.col("h").alias("sh"), "i", "j"), "tree-seeds")
            spread = chosen.select("seed", "sx", "sy", around.alias("c")).select("seed", "sx", "sy", "c.i", "c.j")
            held = own.select(F.col("seed").alias("u"), "ux", "uy", "i", "j").join(spread, ["i", "j"]).where(F.hypot(F.col("ux") - F.col("sx"), F.col("uy") - F.col("sy")) < reach).select("u", "seed")
            grown = written(out.join(held, "u").groupBy("seed").applyInPandas(_grow(reach, delta), STEPS), "tree-balls")
            took = grown.where("kind = 'take'").select("seed", F.col("a").alias("id")).join(chosen.select("seed", "sh"), "seed")
            one = took.select(F.col("id").alias("u"), "seed", "sh")
            two = joins.fresh(took).select(F.col("id").alias("v"), F.col("seed").alias("_s"), F.col("sh").alias("_h"))
            waits = out.select("u", "v").join(one, "u").join(two, "v").where((F.col("seed") != F.col("_s")) & (F.struct("sh", "seed") > F.struct("_h", "_s"))).select("seed").distinct()
            done = written(grown.join(waits, "seed", "left_anti"), "tree-round")
            seeds = seeds.unionByName(written(done.select(F.lit(n).alias("round"), "seed").distinct(), "tree-order"))
            taken = written(taken.unionByName(done.where("kind = 'take'").select(F.col("a").alias("id"))), "tree-taken")
        gone = done.where("kind = 'gone'").select("a")
        kept = links.join(gone, "a", "left_anti").join(gone.withColumnRenamed("a", "b"), "b", "left_anti").select("a", "b")
        links = written(kept.unionByName(done.where("kind = 'link'").select("a", "b")).distinct(), "tree-links")
        if left <= few:
            break
        n += 1
    ends = lambda k: place.select(F.col("id").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y"))
    return links.join(ends("a"), "a").join(ends("b"), "b").select("a", "b", "ax", "ay", "bx", "by"), seeds
