"""The engine's relations, bound to the tables at hand, in Spark and as SQL.

There are no recorded trips among the tables, so events stand for positions,
parts for the nodes of a street grid, and order lines for matched edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import geo

#: Box of the study area: south, west, north, east.
BOX = (35.7185, 51.32, 35.7384, 51.3822)
GRID = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def thousandths(x: Column) -> Column:
    """A double as a whole number of thousandths, for comparison."""
    return F.round(x * 1000).cast("long")


def micro(x: Column) -> Column:
    """Degrees as a whole number of millionths."""
    return F.round(x * 1_000_000).cast("long")


def u(x: str) -> str:
    """The same in SQL."""
    return f"CAST(round(({x}) * 1000000) AS BIGINT)"


def k(x: str) -> str:
    """The same in SQL."""
    return f"CAST(round(({x}) * 1000) AS BIGINT)"


def gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions: route_id, event_id, us (microseconds since 1970), lon, lat, value, kind."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("route_id"),
        "event_id",
        F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("us"),
        (51.32 + F.get_json_object("props", "$.k").cast("int") * 0.0006).alias("lon"),
        (35.7185 + F.col("value") * 0.00004).alias("lat"),
        "value",
        F.col("event_type").alias("kind"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a street grid, GRID columns wide: node_id, row, col, lat, lon, weight."""
    p = i = F.col("p_partkey")
    row, col = F.floor(i / GRID), i % GRID
    return table(spark, sf_dir, "part").select(
        p.alias("node_id"),
        row.alias("row"),
        col.alias("col"),
        (35.71 + row * 0.0009 + (p * 37 % 11) * 0.00001).alias("lat"),
        (51.32 + col * 0.0011 + (p * 53 % 13) * 0.00001).alias("lon"),
        F.col("p_size").cast("long").alias("weight"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed links between neighbours, a tenth of the pairs left out: edge_id, source, target, weight, highway."""
    own = nodes(spark, sf_dir)
    way = lambda d, t, ok: F.when(ok, F.struct(F.lit(d).alias("d"), (F.col("node_id") + t).alias("t")))
    ways = F.array_compact(F.array(way(0, 1, F.col("col") < GRID - 1), way(1, -1, F.col("col") > 0), way(2, GRID, F.lit(True)), way(3, -GRID, F.col("row") > 0)))
    out = own.select(F.col("node_id").alias("source"), "weight", F.explode(ways).alias("w"))
    pair = (F.least("source", "w.t") * 7919 + F.greatest("source", "w.t") * 104729) % 10
    kept = out.where(pair != 0).select((F.col("source") * 4 + F.col("w.d")).alias("edge_id"), "source", F.col("w.t").alias("target"), "weight")
    known = own.select(F.col("node_id").alias("target"))
    return kept.join(known, "target", "left_semi").select("edge_id", "source", "target", "weight", F.element_at(F.array(F.lit("residential"), F.lit("primary"), F.lit("service")), (F.col("weight") % 3 + 1).cast("int")).alias("highway"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with the places of both ends and their length in metres."""
    from trackloom.operators.joins import with_ends

    own = with_ends(links(spark, sf_dir), nodes(spark, sf_dir), "node_id", ["lat", "lon"])
    return own.withColumn("length", geo.haversine("lat1", "lon1", "lat2", "lon2"))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched trips: id, opath (edges crossed), ep, tp, error (by crossing)."""
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.struct(
            F.col("l_linenumber").alias("n"),
            (F.col("l_partkey") * 4 + F.when(F.col("l_linenumber") % 2 == 0, 0).otherwise(2)).alias("edge"),
            (F.col("l_discount") * 10).alias("ep"),
            (F.col("l_tax") * 12).alias("tp"),
            F.col("l_quantity").cast("double").alias("error"),
        ).alias("x"),
    )
    own = line.groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return own.select("id", *[F.col(f"x.{c}").alias(o) for c, o in (("edge", "opath"), ("ep", "ep"), ("tp", "tp"), ("error", "error"))])


def crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each crossing: id, n, edge_id, ep."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").cast("long").alias("n"),
        (F.col("l_partkey") * 4 + F.when(F.col("l_linenumber") % 2 == 0, 0).otherwise(2)).alias("edge_id"),
        (F.col("l_discount") * 10).alias("ep"),
    )


def points2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plane points in groups: id, grp, x, y."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("grp"), (F.get("embedding", F.lit(0)).cast("double") * 100).alias("x"), (F.get("embedding", F.lit(1)).cast("double") * 100).alias("y"))


CTE = {
    "gps": "gps AS (SELECT user_id AS route_id, event_id, epoch_us(ts) AS us, 51.32e0 + CAST(json_extract_string(props, '$.k') AS INTEGER) * 6e-4 AS lon, 35.7185e0 + value * 4e-5 AS lat, value, event_type AS kind FROM events)",
    "nodes": f"nodes AS (SELECT p_partkey AS node_id, p_partkey // {GRID} AS \"row\", p_partkey % {GRID} AS col, 35.71e0 + (p_partkey // {GRID}) * 9e-4 + (p_partkey * 37 % 11) * 1e-5 AS lat, 51.32e0 + (p_partkey % {GRID}) * 11e-4 + (p_partkey * 53 % 13) * 1e-5 AS lon, CAST(p_size AS BIGINT) AS weight FROM part)",
    "links": f"""links AS (SELECT source * 4 + d AS edge_id, source, target, weight, CASE weight % 3 WHEN 0 THEN 'residential' WHEN 1 THEN 'primary' ELSE 'service' END AS highway FROM (
  SELECT a.node_id AS source, b.node_id AS target, a.weight, CASE b.node_id - a.node_id WHEN 1 THEN 0 WHEN -1 THEN 1 WHEN {GRID} THEN 2 ELSE 3 END AS d
  FROM nodes a JOIN nodes b ON b.node_id = a.node_id + 1 AND a.col < {GRID - 1} OR b.node_id = a.node_id - 1 AND a.col > 0 OR b.node_id = a.node_id + {GRID} OR b.node_id = a.node_id - {GRID})
  WHERE (least(source, target) * 7919 + greatest(source, target) * 104729) % 10 <> 0)""",
    "edges": "edges AS (SELECT l.*, s.lat AS lat1, s.lon AS lon1, t.lat AS lat2, t.lon AS lon2, {hav} AS length FROM links l JOIN nodes s ON s.node_id = l.source JOIN nodes t ON t.node_id = l.target)",
    "crossings": "crossings AS (SELECT l_orderkey AS id, CAST(l_linenumber AS BIGINT) AS n, l_partkey * 4 + CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 2 END AS edge_id, l_discount * 10 AS ep, l_tax * 12 AS tp, CAST(l_quantity AS DOUBLE) AS error FROM lineitem)",
    "points2d": "points2d AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS grp, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y FROM embeddings)",
}


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Great-circle metres in SQL."""
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(CASE WHEN {lat1} = {lat2} AND {lon1} = {lon2} THEN 0e0 ELSE 12742000e0 * atan2(sqrt({a}), sqrt(1 - {a})) END)"


CTE["edges"] = CTE["edges"].replace("{hav}", hav("s.lat", "s.lon", "t.lat", "t.lon"))
NEEDS = {"links": ["nodes"], "edges": ["nodes", "links"]}


def sql(names: str, body: str) -> str:
    """``body`` with the relations it names, and what they need, in front; more CTEs may begin the body with a comma."""
    want: list[str] = []
    for n in names.split():
        for x in (*NEEDS.get(n, []), n):
            if x not in want:
                want.append(x)
    return "WITH " + ",\n".join(CTE[n] for n in want) + "\n" + body


def recursive(text: str) -> str:
    """A query whose CTEs may refer to themselves."""
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


def roots(pairs: str, most: int, out: str = "roots") -> str:
    """CTEs ``out`` (node, root): the smallest node of each component of the pairs (a, b), after ``most`` steps, which must be at least a component's width."""
    return (
        f"both_{out} AS (SELECT a, b FROM {pairs} UNION SELECT b, a FROM {pairs} UNION SELECT a, a FROM {pairs} UNION SELECT b, b FROM {pairs}), "
        f"step_{out} AS (SELECT 0 AS i, a AS node, a AS root FROM (SELECT DISTINCT a FROM both_{out}) UNION ALL SELECT l.i + 1, p.a, min(l.root) FROM step_{out} l JOIN both_{out} p ON p.b = l.node WHERE l.i < {most} GROUP BY l.i, p.a), "
        f"{out} AS (SELECT node, root FROM step_{out} WHERE i = {most})"
    )
