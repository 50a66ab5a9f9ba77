"""Road maps and matches in files."""

from __future__ import annotations

import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.codec import listed, numbers


def write_graph_text(nodes: DataFrame, edges: DataFrame, path: str, sep: str = ",") -> None:
    """vertices (id, x, y, z) and edges (id, source, target) as text."""
    nodes.select("id", "x", "y", F.coalesce("z", F.lit(0.0)) if "z" in nodes.columns else F.lit(0.0)).write.option("sep", sep).csv(f"{path}/vertices")
    edges.select("id", "source", "target").write.option("sep", sep).csv(f"{path}/edges")


def read_graph_text(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """Vertices within a box (min y, min x, max y, max x), with an edge, and the edges between them."""
    v = spark.read.schema("id long, x double, y double, z double").option("sep", sep).csv(f"{path}/vertices")
    e = spark.read.schema("id long, source long, target long").option("sep", sep).csv(f"{path}/edges")
    if box is not None:
        s, w, n, t = box
        v = v.where(F.col("y").between(s, n) & F.col("x").between(w, t))
    for end in ("source", "target"):
        e = e.join(v.select(F.col("id").alias(end)), end, "left_semi")
    used = e.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return v.join(used, "id", "left_semi"), e


def write_edge_text(edges: DataFrame, path: str) -> None:
    """Two lines "lat,lon" and an empty one for each edge."""
    line = lambda n: F.concat_ws(",", f"lat{n}", f"lon{n}")
    edges.select(F.concat(line(1), F.lit("\n"), line(2), F.lit("\n")).alias("value")).write.text(path)


def read_edge_text(spark: SparkSession, path: str) -> DataFrame:
    blocks = spark.read.option("lineSep", "\n\n").text(path).select(F.split(F.trim("value"), r"[,\n]").alias("p")).where(F.size("p") == 4)
    return blocks.select(*[F.col("p")[k].cast("double").alias(n) for k, n in enumerate(("lat1", "lon1", "lat2", "lon2"))])


def write_matches(df: DataFrame, path: str) -> None:
    """Semicolon CSV with lists in text."""
    out = df.select(*[listed(F.col(c)).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    out.write.option("sep", ";").option("header", True).csv(path)


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("sep", ";").option("header", True).option("nullValue", "\x00").option("emptyValue", "").csv(path)
    kinds = {"opath": "long", "cpath": "long", "ep": "double", "tp": "double", "error": "double", "length": "double", "offset": "double", "spdist": "double"}
    return raw.select(*[numbers(F.coalesce(F.col(c), F.lit("")), kinds[c]).alias(c) if c in kinds else F.col(c).cast("long" if c == "id" else "string").alias(c) for c in raw.columns])


def write_ragged(df: DataFrame, path: str) -> None:
    """Matched points: route, lat, lon, time and the ends of the edge, or the word unknown."""
    known = [F.col(c).cast("string") for c in ("in_lat", "in_lon", "out_lat", "out_lon")]
    head = [F.col(c).cast("string") for c in ("route_id", "lat", "lon", "time")]
    df.select(F.when(F.col("in_lat").isNull(), F.concat_ws(",", *head, F.lit("unknown"))).otherwise(F.concat_ws(",", *head, *known)).alias("value")).write.text(path)


def read_ragged(spark: SparkSession, path: str) -> DataFrame:
    p = F.split("value", ",")
    own = spark.read.text(path).select(p.alias("p")).where(F.size("p").isin(5, 8))
    tail = [F.when(F.size("p") == 8, F.get("p", F.lit(k)).cast("double")).alias(n) for k, n in ((4, "in_lat"), (5, "in_lon"), (6, "out_lat"), (7, "out_lon"))]
    return own.select(F.get("p", F.lit(0)).cast("long").alias("route_id"), F.get("p", F.lit(1)).cast("double").alias("lat"), F.get("p", F.lit(2)).cast("double").alias("lon"), F.get("p", F.lit(3)).alias("time"), *tail)


def write_traces(df: DataFrame, path: str, trace: str = "trace_id", order: str = "seq") -> None:
    """Blocks of lines segment,edge,lat,lon,time with an empty line after each trace."""
    row = F.concat_ws(",", *[F.col(c).cast("string") for c in ("segment_id", "edge_id", "lat", "lon", "time")])
    packed = df.groupBy(trace).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("r")))).alias("x"))
    packed.select(F.concat(F.array_join(F.col("x.r"), "\n"), F.lit("\n")).alias("value")).write.text(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all traces: trace (an arbitrary number), seq, segment_id, edge_id, lat, lon, time."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).where("trim(value) <> ''").withColumn("trace", F.monotonically_increasing_id())
    rows = blocks.select("trace", F.posexplode(F.split(F.trim("value"), "\n")).alias("seq", "line"))
    p = F.split("line", ",")
    return rows.select("trace", F.col("seq").cast("long").alias("seq"), p[0].cast("long").alias("segment_id"), p[1].cast("long").alias("edge_id"), p[2].cast("double").alias("lat"), p[3].cast("double").alias("lon"), p[4].alias("time"))


def write_graph(path: str, nodes: DataFrame, edges: DataFrame, segments: DataFrame, intersections: DataFrame) -> None:
    """The four tables of a road graph as Parquet."""
    for name, df in (("nodes", nodes), ("edges", edges), ("segments", segments), ("intersections", intersections)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in ("nodes", "edges", "segments", "intersections")}


#: The tables of the graph database.
TABLES = {
    "nodes": "id INTEGER, latitude FLOAT, longitude FLOAT, weight FLOAT",
    "edges": "id INTEGER, in_node INTEGER, out_node INTEGER, weight FLOAT",
    "segments": "id INTEGER, edge_ids TEXT",
    "intersections": "node_id INTEGER",
}


def export_sqlite(file: str, graph: dict[str, DataFrame]) -> None:
    """A graph into a SQLite file on the driver, rows streamed a partition at a time; for maps of a city, not of a continent."""
    import json

    with sqlite3.connect(file) as db:
        for name, cols in TABLES.items():
            db.execute(f"CREATE TABLE {name} ({cols})")
            names = [c.split()[0] for c in cols.split(", ")]
            rows = ([json.dumps(list(v)) if isinstance(v, list) else v for v in r] for r in graph[name].select(*names).toLocalIterator())
            db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(names))})", rows)


def import_sqlite(spark: SparkSession, file: str) -> dict[str, DataFrame]:
    """A graph from a SQLite file on the driver; lists of edges are parsed as JSON, never evaluated."""
    kinds = {"id": "long", "latitude": "double", "longitude": "double", "weight": "double", "in_node": "long", "out_node": "long", "edge_ids": "string", "node_id": "long"}
    out = {}
    with sqlite3.connect(file) as db:
        for name, cols in TABLES.items():
            names = [c.split()[0] for c in cols.split(", ")]
            df = spark.createDataFrame(db.execute(f"SELECT {', '.join(names)} FROM {name}").fetchall(), ", ".join(f"{n} {kinds[n]}" for n in names))
            out[name] = df.withColumn("edge_ids", F.from_json("edge_ids", "array<long>")) if name == "segments" else df
    return out


def streets_in_box(edges: DataFrame, box: tuple[float, float, float, float], one_way: bool = True) -> DataFrame:
    """Drivable edges whose both ends are in a box, from a table of streets; reversed copies are added for two-way streets unless asked not to."""
    from trackloom.operators.filters import both_ends_inside

    own = edges.where(both_ends_inside(box))
    if one_way or "oneway" not in edges.columns:
        return own
    back = own.where("NOT oneway").withColumnsRenamed({"source": "target", "target": "source", "lat1": "lat2", "lat2": "lat1", "lon1": "lon2", "lon2": "lon1"})
    return own.unionByName(back)
