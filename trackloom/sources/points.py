"""Positions, boxes and trajectories in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.functions.codec import wkb_point
from trackloom.operators.filters import inside

GPS = T.StructType([T.StructField(n, t) for n, t in (("device_id", T.StringType()), ("route_slug", T.StringType()), ("location", T.StringType()), ("altitude", T.DoubleType()), ("timestamp", T.LongType()), ("bearing", T.DoubleType()), ("speed", T.DoubleType()))])
TRAJECTORY = "route_id long, longitude double, latitude double, altitude double, timestamp timestamp_ntz, bearing double, speed double"


def read_positions(spark: SparkSession, path: str | list[str], box: tuple[float, float, float, float] | None = None, start_ms: int | None = None, end_ms: int | None = None, distance: bool = False, skip_corrupt: bool = False) -> DataFrame:
    """Recorded positions from Parquet, points decoded, within an optional box and time range.

    The time range reaches the scan; the box can't, for places are in text there, so
    write what this returns once and read lon and lat after that. With
    ``skip_corrupt`` unreadable files are passed over.
    """
    schema = T.StructType([*GPS.fields, *([T.StructField("distance", T.DoubleType())] if distance else [])])
    df = spark.read.schema(schema).option("ignoreCorruptFiles", str(skip_corrupt).lower()).parquet(*([path] if isinstance(path, str) else path))
    if start_ms is not None and end_ms is not None:
        df = df.where(F.col("timestamp").between(start_ms, end_ms))
    df = df.withColumn("_p", wkb_point(F.col("location"))).withColumns({"lon": F.col("_p.x"), "lat": F.col("_p.y")}).drop("_p")
    return df if box is None else df.where(inside("lat", "lon", box))


def read_box(spark: SparkSession, path: str) -> DataFrame:
    """south, west, north, east from lines KEY=number, by name and in any order."""
    lines = spark.read.text(path).where("value LIKE '%=%'")
    pairs = lines.select(F.lower(F.trim(F.split("value", "=")[0])).alias("k"), F.trim(F.split("value", "=")[1]).cast("double").alias("v"))
    pick = lambda n: F.max(F.when(F.col("k").contains(n), F.col("v"))).alias(n)
    return pairs.agg(pick("south"), pick("west"), pick("north"), pick("east"))


def write_box(spark: SparkSession, box: tuple[float, float, float, float], path: str) -> None:
    s, w, n, e = box
    lines = [f"NORTH={n!r}", f"SOUTH={s!r}", f"EAST={e!r}", f"WEST={w!r}"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)


def write_trajectories(df: DataFrame, path: str, rows_per_file: int = 1_000_000, route: str = "route_id", text: bool = False) -> None:
    """CSV with a header, routes whole within a file, files of about so many rows; or a space-separated folder a route."""
    if text:
        df.repartition(route).sortWithinPartitions(route).write.partitionBy(route).option("sep", " ").csv(path)
        return
    n = max(1, -(-df.count() // rows_per_file))
    df.repartitionByRange(int(n), route).sortWithinPartitions(route).write.option("header", True).csv(path)


def read_trajectories(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """Trajectory rows of all files, with their file's name for order."""
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def read_trip_texts(spark: SparkSession, path: str) -> DataFrame:
    """One trip a file, lines "x y t": trip (from the file's name), x, y, t, in order n."""
    own = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"(\d+)[^/]*$", 1).cast("long").alias("trip"), F.posexplode(F.split("value", "\n")).alias("n", "line")).where("trim(line) <> ''")
    part = F.split(F.trim("line"), r"\s+")
    return own.select("trip", F.col("n").cast("long").alias("n"), part[0].cast("double").alias("x"), part[1].cast("double").alias("y"), part[2].cast("double").alias("t"))


def read_metric_trips(spark: SparkSession, path: str) -> DataFrame:
    """CSV of id, x, y, altitude, time in ms; time in seconds, sorted by id within partitions."""
    df = spark.read.schema("id long, x double, y double, altitude double, time_ms double").option("header", True).csv(path)
    return df.withColumn("time", F.col("time_ms") / 1000).drop("time_ms").sortWithinPartitions("id", "time")
