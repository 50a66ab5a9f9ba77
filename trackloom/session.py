"""A session with the settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests and the benchmark."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("trackloom").config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or of this machine on a local master."""
    import tempfile
    import uuid

    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if named is None:
        named = getattr(spark, "_trackloom_folder", None)
        if named is None:
            named = spark._trackloom_folder = "file://" + tempfile.mkdtemp(prefix="trackloom-")
    return f"{named.rstrip('/')}/trackloom/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a shared folder and read again: later plans begin there, however many rounds went before."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
