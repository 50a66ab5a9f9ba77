"""The stages of the pipeline as functions with typed arguments, and what the command line offers of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from trackloom.operators import evaluation, matching, trajectories


@dataclass(frozen=True)
class Stage:
    """A stage: what it reads (Parquet tables by name), its arguments with defaults, and how it runs."""

    reads: tuple[str, ...]
    run: Callable[..., DataFrame]
    arguments: dict[str, float | int] = field(default_factory=dict)


def sessions(positions: DataFrame, seconds: float, metres: float, speed: float, least_metres: float) -> DataFrame:
    """Positions (route_id, event_id, us, lat, lon) with session numbers."""
    return trajectories.sessions(positions, trajectories.Limits(seconds, metres, speed, least_metres))


def clean(positions: DataFrame, seconds: float, most: float, least: float, fastest: float, slowest: float) -> DataFrame:
    return trajectories.cleaned(positions, "route_id", seconds, most, least, fastest, slowest)


def match(points: DataFrame, edges: DataFrame, reach: float, keep: int) -> DataFrame:
    """Points (trip, n, point_id, x, y) with the edges (edge_id, source, target, weight, ax, ay, bx, by) they are on."""
    return matching.match_trips(points, edges, reach, keep)


def score(matches: DataFrame, dropped: DataFrame, degrees: float, length: float) -> DataFrame:
    """Precision, recall and F1 of matches (id, vx, vy, opath) against dropped edges (edge_id, ux, uy, length)."""
    return evaluation.precision_recall(evaluation.detections(matches, dropped, degrees), matches, dropped, length)


STAGES = {
    "sessions": Stage(("positions",), sessions, {"seconds": 10.0, "metres": 100.0, "speed": 25.0, "least_metres": 5.0}),
    "clean": Stage(("positions",), clean, {"seconds": 20.0, "most": 170.0, "least": 5.0, "fastest": 26.0, "slowest": 2.0}),
    "match": Stage(("points", "edges"), match, {"reach": 150.0, "keep": 300}),
    "score": Stage(("matches", "dropped"), score, {"degrees": 20.0, "length": 50.0}),
}


def run(spark: SparkSession, name: str, paths: dict[str, str], out: str, **arguments: float) -> None:
    """Read a stage's tables, run it and write what it gives as Parquet."""
    stage = STAGES[name]
    tables = [spark.read.parquet(paths[n]) for n in stage.reads]
    stage.run(*tables, **(stage.arguments | arguments)).write.parquet(out)
