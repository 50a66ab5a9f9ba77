"""Online map matching: a Viterbi state for each route, carried from batch to batch.

Observations arrive as rows (route, n, at, candidates); states that leave the
kept history, and all states of a route that has been silent, are emitted. Batch
matching stays the source of truth; on one route both give the same states.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackloom.kernels.matching import UNKNOWN, Viterbi

OUT = "route long, n long, state long"
STATE = "viterbi string, next long"


def packed(v: Viterbi) -> str:
    return json.dumps({"v": list(v.v.items()), "back": [list(came.items()) for came in v.back]})


def unpacked(text: str, lookup: Callable, prior: dict, keep: int) -> Viterbi:
    raw = json.loads(text)
    v = Viterbi(lookup, prior, keep)
    v.v = {s: p for s, p in raw["v"]}
    v.back.extend(dict(came) for came in raw["back"])
    return v


def match_stream(observations: DataFrame, lookup: Callable[[int, int], float], keep: int = 50, silent_ms: int | None = 60_000) -> DataFrame:
    """A streaming frame of (route, n, state) from one of (route long, n long, candidates array<struct<state long, e double>>).

    Without ``silent_ms`` a route's last states wait for more observations for ever.
    """
    prior = {UNKNOWN: 1.0}

    def each(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            text, nxt = state.get
            rest = unpacked(text, lookup, prior, keep).tail()
            state.remove()
            yield pd.DataFrame({"route": key[0], "n": range(nxt, nxt + len(rest)), "state": rest})
            return
        if state.exists:
            text, nxt = state.get
            v = unpacked(text, lookup, prior, keep)
        else:
            v, nxt = Viterbi(lookup, prior, keep), 0
        out = []
        for c in pd.concat(list(batches)).sort_values("n")["candidates"]:
            gone = v.step([(int(x["state"]), float(x["e"])) for x in c])
            if gone is not None:
                out.append((key[0], nxt, gone))
                nxt += 1
        state.update((packed(v), nxt))
        if silent_ms is not None:
            state.setTimeoutDuration(silent_ms)
        yield pd.DataFrame(out, columns=["route", "n", "state"])

    return observations.groupBy("route").applyInPandasWithState(each, OUT, STATE, "append", GroupStateTimeout.NoTimeout if silent_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def windowed_speed(points: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Points and mean value by kind in tumbling windows of event time, late rows dropped; works on streams and on batches."""
    from pyspark.sql import functions as F

    w = F.window("ts", width)
    own = points.withWatermark("ts", late) if points.isStreaming else points
    return own.groupBy(w, "kind").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "kind", "n", "mean")
