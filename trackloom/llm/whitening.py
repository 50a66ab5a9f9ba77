"""Whitening of embeddings by the covariance of their distinct vectors.

``fit`` takes each distinct integer vector once. Their number n and sums S are exact, so
that n*x - S, the centred vector times n, is a whole number too; divided by n once, it is
a row of MLlib's RowMatrix, whose computeGramianMatrix, over n, is the covariance. Only
that square matrix, of the vectors' dimension, comes to the driver, where eigh finds the
components. ``apply`` broadcasts mean and components, as large as that matrix, and
projects whole Arrow batches in mapInPandas.

* Rows whose vector ``vectors.integer_vectors`` refuses (null, empty, not finite, of
  another length) take no part. Null ids and repeated rows stay: one row out for each
  row in. Extra columns are left out.
* An empty table, or one without any such vector, gives no model and no rows.
* Where vectors don't vary (one distinct vector, or fewer of them than dimensions) the
  last eigenvalues are zero but for rounding; projections on their components are zero,
  and ``identity_error`` is then 1, as no scale makes their variance one.
* Equal eigenvalues: any orthonormal basis of their space, the same for all rows.
* Deviations that a long can't hold are null.

Copies fall together before the shuffle, in the partial aggregate of ``distinct``, so a
vector that very many rows have is counted where it is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import stage_table

LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with sums per dimension, eigenvalues falling, components as columns, and the trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    largest: int

    def scales(self, k: int) -> np.ndarray:
        e = self.values[:k]
        real = e > self.values[0] * len(self.sums) * np.finfo(float).eps
        return np.where(real, 1 / np.sqrt(np.where(real, e, 1)), 0.0)

    def explained(self, k: int) -> list[float]:
        return [float(e / self.trace) if self.trace > 0 else 0.0 for e in self.values[:k]]

    def reach(self) -> int:
        """No entry of n*x - S is larger."""
        return self.n * self.largest + max(map(abs, self.sums))


def covariance(rows: DataFrame, col: str, n: int, d: int) -> np.ndarray:
    """Gramian over n of an array column whose rows are centred."""
    as_vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(col).alias("v")), "v")
    return RowMatrix(as_vectors, 0, d).computeGramianMatrix().toArray() / n


def centred(x: str, model_n: int, sums: list[int], exact_in_long: bool) -> Column:
    """(n*x - S) / n, by whole numbers up to the division."""
    kind = "bigint" if exact_in_long else "decimal(38,0)"
    s = F.array(*[F.lit(v).cast(kind) for v in sums])
    return F.zip_with(x, s, lambda v, t: (F.lit(model_n).cast(kind) * v.cast(kind) - t).cast("double") / model_n)


def fit(vectors: DataFrame, col: str = "x") -> tuple[Whitening, DataFrame] | None:
    """The model of an array column of whole numbers, and the written table of its distinct vectors."""
    once = stage_table(vectors.select(F.col(col).alias("x")).distinct(), "distinct-vectors")
    by_place = once.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(20,0)")).alias("s"), F.max(F.abs("v")).alias("m"))
    places = sorted(by_place.collect())  # a row for each dimension
    if not places:
        return None
    n, sums, d = places[0]["n"], [int(p["s"]) for p in places], len(places)
    largest = max(p["m"] for p in places)
    small = n * largest + max(map(abs, sums)) < 1 << 62
    v = covariance(once.select(centred("x", n, sums, small).alias("c")), "c", n, d)
    values, comps = np.linalg.eigh((v + v.T) / 2)
    return Whitening(n, tuple(sums), np.maximum(values[::-1], 0), comps[:, ::-1].copy(), float(np.trace(v)), largest), once


def apply(vectors: DataFrame, model: Whitening, k: int, keep: tuple[str, ...] = (), col: str = "x") -> DataFrame:
    """``keep``, the deviation (the sum of squares of n*x - S) and the whitened coordinates of the first ``k`` components."""
    spark = vectors.sparkSession
    k = min(k, len(model.sums))
    sent = spark.sparkContext.broadcast((model.n, model.sums, model.vectors[:, :k] * model.scales(k), model.reach()))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, matrix, reach = sent.value
        whole = len(sums) * reach**2 <= LONG
        for pdf in batches:
            x = np.stack(pdf[col].to_numpy()) if len(pdf) else np.zeros((0, len(sums)), np.int64)
            if whole:
                c = n * x.astype(np.int64) - np.array(sums, np.int64)
                dev = list(map(int, (c * c).sum(axis=1)))
            else:  # Python's own whole numbers
                c = n * x.astype(object) - np.array(sums, object)
                dev = [v if v <= LONG else None for v in (c * c).sum(axis=1)]
            out = pdf[list(keep)].copy()
            out["deviation"] = pd.array(dev, dtype="Int64")
            out["whitened"] = list(c.astype(np.float64) / n @ matrix)
            yield out

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in vectors.select(*keep).schema)
    return vectors.select(*keep, col).mapInPandas(project, fields + "deviation bigint, whitened array<double>")


def identity_error(once: DataFrame, model: Whitening, k: int) -> float:
    """The largest entry, in size, of the covariance of the whitened distinct vectors minus the identity."""
    k = min(k, len(model.sums))
    own = apply(once, model, k).select("whitened")
    means = [float(r["m"]) for r in sorted(own.select(F.posexplode("whitened").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m")).collect())]
    mid = F.array(*map(F.lit, means))
    v = covariance(own.select(F.zip_with("whitened", mid, lambda a, b: a - b).alias("c")), "c", model.n, k)
    return float(np.abs(v - np.eye(k)).max())
