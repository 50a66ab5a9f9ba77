"""A corpus cleaned in five stages: toxicity, line dedup, near-dedup, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet to the shared folder and reads it again as the next stage's documents.
All but the last keep the columns of documents. Stages act on rows as they come:
null texts and ids pass or fall by the rules of each operator, and columns that
documents doesn't have stay.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import decontam, linededup, nearcopies, queries, spbpe, toxicity
from trackloom.llm.common import SPACES, read_table, stage_table


def set_apart(docs: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``step`` makes of the documents, with their columns renamed meanwhile so that none meets the operator's own."""
    own = step(docs.withColumnsRenamed({c: f"doc:{c}" for c in docs.columns}))
    return own.select(*[F.col(f"`doc:{c}`").cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; the network learns from the labels of the learning folds."""
    net = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), ~queries.held_out(5, 0))
    return set_apart(docs, lambda own: toxicity.with_toxicity(own, net, "`doc:text`", "toxicity").where("toxicity < 0.5"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of windows that occurred before; those that lose all their words go. n_chars follows."""

    def step(own: DataFrame) -> DataFrame:
        done = linededup.dedup_lines(own, "doc:doc_id", "doc:text")
        left = done.where((F.col("n_removed") == 0) | (F.btrim(F.col("`doc:text`"), F.lit(SPACES)) != ""))
        return left.withColumn("doc:n_chars", F.length("`doc:text`")) if "n_chars" in docs.columns else left

    return set_apart(docs, step)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, similarity 0.8): the one with the smallest id, null ids last."""
    return set_apart(docs, lambda own: nearcopies.without_near_copies(own, "doc:doc_id", "doc:text"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return set_apart(docs, lambda own: decontam.find_benchmark(own, read_table(spark, sf_dir, "benchmark"), "doc:doc_id", "doc:text").where("n_hit = 0"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document and digests of them and of what they decode to."""
    done = spbpe.with_round_trip(docs.select("doc_id", "text"), public_tokenizers.path(queries.PIECE_MODEL))
    ids = F.when(F.col("spm.ids") == "", F.array().cast("array<int>")).otherwise(F.split("spm.ids", ",").cast("array<int>"))
    return done.select("doc_id", "spm.n_tokens", ids.alias("ids"), F.sha2(F.col("spm.ids").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("spm.decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("near-duplicates", drop_copies), ("decontamination", drop_contaminated), ("tokens", tokens)]

#: A trained network and a tokenizer are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
