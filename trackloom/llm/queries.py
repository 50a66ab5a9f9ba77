"""The corpus operators applied to whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import decontam, langid, linededup, negatives, quality, secrets, shards, simhash, sketch, spbpe, succession, tokencount, toxicity, vectors, whitening
from trackloom.llm.common import crc_fold, new_path, read_table

PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"
TOKEN_LIMIT = 512
#: Components that a row is whitened to, and the size from which on 256 times a component doesn't fit a long with room to spare.
COMPONENTS, WHOLE = 4, float(1 << 52)


def held_out(folds: int, fold: int):
    """Whether a row is kept from learning; rows without an id are."""
    return F.coalesce(crc_fold("doc_id", folds) == fold, F.lit(True))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    net = toxicity.fit(docs, labels, ~held_out(5, 0))
    scored = toxicity.with_toxicity(docs.select("doc_id", "text"), net, out="score")
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return done.select("doc_id", "n_lines", "n_removed", spans.alias("removed"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return spbpe.with_digests(docs, public_tokenizers.path(PIECE_MODEL)).drop("text")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    samples = langid.fit(docs, "lang", "text", "doc_id", ~held_out(4, 2))
    return langid.with_language(docs.select("doc_id", "text"), samples).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "accepted")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.with_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spell = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    number = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda x: x["kind"] != "random")
    return found.select("doc_id", number("assign").alias("n_assign"), number("access").alias("n_access"), number("hex").alias("n_hex"), F.sha2(spell(base).cast("binary"), 256).alias("base_sha256"), spell("secrets").alias("spans"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_boilerplate_words")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_benchmark(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arrivals of the table's rows, compacted; where each row has come to lie."""
    docs = read_table(spark, sf_dir, "documents")
    store = shards.ShardStore(spark, new_path(spark, "shards"))
    late = F.coalesce(crc_fold("doc_id", 4) == 0, F.lit(False))
    store.append(docs.where(~late))
    store.append(docs.where(late))
    done = store.compact()
    store.vacuum()
    listed = spark.createDataFrame([(s.path, s.order, s.tier, s.size) for s in done.shards], "_shard string, shard int, tier int, shard_bytes long")
    rows = store.read().select("doc_id", F.length("text").cast("long").alias("n_chars"), "_shard")
    return rows.join(F.broadcast(listed), "_shard").select("doc_id", "n_chars", "shard", "tier", "shard_bytes", F.lit(done.version).alias("version"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = tokencount.with_token_count(docs, public_tokenizers.path(BYTE_MODEL))
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text beside itself with the second half put in from the next document, and beside that document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    paired = succession.with_next(docs, "doc_id", ("text",), {"text": "next_text", "sketch": "next_sketch"}, lambda df: sketch.with_sketch(df))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = paired.select("*", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)).alias("edited"))
    both = sketch.with_sketch(edited, "edited", "edited_sketch")
    near = {"near_edited": sketch.resemblance("sketch", "edited_sketch"), "near_next": sketch.resemblance("sketch", "next_sketch"), "kept_in_edited": sketch.containment("sketch", "edited_sketch"), "n_shingles": sketch.distinct(F.col("sketch"))}
    return both.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), sketch.spelled("sketch").alias("fingerprint"), sketch.spelled("edited_sketch").alias("edited_fingerprint"), *[c.alias(n) for n, c in near.items()])


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.integer_vectors(own, "embedding").select(F.col("vec_id").alias("id"), moved.alias("label"), "x")
    return negatives.mine(rows, F.col("id") % 50 == 0)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    rows = vectors.integer_vectors(own, "embedding", most=WHOLE).select("vec_id", "x")
    made = whitening.fit(rows)
    if made is None:
        return spark.createDataFrame([], "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    model, once = made
    explained = F.array(*map(F.lit, model.explained(COMPONENTS)))
    spread = whitening.apply(rows, model, COMPONENTS, ("vec_id",)).select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    error = whitening.identity_error(once, model, COMPONENTS)
    return spread.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_line_dedup, op3_sentencepiece, op4_language, op5_secrets, op6_quality, op7_decontamination, op8_sharding, op9_simhash, op10_token_count, op11_fingerprints, op12_hard_negatives, op13_whitening)}
