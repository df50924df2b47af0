"""The registered query of each operator: the operator over its whole table, with the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import embedding_dedup, licenses, minhash_dedup, mixing
from graphloom.llm.decontamination import contaminated
from graphloom.llm.embedding_dedup import near_vectors
from graphloom.llm.language_id import identify
from graphloom.llm.lm_scoring import score_texts
from graphloom.llm.minhash_dedup import near_duplicates
from graphloom.llm.quality import quality_scores
from graphloom.llm.sampling import fold
from graphloom.llm.secrets import find_secrets
from graphloom.llm.tables import read
from graphloom.llm.token_counts import EDITS, count_tokens


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the item: one row per pair."""
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).selectExpr("id as doc_id", "size", "source_size", "target", "taken")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits to every document, at places that its id determines: a replacement, a deletion, an insertion."""
    at = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), F.length(F.coalesce("text", F.lit(""))) + 1)
    change = lambda k, cut, new: F.struct(at(k).alias("start"), (at(k) + cut).alias("end"), F.lit(new).alias("text"))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.array(change(1, 12, "edited text 42"), change(2, 7, ""), change(3, 0, " don't ")).cast(EDITS).alias("edits"))
    return count_tokens(docs, "edits").withColumnRenamed("id", "doc_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return scores.select(F.col("id").alias("doc_id"), (fold(F.col("id"), 3) == 1).alias("held_out"), "score", "predicted")


def license_digest(found: DataFrame) -> DataFrame:
    at = F.col("base_places.at")
    joined = lambda labels: F.array_join(labels, ",")
    every = F.array_sort(F.array_union("base_labels", "found.label"))
    return found.select(F.col("id").alias("doc_id"), "n_words", F.size(at).cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), joined("base_labels").alias("base_labels"), joined(every).alias("labels"), F.round("score", 9).alias("score"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(licenses.scan(read(spark, sf_dir, "documents")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(read(spark, sf_dir, "documents"), fold(F.col("doc_id"), 4) != 2)
    return found.select(F.col("id").alias("doc_id"), (fold(F.col("id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))))
    base = F.sha2(listed(F.filter("spans", lambda s: s.kind != "crf")), 256)
    return found.select(F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), base.alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_source_mixing": op2_source_mixing,
    "op3_token_counts": op3_token_counts,
    "op4_quality": op4_quality,
    "op5_license_scan": op5_license_scan,
    "op6_language_id": op6_language_id,
    "op7_secret_scan": op7_secret_scan,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_minhash_dedup": op10_minhash_dedup,
}

#: DuckDB SQL, for those that SQL can express.
SQL: dict[str, str] = {"op2_source_mixing": mixing.SQL, "op5_license_scan": licenses.SQL, "op9_embedding_dedup": embedding_dedup.SQL, "op10_minhash_dedup": minhash_dedup.SQL}
