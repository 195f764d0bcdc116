"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finlark.llm import decontam, dedup, fingerprint, language_id, lm, neardup, oracles, pieces, pii, quality, resample, secrets, sharding, vector_codes
from finlark.llm.common import crc_mod, table


def model_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the installed public tokenizer files are; each executor has them."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    model = quality.fit(quality.labelled_sample(docs, labels))
    return quality.score(docs.withColumn("held_out", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))), model).select("doc_id", "held_out", "score", "predicted")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(crc_mod("doc_id", 4) != 2))
    held = docs.select("doc_id", "text", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"))
    return language_id.classify(held, model).select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [r.kind for r in secrets.RULES if r.base]

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in base]
    digest = F.sha2(secrets.listed(F.filter("spans", lambda s: s["kind"].isin(base))), 256)
    return found.select("doc_id", "spans").select("doc_id", *counts, digest.alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 8)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model_path()).select("doc_id", "n_tokens", "round_trip", "ids")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), crc_mod("doc_id", 7) != 2, min_count=1)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs)).select("doc_id", "base_spans", F.concat("base_spans", "added_spans").alias("all_spans"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{pii.KINDS[kind]}")

    return found.select("doc_id", *map(count, range(len(pii.KINDS))), F.sha2(pii.listed("base_spans"), 256).alias("base_sha256"), pii.listed("all_spans").alias("spans"))


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.search(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op13_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op2_pii."""
    return op2_pii(spark, sf_dir).drop("spans")


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op7_lm."""
    return op7_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def shard_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether op9_sharding keeps its law: all rows, slots without gaps, sizes within 0.1 % or one row of the mean."""
    each = op9_sharding(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.max("size").alias("most"), F.min("slot").alias("first"), F.max("slot").alias("last"), F.countDistinct("slot").alias("slots"))
    gapless = F.bool_and((F.col("first") == 0) & (F.col("last") == F.col("n") - 1) & (F.col("slots") == F.col("n"))).alias("gapless")
    mean = F.sum("b") / F.count("*")
    balanced = (F.greatest(F.max("b") - mean, mean - F.min("b")) <= F.greatest(mean * 0.001, F.max("most"))).alias("balanced")
    return each.agg(F.sum("n").alias("docs"), F.sum("b").alias("bytes"), F.count("*").alias("shards"), gapless, balanced)


def fingerprint_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op8_fingerprint."""
    return op8_fingerprint(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op9_sharding, row by row."""
    return op9_sharding(spark, sf_dir).select("doc_id", "size", "law")


QUERIES = {
    "op1_quality": op1_quality, "op2_pii": op2_pii, "op3_language": op3_language, "op4_secrets": op4_secrets, "op5_decontam": op5_decontam, "op6_pieces": op6_pieces, "op7_lm": op7_lm, "op8_fingerprint": op8_fingerprint,
    "op9_sharding": op9_sharding, "op10_neardup": op10_neardup, "op11_resample": op11_resample, "op12_vector_codes": op12_vector_codes, "op13_dedup": op13_dedup, "pii_base": pii_base, "lm_base": lm_base, "shard_balance": shard_balance,
    "fingerprint_base": fingerprint_base, "shard_rows": shard_rows,
}

ORACLE_SQL = {"op4_secrets": oracles.OP4_SECRETS, "op10_neardup": oracles.OP10_NEARDUP, "op11_resample": oracles.OP11_RESAMPLE, "op12_vector_codes": oracles.op12_vector_codes(), "op13_dedup": oracles.OP13_DEDUP, "pii_base": oracles.PII_BASE, "lm_base": oracles.LM_BASE, "shard_balance": oracles.SHARD_BALANCE, "fingerprint_base": oracles.FINGERPRINT_BASE, "shard_rows": oracles.SHARD_ROWS}
