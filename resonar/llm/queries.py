"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup, oracles, quality_rules, vector_codes
from .common import Scratch
from .embedding_dedup import near_vectors
from .lm_scoring import score_documents
from .near_dedup import near_groups
from .packing import pack_documents
from .quality_model import classify
from .repeats import run_digests
from .secrets import scan
from .sentencepieces import round_trip
from .sharding import shard_documents
from .token_files import token_digests


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents"))


def op1_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "n_lines", "n_removed")


def op2_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"))


def op5_char_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_table(spark, sf_dir, "documents"))


def op6_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(_table(spark, sf_dir, "documents"))


def op7_projection_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op8_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress_vectors(_table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(_table(spark, sf_dir, "documents"), repeats=True)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{Scratch(spark, 'files').base}/files"
    return token_digests(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), folder)


# ---- what SQL can say of results that it cannot say whole
def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op3_context_mixing(spark, sf_dir)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_char_network(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and distinct slots from 0 of each shard."""
    return op2_hypergeometric_shards(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n_rows"), (F.max("slot") + 1).alias("n_slots"))


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_hypergeometric_shards(spark, sf_dir).select("doc_id", "size", "law")


def quality_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_factorisation_machine(spark, sf_dir).select("doc_id", "held_out")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_spread": op1_line_spread,
    "op2_hypergeometric_shards": op2_hypergeometric_shards,
    "op3_context_mixing": op3_context_mixing,
    "op4_minhash": op4_minhash,
    "op5_char_network": op5_char_network,
    "op6_rule_table": op6_rule_table,
    "op7_projection_passes": op7_projection_passes,
    "op8_factorisation_machine": op8_factorisation_machine,
    "op9_best_two_fit": op9_best_two_fit,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_vector_codes": op11_vector_codes,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_files": op13_token_files,
    "lm_base_scores": lm_base_scores,
    "secret_base_counts": secret_base_counts,
    "shard_rows": shard_rows,
    "shard_sizes": shard_sizes,
    "quality_held_out": quality_held_out,
}
ORACLES: dict[str, str] = {
    "op1_line_spread": line_dedup.ORACLE,
    "op4_minhash": oracles.NEAR,
    "op6_rule_table": quality_rules.ORACLE,
    "op7_projection_passes": oracles.VECTORS,
    "op11_vector_codes": vector_codes.ORACLE,
    "lm_base_scores": oracles.LM_BASE,
    "secret_base_counts": oracles.SECRET_COUNTS,
    "shard_rows": oracles.SHARD_ROWS,
    "shard_sizes": oracles.SHARD_SIZES,
    "quality_held_out": oracles.HELD_OUT,
}
