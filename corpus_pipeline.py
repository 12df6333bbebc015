"""A training-data pipeline over `documents`: each stage is an operator of resonar.llm, written and read again.

Stages get (spark, docs, sf_dir). All but the last return the columns of documents; packing returns its pieces. All take
null, empty and very long texts, null and repeated ids, repeated rows, empty tables and further columns of any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resonar.llm.common import Scratch, fresh, with_rows
from resonar.llm.line_dedup import dedup_lines
from resonar.llm.near_dedup import near_groups
from resonar.llm.packing import pack_documents
from resonar.llm.quality_model import quality_filter
from resonar.llm.secrets import redact

#: Words that a worker remembers while packing: fewer than by default, as executors also hold what earlier stages left.
KNOWN = 200_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; rows and columns stay as they are."""
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that spread over many sites; n_chars follows the text. What had no other lines goes."""
    out = dedup_lines(docs)
    (gone,) = fresh(out, "_gone")
    out = out.withColumn(gone, F.col("n_removed") > 0)
    n_chars = F.when(F.col(gone), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.where(~F.col(gone) | (F.trim("text") != "")).withColumn("n_chars", n_chars).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, of the smallest doc_id; rows without words all stay. Rows are told apart by
    file and place, so null and repeated ids do not matter."""
    given, row = with_rows(docs, Scratch(spark, "near-rows"))
    first = near_groups(given, carry=tuple(row)).where("first").select(*row)
    return given.join(first, row, "left_semi").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced; n_chars follows the text, and stays where there is none."""
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return redact(docs).withColumn("n_chars", F.coalesce(length, F.col("n_chars"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents and their places in sequences; a null text is an empty one."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), known=KNOWN)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]

#: No SQL says what a trained classifier, a tokenizer or a packing decides; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    before = None
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
