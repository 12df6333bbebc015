"""Empty tables, and tables of one row over and over."""

import public_tokenizers

from pyspark.sql import functions as F
from resonar.llm.quality_rules import apply_rules
from resonar.llm.sentencepieces import decode, encode, round_trip
from resonar.llm.sharding import shard_documents

from .helpers import frame

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_empty_tables_give_empty_tables(spark):
    none = frame(spark, [])
    assert apply_rules(none).collect() == [] and shard_documents(none).collect() == []
    assert encode(none, PIECES).collect() == [] and round_trip(none, PIECES).collect() == []
    assert decode(encode(none, PIECES), PIECES).collect() == []


def test_equal_rows_by_the_thousand_are_spread_evenly(spark):
    same = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one text").alias("text"))
    got = shard_documents(same).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last")).collect()
    assert len(got) == 40 and all(r.n == 500 == r.slots == r["last"] + 1 for r in got)
