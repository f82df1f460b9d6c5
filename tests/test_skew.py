"""Hot keys: one word / key holding a large share of the rows."""

import glob

from pyspark.sql import functions as F

from tests.conftest import SF_CHECK
from trendloom.operators import aggregate as agg
from trendloom.operators.append import append_new
from trendloom.plans import fixtures as fx
from trendloom.sources.tables import read_table, write_table


def _hot_facts(spark):
    li = fx.read(spark, SF_CHECK, "lineitem")
    word = F.when(F.col("l_linenumber") <= 3, F.lit("hot")).otherwise(
        F.concat(F.lit("w"), F.col("l_linenumber").cast("string")))
    return li.select(word.alias("word"),
                     F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("objectid"),
                     F.date_format("l_shipdate", "yyyy-MM-dd").alias("submission_date"),
                     F.lit("t").alias("title"),
                     F.date_format("l_shipdate", "yyyy-MM").alias("year_month"))


def test_hot_word_is_split_over_several_files(spark, tmp_dir):
    # AQE splits a skewed rebalance partition along map outputs: give the
    # write several input files, as a large input has
    _hot_facts(spark).repartition(8).write.parquet(f"{tmp_dir}/src")
    facts = spark.read.parquet(f"{tmp_dir}/src")
    total = facts.count()
    hot = facts.where(F.col("word") == "hot").count()
    assert hot > total / 3
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        write_table(facts, f"{tmp_dir}/keywords", "keywords")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    files = glob.glob(f"{tmp_dir}/keywords/word=hot/*.parquet")
    assert len(files) > 1                      # the hot word was written by several tasks
    back = read_table(spark, f"{tmp_dir}/keywords", "keywords")
    assert back.count() == total
    assert back.where(F.col("word") == "hot").count() == hot


def test_hot_word_counts_are_exact(spark):
    facts = _hot_facts(spark)
    wide = agg.wide_counts(facts, ["hot", "w5"], "title")
    sums = wide.agg(F.sum("hot").alias("hot"), F.sum("w5").alias("w5")).first()
    assert sums.hot == facts.where(F.col("word") == "hot").count()
    assert sums.w5 == facts.where(F.col("word") == "w5").count()


def test_hot_key_append_keeps_one_row(spark):
    li = fx.read(spark, SF_CHECK, "lineitem")
    # a third of the batch carries the same key
    hot = F.col("l_orderkey") % 3 == 0
    batch = li.select(F.when(hot, F.lit(-1)).otherwise(F.col("l_orderkey")).alias("k"),
                      F.col("l_extendedprice").alias("v"))
    existing = spark.createDataFrame([(-2, 0.0)], "k long, v double")
    out = append_new(existing, batch, ["k"], order=["v"])
    assert out.count() == batch.select("k").distinct().count()
    got = out.where(F.col("k") == -1).first().v
    assert got == batch.where(F.col("k") == -1).agg(F.min("v")).first()[0]
