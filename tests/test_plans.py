"""Plan-shape checks: the properties the scale design relies on."""

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from trendloom.plans import fixtures as fx
from trendloom.plans import registry


import contextlib
import io


def _explain(df, extended: bool) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(extended=extended)
    return buf.getvalue()


def plan(df) -> str:
    return _explain(df, False)


def optimized(df) -> str:
    text = _explain(df, True)
    return text[text.index("== Optimized Logical Plan =="):text.index("== Physical Plan ==")]


def test_matching_is_an_equi_join_not_a_cartesian_product(spark):
    p = plan(registry.t7_story_postings(spark, SF_SMALL))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "BroadcastHashJoin" in p
    assert "PythonUDF" not in p and "ArrowEvalPython" not in p   # no Python in the hot path


def test_cursor_bound_reaches_the_scan(spark):
    from trendloom.operators.ingest import select_new
    orders = fx.read(spark, SF_SMALL, "orders")
    existing = orders.where(F.col("o_orderdate") < "1998-01-01").select(
        F.col("o_orderkey").alias("created_at_i"))
    incoming = orders.select(F.col("o_orderkey").alias("created_at_i"), "o_totalprice")
    p = plan(select_new(incoming, existing, "latest"))
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey," in p


def test_columns_are_pruned_at_the_scan(spark):
    p = plan(registry.q4_submission_trend(spark, SF_SMALL))
    assert "ReadSchema: struct<l_partkey:bigint,l_shipdate:timestamp_ntz>" in p
    assert "ReadSchema: struct<p_partkey:bigint,p_name:string>" in p


def test_wide_matrix_is_one_aggregation_over_the_facts(spark):
    p = plan(registry.q4_submission_trend(spark, SF_SMALL))
    assert p.count("HashAggregate") == 2          # partial + final, no separate pivot
    assert "SortAggregate" not in p


def test_fact_table_filters_prune_months_and_words(spark, tmp_dir):
    from trendloom.plans import api
    from trendloom.sources.tables import read_table, write_table
    store = api.refresh(fx.doc_stories(spark, SF_SMALL), fx.hiring_comments(spark, SF_SMALL),
                        fx.doc_dictionary(), tmp_dir)
    point = (F.col("word") == "the") & (F.col("year_month") == "2019-03")
    p = plan(store.read("keywords").where(point))
    assert "PartitionFilters: [isnotnull(year_month" in p and "EqualTo(word,the)" in p
    # a table written by itself has a folder for each word
    write_table(store.read("keywords"), f"{tmp_dir}/by_word", "keywords")
    p = plan(read_table(spark, f"{tmp_dir}/by_word", "keywords").where(point))
    assert "PartitionFilters: [isnotnull(word" in p and "EqualTo(year_month,2019-03)" in p


def test_samples_are_top_k_not_a_global_sort(spark):
    p = plan(registry.q5_submission_samples(spark, SF_SMALL))
    assert "TakeOrderedAndProject" in p
    p = plan(registry.i5_newest_batch(spark, SF_SMALL))
    assert "TakeOrderedAndProject" in p


def test_dictionary_is_folded_into_the_projection(spark):
    o = optimized(registry.t5_match_set(spark, SF_SMALL))
    assert "array_intersect" in o and "Join" not in o


def test_spread_is_a_no_op_on_multi_split_input(spark, tmp_dir):
    from trendloom.operators.partitioning import spread
    one_split = fx.read(spark, SF_SMALL, "documents")
    assert "Exchange" in plan(spread(one_split, "doc_id"))
    cores = spark.sparkContext.defaultParallelism
    one_split.repartition(cores * 2).write.parquet(f"{tmp_dir}/docs")
    many = spark.read.parquet(f"{tmp_dir}/docs")
    assert many.rdd.getNumPartitions() >= cores
    assert spread(many, "doc_id") is many
