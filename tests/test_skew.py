"""Joins whose long side has one hot key are spread over tasks."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from askloom.operators import context, sessions
from askloom.plans import skew

SHUFFLED_JOINS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
}


@pytest.fixture
def shuffled(spark):
    before = {k: spark.conf.get(k, None) for k in SHUFFLED_JOINS}
    for key, value in SHUFFLED_JOINS.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_spread_join_equals_a_plain_join(spark, how):
    i = F.col("id")
    key = F.when(i % 3 == 0, F.lit("hot")).when(i % 3 == 1, F.lit(None)).otherwise((i % 500).cast("string"))
    long = spark.range(20000).select(key.alias("k"), i.alias("n"))
    for keep in ["k <> '8'", "k <> 'hot'", "k = 'none'"]:
        unique = long.select("k").distinct().filter(keep).withColumn("v", F.upper("k"))
        assert rows(skew.spread_join(long, unique, "k", how).fillna("-")) == rows(
            long.join(unique, "k", how).fillna("-")
        )


def largest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) / sum(sizes)


def test_history_of_one_hot_session_is_spread(spark, shuffled):
    i = F.col("id")
    memory = spark.range(60000).select(
        F.when(i % 3 == 0, F.lit(-1)).otherwise(i).alias("session_id"),
        i.alias("position"),
        F.lit("user").alias("role"),
        i.cast("string").alias("content"),
    )
    requests = memory.select("session_id").distinct().withColumn("question", F.lit("?"))
    requests = requests.withColumn("request_id", F.col("session_id"))
    plain = memory.join(requests, "session_id")
    assert largest_share(plain) > 0.35
    sent = sessions.request_messages(requests, memory)
    assert sent.count() == 60000 + 2 * 40001
    spread = skew.spread_join(memory, requests.select("session_id"), "session_id")
    assert largest_share(spread) < 0.2


def test_texts_of_one_hot_hit_are_spread(spark, shuffled):
    i = F.col("id")
    hits = spark.range(60000).select(
        F.sha2(i.cast("string"), 256).alias("query_id"),
        F.lit(1).alias("rank"),
        F.when(i % 3 == 0, F.lit(-1)).otherwise(i).cast("long").alias("id"),
        F.lit(0.5).alias("score"),
    )
    texts = spark.range(-1, 60000).select("id", F.lit("x").alias("text"))
    assert largest_share(hits.join(texts, "id")) > 0.35
    joined = context.with_text(hits.repartition(8), texts.filter("id <> 1"))
    assert joined.count() == 60000 and joined.filter("text = ''").count() == 1
    assert largest_share(joined) < 0.2


def test_joint_keys_match_nulls(spark, shuffled):
    long = spark.createDataFrame([(None, 1, "a"), (2, None, "b"), (2, 2, "c")], "x int, y int, v string")
    keys = spark.createDataFrame([(None, 1), (2, None)], "x int, y int")
    assert sorted(r["v"] for r in skew.spread_join(long, keys, ["x", "y"]).collect()) == ["a", "b"]
    maps = long.withColumn("m", F.create_map(F.lit("k"), F.col("v")))
    assert skew.spread_join(maps, keys, ["x", "y"], "left_anti").count() == 1
