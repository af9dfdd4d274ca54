"""Joins whose keys are hot or missing."""

from collections import Counter

from pyspark.sql import functions as F

from docloom.operators import lifecycle, mining
from docloom.operators.joins import SALTS, salted_left_join


def hot_rows(spark, n=6000):
    """A third of the rows has one key, a third none."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50))
    return spark.range(n).select(F.col("id").alias("doc_id"), key.alias("low"), (F.col("id") % 7).alias("x"))


def test_same_rows_as_a_plain_left_join(spark):
    rows = hot_rows(spark).unionByName(hot_rows(spark, 30))  # repeated rows too
    side = spark.createDataFrame([("hot", 1), ("k5", 2), ("k9", 3), ("unused", 4)], "low string, y int")
    got = Counter(map(tuple, salted_left_join(rows, side, ["low"], ["doc_id"]).select("doc_id", "low", "x", "y").collect()))
    want = Counter(map(tuple, rows.join(side, "low", "left").select("doc_id", "low", "x", "y").collect()))
    assert got == want
    two = salted_left_join(rows, side.withColumn("x", F.lit(3).cast("bigint")), ["low", "x"], ["doc_id"])
    assert two.filter("y IS NOT NULL").count() == rows.join(side, "low").filter("x = 3").count()
    assert salted_left_join(rows.limit(0), side, ["low"], ["doc_id"]).collect() == []
    assert salted_left_join(rows, side.limit(0), ["low"], ["doc_id"]).filter("y IS NULL").count() == rows.count()


def test_no_partition_gets_the_hot_key_or_the_nulls(spark):
    rows = hot_rows(spark, 30_000)
    side = spark.createDataFrame([("hot", 1)], "low string, y int").hint("merge")
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        joined = salted_left_join(rows, side, ["low"], ["doc_id"])
        sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 30_000 and sizes[-1] < 30_000 / 3 / SALTS * 5  # unsalted: 10,000 hot ones and 10,000 nulls


def test_tokens_and_updates_use_it(spark):
    freq = hot_rows(spark).select("doc_id", "low", "x", F.lit("t1").alias("own_template_id"))
    templates = spark.createDataFrame([("t1", ["HOT", "k5"]), ("t2", ["hot"]), ("t3", ["hot"])], "template_id string, required_keywords array<string>")
    found = mining.with_collisions(freq, templates)
    assert "_salt" in found._jdf.queryExecution().analyzed().toString()
    counts = {r["low"]: r["collisions"] for r in found.select("low", "collisions").distinct().collect()}
    assert counts["hot"] == 2 and counts["k5"] == 0 and counts[None] == 0
    incoming = spark.createDataFrame([(1, "a", None)], "response_seq bigint, template_id string, existing_template_id string")
    assert "_salt" in lifecycle.resolve_targets(templates, incoming)._jdf.queryExecution().analyzed().toString()
