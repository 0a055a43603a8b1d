"""Connected components of an edge table, over many tasks.

Every round each vertex takes the least label among its neighbours, tells it to the label
it had, and follows; so trees of labels merge and flatten together and the rounds grow
with the logarithm of the longest path. Minima are combined before they are shuffled and
joins on labels, of which one may be held by most vertices, have stored tables on both
sides, so that Spark can split hot partitions.
Each round is written to the shared folder, and the one before it deleted; nothing but a
count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from askloom.llm.stored import release, stored


def connected(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``id, root`` for every vertex of ``edges(a, b)``; ``root`` is its component's least id.

    Repeated edges, loops and both directions are fine; edges with a null end are ignored;
    no edges give no rows.
    """
    edges = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    both = stored(spark, edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(spark, both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("root")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("root").alias("near"))
        )
        heard = stored(
            spark,
            labels.join(near, "id").select("id", "root", F.least("root", "near").alias("near")),
            "heard",
        )
        if not heard.filter(F.col("near") < F.col("root")).limit(1).count():
            release(both, heard)
            return labels
        told = heard.groupBy(F.col("root").alias("old")).agg(F.min("near").alias("told"))
        told = stored(spark, told.filter(F.col("told") < F.col("old")), "told")
        followed = heard.withColumnRenamed("root", "old").join(told, "old", "left")
        step = followed.select("id", F.least("near", F.coalesce("told", "near")).alias("root"))
        labels, old = stored(spark, step, "labels"), labels
        release(old, heard, told)
