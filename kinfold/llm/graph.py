"""Connected components of an edge table, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, comp): every node of ``edges`` (u, v) and the smallest node that it reaches.

    Large-star and small-star steps in turn, until the set of edges stays as it is, however many rounds that
    takes (about the logarithm of the longest path). Each round is written to the shared folder, so lineage
    stays short and a lost executor costs one round at most. Minima are pre-aggregated; a node with very many
    edges meets a one-row side in each join, which Spark can split.
    """
    spark = edges.sparkSession
    now = common.written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), folder, f"{name}_0")
    size, i, live = now.count(), 0, True
    while live:
        i += 1
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = common.sorted_join(both.where("v > u"), low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = common.sorted_join(large, low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = common.written(small, folder, f"{name}_{i}")
        before, size = size, after.count()
        live = size != before or not common.sorted_join(after, now, ["u", "v"], "left_anti").isEmpty()  # both hold distinct edges
        common.removed(spark, f"{folder}/{name}_{i - 1}")
        now = after
    common.forget(spark)
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
