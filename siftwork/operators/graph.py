"""Connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop_path, work_path


def components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 40) -> DataFrame:
    """Connected components of an edge list as (node, component), component being the smallest node.

    Alternating large-star and small-star passes (O(log n) rounds), each written to the shared
    folder. Stars are joins and pre-aggregated minima, so a hub node is never gathered in one task.
    Self-edges and repeated edges are allowed. Nodes without an edge do not appear.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    cur, cur_path = None, None
    for k in range(rounds):
        first = e if cur is None else cur
        both = first.select("u", "v").union(first.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every neighbour larger than u hangs on u's minimum
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours hang on the smallest of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .union(down.select("u", F.col("m").alias("v"))).distinct())
        path = work_path(spark, "components")
        small.write.parquet(path)
        new = spark.read.schema("u bigint, v bigint").parquet(path)
        stable = new.groupBy("u").count().where("count > 1").isEmpty() and new.join(
            new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty()
        if cur_path:
            drop_path(spark, cur_path)
        cur, cur_path = new, path
        if stable:
            break
    else:
        raise RuntimeError("components did not converge")
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
