"""Incremental scan (an extension): a stream of resources keeps a history of signals, each batch merged on demand.

The reference has no streaming; its notion of scanning again and gathering history is served here by Structured
Streaming: new resource files become signals once, and projects are formed over the history when asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import cluster, merge, order
from ..plans import pipeline


def keep_history(spark: SparkSession, source: str, schema: StructType | str, history: str, checkpoint: str, once: bool = True, **options) -> StreamingQuery:
    """Append the signals of new Parquet files under source to history, one folder a batch.

    A batch that is run again after a failure overwrites its own folder, so every file counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        found = pipeline.signals(pipeline.chunks(batch), **options)
        found.withColumn("batch", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{history}/batch_no={number}")

    writer = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def projects(spark: SparkSession, history: str, merge_threshold: float = cluster.THRESHOLD) -> DataFrame:
    """Merged, ranked projects of the whole history; arrival is batch, then site, resource and chunk."""
    rows = spark.read.parquet(history).drop("batch_no")
    arrived = pipeline.numbered(rows.withColumn("site_no", F.struct("batch", "site_no"))).drop("batch")
    return order.ranked(merge.merged(cluster.assign(arrived, merge_threshold)))
