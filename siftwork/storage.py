"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; always through Spark's reader so any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, own temp folder only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{os.path.join(tempfile.gettempdir(), 'siftwork-checkpoints')}"
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/siftwork-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Cut lineage: write df as Parquet under the shared folder and read it back.

    release: let Spark delete the shuffle files of plans that nothing refers to any more, which it otherwise
    does whenever the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    if release:
        del df
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in any Hadoop file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that materialize() wrote; df must not be read again."""
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        if os.path.basename(path).startswith("siftwork-"):
            drop_path(df.sparkSession, path)
