"""Writing intermediate tables where every executor sees them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where spark.checkpoint.dir is unset and everything runs on one machine, as in tests.
LOCAL_SHARED = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Without it only a local master works: other machines wouldn't see the tables."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder or LOCAL_SHARED


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: it cuts lineage
    and, unlike a local checkpoint, outlives the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillgraph/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> None:
    """Deletes what ``stored`` has written for this application; results that read it must be written by then."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/quillgraph/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
