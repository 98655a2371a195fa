"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where spark.checkpoint.dir is unset and the master is local: driver and executors are one process then.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints/loomseq"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; an error if a cluster names none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(found or LOCAL_CHECKPOINTS).rstrip('/')}/loomseq-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> bool:
    """Deletes all that this application has written to the shared folder; call it once results are stored elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
