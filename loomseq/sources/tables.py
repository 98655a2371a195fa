"""Tables and indexes as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomseq.operators import fm


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than cores, dealt to all cores: for work on rows that costs far more than moving them.

    Files, not splits, tell: a file of one row group is read by one task, however many splits it has.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def save_index(df: DataFrame, key: str, data: str, path: str) -> None:
    """Builds the compact index of a text or binary column and writes it: built once, searched by any later session."""
    fm.index_bytes(df, key, data).write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
