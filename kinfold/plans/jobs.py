"""Batch jobs: clustering by block into a partitioned table, with resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators.cluster import cluster
from kinfold.sources import readers, sinks


def cluster_by_block(df: DataFrame, name_col: str = "vendor_name", partition_col: str = "country_of_origin", only: list[str] | None = None, **options) -> DataFrame:
    """(partition_col, name_col, cluster_id, canonical_name) of the distinct names of each block, ids from 0 in each. All
    blocks are clustered in one plan; a null block is left out."""
    rows = df.select(F.col(f"`{name_col}`"), F.col(f"`{partition_col}`")).where(F.col(f"`{partition_col}`").isNotNull())
    if only:
        rows = rows.where(F.col(f"`{partition_col}`").isin(only))
    return cluster(rows.distinct(), name_col, block_col=partition_col, **options)


def cluster_job(spark: SparkSession, source: str, target: str, name_col: str = "vendor_name", partition_col: str = "country_of_origin", only: list[str] | None = None, skip_existing: bool = False, **options) -> DataFrame:
    """cluster_by_block from a parquet to <target>/<partition_col>=<value>/; gives the table's statistics by block."""
    df = readers.parquet(spark, source, [name_col, partition_col])
    if skip_existing and (done := sinks.existing_partitions(spark, target, partition_col)) is not None:
        df = df.join(done.withColumnRenamed(partition_col, "__done"), F.col(f"`{partition_col}`").cast("string") == F.col("__done"), "left_anti")
    sinks.partitioned(cluster_by_block(df, name_col, partition_col, only, **options), target, partition_col)
    return block_statistics(spark.read.parquet(target), partition_col)


def block_statistics(clustered: DataFrame, partition_col: str) -> DataFrame:
    """(block, rows, clusters, null_rows)."""
    return clustered.groupBy(F.col(f"`{partition_col}`").alias("block")).agg(
        F.count("*").alias("n_rows"), F.count_distinct("cluster_id").alias("n_clusters"), F.count_if(F.col("cluster_id").isNull()).alias("n_null")
    )
