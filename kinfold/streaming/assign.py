"""Arrivals assigned to known clusters by their normalized name, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinfold.functions.normalize import normalize_name


def cluster_table(clustered: DataFrame, name_col: str = "name") -> DataFrame:
    """(norm, cluster_id, canonical_name) of a clustered table; one row per normalized name."""
    named = clustered.select(normalize_name(F.col(f"`{name_col}`")).alias("norm"), "cluster_id", "canonical_name").where("norm <> '' and cluster_id is not null")
    return named.groupBy("norm").agg(F.min_by("cluster_id", "cluster_id").alias("cluster_id"), F.min_by("canonical_name", "cluster_id").alias("canonical_name"))


def assign(arrivals: DataFrame, known: DataFrame, name_col: str = "name") -> DataFrame:
    """arrivals (a stream or a table) with cluster_id and canonical_name of the known table; null where the name is new."""
    named = arrivals.drop("cluster_id", "canonical_name").withColumn("__norm", normalize_name(F.col(f"`{name_col}`")))
    return named.join(known.withColumnRenamed("norm", "__norm"), "__norm", "left").drop("__norm")


def start(arrivals: DataFrame, known_path: str, target: str, checkpoint: str, name_col: str = "name", once: bool = False) -> StreamingQuery:
    """Each batch joins the cluster table as it is then, and is appended to target; a batch that is repeated after a failure
    replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        known = batch.sparkSession.read.parquet(known_path)
        assign(batch, known, name_col).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
