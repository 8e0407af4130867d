"""Writers: parquet, partitioned parquet with resume, CSV, a cache and reports."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def parquet(df: DataFrame, path: str, compression: str = "zstd", mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", compression).parquet(path)


def existing_partitions(spark: SparkSession, path: str, column: str) -> DataFrame | None:
    """(column) of the partitions a folder already has, from their names only."""
    if not _exists(spark, path):
        return None
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs_path)]
    unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    values = [(unescape(n.split("=", 1)[1]),) for n in names if n.startswith(f"{column}=")]
    return spark.createDataFrame(values, f"`{column}` string")


def partitioned(df: DataFrame, path: str, column: str, skip_existing: bool = False) -> None:
    """<path>/<column>=<value>/; rows with a null value are left out. skip_existing keeps partitions that are there and
    drops their rows before any work is done on them; otherwise they are replaced, and only they."""
    spark = df.sparkSession
    rows = df.where(F.col(f"`{column}`").isNotNull())
    if skip_existing and (done := existing_partitions(spark, path, column)) is not None:
        rows = rows.join(done.withColumnRenamed(column, "__done"), F.col(f"`{column}`").cast("string") == F.col("__done"), "left_anti")
    # a hot value is written by many tasks: rows are spread by value and a salt
    spread = rows.repartition(F.col(f"`{column}`"), F.pmod(F.monotonically_increasing_id(), F.lit(16)))
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(column).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    """One file with header, for small tables that people read."""
    df.coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """Read-through: what make gives is written once and read from then on."""
    if rebuild or not _exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def report(tables: dict[str, DataFrame], json_path: str, markdown_path: str, most: int = 100) -> None:
    """Small tables as JSON and Markdown. A table of more rows than `most` is an error, and nothing is written."""
    data = {name: [r.asDict(True) for r in df.limit(most + 1).collect()] for name, df in tables.items()}
    if large := [name for name, rows in data.items() if len(rows) > most]:
        raise ValueError(f"more than {most} rows in {', '.join(large)}")
    with open(json_path, "w") as f:
        json.dump(data, f, indent=1, default=str)
    lines = []
    for name, rows in data.items():
        lines += [f"## {name}", ""]
        if rows:
            lines += ["| " + " | ".join(rows[0]) + " |", "|" + "---|" * len(rows[0])]
            lines += ["| " + " | ".join(str(v) for v in r.values()) + " |" for r in rows]
        lines.append("")
    with open(markdown_path, "w") as f:
        f.write("\n".join(lines))
