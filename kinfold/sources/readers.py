"""Readers of the registers' file formats, and small helpers of scans."""

from __future__ import annotations

import glob
import warnings
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The registration extract has 142 fields without header; those read, by position from 1.
EXTRACT_FIELDS = 142
EXTRACT_POSITIONS = {
    "uei": 1, "cage_code": 4, "status": 6, "purpose_of_registration": 7, "initial_registration_date": 8, "expiration_date": 9, "legal_name": 12,
    "dba_name": 13, "physical_addr_street1": 16, "physical_addr_city": 18, "physical_addr_state": 19, "physical_addr_zip": 20,
    "physical_addr_country": 22, "entity_structure_code": 28, "entity_country_of_incorp": 30, "primary_naics": 33, "all_naics": 35, "psc_codes": 37,
}


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*[f"`{c}`" for c in columns]) if columns else df


def has_column(spark: SparkSession, path: str, column: str) -> bool:
    """From the files' metadata only."""
    return column in spark.read.parquet(path).columns


def latest(pattern: str, spark: SparkSession | None = None) -> str | None:
    """The last path of a glob in order of names, None if there is none. With a session the pattern is one of any file
    system that Spark reads, else of this machine's."""
    if spark is None:
        paths = sorted(glob.glob(pattern))
    else:
        p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        paths = sorted(s.getPath().toString() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or [])
    return paths[-1] if paths else None


def unzipped(path: str, folder: str) -> str:
    """The only member of a zip, extracted to a folder that all executors see; other paths as they are."""
    if not zipfile.is_zipfile(path):
        return path
    with zipfile.ZipFile(path) as z:
        return z.extract(z.namelist()[0], folder)


def csv_selected(spark: SparkSession, path: str, columns: dict[str, str], folder: str | None = None) -> DataFrame:
    """A CSV (or zipped CSV) with header, all strings: columns maps output names to headers, which match after trimming.
    A missing header gives nulls and a warning."""
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(unzipped(path, folder) if folder else path)
    df = df.toDF(*[c.strip() for c in df.columns])
    if missing := [h for h in columns.values() if h not in df.columns]:
        warnings.warn(f"{path} has no column {', '.join(missing)}", stacklevel=2)
    return df.select(*[(F.col(f"`{h}`") if h in df.columns else F.lit(None).cast("string")).alias(n) for n, h in columns.items()])


def labels_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def registration_extract(spark: SparkSession, path: str, folder: str | None = None, active_only: bool = False) -> DataFrame:
    """The pipe-delimited extract: no header, no quoting, a first line starting with BOF; long rows are cut, short ones
    filled with nulls."""
    schema = T.StructType([T.StructField(f"f{i:03d}", T.StringType()) for i in range(1, EXTRACT_FIELDS + 1)])
    df = spark.read.schema(schema).option("sep", "|").option("quote", "").option("mode", "PERMISSIVE").csv(unzipped(path, folder) if folder else path)
    df = df.where(~F.coalesce(F.col("f001"), F.lit("")).startswith("BOF"))
    out = df.select(*[F.col(f"f{p:03d}").alias(n) for n, p in EXTRACT_POSITIONS.items()])
    return out.where("status = 'A'") if active_only else out


def sanctions_xml(spark: SparkSession, path: str) -> DataFrame:
    """(entity_id, entity_type, is_primary, alias_type, name): one row per name of each entity, in Latin script if there is
    a translation in it, else the first one."""
    translation = "struct<script: string, formattedFullName: string>"
    schema = (
        "_id string, generalInfo struct<entityType: string>, names struct<name: array<struct<isPrimary: string, aliasType: string,"
        f" translations: struct<translation: array<{translation}>>>>>"
    )
    df = spark.read.format("xml").option("rowTag", "entity").schema(schema).load(path)
    name = df.select(F.col("_id").alias("entity_id"), F.trim("generalInfo.entityType").alias("entity_type"), F.explode("names.name").alias("n"))
    full = F.filter("n.translations.translation", lambda t: F.length(F.trim(t["formattedFullName"])) > 0)
    latin = F.filter(full, lambda t: F.trim(t["script"]) == "Latin")
    best = F.coalesce(F.get(latin, 0), F.get(full, 0))["formattedFullName"]
    primary = F.coalesce(F.col("n.isPrimary") == "true", F.lit(False))
    kind = F.coalesce(F.trim("n.aliasType"), F.lit(""))
    return name.select(
        "entity_id", F.coalesce("entity_type", F.lit("")).alias("entity_type"), primary.alias("is_primary"),
        F.when(kind != "", kind).when(primary, F.lit("PRIMARY")).otherwise(F.lit("")).alias("alias_type"), F.trim(best).alias("name"),
    ).where("name is not null")


def entity_api_json(spark: SparkSession, path: str) -> DataFrame:
    """Nested records of the entity API, a line each (gzip or plain), to flat rows."""
    schema = (
        "entityRegistration struct<ueiSAM: string, uei: string, legalBusinessName: string, dbaName: string, initialRegistrationDate: string, registrationStatus: string>,"
        " coreData struct<physicalAddress: struct<stateOrProvinceCode: string, countryCode: string>, entityInformation: struct<entityStructureCode: string>>,"
        " assertions struct<goodsAndServices: struct<naicsList: array<struct<naicsCode: string, isPrimary: string>>>>"
    )
    df = spark.read.schema(schema).json(path)
    codes = F.transform(F.coalesce("assertions.goodsAndServices.naicsList", F.array().cast("array<struct<naicsCode:string,isPrimary:string>>")), lambda x: F.coalesce(x["naicsCode"], F.lit("")))
    main = F.get(F.filter("assertions.goodsAndServices.naicsList", lambda x: x["isPrimary"].isin("Y", "true")), 0)["naicsCode"]
    return df.select(
        F.coalesce("entityRegistration.ueiSAM", "entityRegistration.uei").alias("uei"),
        F.trim(F.coalesce("entityRegistration.legalBusinessName", F.lit(""))).alias("legal_name"),
        F.nullif(F.trim("entityRegistration.dbaName"), F.lit("")).alias("dba_name"),
        F.col("coreData.physicalAddress.stateOrProvinceCode").alias("state"), F.col("coreData.physicalAddress.countryCode").alias("country"),
        F.coalesce(main, F.get(codes, 0)).alias("primary_naics"), codes.alias("naics_codes"),
        F.col("coreData.entityInformation.entityStructureCode").alias("entity_structure"), F.col("entityRegistration.initialRegistrationDate").alias("registration_date"),
        F.col("entityRegistration.registrationStatus").alias("entity_status"),
    )


def in_memory(spark: SparkSession, data) -> DataFrame:
    """pandas, Arrow or a DataFrame of another library with to_arrow()."""
    return spark.createDataFrame(data.to_arrow() if hasattr(data, "to_arrow") else data)


def file_name(path: str) -> str:
    return Path(path).name
