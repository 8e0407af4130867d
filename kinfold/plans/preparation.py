"""Queries of the general data-preparation operators (p1, p2, p5) with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators import packed, records, skew


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def utc_month(c: str) -> Column:
    """yyyy-MM in UTC, whatever zone the session has."""
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    out = packed.split_packed(read(spark, sf, "sam_entities"), "uei", ["all_naics", "psc_codes"], r"[^\W_]")
    return out.select("uei", "field_name", "pos", "value_text").distinct()


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "vendor_shipments").withColumn("ship_month", utc_month("shipped_at"))
    keys = ["country_of_origin", "vendor_name", "ship_month"]
    return skew.lower_median_rows(rows, keys, ["weight_kg", "shipment_id"]).select(*keys, "shipment_id")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return records.failed_lines(read(spark, sf, "sam_raw")).select("line_id", "reason").distinct()


def p5_valid(spark: SparkSession, sf: str) -> DataFrame:
    return records.valid_records(read(spark, sf, "sam_raw"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p5_found": p5_found, "p5_valid": p5_valid}

_P1 = r"""
SELECT DISTINCT uei, field_name, CAST(u.pos AS INTEGER) AS pos, u.v AS value_text FROM (
 SELECT uei, field_name, list_filter(list_transform(
   regexp_extract_all(field_text, '"(?:[^"]|"")*"|[\pL\pN]+'),
   lambda t: CASE WHEN t LIKE '"%' THEN replace(substr(t, 2, length(t) - 2), '""', '"') ELSE t END), lambda t: t <> '') AS vs
 FROM (SELECT uei, 'all_naics' AS field_name, all_naics AS field_text FROM sam_entities UNION ALL SELECT uei, 'psc_codes', psc_codes FROM sam_entities) s
 WHERE field_text IS NOT NULL) x, LATERAL (SELECT unnest(vs) AS v, generate_subscripts(vs, 1) AS pos) u
"""

_P2 = """
WITH d AS (SELECT DISTINCT country_of_origin, vendor_name, strftime(shipped_at AT TIME ZONE 'UTC', '%Y-%m') AS ship_month, weight_kg, shipment_id
  FROM vendor_shipments WHERE country_of_origin IS NOT NULL AND vendor_name IS NOT NULL AND weight_kg IS NOT NULL AND shipped_at IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY country_of_origin, vendor_name, ship_month ORDER BY weight_kg, shipment_id) AS rn,
  count(*) OVER (PARTITION BY country_of_origin, vendor_name, ship_month) AS n FROM d)
SELECT country_of_origin, vendor_name, ship_month, shipment_id FROM r WHERE rn = (n + 1) // 2
"""

_FIELD = r'(?:"(?:[^"]|"")*"|[^"|][^|]*|)'
_BLANK = r"[\s\pZ\x{85}\x{1C}-\x{1F}\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{180E}\x{2800}\x{3164}\x{115F}\x{1160}\x{FFA0}\x{AD}]*"
_LINES = rf"""
WITH l AS (SELECT line_id, raw_line, regexp_full_match(raw_line, '(?s){_FIELD}(?:\|{_FIELD})*') AS sound,
  list_transform(regexp_extract_all(raw_line || '|', '(?s)({_FIELD})\|', 1),
    lambda t: CASE WHEN t LIKE '"%' THEN replace(substr(t, 2, length(t) - 2), '""', '"') ELSE t END) AS f
 FROM sam_raw WHERE raw_line IS NULL OR NOT (raw_line LIKE 'BOF %' OR raw_line = '!end')),
j AS (SELECT *, CASE WHEN NOT sound THEN 'quoting' WHEN sound IS NULL OR len(f) <> 8 THEN 'column_count'
  WHEN NOT regexp_full_match(f[1], '[A-HJ-NP-Z0-9]{{12}}') THEN 'uei'
  WHEN length(f[4]) > 120 OR regexp_full_match(f[4], '{_BLANK}') OR regexp_matches(f[4], '[\x{{0}}-\x{{1F}}\x{{7F}}-\x{{9F}}\x{{FFFD}}]') THEN 'legal_name'
  WHEN NOT regexp_full_match(f[6], '[0-9]{{8}}') OR NOT regexp_full_match(f[7], '[0-9]{{8}}')
    OR try_strptime(f[6], '%Y%m%d') IS NULL OR try_strptime(f[7], '%Y%m%d') IS NULL THEN 'date' END AS reason FROM l)
"""

SQL = {
    "p1_found": _P1,
    "p2_found": _P2,
    "p5_found": _LINES + " SELECT DISTINCT line_id, reason FROM j WHERE reason IS NOT NULL",
    "p5_valid": _LINES
    + """ SELECT line_id, f[1] AS uei, f[2] AS cage_code, f[3] AS status, f[4] AS legal_name, f[5] AS country,
    CAST(strptime(f[6], '%Y%m%d') AS DATE) AS initial_registration_date, CAST(strptime(f[7], '%Y%m%d') AS DATE) AS expiration_date,
    f[8] AS primary_naics FROM j WHERE reason IS NULL""",
}
