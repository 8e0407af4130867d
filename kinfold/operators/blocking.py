"""Candidate pairs by MinHash-LSH."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.grams import Grams, Signer, band_keys
from kinfold.operators.features import NAMES_OF_A_STEP
from kinfold.session import tasks


def signatures(uniques: DataFrame, n: int = 3, permutations: int = 128, seed: int = 0) -> DataFrame:
    """(id, block, sig) of all names, in numpy."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signer(n, permutations, seed)
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "block": b["block"], "sig": [signer(t) for t in b["form"]]})

    return uniques.select("id", "block", "form").mapInPandas(sign, "id long, block string, sig array<long>")


def lsh_buckets(uniques: DataFrame, n: int = 3, bands: int = 32, rows: int = 4, seed: int = 0) -> DataFrame:
    """(block, band, bucket, id) of names with at least one gram. Names without grams would all share every bucket with
    score 0; they have no bucket."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signer(n, bands * rows, seed)
        for b in batches:
            for at in range(0, len(b), NAMES_OF_A_STEP):
                part = b.iloc[at : at + NAMES_OF_A_STEP]
                _, sigs = Grams(part["form"].tolist(), n).signatures(signer)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "block": part["block"].to_numpy(), "keys": list(band_keys(sigs, bands, rows))})

    # a small table would come in few files: names are spread over all tasks before each becomes bands rows
    spread = uniques.where(F.length("form") >= n).select("id", "block", "form").repartition(tasks(uniques.sparkSession))
    keyed = spread.mapInPandas(keys, "id long, block string, keys array<long>")
    return keyed.select("block", F.posexplode("keys").alias("band", "bucket"), "id")


def lsh_pairs(buckets: DataFrame) -> DataFrame:
    """(block, a, b), a < b: names that share a bucket (block, bucket and band, whichever are there; no block where there is
    none). If buckets has masks (features.profiles), pairs that share none of their rarest grams, and so can't reach the
    score, are left out before they are made distinct."""
    left = buckets.withColumnsRenamed({"id": "a", "mask1": "a1", "mask2": "a2"})
    right = buckets.withColumnsRenamed({"id": "b", "mask1": "b1", "mask2": "b2"})
    by = [c for c in ("block", "band", "bucket") if c in buckets.columns]
    pairs = left.join(right, by).where("a < b")
    if "mask1" in buckets.columns:
        pairs = pairs.where("(a1 & b1) <> 0 and (a2 & b2) <> 0")
    return pairs.select(*by[: "block" in by], "a", "b").distinct()


def gramless_pairs(uniques: DataFrame, n: int) -> DataFrame:
    """All pairs of names too short for a gram: they count only where a score of 0 is enough, and then all are asked for."""
    short = uniques.where(F.length("form") < n).select("block", "id")
    return short.withColumnRenamed("id", "a").join(short.withColumnRenamed("id", "b"), "block").where("a < b")
