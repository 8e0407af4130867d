"""Cosine scores of pairs of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.grams import ngrams
from kinfold.functions.normalize import let
from kinfold.operators.blocking import gramless_pairs, lsh_pairs
from kinfold.operators.features import profiles, tfidf_vectors
from kinfold.session import cut, release

#: Scores are compared after rounding, so sums of floating numbers can't move a pair over a threshold.
DIGITS = 6


def dot(a: str, b: str):
    """Sum over the entries of a, in their order, so it is the same in every run."""
    # the map is built once per pair, not once per entry
    return let(
        F.map_from_arrays(f"grams_{b}", f"weights_{b}"),
        lambda other: F.aggregate(F.arrays_zip(f"grams_{a}", f"weights_{a}"), F.lit(0.0), lambda s, e: s + e[f"weights_{a}"] * F.coalesce(F.try_element_at(other, e[f"grams_{a}"]), F.lit(0.0))),
    )


def score_pairs(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """(block, a, b, score) of pairs (a, b) whose vectors (features.profiles) are in one block."""
    side = lambda s: profiles.selectExpr(f"id as {s}", f"block as block_{s}", f"grams as grams_{s}", f"weights as weights_{s}")
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where("block_a = block_b")
    return joined.select(F.col("block_a").alias("block"), "a", "b", F.round(dot("a", "b"), DIGITS).alias("score"))


def scored_candidates(uniques: DataFrame, min_score: float, n: int = 3, bands: int = 32, rows: int = 4, seed: int = 0) -> DataFrame:
    """(block, a, b, score) with score >= min_score of all LSH pairs; blocks with fewer than three names have none."""
    if not 0 <= min_score <= 1:
        raise ValueError("the threshold must be between 0 and 1")
    if n < 1 or bands < 1 or rows < 1:
        raise ValueError("ngram_size, lsh_bands and lsh_rows must be at least 1")
    enough = uniques.groupBy("block").agg(F.count("*").alias("n")).where("n >= 3").select("block")
    names = uniques.join(enough, "block", "left_semi")
    known = cut(profiles(names, n, bands, rows, seed, min_score if min_score > 0 else None))
    # keys of different bands differ: a pair is found by one number, and blocks are compared once more with the vectors
    buckets = known.select("block", F.explode("keys").alias("key"), "id", "mask1", "mask2").select(F.xxhash64("block", "key").alias("bucket"), "id", "mask1", "mask2")
    scores = score_pairs(lsh_pairs(buckets), known)
    if min_score == 0:
        scores = scores.unionByName(gramless_pairs(names, n).withColumn("score", F.lit(0.0)))
    scored = cut(scores.where(F.col("score") >= min_score))
    release(known)
    return scored


def exact_pairs(uniques: DataFrame, min_score: float, n: int = 3) -> DataFrame:
    """(block, a, b, score) of all pairs that share a gram, by an inverted index: the check of LSH on small tables."""
    v = tfidf_vectors(uniques, n).join(uniques.select("id", "block"), "id").select("id", "block", F.explode("vec").alias("e")).select("id", "block", "e.*")
    a, b = v.selectExpr("block", "gram", "id as a", "w as wa"), v.selectExpr("block", "gram", "id as b", "w as wb")
    out = a.join(b, ["block", "gram"]).where("a < b").groupBy("block", "a", "b").agg(F.round(F.sum(F.col("wa") * F.col("wb")), DIGITS).alias("score"))
    return out.where(F.col("score") >= min_score)


def pairwise_cosines(members: DataFrame, n: int = 3) -> DataFrame:
    """(a, b, score) of all pairs of members (id, form), by plain gram counts; members are the names of one cluster."""
    grams = members.select("id", F.explode_outer(ngrams("form", n)).alias("gram")).groupBy("id", "gram").agg(F.count("gram").alias("c"))
    size = grams.groupBy("id").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("size"))
    x, y = grams.selectExpr("id as a", "gram", "c as ca"), grams.selectExpr("id as b", "gram", "c as cb")
    dots = x.join(y, "gram").where("a < b").groupBy("a", "b").agg(F.sum(F.col("ca") * F.col("cb")).alias("d"))
    every = size.selectExpr("id as a", "size as sa").join(size.selectExpr("id as b", "size as sb"), F.col("a") < F.col("b"))
    score = F.coalesce(F.col("d") / F.nullif(F.col("sa") * F.col("sb"), F.lit(0.0)), F.lit(0.0))
    return every.join(dots, ["a", "b"], "left").select("a", "b", F.round(score, DIGITS).alias("score"))
