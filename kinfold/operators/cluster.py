"""Clusters of spellings of one name: the library's main operator, and its candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators import graph
from kinfold.operators.features import unique_names, with_norm
from kinfold.operators.scoring import exact_pairs, scored_candidates
from kinfold.session import cut, tasks

_NORM, _ROW, _BLOCK = "__kf_norm", "__kf_row", "__kf_block"


def _prepared(df: DataFrame, name_col: str, order_col: str | None, block_col: str | None, max_name_length: int, aliases: dict | None) -> DataFrame:
    rows = with_norm(df, name_col, _NORM, max_name_length, aliases)
    rows = rows.withColumn(_ROW, F.col(f"`{order_col}`").cast("long") if order_col else F.monotonically_increasing_id())
    return rows.withColumn(_BLOCK, F.col(f"`{block_col}`").cast("string") if block_col else F.lit(""))


def _uniques(rows: DataFrame, name_col: str) -> DataFrame:
    return cut(unique_names(rows.where(F.col(_BLOCK).isNotNull()), _NORM, name_col, _ROW, F.col(_BLOCK)))


def dense_ids(canonicals: DataFrame) -> DataFrame:
    """(block, canonical, cluster_id): 0, 1, ... within each block in order of canonical, without a single-task sort."""
    n = tasks(canonicals.sparkSession)
    ranged = canonicals.repartitionByRange(n, "block", "canonical").sortWithinPartitions("block", "canonical")
    # the low 33 bits of this id number the rows of a partition, the rest numbers the partitions
    placed = cut(ranged.withColumn("m", F.monotonically_increasing_id()).selectExpr("block", "canonical", "m >> 33 as p", "m & 8589934591 as i"))
    counts = placed.groupBy("p").agg(F.count("*").alias("n")).selectExpr("p", "sum(n) over (order by p) - n as before")  # a row per partition
    numbered = placed.join(F.broadcast(counts), "p").selectExpr("block", "canonical", "before + i as g")
    first = numbered.groupBy("block").agg(F.min("g").alias("first"))
    return numbered.join(first, "block").selectExpr("block", "canonical", "g - first as cluster_id")


def cluster_names_table(uniques: DataFrame, edges: DataFrame, hub_radius_max: int = 2, diameter_check_min_size: int = 5) -> DataFrame:
    """(block, norm, cluster_id, canonical_name, flagged, cluster_size) from unique names and scored edges."""
    nodes = cut(graph.connected_components(edges).join(graph.degrees(edges), "id").join(uniques.select("id", "norm"), "id"))
    pieces = graph.split_wide(nodes, edges, hub_radius_max, diameter_check_min_size).join(nodes.select("id", "norm", "degree"), "id")
    hubs = pieces.groupBy("piece").agg(F.expr("min_by(norm, struct(-degree, norm))").alias("canonical"))
    linked = pieces.join(hubs, "piece").select("id", "canonical", "flagged")
    named = cut(uniques.join(linked, "id", "left").select("block", "norm", F.coalesce("canonical", "norm").alias("canonical"), F.coalesce("flagged", F.lit(False)).alias("flagged")))
    sizes = named.groupBy("block", "canonical").agg(F.count("*").alias("cluster_size"))
    ids = dense_ids(named.select("block", "canonical").distinct()).join(sizes, ["block", "canonical"])
    return named.join(ids, ["block", "canonical"]).select("block", "norm", "cluster_id", F.col("canonical").alias("canonical_name"), "flagged", "cluster_size")


def cluster(
    df: DataFrame, name_col: str = "name", *, threshold: float = 0.85, seed: int = 0, ngram_size: int = 3, lsh_bands: int = 32, lsh_rows: int = 4,
    hub_radius_max: int = 2, diameter_check_min_size: int = 5, max_name_length: int = 256, aliases: dict[str, list[str]] | None = None,
    block_col: str | None = None, order_col: str | None = None, blocking: str = "lsh", diagnostics: bool = False,
) -> DataFrame:
    """df with cluster_id (0, 1, ... in order of canonical names; within each block if block_col is given) and canonical_name,
    the normalized name with most neighbours; both null where the name is null or normalizes to nothing, or its block is
    null. Columns of these names are replaced. diagnostics adds flagged (the cluster comes from a split component), cluster_size (its unique names) and normalized_name.

    blocking 'exact' scores all pairs that share a gram instead of LSH's candidates; for small tables."""
    rows = _prepared(df, name_col, order_col, block_col, max_name_length, aliases)
    uniques = _uniques(rows, name_col)
    if blocking == "exact":
        enough = uniques.groupBy("block").count().where("count >= 3").select("block")
        edges = cut(exact_pairs(uniques.join(enough, "block", "left_semi"), threshold, ngram_size))
    else:
        edges = scored_candidates(uniques, threshold, ngram_size, lsh_bands, lsh_rows, seed)
    found = cluster_names_table(uniques, edges, hub_radius_max, diameter_check_min_size)
    found = found.withColumnsRenamed({"block": _BLOCK, "norm": _NORM})
    added = ["cluster_id", "canonical_name", *(["flagged", "cluster_size", "normalized_name"] if diagnostics else [])]
    kept = [c for c in df.columns if c not in added]
    joined = rows.drop(*added).join(found, [_BLOCK, _NORM], "left").withColumn("normalized_name", F.col(_NORM))
    return joined.select(*[f"`{c}`" for c in kept], *added)


def cluster_names(spark: SparkSession, names: list[str | None], **options) -> list[int | None]:
    """Cluster ids of a list, in its order; for lists that a driver holds anyway."""
    df = spark.createDataFrame([(i, n if isinstance(n, str) else None) for i, n in enumerate(names)], "pos long, name string")
    return [r.cluster_id for r in cluster(df, order_col="pos", **options).orderBy("pos").collect()]


def candidates(
    df: DataFrame, name_col: str = "name", *, min_score: float = 0.0, seed: int = 0, ngram_size: int = 3, lsh_bands: int = 32, lsh_rows: int = 4,
    max_name_length: int = 256, aliases: dict[str, list[str]] | None = None, block_col: str | None = None, order_col: str | None = None,
) -> DataFrame:
    """(name_a, name_b, normalized_a, normalized_b, score) of the candidate pairs of unique names, ordered by a and b; names
    are those of the first row with the normalized name by order_col, a is the earlier one. Without order_col rows count in
    file order."""
    rows = _prepared(df, name_col, order_col, block_col, max_name_length, aliases)
    uniques = _uniques(rows, name_col)
    pairs = scored_candidates(uniques, min_score, ngram_size, lsh_bands, lsh_rows, seed)
    side = lambda s: uniques.selectExpr(f"id as {s}", f"first_raw as name_{s}", f"norm as normalized_{s}")
    return pairs.join(side("a"), "a").join(side("b"), "b").orderBy("a", "b").select("name_a", "name_b", "normalized_a", "normalized_b", "score")
