"""Operators beside clustering: explaining a cluster, acronyms, scoring a clustering, counting pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.normalize import comparison_form, normalize_name
from kinfold.operators.scoring import pairwise_cosines

# Words that a loose first-letter signature leaves out.
STOPWORDS = ["and", "of", "the", "for", "in", "by", "to", "a"]


def members(result: DataFrame, cluster_id: int, name_col: str = "name", order_col: str | None = None) -> DataFrame:
    """(id, norm, form, raw) of the unique normalized names of a cluster, raw being the first row's. Aliases and truncation
    of the clustering are not applied again."""
    rows = result.where(F.col("cluster_id") == cluster_id).withColumn("id", F.col(order_col).cast("long") if order_col else F.monotonically_increasing_id())
    named = rows.select("id", F.col(f"`{name_col}`").alias("raw"), normalize_name(F.col(f"`{name_col}`")).alias("norm")).where("norm <> ''")
    firsts = named.groupBy("norm").agg(F.min("id").alias("id"), F.min_by("raw", "id").alias("raw"))
    return firsts.select("id", "norm", comparison_form("norm").alias("form"), "raw")


def explain_edges(result: DataFrame, cluster_id: int, name_col: str = "name", ngram_size: int = 3, order_col: str | None = None) -> DataFrame:
    """(name_a, name_b, score): every pair of a cluster's unique names by cosine of plain gram counts."""
    m = members(result, cluster_id, name_col, order_col)
    pairs = pairwise_cosines(m.select("id", "form"), ngram_size)
    return pairs.join(m.selectExpr("id as a", "raw as name_a"), "a").join(m.selectExpr("id as b", "raw as name_b"), "b").select("name_a", "name_b", "score")


#: Unique names of a cluster that explain() brings to the driver with all their pairs, some 130,000; explain_edges has no bound.
MOST_MEMBERS = 512


def explain(result: DataFrame, cluster_id: int, name_col: str = "name", ngram_size: int = 3, order_col: str | None = None) -> dict:
    """canonical, members, edges, hub_radius and size of one cluster, as a dict for reading; ValueError if there is no such
    cluster or column, or it has more than MOST_MEMBERS unique names."""
    if name_col not in result.columns:
        raise ValueError(f"no column {name_col!r}; pass the one given to cluster()")
    head = result.where(F.col("cluster_id") == cluster_id).select("canonical_name").head()
    if head is None:
        raise ValueError(f"no rows with cluster_id={cluster_id}")
    names = members(result, cluster_id, name_col, order_col).orderBy("id").limit(MOST_MEMBERS + 1).collect()
    if len(names) > MOST_MEMBERS:
        raise ValueError(f"cluster {cluster_id} has more than {MOST_MEMBERS} unique names; read explain_edges() instead")
    norms = [r.norm for r in names]
    edges = explain_edges(result, cluster_id, name_col, ngram_size, order_col).collect() if len(names) > 1 else []
    return {
        "canonical": head[0],
        "members": [r.raw for r in names],
        "edges": [tuple(e) for e in edges],
        "hub_radius": 1 if len(names) > 1 and head[0] in norms else 0,  # every pair is an edge
        "size": len(names),
    }


def first_letters(norm: Column, loose: bool = False) -> Column:
    words = F.split(norm, " ")
    if loose:
        words = F.filter(words, lambda t: ~t.isin(STOPWORDS))
    return F.array_join(F.transform(words, lambda t: F.left(t, F.lit(1))), "")


def acronym_map(df: DataFrame, name_col: str = "name", min_acronym_len: int = 2, max_acronym_len: int = 6, min_expansion_tokens: int = 2, order_col: str | None = None) -> DataFrame:
    """(acronym, expansion_count, expansions, acronym_examples): names of one short word that are the first letters of names
    of several words. expansions are the first 10 raw names, acronym_examples the first 5, by order_col; sorted by count
    and acronym. A row of df counts each time; null and empty names don't."""
    if not 1 <= min_acronym_len <= max_acronym_len:
        raise ValueError("need 1 <= min_acronym_len <= max_acronym_len")
    if min_expansion_tokens < 2:
        raise ValueError("min_expansion_tokens must be at least 2")
    row = F.col(order_col).cast("long") if order_col else F.monotonically_increasing_id()
    named = df.select(row.alias("row"), F.col(f"`{name_col}`").alias("raw"), normalize_name(F.col(f"`{name_col}`")).alias("norm")).where("norm <> ''")
    named = named.withColumn("words", F.size(F.split("norm", " ")))
    short = named.where((F.col("words") == 1) & F.length("norm").between(min_acronym_len, max_acronym_len))
    signs = F.explode(F.array_distinct(F.array(first_letters(F.col("norm")), first_letters(F.col("norm"), True))))
    long = named.where(F.col("words") >= min_expansion_tokens).select("row", "raw", "norm", signs.alias("acronym"))
    long = long.where(F.length("acronym").between(min_acronym_len, max_acronym_len))

    def firsts(rows: DataFrame, k: int, name: str, *more: Column) -> DataFrame:
        """The first k raw names per acronym; a window keeps what a task holds at k rows per key."""
        from pyspark.sql import Window

        ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("acronym").orderBy("row"))).where(F.col("rank") <= k)
        lists = ranked.groupBy("acronym").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "raw"))), lambda x: x["raw"]).alias(name))
        return lists

    known = short.select(F.col("norm").alias("acronym"), "row", "raw")
    matching = long.join(known.select("acronym").distinct(), "acronym", "left_semi")
    counts = matching.groupBy("acronym").agg(F.count_distinct("norm").alias("expansion_count"))
    out = counts.join(firsts(matching, 10, "expansions"), "acronym").join(firsts(known, 5, "acronym_examples"), "acronym")
    return out.select("acronym", "expansion_count", "expansions", "acronym_examples").orderBy("expansion_count", "acronym")


def score_clusters(df: DataFrame, predicted: str, true: str) -> DataFrame:
    """One row (adjusted_rand, f1_pairs, precision, recall, n_predicted_clusters, n_true_clusters, n_items) of two label
    columns; a null label is a cluster of its own."""
    own = F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))
    rows = df.select(F.coalesce(F.col(f"`{predicted}`").cast("string"), own).alias("p"), F.coalesce(F.col(f"`{true}`").cast("string"), own).alias("t"))
    cells = rows.groupBy("p", "t").agg(F.count("*").alias("n"))
    pairs = lambda c: F.coalesce(F.sum((F.col(c).cast("double") * (F.col(c) - 1)) / 2), F.lit(0.0))
    both = cells.agg(pairs("n").alias("both"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"))
    side = lambda c: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(pairs("n").alias(f"{c}_pairs"), F.count("*").alias(f"{c}_n"))
    # three rows with different columns, laid over each other
    every = both.unionByName(side("p"), True).unionByName(side("t"), True)
    one = every.agg(*[F.max(c).alias(c) for c in every.columns]).selectExpr("*", "n_items * (n_items - 1D) / 2 as every")
    one = one.selectExpr("*", "if(p_pairs = 0, 1D, both / p_pairs) as precision", "if(t_pairs = 0, 1D, both / t_pairs) as recall", "if(every = 0, 0D, p_pairs * t_pairs / every) as expected", "(p_pairs + t_pairs) / 2 as most")
    return one.selectExpr(
        "case when n_items < 2 or every = 0 then 1D when most = expected then if(both = expected, 1D, 0D) else (both - expected) / (most - expected) end as adjusted_rand",
        "if(precision + recall = 0, 0D, 2 * precision * recall / (precision + recall)) as f1_pairs",
        "precision", "recall", "p_n as n_predicted_clusters", "t_n as n_true_clusters", "n_items",
    )


def score_labels(spark: SparkSession, predicted, true) -> dict:
    """score_clusters of two sequences of labels in the same order, as a dict; ValueError if their lengths differ."""
    p, t = ([None if x is None else str(x) for x in (s.to_pylist() if hasattr(s, "to_pylist") else s)] for s in (predicted, true))
    if len(p) != len(t):
        raise ValueError(f"{len(p)} predicted labels but {len(t)} true ones")
    return score_clusters(spark.createDataFrame(list(zip(p, t)), "p string, t string"), "p", "t").head().asDict()


def cluster_sizes(result: DataFrame, top: int | None = None) -> DataFrame:
    """(cluster_id, canonical_name, n), largest first; the top ones only if asked for."""
    out = result.where("cluster_id is not null").groupBy("cluster_id", "canonical_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster_id")
    return out.limit(top) if top else out
