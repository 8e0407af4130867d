"""Per-key results where a few keys hold most rows: heavy keys apart from the rest.

Heavy keys are found with a frequent-items sketch; their list is bounded by its share parameter (at most 1 / share keys),
is broadcast, and splits the rows. The light keys go through an ordinary shuffle and are ranked by a sort that spills, so
no key's rows stand in memory together. The rows of heavy keys are spread over all tasks by range and the wanted one is
found by counting, so no task holds a heavy key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.session import cut, tasks

#: A key with more than this share of the rows is heavy: at most 1000 keys are.
HEAVY_SHARE = 0.001
SKETCH_ITEMS = 16_384


def heavy_keys(df: DataFrame, key_hash: str, share: float = HEAVY_SHARE) -> DataFrame:
    """Hashes of the keys that hold more than the share of all rows, (key_hash, rows); at most 1 / share of them.

    The sketch never counts a key lower than it is by more than its error, which is far below the share; a light key
    taken for heavy costs time only, since both ways give the same result. Null hashes are not counted."""
    if not 1 / SKETCH_ITEMS <= share < 1:
        raise ValueError(f"share must be in [1/{SKETCH_ITEMS}, 1)")
    most = int(1 / share)
    got = df.agg(F.expr(f"approx_top_k(`{key_hash}`, {most}, {SKETCH_ITEMS})").alias("top"), F.count(key_hash).alias("n")).head()
    rows = [(x["item"], x["count"]) for x in got["top"] or [] if x["count"] > share * got["n"]]
    return df.sparkSession.createDataFrame(rows, T.StructType([T.StructField(key_hash, T.LongType()), T.StructField("rows", T.LongType())]))


def lower_median_rows(df: DataFrame, keys: list[str], order: list[str], share: float = HEAVY_SHARE) -> DataFrame:
    """For each key the row number (n+1) div 2 in the given order, over distinct rows of keys + order.

    Rows with a null in a key or in the order don't count; keys without rows give none; other columns are not looked at."""
    base = df.select(*keys, *order)
    for c in [*keys, *order]:
        base = base.where(F.col(c).isNotNull())
    base = base.withColumn("__h", F.xxhash64(*keys))
    heavy = heavy_keys(base, "__h", share)
    marked = F.broadcast(heavy.select("__h"))  # at most 1 / share rows
    light = _light(base.join(marked, "__h", "left_anti"), keys, order)
    return light.unionByName(_heavy(base.join(marked, "__h", "left_semi"), keys, order))


def _light(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One shuffle on the key and one sort. Repeated rows share a rank, so the last rank counts the distinct ones; Spark
    keeps a few thousand rows of a key in memory to hand the last rank on and spills the rest."""
    quoted, by = [f"`{c}`" for c in [*keys, *order]], ", ".join(f"`{k}`" for k in keys)
    inside = f"partition by {by} order by {', '.join(f'`{o}`' for o in order)}"
    ranked = rows.repartition(*[f"`{k}`" for k in keys]).selectExpr(*quoted, f"dense_rank() over ({inside}) as __r")
    last = ranked.selectExpr("*", f"max(__r) over (partition by {by}) as __last", f"lag(__r) over ({inside}) as __before")
    return last.where("__r = (__last + 1) div 2 and not (__before <=> __r)").select(*keys, *order)


def _heavy(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Distinct rows sorted by range over all tasks; counts by key and task tell where the wanted row lies."""
    quoted, by = [f"`{k}`" for k in keys], ", ".join(f"`{k}`" for k in keys)
    n = max(2, tasks(rows.sparkSession))
    ranged = rows.groupBy("__h", *quoted, *order).agg(F.lit(1).alias("__one")).drop("__one").repartitionByRange(n, "__h", *quoted, *order)
    placed = cut(ranged.withColumn("__p", F.spark_partition_id()))
    counts = placed.groupBy(*quoted, "__p").agg(F.count("*").alias("__n"))  # at most heavy keys + tasks rows: ranges of sorted keys
    at = counts.selectExpr("*", f"sum(__n) over (partition by {by} order by __p) as __upto", f"(sum(__n) over (partition by {by}) + 1) div 2 as __nth")
    at = at.where("__nth <= __upto and __nth > __upto - __n").selectExpr(*quoted, "__p", "__nth - (__upto - __n) as __k")
    hit = placed.join(F.broadcast(at), [*keys, "__p"])  # one row per heavy key
    inside = f"partition by {by} order by {', '.join(f'`{o}`' for o in order)}"
    return hit.selectExpr("*", f"row_number() over ({inside}) as __rn").where("__rn = __k").select(*quoted, *order)
