"""Groups of records linked directly or indirectly, from pairwise links.

Union-find runs within the partitions of links, which keep spanning forests only; forests are merged hierarchically
through bounded partitions, where nodes of one partition are settled and only nodes of several go on to the next level,
until global components remain (kinfold.operators.forest). The same code runs at every size.

Links with a null end don't link; a link of a node with itself links nothing; repeated and turned links count once. An
empty table has no groups; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators import forest


def components(links: DataFrame, a: str = "a", b: str = "b", chunk_links: int = forest.CHUNK_LINKS) -> DataFrame:
    """(node, root) of every linked node but the roots; root is the smallest node of the component by code points."""
    return forest.components(links.select(F.col(a).cast("string"), F.col(b).cast("string")), chunk_links).select("node", "root")


def groups(pairs: DataFrame, a: str, b: str, linking, chunk_links: int = forest.CHUNK_LINKS) -> DataFrame:
    """(group_name, name): every non-null name of either side with the smallest name of its group."""
    names = pairs.select(F.col(a).alias("name")).unionByName(pairs.select(F.col(b).alias("name"))).where("name is not null").distinct()
    roots = components(pairs.where(linking), a, b, chunk_links)
    return names.join(roots.withColumnRenamed("node", "name"), "name", "left").select(F.coalesce("root", "name").alias("group_name"), "name")
