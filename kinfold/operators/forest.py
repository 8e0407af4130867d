"""Connected components of any number of links, by union-find over bounded forests.

1. Each task runs union-find over its own links and keeps a spanning forest: every node with the root of its tree.
2. The forests' links are brought together by one end, in as many partitions as chunks of a bounded number of links are
   needed (ends of more links than a chunk are spread by the other end), and merged by union-find again.
3. A node that stands in one chunk only is settled: it belongs to whatever its tree belongs to. Nodes of several chunks go
   on to the next level: each is linked with the least of its trees' representatives, and that with the others. There the
   same begins again with fewer nodes, until a level has no node of several chunks.
4. From the last level back to the first, settled nodes take over the component of their representative.

Representatives are least by hash, so a chain of links shrinks by a constant share at each level, whatever the order of its
nodes; and the last node by hash is settled two levels after it came up, so the levels end. A task never holds more than
a chunk: a node with a third of all links stands in many chunks and many partitions. All levels run the same code, one
chunk or many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.session import cut, release

#: Links of a chunk: some 100 bytes each, for names of usual length.
CHUNK_LINKS = 2_000_000


def spanning(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of its tree for each of the nodes 0 to n-1: roots hook to the smallest root they are linked with."""
    parent = np.arange(n)
    while len(u):
        a, b = parent[u], parent[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def _stars(links: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """(nodes in order, for each the place of its tree's smallest node) of links (u, v)."""
    ends = pa.chunked_array([*links.column(0).chunks, *links.column(1).chunks], links.schema.field(0).type).combine_chunks()
    coded = ends.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    place = rank[coded.indices.to_numpy()]
    return coded.dictionary.take(pa.array(order)), spanning(place[: links.num_rows], place[links.num_rows :], len(order))


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Forests of a task's links. Links are taken in as long as the forest they leave is below half a chunk."""
    held, rows = [], 0
    for b in batches:
        for at in range(0, b.num_rows, most):
            held.append(b.slice(at, most))
            rows += held[-1].num_rows
            if rows >= most:
                nodes, root = _stars(pa.Table.from_batches(held))
                inner = np.flatnonzero(root != np.arange(len(root)))
                if 2 * len(inner) >= most:
                    yield nodes, root
                    held, rows = [], 0
                else:
                    held, rows = [pa.RecordBatch.from_arrays([nodes.take(pa.array(root[inner])), nodes.take(pa.array(inner))], names=["u", "v"])], len(inner)
    if rows:
        yield _stars(pa.Table.from_batches(held))


def _local(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, root in _chunks(batches, most):
            inner = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(root[inner])), nodes.take(pa.array(inner))], names=["u", "v"])

    return run


def _merged(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        for k, (nodes, root) in enumerate(_chunks(batches, most)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(root), first + k)), nodes, nodes.take(pa.array(root))], names=["chunk", "node", "root"])

    return run


def _rank(node: str) -> Column:
    return F.struct(F.xxhash64(node), F.col(node))


def _met(links: DataFrame, chunk_links: int) -> DataFrame:
    """Links (u, v), u the lesser by hash, with all links of u together: as many partitions as there are chunks."""
    turned = _rank("u") < _rank("v")
    left = links.select(F.when(turned, F.col("u")).otherwise(F.col("v")).alias("u"), F.when(turned, F.col("v")).otherwise(F.col("u")).alias("v"))
    chunks = -(-links.count() // chunk_links)
    if chunks <= 1:
        return left.coalesce(1)
    # fewer rows than chunks
    hot = left.groupBy("u").agg(F.count("*").alias("k")).where(F.col("k") > chunk_links).select("u", (F.col("k") / chunk_links).cast("long").alias("salts"))
    salt = F.pmod(F.xxhash64("v"), F.col("salts") + 1)
    return left.join(F.broadcast(hot), "u", "left").repartition(chunks, "u", salt).select("u", "v").sortWithinPartitions("u")


def components(links: DataFrame, chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """(node, root) of every linked node but the roots, as a table, from links (u, v), two columns of strings or of longs;
    root is the smallest node of the component. Nulls link nothing, nor does a link of a node with itself; repeated links count once."""
    u, v = links.columns
    kind = dict(links.dtypes)[u].replace("bigint", "long")
    links = cut(links.toDF("u", "v").where("u is not null and v is not null and u <> v").mapInArrow(_local(chunk_links), f"u {kind}, v {kind}"))
    levels = []
    while True:
        met, previous = _met(links, chunk_links), links
        forest = cut(met.mapInArrow(_merged(chunk_links), f"chunk long, node {kind}, root {kind}"))
        release(previous)
        ends = forest.agg(F.min("chunk"), F.max("chunk")).head()
        if ends[0] == ends[1]:
            break
        several = cut(forest.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"))
        going = forest.join(several, "node")
        rep = cut(going.groupBy("chunk", "root").agg(F.min_by("node", _rank("node")).alias("rep")))
        trees = cut(going.join(rep, ["chunk", "root"]).select("node", "rep"))
        settled = forest.join(several, "node", "left_anti").join(rep, ["chunk", "root"], "left").select("node", F.coalesce("rep", "root").alias("root"))
        levels.append(cut(settled.where("node <> root")))
        least = trees.groupBy("node").agg(F.min_by("rep", _rank("rep")).alias("m"))
        links = cut(trees.join(least, "node").selectExpr("inline(array(struct(m as u, node as v), struct(m as u, rep as v)))").where("u <> v").distinct())
        for t in (forest, several, rep, trees):
            release(t)
    found = forest.where("node <> root").select("node", "root")
    if not levels:
        return found
    for level in reversed(levels):
        above = found.selectExpr("node as root", "root as top")
        found, old = cut(level.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(found)), found
        release(level)
        release(old)
    release(forest)
    # a root is the last representative so far: now the smallest node
    names = found.groupBy("root").agg(F.least(F.min("node"), F.col("root")).alias("first"))
    every = found.unionByName(names.selectExpr("root as node", "root"))
    named = cut(every.join(names, "root").selectExpr("node", "first as root").where("node <> root"))
    release(found)
    return named
