"""Unique normalized names and their n-gram vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.grams import Grams, Signer, band_keys, distinct_ngrams, ngrams
from kinfold.functions.normalize import comparison_form, let, normalize_name, truncate_bytes
from kinfold.session import tasks

#: Frequencies of at most so many grams of blocks go to the driver and, as a broadcast of some 30 bytes each, to the tasks.
MAX_VOCABULARY = 1_000_000
#: Names of a step in numpy: some 25 kilobytes each for 128 permutations.
NAMES_OF_A_STEP = 2000


def alias_table(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """(alias_norm, canon_norm): for an alias of several canonicals the greatest raw canonical wins; empty forms are left out."""
    pairs = df.sparkSession.createDataFrame([(c, a) for c, many in aliases.items() for a in many], "canon string, alias string")
    named = pairs.select("canon", normalize_name("canon").alias("canon_norm"), normalize_name("alias").alias("alias_norm"))
    named = named.where("canon_norm <> '' and alias_norm <> ''")
    return named.groupBy("alias_norm").agg(F.max_by("canon_norm", "canon").alias("canon_norm"))


def with_norm(df: DataFrame, name_col: str, norm_col: str, max_name_length: int | None = None, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """df with the normalized (and by aliases rewritten) name; null where the name is null or normalizes to nothing."""
    if dict(df.dtypes)[name_col] != "string":
        raise TypeError(f"{name_col} must be a string column")
    raw = F.col(f"`{name_col}`")
    norm = normalize_name(truncate_bytes(raw, max_name_length) if max_name_length else raw)
    out = df.withColumn(norm_col, let(norm, lambda n: F.when(n != "", n)))
    if aliases:
        known = alias_table(df, aliases).withColumnsRenamed({"alias_norm": "__alias", "canon_norm": "__canon"})
        # the caller's dictionary, which the driver holds already
        out = out.join(F.broadcast(known), F.col(norm_col) == F.col("__alias"), "left").withColumn(norm_col, F.coalesce("__canon", norm_col)).drop("__alias", "__canon")
    return out


def unique_names(rows: DataFrame, norm_col: str, name_col: str, row_col: str, block: Column) -> DataFrame:
    """(id, block, norm, form, first_raw, n_rows) per distinct name of a block; id is the first row's number."""
    got = rows.groupBy(block.alias("block"), F.col(norm_col).alias("norm")).agg(
        F.min(row_col).alias("id"), F.min_by(F.col(f"`{name_col}`"), row_col).alias("first_raw"), F.count(norm_col).alias("n_rows")
    )
    # on a count, not on the name: a filter on it would be pushed below and normalize every name a second time
    got = got.where("n_rows > 0")
    return got.select("id", "block", "norm", comparison_form("norm").alias("form"), "first_raw", "n_rows")


def gram_idf(uniques: DataFrame, n: int = 3) -> DataFrame:
    """(block, gram, df, idf): idf = ln(names / names with the gram), counted over unique normalized names."""
    docs = uniques.groupBy("block").agg(F.count("*").alias("n_docs"))
    df = uniques.select("block", F.explode(distinct_ngrams("form", n)).alias("gram")).groupBy("block", "gram").agg(F.count("*").alias("df"))
    return df.join(docs, "block").select("block", "gram", "df", F.log(F.col("n_docs") / F.col("df")).alias("idf"))


def tfidf_vectors(uniques: DataFrame, n: int = 3, prefix_for: float | None = None) -> DataFrame:
    """(id, vec): entries (gram, w) in order of grams, of length 1; a vector without weight keeps zeros.

    With prefix_for, also prefix: hashes of the rarest grams without which the rest of the vector is shorter than that score.
    Of two vectors whose product reaches it, the rarest common gram is in both prefixes."""
    # names are shuffled, not their grams: both groupings below find the grams of a name in one place already
    spread = uniques.select("id", "block", "form").repartition(tasks(uniques.sparkSession), "id")
    grams = spread.select("id", "block", F.explode(ngrams("form", n)).alias("gram"))
    tf = grams.groupBy("id", "block", "gram").agg(F.count("*").alias("tf"))
    weights = tf.join(gram_idf(uniques, n), ["block", "gram"]).select("id", "gram", "df", (F.col("tf") * F.col("idf")).alias("w"))
    # sums along one sort per name, in the same order in every run; the names' partitioning serves it
    rarest = Window.partitionBy("id").orderBy("df", "gram")
    square = F.col("w") * F.col("w")
    total = F.sum(square).over(rarest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    upto = F.sum(square).over(rarest.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = weights.select("id", "gram", "w", total.alias("total"), *([] if prefix_for is None else [upto.alias("upto")]))
    unit = F.when(F.col("total") > 0, F.col("w") / F.sqrt("total")).otherwise(0.0)
    out = [F.array_sort(F.collect_list(F.struct("gram", unit.alias("w")))).alias("vec")]
    if prefix_for is not None:
        rest = F.col("total") - F.col("upto") + square
        needed = (rest >= F.col("total") * F.lit(max(prefix_for - 1e-6, 0.0) ** 2)) & (F.col("w") > 0)
        out.append(F.collect_list(F.when(needed, F.xxhash64("gram"))).alias("prefix"))
    return summed.groupBy("id").agg(*out)


def profiles(uniques: DataFrame, n: int = 3, bands: int = 32, rows: int = 4, seed: int = 0, prefix_for: float | None = None, max_vocabulary: int = MAX_VOCABULARY) -> DataFrame:
    """(id, block, grams, weights, mask1, mask2, keys) of names with a gram: the entries of tfidf_vectors by gram code, two
    masks of 64 bits over the prefix (a bit for each gram by two hashes; all bits without prefix_for) and the LSH keys of
    the bands. Up to max_vocabulary grams all of it is made in one pass over the names; beyond that, frequencies are joined
    by gram."""
    known = _vocabulary(uniques, n, max_vocabulary)
    # a small table would come in few files: names are spread over all tasks
    spread = uniques.where(F.length("form") >= n).select("id", "block", "form").repartition(tasks(uniques.sparkSession))
    schema = "id long, block string, grams array<long>, weights array<double>, mask1 long, mask2 long, keys array<long>"
    if known is not None:
        return spread.mapInArrow(_profiler(uniques.sparkSession.sparkContext.broadcast(known), n, bands, rows, seed, prefix_for), schema)
    vectors = tfidf_vectors(uniques, n, prefix_for)
    keys = spread.mapInArrow(_profiler(None, n, bands, rows, seed, None), schema).select("id", "block", "keys")
    entries = [F.transform("vec", lambda e: F.xxhash64(e["gram"])).alias("grams"), F.transform("vec", lambda e: e["w"]).alias("weights")]
    bit = lambda g, seed: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(g, F.lit(seed)), F.lit(64)).cast("int"))
    mask = lambda seed: F.lit(-1).cast("long") if prefix_for is None else F.aggregate("prefix", F.lit(0).cast("long"), lambda m, g: m.bitwiseOR(bit(g, seed)))
    return keys.join(vectors, "id").select("id", "block", *entries, mask(1).alias("mask1"), mask(2).alias("mask2"), "keys")


def _vocabulary(uniques: DataFrame, n: int, most: int) -> dict[str, tuple[int, np.ndarray, np.ndarray]] | None:
    """block -> (names, gram codes in order, names with each), None if there are more than so many grams."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            blocks = b.column(0).dictionary_encode()
            which, forms = blocks.indices.to_numpy(), np.array(b.column(1).to_pylist(), object)
            out = []
            for k, block in enumerate(blocks.dictionary.to_pylist()):
                texts = forms[which == k].tolist()
                g = Grams(texts, n)
                df = np.bincount(g.counts()[1], minlength=len(g.codes))
                out.append(pa.RecordBatch.from_arrays([pa.array([block] * (len(df) + 1), pa.string()), pa.array([None, *g.codes.tolist()], pa.int64()), pa.array([len(texts), *df.tolist()], pa.int64())], ["block", "gram", "df"]))
            yield from out

    counted = uniques.select("block", "form").mapInArrow(count, "block string, gram long, df long").groupBy("block", "gram").agg(F.sum("df").alias("df"))
    got = counted.limit(most + 1).toArrow()
    if got.num_rows > most:
        return None
    out = {}
    got = got.sort_by([("block", "ascending"), ("gram", "ascending")])  # null, the number of names, comes last
    blocks = got.column("block").to_pylist()
    edges = [0, *(i for i in range(1, len(blocks)) if blocks[i] != blocks[i - 1]), len(blocks)]
    gram, df = got.column("gram").fill_null(0).to_numpy(), got.column("df").to_numpy()
    for a, b in zip(edges, edges[1:]):
        if b > a:
            out[blocks[a]] = int(df[b - 1]), gram[a : b - 1].copy(), df[a : b - 1].copy()
    return out


def _lists(of: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """A list for each of n names from values sorted by their name."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), pa.array(values, kind))


def _mask(of: np.ndarray, codes: np.ndarray, n: int, odd: int) -> np.ndarray:
    """A bit of 64 for each code, by name."""
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        np.bitwise_or.at(out, of, np.uint64(1) << ((codes.astype(np.uint64) * np.uint64(odd)) >> np.uint64(58)))
    return out.view(np.int64)


def _profiler(vocabulary, n: int, bands: int, rows: int, seed: int, prefix_for: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(n, bands * rows, seed)
        for whole in batches:
            for at in range(0, whole.num_rows, NAMES_OF_A_STEP):
                b = whole.slice(at, NAMES_OF_A_STEP)
                g, m = Grams(b.column(2).to_pylist(), n), b.num_rows
                texts, sigs = g.signatures(signer)  # every text has a gram here
                name, code, tf = g.counts()
                w, df = np.zeros(len(name)), np.ones(len(name), np.int64)
                if vocabulary is not None:
                    blocks = b.column(1).dictionary_encode()
                    which = blocks.indices.to_numpy()[name]
                    for k, block in enumerate(blocks.dictionary.to_pylist()):
                        names, grams, counts = vocabulary.value[block]
                        here = np.flatnonzero(which == k)
                        df[here] = counts[np.searchsorted(grams, g.codes[code[here]])]
                        w[here] = tf[here] * np.log(names / df[here])
                total = np.bincount(name, w * w, m)
                unit = w / np.sqrt(np.where(total > 0, total, 1.0))[name]
                masks = [np.full(m, -1, np.int64)] * 2
                if prefix_for is not None:
                    order = np.lexsort((code, df, name))
                    square = w[order] ** 2
                    before = np.concatenate([[0.0], np.cumsum(square)])
                    start = np.searchsorted(name, np.arange(m))
                    rest = total[name] - (before[:-1] - before[start][name])  # of this gram and all more frequent ones
                    needed = order[(rest >= total[name] * max(prefix_for - 1e-6, 0.0) ** 2) & (square > 0)]
                    masks = [_mask(name[needed], g.codes[code[needed]], m, odd) for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
                keys = band_keys(sigs, bands, rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0), b.column(1), _lists(name, g.codes[code], m, pa.int64()), _lists(name, unit, m, pa.float64()),
                        *map(pa.array, masks), _lists(np.repeat(texts, bands), keys.ravel(), m, pa.int64()),
                    ],
                    ["id", "block", "grams", "weights", "mask1", "mask2", "keys"],
                )

    return run
