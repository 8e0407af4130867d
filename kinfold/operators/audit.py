"""Reports on what normalization does to a table of names, and an evaluation set of scored pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kinfold.functions.normalize import normalize_name
from kinfold.session import cut, tasks


def changed(raw: Column, norm: Column) -> Column:
    """Does the form differ by more than case and outer blanks?"""
    return F.lower(F.trim(raw)) != norm


def normalized(df: DataFrame, name_col: str) -> DataFrame:
    return df.where(F.length(f"`{name_col}`") > 0).select(F.col(f"`{name_col}`").alias("raw"), normalize_name(F.col(f"`{name_col}`")).alias("norm"))


def stats(df: DataFrame, name_col: str) -> DataFrame:
    """One row: counts of names, empty and one-letter forms, changed names; lengths and words of the forms."""
    n = normalized(df, name_col)
    form = F.when(F.col("norm") != "", F.col("norm"))
    chars, words = F.length(form), F.size(F.split(form, " "))
    words = F.when(form.isNotNull(), words)
    return n.agg(
        F.count("*").alias("n_input"),
        F.count_if(F.col("norm") == "").alias("n_empty"),
        F.count_if(F.length("norm") == 1).alias("n_one_char"),
        F.count_if(changed(F.col("raw"), F.col("norm"))).alias("n_changed"),
        F.round(F.avg(chars), 6).alias("chars_mean"), F.min(chars).alias("chars_min"), F.max(chars).alias("chars_max"), F.percentile(chars, F.lit(0.5)).alias("chars_median"),
        F.round(F.stddev(chars), 6).alias("chars_std"),
        F.round(F.avg(words), 6).alias("words_mean"), F.min(words).alias("words_min"), F.max(words).alias("words_max"), F.percentile(words, F.lit(0.5)).alias("words_median"),
    )


def describe(df: DataFrame, name_col: str) -> DataFrame:
    """(measure, n, n_null, mean, std, min, p25, p50, p75, max) of the lengths ('chars') and words ('words') of the forms;
    names without a form count as null. Quartiles lie between two values where the place does."""
    form = F.when(F.col("norm") != "", F.col("norm"))
    pair = lambda name, value: F.struct(F.lit(name).alias("measure"), F.when(form.isNotNull(), value).alias("x"))
    long = normalized(df, name_col).select(F.explode(F.array(pair("chars", F.length(form)), pair("words", F.size(F.split(form, " "))))).alias("r")).select("r.*")
    # counts by value first: lengths are few, so the quartiles' table of values stays small
    cells = long.groupBy("measure", "x").agg(F.count("*").alias("k"))
    at = lambda q: F.expr(f"percentile(x, {q}, k)")
    k, x = F.when(F.col("x").isNotNull(), F.col("k")).otherwise(0), F.col("x").cast("double")
    n, total, square = F.sum(k), F.sum(F.col("k") * x), F.sum(F.col("k") * x * x)
    return cells.groupBy("measure").agg(
        n.alias("n"), F.sum(F.when(F.col("x").isNull(), F.col("k")).otherwise(0)).alias("n_null"), F.round(total / n, 6).alias("mean"),
        F.round(F.sqrt(F.greatest(F.lit(0.0), (square - total * total / n) / F.nullif(n - 1, F.lit(0)))), 6).alias("std"),
        F.min("x").alias("min"), at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75"), F.max("x").alias("max"),
    )


def collisions(df: DataFrame, name_col: str, top: int = 100) -> DataFrame:
    """(norm, n): the forms that most names share."""
    return normalized(df, name_col).where("norm <> ''").groupBy("norm").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "norm").limit(top)


def edge_tokens(df: DataFrame, name_col: str, last: bool, top: int = 50) -> DataFrame:
    """(token, n): the most frequent last or first words of raw names, without points and commas beside them."""
    words = F.filter(F.split(F.lower(F.col(f"`{name_col}`")), r"\s+"), lambda w: w != "")
    token = F.rtrim(F.element_at(words, -1), F.lit(".,;:")) if last else F.ltrim(F.element_at(words, 1), F.lit(".,;:"))
    rows = df.where(F.col(f"`{name_col}`").isNotNull()).select(words.alias("w"), F.when(F.size(words) > 0, token).alias("token"))
    return rows.where("token <> ''").groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(top)


def of_type(df: DataFrame, entity_type: str | None, type_col: str = "entity_type") -> DataFrame:
    """Rows of one type of entity, all rows if none is asked for."""
    return df if entity_type is None else df.where(F.col(f"`{type_col}`") == entity_type)


def alias_recall(aliases: DataFrame, entity_col: str, name_col: str, entity_type: str | None = None) -> DataFrame:
    """One row: of all pairs of names of an entity, how many share their normalized form."""
    aliases = of_type(aliases, entity_type)
    forms = aliases.select(F.col(entity_col).alias("e"), normalize_name(F.col(name_col)).alias("norm")).where("norm <> ''")
    cells = forms.groupBy("e", "norm").agg(F.count("*").alias("n"))
    each = cells.groupBy("e").agg(F.sum("n").alias("k"), F.sum(F.expr("n * (n - 1) div 2")).alias("same"), F.count("*").alias("forms")).where("k >= 2")
    return each.agg(
        F.count("*").alias("n_entities_with_aliases"), F.coalesce(F.sum(F.expr("k * (k - 1) div 2")), F.lit(0)).alias("total_pairs"),
        F.coalesce(F.sum("same"), F.lit(0)).alias("matching_pairs"), F.count_if(F.col("forms") == 1).alias("entities_collapsed_fully"),
    )


def apart(aliases: DataFrame, entity_col: str, name_col: str, entity_type: str | None = None, top: int = 10) -> DataFrame:
    """(entity_id, norm, n) of the first entities, by id, whose names have more than one form."""
    forms = of_type(aliases, entity_type).select(F.col(f"`{entity_col}`").alias("entity_id"), normalize_name(F.col(f"`{name_col}`")).alias("norm")).where("norm <> ''")
    cells = forms.groupBy("entity_id", "norm").agg(F.count("*").alias("n"))
    several = cells.groupBy("entity_id").agg(F.count("*").alias("k")).where("k > 1").orderBy("entity_id").limit(top)
    return cells.join(several.select("entity_id"), "entity_id").orderBy("entity_id", "norm")


def audit(df: DataFrame, name_col: str, order_col: str, entity_col: str | None = None, entity_type: str | None = None) -> dict[str, DataFrame]:
    """All reports on one table of names, each a small DataFrame: what sinks.report writes as Markdown and JSON. With
    entity_col also the recall among each entity's names."""
    df = of_type(df, entity_type)
    n = df.where(F.length(f"`{name_col}`") > 0).select(F.col(f"`{order_col}`").alias("row"), F.col(f"`{name_col}`").alias("raw"), normalize_name(F.col(f"`{name_col}`")).alias("norm"))
    out = {
        "counts": stats(df, name_col), "lengths": describe(df, name_col), "collisions": collisions(df, name_col),
        "empty": n.where("norm = ''").orderBy("row").limit(20), "one_character": n.where("length(norm) = 1").orderBy("row").limit(20),
        "changed": evenly_spaced(n.where(changed(F.col("raw"), F.col("norm")) & (F.col("norm") != "")), "row"),
        "last_words": edge_tokens(df, name_col, True), "first_words": edge_tokens(df, name_col, False),
    }
    if entity_col:
        out |= {"alias_recall": alias_recall(df, entity_col, name_col), "apart": apart(df, entity_col, name_col)}
    return out


def evenly_spaced(df: DataFrame, order_col: str, k: int = 20) -> DataFrame:
    """Every n-th row in order, k of them: a sample for reading. Rows of the same order value come in any order."""
    n = tasks(df.sparkSession)
    whole = df.select(F.struct(*[f"`{c}`" for c in df.columns]).alias("row"), F.col(f"`{order_col}`").alias("o"))
    # two-level numbering: partitions of a range, then rows within; written once, so both readers below see the same
    placed = cut(whole.repartitionByRange(n, "o").sortWithinPartitions("o").withColumn("m", F.monotonically_increasing_id()))
    counts = placed.groupBy(F.expr("m >> 33 as p")).agg(F.count("*").alias("n"))  # a row per partition
    total = counts.agg(F.sum("n")).head()[0] or 0
    step = max(1, total // k)
    before = counts.selectExpr("p", "sum(n) over (order by p) - n as before")
    at = F.expr("before + (m & 8589934591)")
    numbered = placed.withColumn("p", F.expr("m >> 33")).join(F.broadcast(before), "p")
    return numbered.where((at % step == 0) & (at < step * k)).select("row.*")


def seeded_sample(df: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    """n rows by a hash of their keys and the seed: the same rows in every run. Tasks keep their own best n, no more."""
    order = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *[F.col(f"`{k}`").cast("string") for k in keys]).cast("binary"))
    return df.orderBy(order, *[f"`{k}`" for k in keys]).limit(n)


def partition_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values that aren't null, in order."""
    return df.where(F.col(f"`{column}`").isNotNull()).select(f"`{column}`").distinct().orderBy(f"`{column}`")


def score_buckets(pairs: DataFrame, min_score: float = 0.3, max_score: float = 1.0, buckets: int = 7) -> DataFrame:
    """pairs with score in [min_score, max_score) and bucket, the lower edge of their share of that range."""
    step = (max_score - min_score) / buckets
    inside = pairs.where((F.col("score") >= min_score) & (F.col("score") < max_score))
    return inside.withColumn("bucket", F.round(F.lit(min_score) + F.floor((F.col("score") - F.lit(min_score)) / F.lit(step)) * F.lit(step), 4))


def bucket_distribution(bucketed: DataFrame, min_score: float = 0.3, max_score: float = 1.0, buckets: int = 7) -> DataFrame:
    """(bucket, n) of all buckets, empty ones too."""
    step = (max_score - min_score) / buckets
    edges = bucketed.sparkSession.createDataFrame([(round(min_score + i * step, 4),) for i in range(buckets)], "bucket double")
    counts = bucketed.groupBy("bucket").agg(F.count("*").alias("n"))
    return edges.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def sample_per_bucket(bucketed: DataFrame, per_bucket: int = 50, keys: tuple[str, str] = ("name_a", "name_b"), seed: int = 0) -> DataFrame:
    """Up to per_bucket pairs of each bucket, by a hash of the pair and the seed; a bucket is cut down within each task
    before its best are compared."""
    order = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *keys).cast("binary"))
    h = bucketed.withColumn("__h", order).withColumn("__p", F.substring("__h", 1, 2))
    first = h.withColumn("__r", F.row_number().over(Window.partitionBy("bucket", "__p").orderBy("__h", *keys))).where(F.col("__r") <= per_bucket)
    last = first.withColumn("__r", F.row_number().over(Window.partitionBy("bucket").orderBy("__h", *keys))).where(F.col("__r") <= per_bucket)
    return last.drop("__h", "__p", "__r")


def join_context(pairs: DataFrame, df: DataFrame, name_col: str, context_cols: list[str], order_col: str) -> DataFrame:
    """pairs with each context column for both sides: the first value that isn't null among the rows of the raw name."""
    firsts = [F.min_by(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col(order_col))).alias(c) for c in context_cols]
    lookup = df.where(F.col(f"`{name_col}`").isNotNull()).groupBy(F.col(f"`{name_col}`").alias("__name")).agg(*firsts)
    out = pairs
    for s in "ab":
        side = lookup.select(F.col("__name").alias(f"name_{s}"), *[F.col(f"`{c}`").alias(f"{c}_{s}") for c in context_cols])
        out = out.join(side, f"name_{s}", "left")
    head = ["name_a", "name_b", *[c for c in ("score", "bucket") if c in pairs.columns], *[f"{c}_{s}" for c in context_cols for s in "ab"]]
    return out.select(*head, *[c for c in pairs.columns if c not in head])


def evaluation_set(candidates: DataFrame, df: DataFrame, name_col: str, context_cols: list[str], order_col: str, buckets: int = 7, per_bucket: int = 50, min_score: float = 0.3, max_score: float = 1.0, seed: int = 0) -> DataFrame:
    """Pairs to label: a sample of each score bucket with context."""
    sample = sample_per_bucket(score_buckets(candidates, min_score, max_score, buckets), per_bucket, seed=seed)
    return join_context(sample, df, name_col, context_cols, order_col)


def alias_rows(entities: DataFrame) -> DataFrame:
    """(entity_id, entity_type, is_primary, alias_type, name) of registered entities: their legal name, and their trading
    name where it differs. Entities without id or legal name have none."""
    row = lambda c, primary, kind: F.struct(
        F.col("uei").alias("entity_id"), F.lit("Entity").alias("entity_type"), F.lit(primary).alias("is_primary"), F.lit(kind).alias("alias_type"), F.col(c).alias("name")
    )
    dba = F.when((F.length("dba_name") > 0) & (F.col("dba_name") != F.col("legal_name")), row("dba_name", False, "DBA"))
    both = F.array_compact(F.array(row("legal_name", True, "PRIMARY"), dba))
    return entities.where("length(uei) > 0 and length(legal_name) > 0").select(F.explode(both).alias("r")).select("r.*")
