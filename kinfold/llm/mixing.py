"""Sources mixed to target shares of tokens by a low-discrepancy schedule.

The schedule is a row of slots, each of one block of a source. Slot n has the point frac(n * golden ratio), which cumulative
weights map to a source, so every stretch of the schedule has the target shares; a source's weight is its target share by
the tokens of its blocks. A source's slots are ranked; rank r takes block r mod (blocks of the source) in pass r div
blocks. A source's blocks are its records in an order shuffled by hash, cut at equal token counts: blocks of block_tokens
or less, and so many that a small source has MIN_BLOCKS or one for each record. The schedule ends where the first source
has used all records max_repeats times, so shares are met and no record is used more often. Records stay whole: a source
that ends within a pass is off by a block or its largest record at most.

Records without tokens (null, empty) and records of no planned source take no part; a source of a plan without records
gets no slots and share 0, and the others' targets are scaled up to 1. Repeated doc_ids are records of their own. All
prefix sums are two-level: sums by hash range first, then within a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm import tokens
from kinfold.session import cut

BLOCK_TOKENS = 8192
MIN_BLOCKS = 16
#: Hash ranges of a source and slots of a range of the schedule, for prefix sums.
RANGES, SLOT_RANGE = 4096, 1 << 16
SEED = 7
MAX_PLANNED = 10_000
GOLDEN = 0.6180339887498949  # fixed value: 1 / golden ratio


def token_sizes(documents: DataFrame, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of documents with a source and at least one token."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = tokens.load(vocabulary).count
        for b in batches:
            sizes = pa.array([count(t.as_py()) for t in b.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), sizes], ["doc_id", "source", "n_tokens"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text")
    texts = texts.where("source is not null and text is not null and text <> ''")
    return texts.mapInArrow(measure, "doc_id long, source string, n_tokens long").where("n_tokens > 0")


def shuffled_blocks(sizes: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """(source, doc_id, n_tokens, block_no, blocks, total): each source's records in shuffled order, cut into blocks of equal
    tokens. sizes is read twice."""
    h = sizes.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "source")).withColumn("r", F.pmod(F.shiftright("h", 40), F.lit(RANGES)).cast("int"))
    by_range = h.groupBy("source", "r").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k"))  # at most sources x RANGES rows
    ahead = by_range.selectExpr(
        "source", "r", "sum(t) over (partition by source order by r) - t as before", "sum(t) over (partition by source) as total", "sum(k) over (partition by source) as records"
    )
    placed = h.join(ahead, ["source", "r"]).selectExpr(
        "source", "doc_id", "n_tokens", "total", "records",
        "before + sum(n_tokens) over (partition by source, r order by h, doc_id, n_tokens rows unbounded preceding) - n_tokens as start",
    )
    blocks = f"greatest((total + {block_tokens - 1}) div {block_tokens}, least(records, {MIN_BLOCKS}L))"
    # tokens by blocks may pass 64 bits
    at = f"cast(cast(start as decimal(20, 0)) * ({blocks}) div total as long)"
    return placed.selectExpr("source", "doc_id", "n_tokens", f"{at} as block_no", f"{blocks} as blocks", "total")


def schedule(planned: list[dict], spark) -> DataFrame:
    """(plan, source, slot, use_no, block_no) from each plan's rows (plan, source, target_share, max_repeats, blocks, total)."""
    out = spark.createDataFrame([], "plan string, source string, slot long, use_no long, block_no long")
    for plan in sorted({p["plan"] for p in planned}):
        rows = sorted((p for p in planned if p["plan"] == plan and p["blocks"] and p["target_share"] > 0 and p["max_repeats"] > 0), key=lambda p: p["source"])
        weights = [p["target_share"] * p["blocks"] / p["total"] for p in rows]
        whole = sum(weights)
        if not rows:
            continue
        slots = int(min(p["blocks"] * p["max_repeats"] * whole / w for p, w in zip(rows, weights)))
        upto, source = 0.0, F.lit(None).cast("int")
        for k, w in enumerate(weights):
            upto += w / whole
            source = F.coalesce(source, F.when((F.col("point") < upto) if k < len(rows) - 1 else F.lit(True), F.lit(k)))
        s = spark.range(slots).withColumn("point", F.expr(f"(id * {GOLDEN!r}D) % 1D")).select("id", source.alias("k")).withColumn("c", F.expr(f"id div {SLOT_RANGE}"))
        sums = s.groupBy("k", "c").count().selectExpr("k", "c", "sum(count) over (partition by k order by c) - count as before")
        ranked = s.join(sums, ["k", "c"]).selectExpr("k", "id", "before + row_number() over (partition by k, c order by id) - 1 as rank")
        facts = F.create_map(*[x for k, p in enumerate(rows) for x in (F.lit(k), F.struct(F.lit(p["source"]).alias("source"), F.lit(p["blocks"]).alias("n"), F.lit(p["max_repeats"]).alias("m")))])
        ranked = ranked.withColumn("f", facts[F.col("k")])
        out = out.unionByName(
            ranked.where("rank < f.n * f.m").select(  # the points may run ahead of a share by a slot or two
                F.lit(plan).alias("plan"), F.col("f.source").alias("source"), F.col("id").alias("slot"), F.expr("cast(rank div f.n + 1 as long)").alias("use_no"), F.expr("cast(rank % f.n as long)").alias("block_no")
            )
        )
    return out


def mix(documents: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, vocabulary: str = tokens.VOCABULARY, seed: int = SEED) -> DataFrame:
    """One row per use of a record: (plan, slot, source, doc_id, use_no, n_tokens), slot being its place in the mix.

    targets: (plan, source, target_share, max_repeats), at most MAX_PLANNED rows; repeated rows count once."""
    spark = documents.sparkSession
    sizes = cut(token_sizes(documents, vocabulary))
    blocks = cut(shuffled_blocks(sizes, block_tokens, seed))
    planned = [r.asDict() for r in targets.select("plan", "source", "target_share", "max_repeats").where("source is not null and target_share is not null").distinct().limit(MAX_PLANNED + 1).collect()]
    if len(planned) > MAX_PLANNED:
        raise ValueError(f"more than {MAX_PLANNED} rows of targets")
    wanted = spark.createDataFrame([(s,) for s in sorted({p["source"] for p in planned})], "source string")
    counts = {r[0]: {"blocks": r[1], "total": r[2]} for r in blocks.join(wanted, "source", "left_semi").groupBy("source").agg(F.max("blocks"), F.max("total")).collect()}
    slots = schedule([p | counts.get(p["source"], {"blocks": None, "total": None}) for p in planned], spark)
    return slots.join(blocks, ["source", "block_no"]).select("plan", "slot", "source", "doc_id", "use_no", "n_tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(plan, source, target_share, actual_share, tokens, records, max_uses) of a mix, a row for each target."""
    got = mixed.groupBy("plan", "source", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("uses"))
    got = got.groupBy("plan", "source").agg(F.sum("t").alias("tokens"), F.count("*").alias("records"), F.max("uses").alias("max_uses"))
    wanted = targets.select("plan", "source", "target_share").distinct()
    out = wanted.join(got, ["plan", "source"], "left").na.fill(0, ["tokens", "records", "max_uses"])
    return out.selectExpr("plan", "source", "target_share", "coalesce(tokens / nullif(sum(tokens) over (partition by plan), 0), 0D) as actual_share", "tokens", "records", "max_uses")
