"""Fields that hold several values: the dialect (delimiter and quote) of each field by minimum description length.

A field is written as  dialect + values. A dialect costs the bits of its choice: one delimiter of the list, or for the mixed
one a yes or no to each. A value costs its code, -log2 of its share among all values of the table, and its part of the
codebook, where every value is spelled out once, its characters by their own shares: a value seen n times pays an n-th.
So a reading that breaks a field into values known from other fields is cheap, and one that glues values together or cuts
them up is dear. Values are counted in distributed aggregates, first with each of a field's readings in equal parts, then
once more with the cheapest readings only; every field is then parsed with its cheapest dialect.

What is known of the values beforehand is a parameter: `plain` names the characters of values without quotes. It counts as
PLAIN_SEEN such characters read before the table, so another character costs log2 of that, no more.

Null fields and fields without values give no rows; empty places don't count; repeated values keep their own position.
A quote that is never closed is dropped and the rest of the field read as plain values.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.session import cut, release


@dataclass(frozen=True)
class Dialect:
    """values: a regular expression of values, quoted or not; delimiters: one of what parts them; bits: the choice."""

    name: str
    delimiters: re.Pattern | None
    values: re.Pattern
    bits: float


#: Delimiters that a field may use throughout. Blanks and brackets beside values are padding.
SINGLE = {"~": "~", ",": ",", ";": ";", "|": "|", ":": ":", "/": "/", "tab": r"\t", "newline": r"\n\r", "blank": " ", ",;": ",;"}
QUOTED = r'"(?:[^"]|"")*"'
PADDING = r"[\s\[\](){}]+"
DIALECTS = [Dialect(n, re.compile(f"[{d}]"), re.compile(rf'{QUOTED}|[^{d}"]+'), math.log2(len(SINGLE) + 1)) for n, d in SINGLE.items()] + [
    Dialect("mixed", None, re.compile(rf"{QUOTED}|[^\W_]+"), len(SINGLE) + 1.0)
]
#: The characters taken as seen before the table where `plain` is given.
PLAIN_SEEN = 1 << 20
_EDGES = re.compile(f"^{PADDING}|{PADDING}$")


def parse(text: str, d: Dialect) -> tuple[list[str], str]:
    """The values of a field under a dialect, quotes taken off, padding and empty places dropped; and the plain ones' text."""
    values, plain = [], []
    for m in d.values.findall(text):
        if m[0] == '"':
            v = m[1:-1].replace('""', '"')
        else:
            v = _EDGES.sub("", m)
            plain.append(v)
        if v:
            values.append(v)
    return values, "".join(plain)


def readings(text: str, plain: re.Pattern | None = None) -> list[tuple[int, float, list[str]]]:
    """(dialect, bits but for the values', values) of each reading that differs, by its cheapest dialect."""
    found: dict[tuple[str, ...], tuple[int, float]] = {}
    for k, d in enumerate(DIALECTS):
        if d.delimiters is None or d.delimiters.search(text):
            values, rest = parse(text, d)
            bits = d.bits + (len(plain.sub("", rest)) * math.log2(PLAIN_SEEN) if plain else 0.0)
            if bits < found.get(key := tuple(values), (0, math.inf))[1]:
                found[key] = k, bits
    return [(k, bits, list(values)) for values, (k, bits) in found.items()]


_READ = "key string, field_name string, readings array<struct<dialect: int, bits: double, parts: array<string>>>"
_READINGS = pa.list_(pa.struct([("dialect", pa.int32()), ("bits", pa.float64()), ("parts", pa.list_(pa.string()))]))


def _read(plain: str | None):
    known = re.compile(plain) if plain else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                got = [[{"dialect": k, "bits": x, "parts": v} for k, x, v in readings(t, known)] for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got, _READINGS)], ["key", "field_name", "readings"])

    return run


def _characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()
    for b in batches:
        for v in b.column(0).to_pylist():
            seen.update(v)
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["c", "n"])


def codes(values: DataFrame) -> DataFrame:
    """(value, code) in bits, from (value, n): its share and its part of the codebook; a value of no reading that counts
    has n = 0 and costs a new entry. Each value stands once."""
    entered = values.where("n > 0")
    total, entries = entered.agg(F.sum("n"), F.count("*")).head()
    total = max(total or 0.0, 1.0)
    # a row per character that is used: bounded by Unicode
    seen = dict(entered.select("value").mapInArrow(_characters, "c string, n long").groupBy("c").agg(F.sum("n").alias("n")).collect())
    every = sum(seen.values()) + entries  # the end of a value is a character too
    bits = {c: math.log2(every / n) for c, n in seen.items()}
    end, new = math.log2(every / entries) if entries else 0.0, math.log2(every + 1) + 1

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column(0).to_pylist(), b.column(1).to_pylist())
            out = [math.log2(total / (n or 1.0)) + (end + sum(bits.get(c, new) for c in v)) / max(n, 1.0) for v, n in pairs]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["value", "code"])

    return values.select("value", F.col("n").cast("double")).mapInArrow(code, "value string, code double")


def _cheapest(unsure: DataFrame, values: DataFrame) -> DataFrame:
    """(id, r): the reading of each field in doubt that takes fewest bits."""
    long = unsure.select("id", F.posexplode("readings").alias("r", "x")).select("id", "r", "x.bits", F.explode_outer("x.parts").alias("value"))
    bits = long.join(codes(values), "value", "left").groupBy("id", "r", "bits").agg(F.sum(F.coalesce("code", F.lit(0.0))).alias("code"))
    return bits.groupBy("id").agg(F.min_by("r", F.struct(F.round(F.col("bits") + F.col("code"), 6), "r")).alias("r"))


def _counts(values: DataFrame) -> DataFrame:
    """(value, n) from (value, share)."""
    return cut(values.groupBy("value").agg(F.sum("share").alias("n")))


def split_packed(df: DataFrame, key: str, fields: list[str], plain: str | None = None) -> DataFrame:
    """One row per value of the packed fields: (key, field_name, pos from 1, value_text, dialect). Rows of df that repeat
    a key and field give their rows again; other columns of df are not looked at. plain: what is known of values without
    quotes, as a regular expression of their characters."""
    long = df.select(F.col(key).cast("string").alias("key"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])).alias("f"))
    long = long.select("key", "f.*").where("text is not null")
    read = cut(long.mapInArrow(_read(plain), _READ).withColumn("id", F.monotonically_increasing_id()))
    unsure = read.where("size(readings) > 1").select("id", "readings")
    pick = None
    if not unsure.isEmpty():
        shared = read.selectExpr("inline(transform(readings, x -> struct(x.parts as parts, 1D / size(readings) as share)))")
        values = _counts(shared.select(F.explode("parts").alias("value"), "share"))
        first = cut(_cheapest(unsure, values))
        chosen = read.join(first, "id", "left").select(F.explode(F.expr("readings[coalesce(r, 0)].parts")).alias("value"), F.lit(1.0).alias("share"))
        again = _counts(chosen.unionByName(values.select("value", F.lit(0.0).alias("share"))))
        pick = cut(_cheapest(unsure, again))
        for t in (values, first, again):
            release(t)
    read = read.withColumn("r", F.lit(0)) if pick is None else read.join(pick, "id", "left")
    best = read.selectExpr("key", "field_name", "readings[coalesce(r, 0)] as b").select("key", "field_name", "b.dialect", F.posexplode("b.parts").alias("p", "value_text"))
    name = F.element_at(F.array(*[F.lit(d.name) for d in DIALECTS]), F.col("dialect") + 1)
    return best.select(F.col("key").alias(key), "field_name", (F.col("p") + 1).alias("pos"), "value_text", name.alias("dialect"))
