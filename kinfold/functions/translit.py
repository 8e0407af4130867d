"""Names of any script in Latin letters of ASCII, for audits. Clustering doesn't use it.

The table of characters comes from the ICU library that Spark brings along ("Any-Latin; Latin-ASCII"), so it needs no list
of our own; it is bounded by Unicode. Characters are mapped one by one, without regard to their neighbours; those that ICU
can't write in ASCII are dropped, marks too."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

RULES = "Any-Latin; Latin-ASCII"  # fixed value: the published names of ICU's transforms


@lru_cache(1)
def latin_table(spark: SparkSession) -> dict[int, str]:
    """Code point -> ASCII text, for all characters beyond ASCII."""
    codes = [c for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c))[0] in "LNPS"]
    icu = spark._jvm.com.ibm.icu.text.Transliterator.getInstance(RULES)
    lines = icu.transliterate("\n".join(map(chr, codes))).split("\n")
    table = {c: "".join(x for x in t if x.isascii()) for c, t in zip(codes, lines, strict=True)}
    for c in range(128, sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))
        if kind[0] == "Z":
            table[c] = " "
        elif kind[0] == "M" or kind == "Cf":
            table[c] = ""
    return table


def to_latin(spark: SparkSession, name: Column | str) -> Column:
    """The name in ASCII; null stays null."""
    table = spark.sparkContext.broadcast(latin_table(spark))

    @F.pandas_udf("string")
    def mapped(names: pd.Series) -> pd.Series:
        return names.map(lambda x: x if x is None or x.isascii() else x.translate(table.value))

    return mapped(F.col(name) if isinstance(name, str) else name)
