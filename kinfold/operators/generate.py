"""Synthetic variants of names with known entities, to measure a clustering.

A variant takes a number of edits from a binomial distribution, and that many different edits of the difficulty's menu.
An edit is a pattern of what it applies to and what it puts there; an edit without a place to apply leaves the name as it
is. Every entity has its own random numbers, so the table is the same for any number of tasks."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What edits put in and take out, how many there are of each name, and the edits of a difficulty.
SUFFIXES = "Inc LLC Ltd Limited Corp Corporation Co Company LLP LP PLC".split()
ABBREVIATIONS = {
    "International": "Intl", "Manufacturing": "Mfg", "Industries": "Ind", "Holdings": "Hldg", "Group": "Grp", "Services": "Svc", "Technology": "Tech",
    "Technologies": "Tech", "Trading": "Trd", "Solutions": "Sln", "Enterprises": "Ent", "Development": "Dev", "Associates": "Assoc", "Import": "Imp", "Export": "Exp",
}
PREFIXES = ["00 ", "000 ", "# ", "* ", "## "]
PLACES = ["USA", "America", "Global", "Worldwide", "International"]
EDITS_PER_NAME = {"easy": 0.6, "medium": 1.2, "hard": 2.0}
MOST_EDITS = 5
MENUS = {
    "easy": ["case", "comma", "other form", "no form"],
    "medium": ["case", "comma", "other form", "no form", "abbreviation", "prefix", "the", "accents"],
    "hard": ["case", "comma", "other form", "no form", "abbreviation", "prefix", "the", "accents", "typo", "word", "place", "letters"],
}

FORM = re.compile(rf"(?<=\S)\s+({'|'.join(SUFFIXES)})[.,]*\s*$", re.I)
BARE_FORM = re.compile(rf"(?<!,) ({'|'.join(SUFFIXES)})$")
SHORT_WORD = re.compile(r"(?<!\S)[.,]*([^\W\d_]{2,5})[.,]*(?!\S)")
INNER_WORD = re.compile(r"(?<=\S)\s+\S+(?=\s+\S)")

Random = np.random.Generator


def default_names(n: int = 52) -> list[str]:
    """A pool of invented company names by rule."""
    first = "North South Blue Green Silver Golden Summit River Harbor Pioneer Liberty Atlas Orion".split()
    second = "Bridge Ridge Field Stone".split()
    trade = "Manufacturing,Trading,Foods,Technologies,Holdings,Services,Import Export,Solutions,Industries,International Group,Development".split(",")
    return [f"{first[i % 13]} {second[i // 13 % 4]} {trade[i % 11]} {SUFFIXES[i % 11]}" for i in range(n)]


def one_of(r: Random, choices: list):
    return choices[r.integers(len(choices))]


def other_length(word: str) -> str | None:
    """The abbreviation of a word, or the word of an abbreviation; of words that share one, the last."""
    pairs = [(a.lower(), b) for long, short in ABBREVIATIONS.items() for a, b in ((long, short), (short, long))]
    return dict(pairs).get(word.lower())


def put(name: str, places: list[re.Match], what: Callable[[re.Match], str], r: Random) -> str:
    """name with one of the places filled anew."""
    if not places:
        return name
    m = one_of(r, places)
    return name[: m.start()] + what(m) + name[m.end() :]


def typo(name: str, r: Random) -> str:
    """A letter between the second and the last but one put in, left out, swapped with the next or replaced."""
    if len(name) < 4:
        return name
    at, letter = int(r.integers(2, len(name) - 1)), chr(97 + r.integers(26))
    here, behind = name[at], name[at + 1 :]
    return name[:at] + one_of(r, [letter + here + behind, behind, behind[:1] + here + behind[1:], letter + behind])


def comma(name: str, r: Random) -> str:
    """All commas taken out, one time in two; else one put before a legal form."""
    return name.replace(",", "") if "," in name and r.random() < 0.5 else BARE_FORM.sub(r", \1", name)


EDITS: dict[str, Callable[[str, Random], str]] = {
    "case": lambda s, r: one_of(r, [s.upper(), s.lower(), s.title()]),
    "comma": comma,
    "other form": lambda s, r: put(s, [*FORM.finditer(s)], lambda m: " " + one_of(r, [x for x in SUFFIXES if x.lower() != m[1].lower()]), r),
    "no form": lambda s, r: FORM.sub("", s),
    "abbreviation": lambda s, r: put(s, [m for m in re.finditer(r"\S+", s) if other_length(m[0].strip(".,;:"))], lambda m: other_length(m[0].strip(".,;:")), r),
    "prefix": lambda s, r: one_of(r, PREFIXES) + s,
    "the": lambda s, r: re.sub(r"^(?i:the) ", "", s) if s[:4].lower() == "the " else f"The {s}",
    "accents": lambda s, r: "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)),
    "typo": typo,
    "word": lambda s, r: put(s, [*INNER_WORD.finditer(s)], lambda m: "", r),
    "place": lambda s, r: f"{s} {one_of(r, PLACES)}",
    "letters": lambda s, r: put(s, [*SHORT_WORD.finditer(s)], lambda m: " ".join(m[1]), r),
}


def variant(name: str, difficulty: str, r: Random) -> str:
    menu = MENUS[difficulty]
    edits = min(MOST_EDITS, r.binomial(len(menu), min(1.0, EDITS_PER_NAME[difficulty] / len(menu))))
    out = name
    for k in r.permutation(len(menu))[:edits]:
        out = EDITS[menu[k]](out, r)
    return out if out.strip() else name


def generate_examples(spark: SparkSession, n_entities: int = 1000, variants_per_entity: tuple[int, int] = (1, 8), difficulty: str = "medium", seed: int = 0, canonicals: list[str] | None = None) -> DataFrame:
    """(variant_name, true_entity_id, true_canonical): for each entity its distinct variants, few being likelier than many.
    Entities beyond the pool's length take its names again with the number of the lap behind."""
    low, high = variants_per_entity
    pool = default_names() if canonicals is None else canonicals
    if difficulty not in MENUS:
        raise ValueError(f"difficulty must be one of {sorted(MENUS)}")
    if not 1 <= low <= high:
        raise ValueError("variants_per_entity must be (low, high) with 1 <= low <= high")
    if not pool:
        raise ValueError("canonicals is empty")
    weight = 1 / np.arange(1, high - low + 2)
    entity = F.expr("id div {n}".format(n=len(pool)))
    names = spark.createDataFrame(list(enumerate(pool)), "at long, pooled string")  # the caller's list, which the driver holds
    named = spark.range(n_entities).withColumn("at", F.expr(f"id % {len(pool)}")).join(F.broadcast(names), "at")
    named = named.select("id", F.when(entity == 0, F.col("pooled")).otherwise(F.concat_ws(" ", "pooled", entity.cast("string"))).alias("name"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                r = np.random.default_rng([seed & (1 << 64) - 1, i])
                k = low + int(r.choice(len(weight), p=weight / weight.sum()))
                rows += ((v, i, name) for v in sorted({variant(name, difficulty, r) for _ in range(k)}))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))], ["variant_name", "true_entity_id", "true_canonical"])

    return named.mapInArrow(make, "variant_name string, true_entity_id long, true_canonical string")
