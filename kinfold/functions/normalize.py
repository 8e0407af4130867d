"""Name normalization as column expressions that stay in the JVM, and the same in DuckDB's SQL for checking.

Order of steps: compatibility decomposition and marks; letters that don't decompose; lower case of ASCII; '&' to 'and';
dropped punctuation; everything else a blank; leading zeros; a leading 'the' of four words or more; legal forms of several
words in one pass; legal forms off the end, then off the start, one word always left; descriptors. Null gives null; a name
without letters or digits gives the empty string.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from kinfold.rules import ATOMIC_LETTERS, COMPOUND_DESCRIPTORS, COMPOUND_FORMS, DESCRIPTORS, DROPPED_CHARACTERS, HEAD_FORMS, LEGAL_FORMS, phrases

def constant_map(table: dict[str, str]) -> Column:
    """A map of strings as two constants: few calls to build, and folded to a literal by the optimizer."""
    both = ["\x1f".join(x) for x in (table, table.values())]
    return F.map_from_arrays(*[F.split(F.lit(x), "\x1f") for x in both])


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once and standing once in the plan, however often body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


NON_ASCII = r"[^\x00-\x7f]"


@lru_cache(1)
def decompositions() -> tuple[dict[str, str], dict[str, str]]:
    """(one to one, one to several): characters whose compatibility decomposition without marks holds ASCII or a letter of
    ATOMIC_LETTERS. All others end as blanks whether decomposed or not, so they need no entry."""
    one, several = {}, {}
    for code in range(128, sys.maxunicode + 1):
        c = chr(code)
        if unicodedata.category(c)[0] in "CM":
            continue
        d = "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x)[0] != "M")
        d = "".join(ATOMIC_LETTERS.get(x, x) for x in d)
        if d == c or not any(x.isascii() for x in d):
            continue
        (one if len(d) == 1 else several)[c] = d
    return one, several


def fold_unicode(name: Column) -> Column:
    """Letters without marks, compatibility forms opened. ASCII names are left alone."""
    one, several = decompositions()
    table = constant_map(several)

    def each(m: Column) -> Column:
        opened = F.array_join(F.transform(F.split(m, ""), lambda c: F.coalesce(table[c], c)), "")
        # a hash lookup per character; a regular expression of so many characters takes thirty times as long
        return F.when(F.translate(m, "".join(several), "") != m, opened).otherwise(m)

    def fold(n: Column) -> Column:
        # a mark that stands alone is dropped; a precomposed letter whose base is none of ours ends as a blank anyway
        mapped = F.translate(F.regexp_replace(n, r"\p{M}+", ""), "".join(one), "".join(one.values()))
        return F.when(F.regexp_like(n, F.lit(NON_ASCII)), let(mapped, each)).otherwise(n)

    return let(name, fold)


def _tokens(s: Column, table: dict[str, list[str]]) -> Column:
    """Words and the table's phrases, replaced, in one pass from left to right."""
    names = phrases(table)
    pattern = "(?:" + "|".join(f"{p} " for p in names) + "|[^ ]+ )"
    lookup = constant_map(names)
    return F.transform(F.regexp_extract_all(F.concat(s, F.lit(" ")), F.lit(pattern), F.lit(0)), lambda t: F.coalesce(lookup[F.rtrim(t)], F.rtrim(t)))


def _phrases(s: Column, table: dict[str, list[str]]) -> Column:
    """Only names with a first word of a phrase pay for the pass."""
    first = "|".join(sorted({p.split()[0] for p in phrases(table)}))
    return let(s, lambda x: F.when(F.regexp_like(x, F.lit(rf"\b(?:{first}) ")), F.array_join(_tokens(x, table), " ")).otherwise(x))


def normalize_name(name: Column | str) -> Column:
    """The normalized form of a name: words of a-z and 0-9 with one blank between."""
    s = F.col(name) if isinstance(name, str) else name
    s = F.lower(fold_unicode(s))
    s = F.replace(s, F.lit("&"), F.lit(" and "))
    s = F.translate(s, DROPPED_CHARACTERS, "")
    s = F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))
    s = F.regexp_replace(s, "^0+ ", "")
    s = F.regexp_replace(s, "^the ((?:[^ ]+ ){2,}[^ ]+)$", "$1")
    s = _phrases(s, COMPOUND_FORMS)
    forms, heads = "|".join(LEGAL_FORMS), "|".join(HEAD_FORMS)
    s = F.regexp_replace(s, f"^([^ ]+(?: [^ ]+)*?)(?: (?:{forms}))+$", "$1")
    s = F.regexp_replace(s, f"^(?:(?:{heads}) )+", "")
    s = _phrases(s, COMPOUND_DESCRIPTORS)
    words = F.filter(_tokens(s, DESCRIPTORS), lambda t: t != "")
    return F.array_join(words, " ")


def truncate_bytes(name: Column | str, most: int) -> Column:
    """At most so many bytes of UTF-8; a character cut at the end normalizes to nothing."""
    s = F.col(name) if isinstance(name, str) else name
    cut = F.make_valid_utf8(F.substring(s.cast("binary"), 1, most).cast("string"))
    return F.when(F.octet_length(s) > most, cut).otherwise(s)


def comparison_form(norm: Column | str) -> Column:
    """A normalized name without blanks, so that glued and spaced spellings compare as equal."""
    return F.replace(F.col(norm) if isinstance(norm, str) else norm, F.lit(" "), F.lit(""))


def register(spark: SparkSession, function: str = "normalize_name") -> None:
    """For users of SQL: a temporary SQL function that equals normalize_name for every string."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {function}(name STRING) RETURNS STRING RETURN {_SparkText().normalize('name')}")


class _SparkText:
    """normalize_name as SQL text."""

    @staticmethod
    def quote(x: str) -> str:
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def opened(self, c: str) -> str:
        """fold_unicode: marks dropped, letters mapped one to one, then those that open to several."""
        one, several = decompositions()
        q, many = self.quote, "".join(several)
        table = f"map_from_arrays(split({q(chr(31).join(several))}, '\\u001f'), split({q(chr(31).join(several.values()))}, '\\u001f'))"
        each = f"array_join(transform(split(m, ''), x -> coalesce({table}[x], x)), '')"
        mapped = f"translate(regexp_replace({c}, '\\\\p{{M}}+', ''), {q(''.join(one))}, {q(''.join(one.values()))})"
        return f"transform(array({mapped}), m -> CASE WHEN translate(m, {q(many)}, '') <> m THEN {each} ELSE m END)[0]"

    def normalize(self, c: str) -> str:
        q = self.quote
        s = f"replace(lower({self.opened(c)}), '&', ' and ')"
        s = f"trim(regexp_replace(translate({s}, {q(DROPPED_CHARACTERS)}, ''), '[^a-z0-9]+', ' '))"
        s = f"regexp_replace(regexp_replace({s}, '^0+ ', ''), '^the ((?:[^ ]+ ){{2,}}[^ ]+)$', '$1')"
        s = self.tokens(s, COMPOUND_FORMS)
        s = f"regexp_replace(regexp_replace({s}, '^([^ ]+(?: [^ ]+)*?)(?: (?:{'|'.join(LEGAL_FORMS)}))+$', '$1'), '^(?:(?:{'|'.join(HEAD_FORMS)}) )+', '')"
        return self.tokens(self.tokens(s, COMPOUND_DESCRIPTORS), DESCRIPTORS)

    def tokens(self, s: str, table: dict[str, list[str]]) -> str:
        names = phrases(table)
        cases = " ".join(f"WHEN '{p}' THEN '{t}'" for p, t in names.items())
        pattern = "(?:" + "|".join(f"{p} " for p in names) + "|[^ ]+ )"
        return f"array_join(filter(transform(regexp_extract_all({s} || ' ', '{pattern}', 0), t -> CASE rtrim(t) {cases} ELSE rtrim(t) END), t -> t <> ''), ' ')"


def duckdb_normalize(c: str) -> str:
    """normalize_name as an expression of DuckDB."""

    def tokens(s: str, table: dict[str, list[str]]) -> str:
        names = phrases(table)
        cases = " ".join(f"WHEN '{p}' THEN '{t}'" for p, t in names.items())
        pattern = "(?:" + "|".join(f"{p} " for p in names) + "|[^ ]+ )"
        return f"array_to_string(list_filter(list_transform(regexp_extract_all({s} || ' ', '{pattern}'), lambda t: CASE rtrim(t) {cases} ELSE rtrim(t) END), lambda t: t <> ''), ' ')"

    q = lambda x: "'" + x.replace("'", "''") + "'"
    one, several = decompositions()
    s = f"translate(regexp_replace({c}, '\\pM+', '', 'g'), {q(''.join(one))}, {q(''.join(one.values()))})"
    for a, b in several.items():
        if a in ATOMIC_LETTERS or a in "ﬀﬁﬂﬃﬄⅡⅢⅣ":
            s = f"replace({s}, {q(a)}, {q(b)})"
    s = f"translate(replace(lower({s}), '&', ' and '), {q(DROPPED_CHARACTERS)}, '')"
    s = f"trim(regexp_replace({s}, '[^a-z0-9]+', ' ', 'g'))"
    s = f"regexp_replace({s}, '^0+ ', '')"
    s = rf"regexp_replace({s}, '^the ((?:[^ ]+ ){{2,}}[^ ]+)$', '\1')"
    s = tokens(s, COMPOUND_FORMS)
    s = rf"regexp_replace({s}, '^([^ ]+(?: [^ ]+)*?)(?: (?:{'|'.join(LEGAL_FORMS)}))+$', '\1')"
    s = f"regexp_replace({s}, '^(?:(?:{'|'.join(HEAD_FORMS)}) )+', '')"
    return tokens(tokens(s, COMPOUND_DESCRIPTORS), DESCRIPTORS)
