"""One form for texts that look the same but are made of different characters.

Characters are mapped by what they look like: forms by width or joining to the plain letters, blanks of any kind to a
space, look-alike letters of other scripts to the Latin ones; characters without ink are dropped. Mapped values are then
grouped in SQL under the Unicode collation that tells accents and case apart (and takes composed and combining accents as
equal). Each class gets one canonical member, one that is its own mapped form if there is
one, else that of fewest bytes, then the smallest by code points, which is joined back.

Case, accents, spelling and digit against letter stay different. Null values have no form; a value without ink is its own
class with all such values. Repeated rows keep their form each; other columns are not looked at.
"""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.normalize import constant_map, let
from kinfold.session import cut

# Letters drawn like Latin ones, and the Latin ones. The list by hand comes first; the rest is generated from
# Unicode's table of confusable characters (ICU 77): all letters whose prototype is a single Latin letter, but those with
# compatibility forms, those of one script that share a prototype (told apart by that script's readers, as sigma and
# omicron are; Latin letters all are, dotless i too), dotless letters against i, and letters that may be I or l.
CONFUSABLE = {
    "АВЕЅІЈКМНОРСТУХҮԚԜӀ": "ABESIJKMHOPCTYXYQWI",  # Cyrillic capitals
    "аеорсухѕіјһԁԛԝүѵ": "aeopcyxsijhdqwyv",  # Cyrillic small letters
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ": "ABEZHIKMNOPTYXCJ",  # Greek capitals
    "ονρϲϳ": "ovpcj",  # Greek small letters
    "օսՍՕ": "ouUO",  # Armenian
    "ɡɑ‐‑": "ga--",  # other forms
    "𑜆": "v",  # Ahom
    "Տահցք": "Swhgf",  # Armenian
    "ꛟ": "V",  # Bamum
    "ᐯᑌᑭᑯᒍᒪᕼᖇᖴᗅᗰᗷ": "VUPdJLHRFAMB",  # Canadian
    "𐊠𐊡𐊢𐊥𐊫𐊰𐊱𐊲𐊴𐋏": "ABCFOMTYXH",  # Carian
    "ᎠᎢᎪᎫᎬᎷᎻᏂᏃᏏᏙᏞᏟᏢᏦᏧᏴꮁꮃꮓꮩꮪꮯ": "DTAJEMHhZbVLCPKdBrwzvsc",  # Cherokee
    "ⲅⲎⲒⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲨⲬⳐ": "rHIKMNOoPpCcTYXL",  # Coptic
    "ЬгѴԌ": "brVG",  # Cyrillic
    "𐐄𐐕𐐛𐐠𐐬𐐽𐑈": "OCLSocs",  # Deseret
    "𐔓𐔖𐔘𐔜𐔝𐔥𐔦𐔧": "NOKCVFLX",  # Elbasan
    "ሀዐ": "UO",  # Ethiopic
    "ყჿ": "yo",  # Georgian
    "αγυϜᴦ": "ayuFr",  # Greek
    "טס": "vo",  # Hebrew
    "ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ": "BPdDTGKJCZFMNLSRVHWXYAEIOU",  # Lisu
    "𐊂𐊆𐊇𐊐𐊒𐊕𐊖𐊗": "BEFXOPST",  # Lycian
    "ഠ": "o",  # Malayalam
    "𖼈𖼊𖼖𖼵𖼺𖽀𖽂𖽃": "VTLRSAUY",  # Miao
    "ဝ": "o",  # Myanmar
    "𐌁𐌂𐌉𐌑𐌕𐌗": "BCIMTX",  # Old
    "ଠ": "O",  # Oriya
    "𐒴𐓂𐓎𐓪𐓶": "ROUou",  # Osage
    "ᚷᛕᛖ": "XKM",  # Runic
    "ⴸⴹⵔⵕⵝ": "VEOQX",  # Tifinagh
    "𑢠𑢤𑢩𑢵𑢸𑢼𑣀𑣁𑣄𑣘𑣜": "VYZOUTvszuy",  # Warang
}
#: Kinds of compatibility characters that differ from the plain ones in width, joining or blank only.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>")
UNSEEN_FILLERS = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ"


def character_map() -> tuple[dict[str, str], dict[str, str], str]:
    """(one to one, one to several, unseen) over all of Unicode, from the rules above."""
    letters = {a: b for x, y in CONFUSABLE.items() for a, b in zip(x, y)}
    one, several, unseen = {}, {}, []
    for code in range(128, sys.maxunicode + 1):
        c = chr(code)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Co", "Cs"):
            continue
        if kind == "Cf" or c in UNSEEN_FILLERS or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF:
            unseen.append(c)
            continue
        if kind in ("Zs", "Zl", "Zp") or c == "\x85":
            one[c] = " "
            continue
        d = unicodedata.decomposition(c)
        to = c
        if d.startswith(SAME_LOOK) and kind[0] in "LNPS" and not d.startswith("<compat> 0020") and (kind[0] != "L" or d.count(" ") > 1 or not d.startswith("<compat>")):
            to = unicodedata.normalize("NFKC", c)
        # precomposed letters whose base looks Latin, then the letters themselves
        base = unicodedata.normalize("NFD", to)
        to = unicodedata.normalize("NFC", "".join(letters.get(x, x) for x in base))
        if to == c or unicodedata.normalize("NFC", c) == to:
            continue
        (one if len(to) == 1 else several)[c] = to
    one |= {c: " " for c in "\t\n\x0b\x0c\r"}
    return one, several, "".join(unseen)


_MAP = None


def maps() -> tuple[dict[str, str], dict[str, str], str]:
    global _MAP
    if _MAP is None:
        _MAP = character_map()
    return _MAP


def looks(text: Column) -> Column:
    """The text with every character mapped by its look. Texts of printable ASCII are left alone."""
    one, several, unseen = maps()
    table = constant_map(several)

    def opened(m: Column) -> Column:
        each = F.array_join(F.transform(F.split(m, ""), lambda c: F.coalesce(table[c], c)), "")
        return F.when(F.translate(m, "".join(several), "") != m, each).otherwise(m)

    mapped = let(F.translate(text, "".join(one) + unseen, "".join(one.values())), opened)
    return F.when(F.regexp_like(text, F.lit(r"[^\x20-\x7e]")), mapped).otherwise(text)


def canonical_values(values: DataFrame) -> DataFrame:
    """For distinct (field_name, value): (field_name, value, canonical, spellings of the class)."""
    mapped = cut(values.where("value is not null").select("field_name", "value").distinct().withColumn("look", looks(F.col("value"))))
    plainest = F.struct((F.col("value") != F.col("look")).alias("mapped"), F.octet_length("value").alias("bytes"), "value")
    # each look once: comparing under a collation is dear, so members meet their class again by the look's own bytes
    each = mapped.groupBy("field_name", "look").agg(F.min(plainest).alias("best"), F.count("*").alias("n"))
    equal = Window.partitionBy("field_name", F.collate("look", "UNICODE"))
    classes = each.select("field_name", "look", F.min("best").over(equal)["value"].alias("canonical"), F.sum("n").over(equal).alias("spellings"))
    return mapped.join(classes, ["field_name", "look"]).select("field_name", "value", "canonical", "spellings")


def field_values(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(field_name, key, value) for the columns of df named by fields (field_name -> column); a row per row and field with a
    value."""
    long = df.select(F.col(key).alias("key"), F.explode(F.array(*[F.struct(F.lit(n).alias("field_name"), F.col(c).alias("value")) for n, c in fields.items()])).alias("f"))
    return long.select("f.field_name", "key", "f.value").where("value is not null")


def with_canonical(long: DataFrame) -> DataFrame:
    """(field_name, key, value, canonical, spellings) from (field_name, key, value)."""
    return long.join(canonical_values(long), ["field_name", "value"]).select("field_name", "key", "value", "canonical", "spellings")


def canonical_form(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """with_canonical of the columns of one table."""
    return with_canonical(field_values(df, key, fields))


def lookalike_pairs(forms: DataFrame) -> DataFrame:
    """(field_name, key_a, key_b): rows of one class, with different keys, whose values aren't the same characters."""
    rows = cut(forms.where("spellings > 1 and key is not null").select("field_name", "canonical", "key", "value").distinct())
    a, b = (rows.selectExpr("field_name", "canonical", f"key as key_{s}", f"value as value_{s}") for s in "ab")
    pairs = a.join(b, ["field_name", "canonical"]).where("key_a < key_b and value_a <> value_b")
    return pairs.select("field_name", "key_a", "key_b").distinct()
