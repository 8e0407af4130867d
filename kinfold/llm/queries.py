"""Queries of this subpackage (p3, p4, p6 to p9) with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from kinfold.llm import chunking, components, leakage, lookalike, mixing, spelling
from kinfold.session import cut


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def p3_records(spark: SparkSession, sf: str) -> DataFrame:
    typed = read(spark, sf, "name_records").selectExpr("record_id as key", "name", "false as trusted")
    return typed.unionByName(read(spark, sf, "gleif").selectExpr("lei as key", "legal_name as name", "true as trusted"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.same_entity(p3_records(spark, sf))


def p3_members(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.members(p3_records(spark, sf))


def p4_forms(spark: SparkSession, sf: str) -> DataFrame:
    uk = {"uk_register.legal_name": "legal_name", "uk_register.legal_name_translit": "legal_name_translit"}
    long = lookalike.field_values(read(spark, sf, "uk_register"), "company_number", uk)
    return lookalike.with_canonical(long.unionByName(lookalike.field_values(read(spark, sf, "party_aliases"), "alias_key", {"party_aliases.name": "name"})))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.lookalike_pairs(p4_forms(spark, sf))


def p4_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return p4_forms(spark, sf).select("field_name", "key", "value", "canonical")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    linking = F.expr("score >= 0.85 and not isnan(score)")
    return components.groups(read(spark, sf, "match_pairs"), "name_a", "name_b", linking)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_items(read(spark, sf, "documents"), read(spark, sf, "eval_items"))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(read(spark, sf, "documents"), read(spark, sf, "mix_targets"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(p8_mix(spark, sf), read(spark, sf, "mix_targets"))


def p8_checks(spark: SparkSession, sf: str) -> DataFrame:
    """(plan, source, share_met, repeats_kept) of each target: is the source's share off by two of the mix's largest records at
    most, and is no record used more often than allowed?"""
    targets, m = read(spark, sf, "mix_targets"), cut(p8_mix(spark, sf))
    got = mixing.shares(m, targets).join(targets.select("plan", "source", "max_repeats"), ["plan", "source"])
    most = m.groupBy("plan").agg(F.max("n_tokens").alias("largest"))
    whole = "sum(tokens) over (partition by plan) * target_share / nullif(sum(if(tokens > 0, target_share, 0D)) over (partition by plan), 0)"
    out = got.join(most, "plan", "left").selectExpr("plan", "source", f"coalesce(abs(tokens - {whole}) <= 2 * largest, true) as share_met", "max_uses <= max_repeats as repeats_kept")
    return out.distinct()


def p9_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.split_documents(read(spark, sf, "documents"), read(spark, sf, "chunk_profiles"))


def p9_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """(profile, doc_id, n_chars, digest, kept): the text that a document's pieces give without what they share, and whether
    every piece keeps its limit, the pieces' order and the overlap."""
    profiles = read(spark, sf, "chunk_profiles")
    before = "lag(end_char) over (partition by profile, doc_id order by piece_no)"
    p = p9_pieces(spark, sf).selectExpr("*", f"coalesce({before}, 0) as upto").join(profiles.selectExpr("profile", "max_tokens", "overlap_tokens as wanted"), "profile")
    kept = F.expr("n_tokens <= max_tokens and start_char <= upto and end_char > upto and char_length(piece_text) = end_char - start_char and (piece_no = 1 or overlap_tokens >= wanted or overlap_tokens = 0)")
    fresh = F.struct("piece_no", F.expr("substring(piece_text, upto - start_char + 1)").alias("t"))  # the pieces of one document
    got = p.groupBy("profile", "doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(fresh)), lambda x: x["t"]), "").alias("text"), F.min(kept).alias("kept"))
    return got.select("profile", "doc_id", F.char_length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"), "kept")


QUERIES = {"p3_found": p3_found, "p3_members": p3_members, "p4_found": p4_found, "p4_canonical": p4_canonical, "p6_found": p6_found, "p7_found": p7_found, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_checks": p8_checks, "p9_pieces": p9_pieces, "p9_roundtrip": p9_roundtrip}


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _look_sql(c: str) -> str:
    one, several, unseen = lookalike.maps()
    out = f"translate({c}, {_text(''.join(one) + unseen)}, {_text(''.join(one.values()))})"
    # blanks of ASCII are in the map; letters that stand for several are replaced one after the other
    for x, y in several.items():
        if x in SEVERAL_IN_DATA:
            out = f"replace({out}, {_text(x)}, {_text(y)})"
    return out


#: The SQL spells out only those of the characters that stand for several.
SEVERAL_IN_DATA = "ﬀﬁﬂﬃﬄⅡⅢⅣⅥⅦⅧⅨⅪⅫ"
_P4_VALUES = f"""
WITH v AS (SELECT 'uk_register.legal_name' AS field_name, company_number AS key, legal_name AS value FROM uk_register
  UNION ALL SELECT 'uk_register.legal_name_translit', company_number, legal_name_translit FROM uk_register
  UNION ALL SELECT 'party_aliases.name', alias_key, name FROM party_aliases),
l AS (SELECT DISTINCT field_name, key, value, nfc_normalize({_look_sql('value')}) AS look FROM v WHERE value IS NOT NULL AND key IS NOT NULL)
"""
_P6 = """
WITH RECURSIVE l AS (SELECT DISTINCT name_a AS a, name_b AS b FROM match_pairs
  WHERE name_a IS NOT NULL AND name_b IS NOT NULL AND score >= 0.85 AND NOT isnan(score)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
n AS (SELECT DISTINCT x AS name FROM (SELECT name_a AS x FROM match_pairs UNION ALL SELECT name_b FROM match_pairs) t WHERE x IS NOT NULL),
r AS (SELECT name, name AS seen FROM n UNION SELECT r.name, e.b FROM r JOIN e ON e.a = r.seen)
SELECT min(seen) AS group_name, name FROM r GROUP BY name
"""
def _words_sql(c: str) -> str:
    """Words as leakage.normal_words defines them, in DuckDB's expressions."""
    t = rf"replace(lower({c}), '\-', '')"
    t = rf"regexp_replace({t}, '-[ \t]*\r?\n[\s%]*', '', 'g')"
    t = rf"regexp_replace({t}, '\\(?:(?:begin|end|label|eqref|ref|pageref|cite[a-z]*)\*?(?:\[[^\]{{}}]*\])*\{{[^{{}}]*\}}|[a-z@]+\*?)', ' ', 'g')"
    for _ in range(2):  # a digit may stand between two points
        t = rf"regexp_replace({t}, '(\d)[.,](\d)', '\1\2', 'g')"
    t = rf"regexp_replace(translate({t}, '‐‑’' || chr(173), ''), '[^\pL\pN_\s\x00-\x7F]+', ' ', 'g')"
    return rf"regexp_extract_all(translate({t}, '-''', ''), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"


_P7 = f"""
WITH d AS (SELECT doc_id, {_words_sql('text')} AS w FROM documents WHERE text <> ''), i AS (SELECT item_id, {_words_sql('passage')} AS w FROM eval_items),
p AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 11], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12) x),
r AS (SELECT doc_id, array_to_string(w[k : k + 11], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12) x)
SELECT DISTINCT doc_id, item_id FROM r JOIN p USING (run)
"""
SQL: dict[str, str] = {
    "p8_checks": "SELECT DISTINCT plan, source, true AS share_met, true AS repeats_kept FROM mix_targets",
    "p9_roundtrip": "SELECT profile, doc_id, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest, true AS kept FROM documents CROSS JOIN chunk_profiles WHERE text <> ''",
    "p7_found": _P7,
    "p4_found": _P4_VALUES
    + """SELECT DISTINCT a.field_name, a.key AS key_a, b.key AS key_b FROM l a JOIN l b
    ON a.field_name = b.field_name AND a.look = b.look AND a.key < b.key AND a.value <> b.value""",
    "p4_canonical": _P4_VALUES
    + f""", m AS (SELECT DISTINCT field_name, value, {_look_sql('value')} AS plain FROM v WHERE value IS NOT NULL),
    c AS (SELECT field_name, nfc_normalize(plain) AS look, arg_min(value, (value <> plain, strlen(value), value)) AS canonical FROM m GROUP BY 1, 2)
    SELECT v.field_name, v.key, v.value, c.canonical FROM v JOIN m ON m.field_name = v.field_name AND m.value = v.value
      JOIN c ON c.field_name = m.field_name AND c.look = nfc_normalize(m.plain)""",
    "p6_found": _P6,
}
