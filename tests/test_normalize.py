import duckdb
import pytest
from pyspark.sql import functions as F

from kinfold.functions import normalize as N
from kinfold.rules import DESCRIPTORS, HEAD_FORMS, LEGAL_FORMS

# Inputs and results that must hold.
GOLDEN = {
    "IBM Corp": "ibm", "Apple Inc.": "apple", "Procter & Gamble": "procter gamble", "Wal-Mart": "walmart", "McDonald's": "mcdonalds",
    "S.A.": "sa", "Smith, Jones & Co": "smith jones", "Acme (USA) Inc": "acme usa", "Import/Export": "impexp", "00 IBM": "ibm",
    "3M": "3m", "123 Textile Mfg": "123 textile mfg", "7-Eleven": "7eleven", "The Boeing Company Limited": "boeing",
    "The North Face": "the north face", "JSC ROSNEFT": "rosneft", "OOO X CORP": "x", "AKTSIONERNOE OBSHCHESTVO X": "x",
    "GMBH ACME": "acme", "Volvo AB": "volvo", "AB International": "ab intl", "BV Trading": "bv trd",
    "BIMLOGIC LIMITED LIABILITY COMPANY": "bimlogic", "Int Acme": "intl acme", "Acme Information Systems": "acme info systems",
    "S&P 500": "s p 500", "Black and Decker Ltd": "black decker", "Café": "cafe", "naïve": "naive", "": "", "   ": "", "?!": "", "A": "a",
    "LLC Inc Corp": "llc", "ZHEJIANG XYZ YOU XIAN ZE REN GONG SI": "zhejiang xyz", "XYZ GU FEN YOU XIAN GONG SI": "xyz", "XYZ RT": "xyz",
    "ELBRE OÜ": "elbre", "XYZ S.R.O.": "xyz", "XYZ UG (haftungsbeschränkt)": "xyz", "XYZ S.A R.L.": "xyz", "SAS & CO": "", "AND COMPANY LTD": "",
    "RGC GmbH & Co. KG": "rgc gmbh", "UTELIZ RESOURCES CO., LIMITED": "uteliz resources", "00": "00", "00 00 x": "00 x",
    "imports exports": "imp exp", "Łódź Œuvre ẞ": "lodz oeuvre", "ﬁnance Ⅱ": "finance ii", "日本": "", "# ACME": "acme", "Straße": "strasse",
}


def test_golden(spark):
    rows = spark.createDataFrame(list(GOLDEN.items()), "name string, want string").withColumn("got", N.normalize_name("name")).collect()
    assert {r.name: r.got for r in rows if r.got != r.want} == {}


def test_null_stays_null(spark):
    assert spark.createDataFrame([(None,)], "name string").select(N.normalize_name("name").alias("n")).head().n is None


def test_sql_function(spark):
    N.register(spark)
    odd = ["Oﬃce ﬁeld Ltd", "Louis Ⅲ Inc", "№ 5 Co GmbH", "ＡＢＣ ｆoo", "Æsir ẞ", "İstanbul ŞTİ", "a҈b é", "½ x", "㎏ y", "日本 ㍿", "ǅ z"]
    got = spark.createDataFrame([(k,) for k in [*GOLDEN, *odd]], "name string").select("name", F.expr("normalize_name(name)").alias("n"), N.normalize_name("name").alias("e")).collect()
    assert {r.name: r.n for r in got if r.n != GOLDEN.get(r.name, r.e)} == {}
    assert {r.name: r.n for r in got if r.name in odd[:3]} == {"Oﬃce ﬁeld Ltd": "office field", "Louis Ⅲ Inc": "louis iii", "№ 5 Co GmbH": "no 5"}
    letters = spark.createDataFrame([("q" + chr(c) + "r",) for c in range(1, 0x1FFFF, 3) if not 0xD800 <= c < 0xE000], "name string")
    assert letters.where(~F.expr("normalize_name(name)").eqNullSafe(N.normalize_name("name"))).count() == 0


def test_duckdb_agrees():
    c = duckdb.connect()
    c.execute("create table t(name varchar)")
    c.executemany("insert into t values (?)", [(k,) for k in GOLDEN])
    assert {a: b for a, b in c.execute(f"select name, {N.duckdb_normalize('name')} from t").fetchall() if b != GOLDEN[a]} == {}


@pytest.mark.parametrize("most,want", [(3, "caf"), (4, "caf"), (5, "cafe"), (100, "cafe s")])
def test_truncate_at_a_character(spark, most, want):
    got = spark.createDataFrame([("Café S",)], "name string").select(N.normalize_name(N.truncate_bytes("name", most)).alias("n")).head().n
    assert got == want


def test_every_form_leaves_a_word(spark):
    rows = spark.createDataFrame([(f,) for f in LEGAL_FORMS], "f string")
    got = rows.select("f", N.normalize_name(F.concat(F.lit("acme "), "f")).alias("tail"), N.normalize_name(F.concat("f", F.lit(" acme"))).alias("head")).collect()
    assert all(r.tail == "acme" for r in got)
    assert {r.f for r in got if r.head == "acme"} == set(HEAD_FORMS)
    assert len(LEGAL_FORMS) == 88 and len(HEAD_FORMS) == 65 and sum(map(len, DESCRIPTORS.values())) == 40


def test_marks_outside_letters(spark):
    got = spark.createDataFrame([("a҈b é",)], "name string").select(N.normalize_name("name").alias("n")).head().n
    assert got == "ab e"


def test_transliteration(spark):
    from kinfold.functions.translit import to_latin

    names = {"Газпром Компания": "Gazprom Kompania", "Ελλάδα": "Ellada", "Müller ß Ø": "Muller ss O", "plain / ASCII": "plain / ASCII", "": "", "ＡＢ⁠Ｃ\xa0d": "ABC d", "é": "e", None: None}
    rows = spark.createDataFrame([(k,) for k in names], "name string")
    assert {r.name: r.t for r in rows.select("name", to_latin(spark, "name").alias("t")).collect()} == names
    assert rows.limit(0).select(to_latin(spark, "name")).collect() == []
