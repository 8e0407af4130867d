import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinfold.operators.packed import DIALECTS, split_packed

TOKEN = re.compile(r'"((?:[^"]|"")*)"|([^\W_]+)')


def brute(text):
    out = []
    for m in TOKEN.finditer(text or ""):
        v = m.group(1).replace('""', '"') if m.group().startswith('"') else m.group(2)
        if v:
            out.append(v)
    return out


def split(spark, texts, plain=r"[^\W_]"):
    df = spark.createDataFrame([(f"k{i}", t, "x") for i, t in enumerate(texts)], "uei string, codes string, field_name string")
    got = {}
    for r in split_packed(df, "uei", ["codes"], plain).collect():
        got.setdefault(r.uei, {})[r.pos] = r.value_text
    return [[v for _, v in sorted(got.get(f"k{i}", {}).items())] for i in range(len(texts))]


def test_dialects_of_the_field(spark):
    texts = [
        "719763, 282236N", "275308Y~271344Y~", "924666N", "", " ", "~", None, '"549500 retail|testing", 5', "A000~\"A000 \"\"repair\"\" hosting\"~3295",
        "(210965N | 891008, 569302 | 233731Y)", '["558410N"]', "1\n2 / 3|4", "  290155Y / 783115,\"622753N (retail, repair)\"~7 ", "V259~V259", "a,;b,;c",
    ]
    assert split(spark, texts) == [brute(t) for t in texts]


def test_open_quote_reads_plain_values(spark):
    assert split(spark, ['12,"34,56'])[0] == ["12", "34", "56"]


def test_very_long_field_and_ties(spark):
    long = "~".join(f"{i}Y" for i in range(20_000))
    got = split(spark, [long, "7", "7"])
    assert len(got[0]) == 20_000 and got[1] == got[2] == ["7"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "uei string, codes string")
    assert split_packed(df, "uei", ["codes"]).collect() == []


def test_consistent_delimiter_is_named(spark):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(["1Y~2N~3", "1Y~2N", "1Y,2N", "1Y 2N"])], "uei string, codes string")
    names = {(r.uei, r.dialect) for r in split_packed(df, "uei", ["codes"]).collect()}
    assert names == {("0", "~"), ("1", "~"), ("2", ","), ("3", "blank")}
    assert len({d.name for d in DIALECTS}) == len(DIALECTS)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["12Y", "99", "A1", '"a ""b"", c"', '"x|y"']), st.sampled_from(["~", ",", ";", "|", " ", ",;", "\t", "\n", ":", " / "])), min_size=1, max_size=6), min_size=1, max_size=20))
def test_against_brute_force(spark, fields):
    texts = ["".join(a + b for a, b in f) for f in fields]
    assert split(spark, texts) == [brute(t) for t in texts]


@pytest.mark.parametrize("columns", [["all_naics"], ["all_naics", "psc_codes"]])
def test_clashing_columns(spark, columns):
    df = spark.createDataFrame([("u", "1~2", "3", "p", "v")], "uei string, all_naics string, psc_codes string, pos string, value_text string")
    assert len(split_packed(df, "uei", columns).collect()) == len(columns) + 1


def test_description_length_decides(spark):
    """Nothing is known of the values: one delimiter throughout beats the cut at every hyphen, and known codes beat glued ones."""
    r = random.Random(2)
    codes = [f"{a}-{b}" for a in ("DK", "SE", "NO") for b in range(38, 48)]
    fields = [[r.choice(codes) for _ in range(4)] for _ in range(300)]
    assert split(spark, [";".join(f) for f in fields], None) == fields
    plain = [[str(100 + r.randrange(60)) for _ in range(r.randrange(1, 7))] for _ in range(900)]
    texts = ["".join(v + r.choice("~,;|:" if i % 9 == 0 else "~") for v in f)[:-1] for i, f in enumerate(plain)]
    assert split(spark, texts, None) == plain
    words = [[r.choice(["Bolt, steel", "Nut, brass", "Pin"]) for _ in range(3)] for _ in range(60)]
    assert split(spark, [" | ".join(w) for w in words], None) == words
