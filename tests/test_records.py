import datetime

from kinfold.operators.records import failed_lines, parse_records, read_line, read_records, valid_records

GOOD = "ZQXXDZYGEL07|2V920|A|Darni Tosil Ltd|USA|19950309|19960308|541511"


def reason(line):
    got = read_line(line)
    return got and got[0]


def test_reasons():
    assert reason(GOOD) is None and read_line(GOOD)[3] == "ZQXXDZYGEL07"
    assert read_line("BOF PUBLIC V2") is None and read_line("!end") is None
    assert reason("!end ") == "column_count"
    cases = {
        GOOD.replace("Darni", '"Darni'): "quoting", GOOD.replace("Darni Tosil Ltd", '"Darni" Tosil'): "quoting", GOOD + '|"': "quoting",
        GOOD + "|": "column_count", "": "column_count", "a|b": "column_count",
        GOOD.replace("ZQXX", "ZQXI"): "uei", GOOD.replace("ZQXX", "zqxx"): "uei", GOOD.replace("ZQXX", " ZQX"): "uei",
        GOOD.replace("Darni Tosil Ltd", ""): "legal_name", GOOD.replace("Darni Tosil Ltd", "　 ​"): "legal_name",
        GOOD.replace("Darni", "D\x07"): "legal_name", GOOD.replace("Darni", "D�"): "legal_name", GOOD.replace("Darni", "D" * 112): "legal_name",
        GOOD.replace("19950309", "19950230"): "date", GOOD.replace("19960308", ""): "date", GOOD.replace("19960308", "1996030８"): "date",
    }
    assert {k: reason(k) for k in cases} == cases
    assert reason(GOOD.replace("Darni Tosil Ltd", "D" * 120)) is None


def test_quotes():
    ok = GOOD.replace("Darni Tosil Ltd", '"""Darni"" | Tosil"')
    assert read_line(ok)[6] == '"Darni" | Tosil'
    assert read_line(GOOD.replace("Darni", 'Dar"ni'))[6] == 'Dar"ni Tosil Ltd'
    assert read_line(GOOD.replace("541511", '""'))[-1] == ""


def test_errors_are_located_and_resume_at_an_anchor():
    broken = GOOD.replace("Darni Tosil Ltd", '"Darni" x') + GOOD
    got = read_line(broken)
    assert got[0] == "quoting" and broken[got[1]] == " " and broken[got[2] :] == "ZQXXDZYGEL07" + GOOD[12:] or got[2] is None


def test_table(spark):
    lines = [(1, "BOF x"), (2, GOOD), (2, GOOD), (3, None), (4, "x" * 1_000_000), (5, GOOD + "|"), (6, "!end")]
    df = spark.createDataFrame([(*x, "clash") for x in lines], "line_id int, raw_line string, reason string")
    assert sorted((r.line_id, r.reason) for r in failed_lines(df).collect()) == [(3, "column_count"), (4, "column_count"), (5, "column_count")]
    good = valid_records(df).collect()
    assert [r.line_id for r in good] == [2, 2] and good[0].initial_registration_date == datetime.date(1995, 3, 9)
    assert parse_records(df.limit(0)).count() == 0


def found(line):
    """Names of the records a failed line gives beside its error."""
    (reason, *_), *rest = read_records(line)
    assert reason in ("quoting", "column_count") and all(r[:3] == (None, None, None) for r in rest)
    return [r[6] for r in rest]


def named(name, end="541511"):
    return GOOD.replace("Darni Tosil Ltd", name).replace("541511", end)


def test_whole_records_of_a_failed_line_are_valid():
    for broken in (named('"Darni" x'), named('"Darni'), "ZQXBHXGZHA1H|WV920|E|Vipe Be", named("Darni", "541511|||"), named("D") + '|"'):
        line = broken + named("Second")
        assert found(line) == ["Second"] and line[read_line(line)[2] :] == named("Second")
        assert read_records(line)[1] == read_line(named("Second"))
        assert found(broken + named("Second") + named("Third", "")) == ["Second", "Third"]
        assert found(broken + named("Second") + named('"Third" x')) == ["Second"]
        assert found(broken + named('"Se|c""ond"', '"54"') + named("Third")) == ['Se|c"ond', "Third"]
        assert found(broken + named("Second", "") + named("Third")) == ["Second", "Third"]
        assert found(broken + named("Second").replace("19950309", "19950230")) == []
    assert found(GOOD + named("Second")) == ["Darni Tosil Ltd", "Second"]
    # no record: a uei in a column too many, or within closed quotes
    assert found(named("Second", "ZQXXDZYGEL08|541511")) == [] and found(named(f'"{GOOD}"', "1|2")) == []
    assert len(found("x" + GOOD * 20_000)) == 20_000


def test_table_has_the_recovered_records_beside_the_error(spark):
    df = spark.createDataFrame([(1, named('"Darni" x') + named("Second")), (2, GOOD)], "line_id long, raw_line string")
    assert sorted((r.line_id, r.legal_name) for r in valid_records(df).collect()) == [(1, "Second"), (2, "Darni Tosil Ltd")]
    assert [(r.line_id, r.reason) for r in failed_lines(df).collect()] == [(1, "quoting")]
