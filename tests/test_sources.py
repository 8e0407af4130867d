import gzip
import json
import zipfile

import pytest

from kinfold.operators import audit
from kinfold.plans import jobs
from kinfold.sources import readers, sinks
from kinfold.streaming import assign


def test_csv_in_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.csv", ' CompanyName , Number\n"Acme, Inc",007\nZeta,\n')
    got = readers.csv_selected(spark, str(tmp_path / "a.zip"), {"legal_name": "CompanyName", "number": "Number", "gone": "Missing"}, str(tmp_path))
    assert [tuple(r) for r in got.collect()] == [("Acme, Inc", "007", None), ("Zeta", None, None)]


def test_registration_extract(spark, tmp_path):
    row = ["U1", "", "", "C1", "", "A"] + [""] * 5 + ["Acme \"X\" Inc", "Dba"] + [""] * 129 + ["more"]
    (tmp_path / "x.dat").write_text("BOF PUBLIC\n" + "|".join(row) + "\nU2|||C2||E\n")
    got = readers.registration_extract(spark, str(tmp_path / "x.dat")).orderBy("uei").collect()
    assert [r.uei for r in got] == ["U1", "U2"] and got[0].legal_name == 'Acme "X" Inc' and got[1].legal_name is None
    assert readers.registration_extract(spark, str(tmp_path / "x.dat"), active_only=True).count() == 1


def test_sanctions_xml(spark, tmp_path):
    name = lambda primary, kind, *tr: f"<name><isPrimary>{primary}</isPrimary><aliasType>{kind}</aliasType><translations>{''.join(f'<translation><script>{s}</script><formattedFullName>{n}</formattedFullName></translation>' for s, n in tr)}</translations></name>"
    one = f'<entity id="7"><generalInfo><entityType>Entity</entityType></generalInfo><names>{name("true", "", ("Cyrillic", "ООО Дул"), ("Latin", "OOO Dul"))}{name("false", "A.K.A.", ("Arabic", "ab"))}{name("false", "", ("Latin", ""))}</names></entity>'
    (tmp_path / "s.xml").write_text(f"<list>{one}</list>")
    got = [tuple(r) for r in readers.sanctions_xml(spark, str(tmp_path / "s.xml")).collect()]
    assert got == [("7", "Entity", True, "PRIMARY", "OOO Dul"), ("7", "Entity", False, "A.K.A.", "ab")]


def test_entity_json(spark, tmp_path):
    rec = {"entityRegistration": {"ueiSAM": "U", "legalBusinessName": " Acme ", "dbaName": ""}, "assertions": {"goodsAndServices": {"naicsList": [{"naicsCode": "1"}, {"naicsCode": "2", "isPrimary": True}]}}}
    with gzip.open(tmp_path / "r.jsonl.gz", "wt") as f:
        f.write(json.dumps(rec) + "\n{}\n")
    got = readers.entity_api_json(spark, str(tmp_path / "r.jsonl.gz")).where("uei is not null").head()
    assert (got.legal_name, got.dba_name, got.primary_naics, got.naics_codes) == ("Acme", None, "2", ["1", "2"])


def test_partitions_resume_and_cache(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b/c", 3), (None, 4)], "k string, v long")
    path = str(tmp_path / "t")
    sinks.partitioned(df, path, "k")
    assert {r.k for r in sinks.existing_partitions(spark, path, "k").collect()} == {"a", "b/c"}
    sinks.partitioned(spark.createDataFrame([("a", 9), ("d", 5)], "k string, v long"), path, "k", skip_existing=True)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 2, 3, 5]
    calls = []
    make = lambda: calls.append(1) or df
    for rebuild in (False, False, True):
        assert sinks.cached(spark, str(tmp_path / "c"), make, rebuild).count() == 4
    assert len(calls) == 2


def test_helpers_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("Acme Inc",), ("acme",), ("日本",), ("",), (None,)], "name string")
    sinks.parquet(df, str(tmp_path / "p"))
    assert readers.has_column(spark, str(tmp_path / "p"), "name") and not readers.has_column(spark, str(tmp_path / "p"), "x")
    assert readers.latest(str(tmp_path / "p*")) == str(tmp_path / "p") and readers.latest(str(tmp_path / "q*")) is None
    sinks.report({"stats": audit.stats(df, "name")}, str(tmp_path / "r.json"), str(tmp_path / "r.md"))
    got = json.loads((tmp_path / "r.json").read_text())["stats"][0]
    assert (got["n_input"], got["n_empty"], got["n_changed"]) == (3, 1, 2) and "n_input" in (tmp_path / "r.md").read_text()
    sinks.csv(df.na.drop(), str(tmp_path / "csv"))
    assert readers.labels_csv(spark, str(tmp_path / "csv")).columns == ["name"]


def test_cluster_job(spark, tmp_path):
    df = spark.createDataFrame([(n, c) for c in ("US", "DE", None) for n in ("Acme Foods", "Acme Foods Inc", "Zeta", "Other Thing", None)], "vendor_name string, country_of_origin string")
    sinks.parquet(df, str(tmp_path / "in"))
    got = {r.block: r for r in jobs.cluster_job(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()}
    assert set(got) == {"US", "DE"} and got["US"].n_clusters == 3 and got["US"].n_null == 1
    jobs.cluster_job(spark, str(tmp_path / "in"), str(tmp_path / "out"), skip_existing=True)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_stream_of_arrivals(spark, tmp_path):
    known = spark.createDataFrame([("Acme Inc", 3, "acme"), ("Zeta", 4, "zeta")], "name string, cluster_id long, canonical_name string")
    sinks.parquet(assign.cluster_table(known), str(tmp_path / "known"))
    sinks.parquet(spark.createDataFrame([("ACME LLC",), ("new one",), (None,)], "name string"), str(tmp_path / "in"))
    q = assign.start(spark.readStream.schema("name string").parquet(str(tmp_path / "in")), str(tmp_path / "known"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination(60)
    assert {(r.name, r.cluster_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("ACME LLC", 3), ("new one", None), (None, None)}


def test_report_writes_all_rows_or_none(spark, tmp_path):
    paths = [str(tmp_path / "r.json"), str(tmp_path / "r.md")]
    with pytest.raises(ValueError, match="more than 100 rows in large"):
        sinks.report({"small": spark.range(1), "large": spark.range(101)}, *paths)
    assert not list(tmp_path.iterdir())
    sinks.report({"full": spark.range(100)}, *paths)
    assert len(json.loads((tmp_path / "r.json").read_text())["full"]) == 100


def test_evenly_spaced_rows_of_wide_tables(spark):
    from kinfold.operators import audit

    rows = spark.range(60_000).selectExpr("(id * 7919) % 60000 as n", "repeat(cast(id as string), 120) as wide", "id as __before")
    got = sorted(r.n for r in audit.evenly_spaced(rows, "n").collect())
    assert got == list(range(0, 60_000, 3000))
    assert audit.evenly_spaced(rows.limit(0), "n").collect() == []
    assert len(audit.evenly_spaced(rows.where("n < 7"), "n").collect()) == 7


def test_audit_reports(spark, tmp_path):
    import json

    from kinfold.operators import audit
    from kinfold.sources import sinks

    rows = [(1, "e1", "Vessel", "Acme Inc"), (2, "e1", "Vessel", "Acme LLC"), (3, "e2", "Entity", "?!"), (4, "e2", "Entity", "Big Steel Co"), (5, "e2", "Entity", "Steel Big"), (6, None, "Entity", None), (7, "e3", "Entity", "A")]
    df = spark.createDataFrame(rows, "row long, entity_id string, entity_type string, name string")
    sinks.report(audit.audit(df, "name", "row", "entity_id", "Entity"), str(tmp_path / "a.json"), str(tmp_path / "a.md"))
    got = json.loads((tmp_path / "a.json").read_text())
    assert got["counts"][0]["n_input"] == 4 and [x["raw"] for x in got["empty"]] == ["?!"] and [x["raw"] for x in got["one_character"]] == ["A"]
    assert got["alias_recall"][0]["total_pairs"] == 1 and {x["norm"] for x in got["apart"]} == {"big steel", "steel big"}
    assert {x["measure"]: (x["n"], x["n_null"], x["p50"]) for x in got["lengths"]} == {"chars": (3, 1, 9.0), "words": (3, 1, 2.0)}
    assert audit.alias_recall(df, "entity_id", "name").head().matching_pairs == 1
    empty = audit.audit(df.limit(0), "name", "row", "entity_id")
    assert empty["counts"].head().n_input == 0 and empty["changed"].collect() == []


def test_alias_rows_need_an_id_and_a_legal_name(spark):
    from kinfold.operators import audit

    rows = [("u", "A", "B"), ("u", "A", "A"), (None, "A", "B"), ("", "A", "B"), ("u", "", "B"), ("u", None, "B"), ("u", "A", None)]
    got = audit.alias_rows(spark.createDataFrame(rows, "uei string, legal_name string, dba_name string")).collect()
    assert sorted((r.entity_id, r.alias_type, r.name) for r in got) == [("u", "DBA", "B"), *[("u", "PRIMARY", "A")] * 3]


def test_missing_header_and_latest_file(spark, tmp_path):
    from kinfold.sources import readers

    for n in ("a-1.csv", "a-2.csv"):
        (tmp_path / n).write_text(" x ,y\n1,2\n")
    with pytest.warns(UserWarning, match="no column z"):
        assert readers.csv_selected(spark, readers.latest(f"file://{tmp_path}/a-*.csv", spark), {"x": "x", "z": "z"}).collect() == [("1", None)]
    assert readers.latest(f"file://{tmp_path}/b-*", spark) is None and readers.latest(f"{tmp_path}/a-*.csv").endswith("a-2.csv")


def test_scores_of_two_sequences(spark):
    from kinfold.operators import companions

    assert companions.score_labels(spark, [1, 1, None], ["a", "a", "b"])["adjusted_rand"] == 1
    assert companions.score_labels(spark, [], [])["n_items"] == 0
    with pytest.raises(ValueError):
        companions.score_labels(spark, [1], [1, 2])
