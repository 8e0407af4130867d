import random
from itertools import combinations, permutations

import pytest
from pyspark.sql import functions as F

from kinfold.llm import components, lookalike, spelling


# ---- components

def brute(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("parts,links", [(1, 10**6), (6, 10**6), (6, 20), (6, 3)])
def test_components(spark, parts, links):
    r = random.Random(parts)
    pairs = [(str(r.randrange(150)), str(r.randrange(150))) for _ in range(110)] + [(f"c{i}", f"c{i + 1}") for i in range(40)]
    df = spark.createDataFrame(pairs + pairs[:5] + [(None, "a"), ("a", None), ("z", "z")], "a string, b string").repartition(parts)
    got = {x.node: x.root for x in components.components(df, chunk_links=links).collect()}
    want = {k: v for k, v in brute(pairs).items() if k != v}
    assert got == want


def test_groups(spark):
    rows = [("b", "a", 0.9), ("b", "c", 0.85), ("c", "d", 0.84), ("e", "f", float("nan")), ("e", "e", 1.0), (None, "g", 1.0), ("h", None, None), ("ä", "Z", 1.0), ("a", "b", 0.1)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "x string, y string, score double, name string")
    got = {r.name: r.group_name for r in components.groups(df, "x", "y", F.expr("score >= 0.85 and not isnan(score)")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f", "g": "g", "h": "h", "ä": "Z", "Z": "Z"}
    assert components.groups(df.limit(0), "x", "y", F.lit(True)).collect() == []


# ---- look-alikes

SAME = ["Kultö Fårnen II", "Kulto\u0308\xa0Fa\u030arnen Ⅱ", "Ｋultö Fårnen II", "Кultö\u2009Fårn\u200ben II", "Kult\xf6 F\xe5rn\u0435n I\u0406"]
OTHERS = ["KULTÖ FÅRNEN II", "Kulto Fårnen II", "Kultö Fårnen 11", "Kultö Fårnen I I", "Kult0 Fårnen II", "Kultö Farnen ll"]


def test_lookalikes(spark):
    rows = [(f"s{i}", v) for i, v in enumerate(SAME)] + [(f"o{i}", v) for i, v in enumerate(OTHERS)] + [("n", None), ("s0", SAME[0]), ("t", SAME[0]), ("long", "ａ" * 100_000), ("long2", "a" * 100_000), (None, SAME[1])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "key string, name string, value string")
    forms = lookalike.canonical_form(df, "key", {"f": "name"})
    canon = {(r.key, r.value): r.canonical for r in forms.collect()}
    assert {canon[f"s{i}", v] for i, v in enumerate(SAME)} == {SAME[0]} and all(canon[f"o{i}", v] == v for i, v in enumerate(OTHERS))
    assert canon["long", "ａ" * 100_000] == "a" * 100_000
    got = {(r.key_a, r.key_b) for r in lookalike.lookalike_pairs(forms).collect()}
    keys = [(f"s{i}", v) for i, v in enumerate(SAME)] + [("t", SAME[0]), ("long", 1), ("long2", 2)]
    want = {tuple(sorted((a, b))) for (a, v), (b, w) in combinations(keys, 2) if v != w and a.startswith("l") == b.startswith("l")}
    assert got == want
    assert lookalike.lookalike_pairs(lookalike.canonical_form(df.limit(0), "key", {"f": "name"})).collect() == []


def test_maps_keep_visible_differences():
    one, several, unseen = lookalike.maps()
    assert not set("éöñßıłø№²½") & set(one) and all(k != v for k, v in one.items()) and "Ⅳ" in several and "\u200b" in unseen


def test_lookalikes_of_all_scripts(spark):
    rows = [("a", "Tasco AB"), ("b", "Ꭲasco AB"), ("c", "ꓔasco ꓮꓐ"), ("d", "Ⲧasⲥo AB"), ("e", "\U00010315asco AB"), ("x", "Tasco ꓮꓑ"), ("y", "Taσco AB"), ("z", "Taƨco AB"), ("n", "Tɑsco АԲ")]
    forms = lookalike.canonical_form(spark.createDataFrame(rows, "key string, name string"), "key", {"f": "name"})
    assert {(r.key_a, r.key_b) for r in lookalike.lookalike_pairs(forms).collect()} == set(combinations("abcde", 2))


# ---- spellings

def test_distance():
    d = spelling.distance
    assert (d("abc", "abc", 2), d("abc", "acb", 2), d("abc", "ab", 2), d("abc", "abcd", 2), d("abc", "xyz", 1), d("", "a", 2)) == (0, 1, 1, 1, 2, 1)


def test_names_are_read():
    assert spelling.read_name("Felmisur Kunful Engyneering A.B.")[:3] == ("felmisur kunful", "", "engineering")
    assert spelling.read_name("FDS Gilvanvan Relrin #3 S A") == ("gilvanvan relrin", "3", "foods", "", "", True)
    assert spelling.read_name("dr. etta gerrilgir y gurmur")[3] == "henrietta"
    assert spelling.read_name("H. Gerrilgir-Gurmur")[4] == "h"
    assert [spelling.read_name(x) for x in (None, "", "N/A", "?", "-", "  ")] == [None] * 6


GROUPS = [
    ["Felmisur Kunful Engineering AB", "FELMISUR KUNFUL ENGRG", "Felmisurkunful Engyneering AB", "Kunful Felmisur Engg. A.B.", "Fel misur Kunfull Engineering"],
    ["Felmisur Kunful Foods AB", "Felmsur Kunful Fds"],
    ["Gilvanvan Relrin 3 Technologies", "Gilvanvan Relrin #3 Tech, AB"],
    ["Gilvanvan Relrin 1 Technologies", "Relrin Gilvanvan No. 1 Tech AB"],
    ["Henrietta Gerrilgir Gurmur", "GERRILGIR-GURMUR, Hettie", "H. Gerrilgir-Grmur", "dr. etta gerrilgir y gurmur"],
    ["Nathaniel Gerrilgir Gurmur", "Gerrilgir Gurmur Nat"],
    ["Teginmon Serda Shipping Incorporated", "INCORPORATED SHIPPING TEGINMON SERDA", "Teginmon Serda, Inc."],
]


def test_entities(spark):
    rows = [(f"k{i}.{j}", n, j == 0, "clash") for i, g in enumerate(GROUPS) for j, n in enumerate(g)]
    rows += [("v1", "N/A", False, "x"), ("v2", "N/A", False, "x"), ("v3", None, False, "x"), ("k0.0", GROUPS[0][0], True, "y"), ("w", "x" * 50_000, False, "x"), ("amb", "Felmisur Kunful AB", False, "x")]
    df = spark.createDataFrame(rows, "key string, name string, trusted boolean, core string")
    got = {(r.key_a, r.key_b) for r in spelling.same_entity(df).collect()}
    want = {p for i, g in enumerate(GROUPS) for p in combinations([f"k{i}.{j}" for j in range(len(g))], 2)}
    assert got == want
    linked = {(r.key, r.group_key, r.links) for r in spelling.members(df).collect() if r.links}
    assert linked == {(f"k{i}.{j}", f"k{i}.0", len(g) - 1) for i, g in enumerate(GROUPS) for j in range(len(g))}
    assert spelling.same_entity(df.limit(0)).collect() == [] and spelling.members(df.limit(0)).collect() == []


@pytest.mark.parametrize("ahead", ["o", "obdfghjmnprs"])
def test_cores_behind_the_heaviest_of_their_keys_are_compared(spark, ahead):
    cores = [(f"{c}tol kelso", 99 - i, False) for i, c in enumerate(ahead)] + [("tola kelso", 2, False), ("tolu kelso", 1, False), ("mirgon feldan", 5, False)]
    got = {r.core: r.root for r in spelling.roots(spark.createDataFrame(cores, "core string, weight long, trusted boolean")).collect()}
    assert got == {c: "otol kelso" if c[1:].startswith("tol ") else "tola kelso" if c.startswith("tol") else c for c, *_ in cores}


LONG = "mirgon feldan kustor belvin zorpat nulgar".split()


def test_long_cores_get_the_optimal_assignment():
    typo = ["mirgn", *LONG[:0:-1]]
    assert spelling.align(LONG, typo) == 1 and spelling.align(LONG, [*LONG[:5], "other"]) is None
    assert spelling.align(LONG * 2, [*typo, *LONG]) == 1 and spelling.align(["mirgon feldan".replace(" ", ""), *LONG[2:]], LONG) == 0
    r = random.Random(1)
    for _ in range(200):
        costs = [[r.randrange(9) for _ in range(5)] for _ in range(5)]
        assert spelling.cheapest(costs) == min(sum(row[j] for row, j in zip(costs, p)) for p in permutations(range(5)))
    keys = lambda words: set(spelling.keys(words).tolist())
    for n in (3, 4, 5, 6, 7, 20, 256):
        words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}word" for i in range(n)]
        other = ["x" + words[0][1:], *words[:1:-1], words[1][:-1]]
        assert keys(words) & keys(other)
    assert keys([f"word{i}" for i in range(300)]) & keys([f"word{i}" for i in range(299, 0, -1)] + ["other"])


def test_entities_of_long_and_short_names(spark):
    seven = [*LONG, "tosdil"]
    groups = [["BP plc", "BP PLC", "bp"], ["BQ plc"], [" ".join(seven) + " AB", " ".join(seven[::-1]) + " AB", " ".join(["mirgn", *seven[1:]])]]
    groups += [[" ".join(w[::-1] for w in seven) + " AB", "Nogrim " + "".join(w[::-1] for w in seven[1:]) + " AB"]]
    groups += [["Kelsot Mardin Volpat Inc", "Mardin Kelsot Volpt Inc"], [" ".join(LONG[::-1][:5] + ["tamgir"]) + " Ltd", " ".join(["tamgr", *LONG[1:]]) + " Ltd"]]
    rows = [(f"k{i}.{j}", n, False) for i, g in enumerate(groups) for j, n in enumerate(g)]
    got = {(r.key_a, r.key_b) for r in spelling.same_entity(spark.createDataFrame(rows, "key string, name string, trusted boolean")).collect()}
    assert got == {p for i, g in enumerate(groups) for p in combinations([f"k{i}.{j}" for j in range(len(g))], 2)}


def test_chains_of_any_length_are_followed_to_their_root(spark, monkeypatch):
    monkeypatch.setattr(spelling, "neighbours", lambda cores: cores.where("n > 0").selectExpr("core", "cast(n - 1 as string) as center"))
    got = spelling.roots(spark.range(5000).selectExpr("cast(id as string) as core", "id as n"))
    assert got.count() == 5000 and [r.root for r in got.select("root").distinct().collect()] == ["0"]


def test_abbreviations_and_nicknames_off_the_lists(spark):
    a = spelling.align
    assert a(["fred", "olsen"], ["olsen", "frederik"]) == 2 and a(["kontoso", "labs"], ["kontoso", "laboratories"]) == 2
    assert a(["fabrikam", "aero"], ["aerospake", "fabrikam"]) == 2 and a(["j", "smith", "vidgets"], ["smith", "john", "vidgets"]) == 2
    assert a(["brdg", "kontoso"], ["kontoso", "bridge"]) == 2 and a(["kontoso", "mfk"], ["kontoso", "manufaktur"]) == 2
    assert a(["mirgon", "fel"], ["feldan", "mir"]) is None and a(["al", "bo"], ["alan", "bo"]) is None and a(["kontoso", "lab"], ["kontoso", "bal"]) is None
    groups = [["Fred Olsen", "Frederick Olsen", "OLSEN, FREDERICK"], ["Contoso Labs", "Contoso Laboratories Inc"], ["Fabrikam Aero", "Aerospace Fabrikam"]]
    groups += [["International Business Machines Corp", "Intl. Business Machines"], ["Business Machines Trading Corp"], ["Kelsot Mardin Paper Mills", "Kelsot Mardin Ppr", "Kelsot Mardin Mls Inc"]]
    rows = [(f"k{i}.{j}", n, False) for i, g in enumerate(groups) for j, n in enumerate(g)]
    got = {(r.key_a, r.key_b) for r in spelling.same_entity(spark.createDataFrame(rows, "key string, name string, trusted boolean")).collect()}
    assert got == {p for i, g in enumerate(groups) for p in combinations([f"k{i}.{j}" for j in range(len(g))], 2)}


@pytest.mark.parametrize("lists", [True, False])
def test_recall_of_the_candidates(lists, monkeypatch):
    """Of all pairs that the assignment accepts, most share a key, with the word lists and without them."""
    if not lists:
        monkeypatch.setattr(spelling, "_LEXICA", [spelling.Lexicon({}), spelling.Lexicon({})])
    import os

    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    names = {n for t, c in (("name_records", "name"), ("gleif", "legal_name")) for n in pq.read_table(f"{sf}/{t}.parquet", columns=[c]).column(c).to_pylist()}
    cores = sorted({r[0] for n in names if (r := spelling.read_name(n))})
    found = lost = 0
    index = [set(spelling.keys(c.split(" ")).tolist()) for c in cores]
    for i in range(0, len(cores), 50):
        for j in range(len(cores)):
            if i != j and spelling.align(cores[i].split(" "), cores[j].split(" ")) is not None:
                shared = bool(index[i] & index[j])
                found, lost = found + shared, lost + (not shared)
    assert found >= 0.9 * (found + lost) and found > 5
    print("candidates", lists, found, lost)
